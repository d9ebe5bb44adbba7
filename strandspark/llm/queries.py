"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from . import centroid_clustering, hamming_search, hard_negatives, mixing, packing, piece_encoding, quality, secret_scan, simhash_dedup, substring_dedup, suffix_dedup, toxicity, warc_fixity
from .common import documents


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def fixity(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc_fixity.audit(warc_fixity.index(warc_fixity.records(pages)), warc_fixity.damaged(pages))


QUERIES = {
    "op1_warc_fixity": fixity,
    "op2_substring_dedup": lambda spark, sf_dir: substring_dedup.dedup(documents(spark, sf_dir)),
    "op3_suffix_dedup": lambda spark, sf_dir: suffix_dedup.dedup(documents(spark, sf_dir)),
    "op4_secret_scan": lambda spark, sf_dir: secret_scan.find(documents(spark, sf_dir)),
    "op5_hamming_search": lambda spark, sf_dir: hamming_search.search(embeddings(spark, sf_dir)),
    "op6_mixing": lambda spark, sf_dir: mixing.mix(documents(spark, sf_dir)),
    "op7_toxicity": lambda spark, sf_dir: toxicity.score(documents(spark, sf_dir), labels(spark, sf_dir)),
    "op8_packing": lambda spark, sf_dir: packing.pack(documents(spark, sf_dir)),
    "op9_simhash": lambda spark, sf_dir: simhash_dedup.groups(documents(spark, sf_dir)),
    "op10_quality": lambda spark, sf_dir: quality.verdicts(documents(spark, sf_dir), quality.trusted_ids(labels(spark, sf_dir))),
    "op11_sentencepiece": lambda spark, sf_dir: piece_encoding.digests(documents(spark, sf_dir)),
    "op12_hard_negatives": lambda spark, sf_dir: hard_negatives.mine(hard_negatives.with_noise(embeddings(spark, sf_dir))),
    "op13_clustering": lambda spark, sf_dir: centroid_clustering.cluster(embeddings(spark, sf_dir)),
}

SQL: dict[str, str] = {
    "op1_warc_fixity": warc_fixity.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op3_suffix_dedup": suffix_dedup.SQL,
    "op5_hamming_search": hamming_search.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_clustering": centroid_clustering.SQL,
}
