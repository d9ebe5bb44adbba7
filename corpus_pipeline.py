"""A corpus pipeline of five stages, from documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandspark.llm import mixing, packing, secret_scan, simhash_dedup, toxicity
from strandspark.llm.common import checkpoint, documents
from strandspark.llm.queries import labels


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go; the others' rows stay as they are.

    Null and empty texts are judged by the bias alone, repeated rows alike; a null doc_id is never learnt from. No documents give none.
    """
    return toxicity.clean(docs, labels(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the least doc_id stays (null first, then by hashes of the text).

    Null and empty texts are one group; rows alike in doc_id and text are one document, of which any row stays. Columns may have any names. No documents give none.
    """
    return simhash_dedup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, however long; no document goes.

    A null text stays null, an empty one empty, repeated rows are masked alike; n_chars follows the text. No documents give none.
    """
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, not at all, once or twice.

    Null and empty texts have no words and are never taken; a null source is a source; rows alike share their copies evenly. No documents give none.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one: only the closing id. Repeated rows are packed each; only documents longer than a sequence are cut. No documents give no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Token ids and learnt scores are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what all stages leave of the documents, each stage checkpointed; stages' docstrings say what becomes of odd rows. Without documents there are no rows."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
