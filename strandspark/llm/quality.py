"""Quality rules: a hashed n-gram log-likelihood ratio between trusted target and raw corpus, in DataFrame functions only.

Words and word pairs of all documents fall into BUCKETS by hash. Their counts over the trusted documents (labelled of
quality) and over the whole corpus make two multinomials. A document's verdict is the mean over its n-grams of
log(p_target / p_corpus): below THRESHOLD it goes. Base rules on length and repetition come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpoint, keyed, real_id

BUCKETS = 1 << 16
PRIOR = 4.0
#: Mean nats an n-gram; clean text lies near 0 or above.
THRESHOLD = -0.2
LEAST_WORDS = 50


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _head(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def _tail(a: Column, skip: int = 1) -> Column:
    return F.slice(a, F.lit(1 + skip), F.greatest(F.size(a) - skip, F.lit(0)))


def with_hashes(rows: DataFrame) -> DataFrame:
    """Adds words, and hashes one, two of the words and pairs of neighbours. Each is a column before the next uses it."""
    rows = rows.withColumn("words", _words(F.col("text")))
    rows = rows.withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))
    return rows.withColumn("two", F.zip_with(_head(F.col("one")), _tail(F.col("one")), lambda a, b: F.xxhash64(a, b)))


def bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def ratios(docs: DataFrame, trusted: DataFrame) -> Column:
    """A constant array, log(p_target / p_corpus) by bucket, to six places. trusted: the doc_ids of the target.

    Each bucket gets PRIOR grams more of the target, and of the corpus as many as make the same share, so that what is rarely
    seen tells little.

    Always BUCKETS values, so it may travel with the plan; a subquery can't be used inside a higher-order function.
    """
    good = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("good", F.lit(1))
    # a sort-merge join at every size: labels grow with the documents
    rows = with_hashes(keyed(docs).join(good.hint("merge"), "doc_id", "left")).select("good", F.explode(F.concat("one", "two")).alias("h"))
    counts = rows.groupBy(bucket(F.col("h")).alias("bucket")).agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    dense = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = checkpoint(
        dense.join(counts, "bucket", "left").select(
            "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")
        ),
    )
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    # smoothing both multinomials leaves this; without trusted n-grams there is nothing to tell apart
    value = F.log((F.col("target") + PRIOR) / (F.col("raw") * (target / raw) + PRIOR)) if target else F.lit(0.0)
    values = [r[0] for r in counts.orderBy("bucket").select(F.round(value, 6)).collect()]  # BUCKETS values
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def verdicts(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio.

    Null and empty texts have no words and fail. Trusted ids that no document has, repeated ones and nulls don't
    matter; without any trusted document every ratio is 0 and the base rules decide. Repeated rows are judged alike, and each
    counts in the corpus. An empty table gives no rows; other columns are ignored.
    """
    ratio = ratios(docs, trusted)
    rows = with_hashes(keyed(docs))
    three = F.zip_with(_head(F.col("two")), _tail(F.col("one"), 2), lambda a, b: F.xxhash64(a, b))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    # one reference to the constant array: each is a copy in every task
    summed = lambda hashes: F.aggregate(hashes, F.lit(0.0), lambda s, h: s + F.get(ratio, bucket(h)))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        three.alias("three"),
        (summed(F.concat("one", "two")) / F.greatest(F.size("one") + F.size("two"), F.lit(1))).alias("ratio"),
    )
    # three-word windows found twice: neighbours in the order of (hash, place)
    twice = F.size(F.array_distinct("three")) < F.size("three")
    rows = rows.withColumn("placed", F.when(twice, F.sort_array(F.transform("three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.withColumn("same", F.zip_with(_head(F.col("placed")), _tail(F.col("placed")), lambda a, b: a["h"] == b["h"]))
    none = F.array(F.lit(False))
    found = F.zip_with(F.zip_with(F.concat("same", none), F.concat(none, "same"), lambda a, b: a | b), "placed", lambda s, p: F.when(s, p["i"]))
    rows = rows.withColumn("places", F.sort_array(F.filter(found, lambda p: p.isNotNull())))
    steps = F.zip_with(_head(F.col("places")), _tail(F.col("places")), lambda a, b: F.least(F.lit(3), b - a))
    repeated = F.when(F.col("places").isNotNull(), F.aggregate(steps, F.lit(3), lambda s, x: s + x)).otherwise(F.lit(0)).cast("long")
    rows = rows.select("*", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated.alias("n_repeat_words"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    kept = ~F.col("base_failed") & (F.col("ratio") >= threshold)
    return rows.select(real_id(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "ratio")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")
