"""The exact distribution of a matrix's score under a Markov background, and scans that report ln p.

The background is counted from the sequences themselves: the chance of a base after the bases before it, up to `order` of them. The
distribution is a fold over the matrix's columns: rows (matrix, context, units, p) meet the column's scores and the chances of the next base,
and chances of equal context and score are added up. All matrices of a catalogue fold together. Scores are whole units of a
grain, so that equal scores are equal and a scan adds up to the same numbers in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import revcomp, windows
from .motif import scan
from .ordered import checkpoint

#: A power of two: matrices of quarters, eighths and so on stay as they are.
GRAIN = 2.0**-12


def background(seqs: DataFrame, order: int = 1, seq: str = "seq", both: bool = False) -> DataFrame:
    """context, base, p: how often each base follows up to `order` bases (contexts of all lengths from 0), at most 4^(order + 1) + ... + 4 rows.

    Counted over windows of order + 1 bases of ACGT in either case; both: on both strands. A shorter context's chances are those at the
    windows' beginnings. A context that never occurs is uniform.
    """
    found = windows(seqs.select(F.upper(seq).alias("seq")), order + 1).where(~F.col("w").rlike("[^ACGT]")).groupBy("w").agg(F.count("*").alias("n"))
    if both:
        found = found.unionByName(found.select(revcomp(F.col("w")).alias("w"), "n")).groupBy("w").agg(F.sum("n").alias("n"))
    prefix = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("_k")
    counts = found.select("n", prefix, "w").select(
        F.substring("w", F.lit(1), F.col("_k")).alias("context"), F.substring("w", F.col("_k") + 1, F.lit(1)).alias("base"), "n"
    )
    counts = counts.groupBy("context", "base").agg(F.sum("n").alias("n"))
    every = _words(seqs, order).withColumn("base", F.explode(F.array(*[F.lit(b) for b in "ACGT"])))
    total = F.sum("n").over(Window.partitionBy("context"))  # four rows
    rows = every.join(counts, ["context", "base"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("context", "base", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.25)).alias("p"))


def _words(df: DataFrame, most: int) -> DataFrame:
    """context: all words of up to most bases."""
    words = [""]
    level = [""]
    for _ in range(most):
        level = [w + b for w in level for b in "ACGT"]
        words += level
    return df.sparkSession.createDataFrame([(w,) for w in words], "context string")


def in_units(score: Column, grain: float = GRAIN) -> Column:
    return F.round(score / grain).cast("long")


def quantised(columns: list[dict[str, float]], grain: float = GRAIN) -> list[dict[str, float]]:
    """A literal matrix in units, as whole floating-point numbers: the sums are exact."""
    return [{b: float(round(v / grain)) for b, v in c.items()} for c in columns]


def catalogue(spark, matrices: dict[str, list[dict[str, float]]]) -> DataFrame:
    """matrix, pos, base, score of literal matrices."""
    rows = [(name, k, b, float(v)) for name, columns in matrices.items() for k, c in enumerate(columns) for b, v in c.items()]
    return spark.createDataFrame(rows, "matrix string, pos int, base string, score double")


def distribution(matrices: DataFrame, background: DataFrame, grain: float = GRAIN) -> DataFrame:
    """matrix, units, score, p, tail: the chance of each score that a word of the background can have, and of that or more.

    matrices: matrix, pos (from 0), base, score. A matrix has at most its scores' range / grain + 1 rows.
    """
    cells = checkpoint(matrices.select("matrix", "pos", "base", in_units(F.col("score"), grain).alias("add")))
    background = checkpoint(background)
    order = background.agg(F.max(F.length("context"))).first()[0] or 0
    width = (cells.agg(F.max("pos")).first()[0] or 0) + 1
    last = cells.groupBy("matrix").agg(F.max("pos").alias("last"))
    state = last.select("matrix", "last", F.lit("").alias("context"), F.lit(0).cast("long").alias("units"), F.lit(1.0).alias("p"))
    ended = None
    for k in range(width):
        step = state.join(cells.where(F.col("pos") == k).drop("pos"), "matrix").join(background.withColumnRenamed("p", "q").where("q > 0"), ["context", "base"])
        grown = F.concat("context", "base")
        context = F.substring(grown, F.greatest(F.length(grown) - order, F.lit(0)) + 1, F.lit(order)) if order else F.lit("")
        state = checkpoint(
            step.groupBy(
                "matrix", "last", context.alias("context"), (F.col("units") + F.col("add")).alias("units")
            ).agg(F.sum(F.col("p") * F.col("q")).alias("p")),
        )
        done = state.where(F.col("last") == k).groupBy("matrix", "units").agg(F.sum("p").alias("p"))
        ended = done if ended is None else ended.unionByName(done)
    above = Window.partitionBy("matrix").orderBy(F.col("units").desc())  # a matrix's scores; small chances are added first
    return ended.withColumn("tail", F.least(F.lit(1.0), F.sum("p").over(above))).select("matrix", "units", (F.col("units") * grain).alias("score"), "p", "tail")


def cutoffs(scores: DataFrame, p: float) -> DataFrame:
    """matrix, units, cutoff: the least score that a word of the background has with chance p or less, of distribution()'s rows; none where all are likelier."""
    found = scores.where(F.col("tail") <= p).groupBy("matrix").agg(F.min("units").alias("units"), F.min("score").alias("cutoff"))
    return found


def scan_with_p(
    seqs: DataFrame,
    columns: list[dict[str, float]],
    background: DataFrame,
    p: float | None = None,
    cutoff: float | None = None,
    seq: str = "seq",
    grain: float = GRAIN,
) -> DataFrame:
    """Other columns of seqs, pos, strand, score, ln_p: windows of either strand whose score has the chance p or less, and is the cutoff or more.

    ln_p: the natural logarithm of the chance that a word of the background scores as much. Scores are those of the matrix in units of grain.
    """
    spark = seqs.sparkSession
    scores = checkpoint(distribution(catalogue(spark, {"m": columns}), background, grain))
    least = float("-inf") if cutoff is None else float(cutoff) / grain
    if p is not None:
        found = cutoffs(scores, p).first()  # one matrix, one row
        least = max(least, float(found.units) if found else float("inf"))
    hits = scan(seqs, quantised(columns, grain), least, seq)
    tails = scores.select(F.col("units").cast("double").alias("score"), F.log("tail").alias("ln_p"))
    keep = [c for c in hits.columns if c != "score"]
    # a window of the sequences may have a chance of zero where the background is another's
    # few scores have all hits, so these are not dealt by score; a matrix has at most its scores' range / grain + 1 rows
    out = hits.join(F.broadcast(tails), "score", "left")
    return out.select(*keep, (F.col("score") * grain).alias("score"), F.coalesce("ln_p", F.lit(float("-inf"))).alias("ln_p"))
