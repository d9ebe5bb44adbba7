"""Permutation tests of many features at once, on one shared set of shuffled responses.

A round's shuffle is the order of a hash: the row whose hash has rank j gets the response of the row whose key has rank j. Hashes are even, so all rounds' rows
are dealt by the leading digits of their hashes; numbers of rows by digits tell at which rank each part begins, and the responses of about these ranks come with it.
Slopes of every feature against every shuffle are then one matrix product, features by rows times rows by rounds:
rows are cut into blocks and rounds into chunks, a task multiplies one block with one chunk, and partial sums are added up by
Spark. Neither a feature nor a round is one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .coverage import with_rank
from .ordered import checkpoint

#: Rows in a block and rounds in a chunk of the product.
BLOCK, CHUNK = 1024, 128
#: Coefficients of a rational fit of the complementary error function, of relative error under 1.2e-7; fixed values.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


#: Hashes of all rounds that are ranked at once, at most, about.
RANKED = 250_000


def _numbered(responses: DataFrame, key: str, y: str) -> DataFrame:
    """key, row (place by key, from 0), y of rows with both; checkpointed."""
    known = responses.where(F.col(key).isNotNull() & F.col(y).isNotNull()).select(key, F.col(y).cast("double").alias("y"))
    return checkpoint(with_rank(known, F.col(key), key, "row").withColumn("row", F.col("row") - 1))


def _ranked(hashes: pa.Table, known: pa.Table) -> pa.Table:
    """Responses of one part of the hashes: the rows of each block and chunk as arrays. known: at which rank the part begins in each round, and y by rank (round 0)."""
    rounds, rows = (hashes.column(c).to_numpy() for c in ("round", "row"))
    h = np.frombuffer(b"".join(hashes.column("h").to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((rows, h[:, 1], h[:, 0], rounds))
    rounds, rows = rounds[order], rows[order]
    given, at, y = (known.column(c).to_numpy() for c in ("round", "at", "y"))
    starts = np.zeros(int(rounds.max(initial=0)) + 1, np.int64)
    starts[given[given > 0]] = at[given > 0]
    rank = starts[rounds] + np.arange(len(rounds)) - np.searchsorted(rounds, rounds)
    by = np.argsort(at[given == 0])
    low, values = at[given == 0][by], y[given == 0][by]
    values = values[np.searchsorted(low, rank)]
    block, chunk = rows // BLOCK, rounds // CHUNK
    order = np.lexsort((chunk, block))
    block, chunk = block[order], chunk[order]
    new = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1])))) if len(block) else np.zeros(0, np.int64)
    ends = pa.array(np.append(new, len(block)), pa.int32())
    lists = (rows[order] % BLOCK, rounds[order] % CHUNK, values[order])
    lists = [pa.ListArray.from_arrays(ends, pa.array(v, k)) for v, k in zip(lists, (pa.int32(), pa.int32(), pa.float64()), strict=True)]
    return pa.table([pa.array(block[new], pa.int64()), pa.array(chunk[new], pa.int32()), *lists], names=["block", "chunk", "at", "place", "y"])


def _dealt(base: DataFrame, n: int, key: str, rounds: int, seed: int) -> DataFrame:
    """block, chunk, at, place, y (arrays): responses of all rounds, several rows a block and chunk. base: _numbered()'s n rows."""
    digits = 0
    while 16**digits * RANKED < n * rounds:
        digits += 1
    session = base.sparkSession
    wide = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    # few rows make many, so they are spread first
    draws = base.repartition(wide).select(key, "row", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    m = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string"), F.col(key).cast("string")))
    draws = draws.select("round", "row", m.alias("m"))
    draws = draws.select(F.conv(F.concat(F.lit("0"), F.substring("m", 1, digits)), 16, 10).cast("int").alias("part"), "round", "row", F.unhex("m").alias("h"))
    sizes = draws.groupBy("round", "part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("round").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpoint(sizes.select("part", "round", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("at"), "_n"))
    # the ranks that a part has in any round are nearly the same ones in all
    spans = starts.groupBy("part").agg(F.min("at").alias("_lo"), F.max(F.col("at") + F.col("_n") - 1).alias("_hi"))
    spans = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / BLOCK), F.floor(F.col("_hi") / BLOCK))))
    given = base.withColumn("_b", F.floor(F.col("row") / BLOCK)).join(spans, "_b").where(F.col("row").between(F.col("_lo"), F.col("_hi")))
    known = given.select("part", F.lit(0).alias("round"), F.col("row").alias("at"), "y").unionByName(
        starts.select("part", "round", "at", F.lit(0.0).alias("y"))
    )
    ranked = draws.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(
        _ranked, "block long, chunk int, at array<int>, place array<int>, y array<double>"
    )
    own = base.select(
        F.floor(F.col("row") / BLOCK).alias("block"),
        F.lit(0).alias("chunk"),
        F.array(F.pmod("row", F.lit(BLOCK)).cast("int")).alias("at"),
        F.array(F.lit(0)).alias("place"),
        F.array("y").alias("y"),
    )
    return own.unionByName(ranked)


def shuffled(responses: DataFrame, key: str, rounds: int, y: str = "y", seed: int = 1) -> DataFrame:
    """round (0: as they are, 1 to rounds: shuffled), key, row (place by key, from 0), y. Keys are unique; rows without a key or y take no part; reruns agree."""
    base = _numbered(responses, key, y)
    cells = _dealt(base, base.count(), key, rounds, seed).select("block", "chunk", F.explode(F.arrays_zip("at", "place", "y")).alias("c"))
    rows = cells.select((F.col("chunk") * CHUNK + F.col("c.place")).alias("round"), (F.col("block") * BLOCK + F.col("c.at")).alias("row"), "c.y")
    return rows.join(base.select(key, "row"), "row").select("round", key, "row", "y")


def _multiply(features: pa.Table, responses: pa.Table) -> pa.Table:
    """Sums of x times y for each feature of a block and each round of a chunk, and the block's sums of x and of its square."""
    names = features.column("feature").combine_chunks().dictionary_encode()
    x = np.zeros((len(names.dictionary), BLOCK))
    np.add.at(x, (names.indices.to_numpy(), features.column("at").to_numpy()), features.column("x").to_numpy())
    y = np.zeros((BLOCK, CHUNK))
    at, place, values = (responses.column(c).combine_chunks().flatten().to_numpy() for c in ("at", "place", "y"))
    y[at, place] = values
    sums = x @ y
    chunk = responses.column("chunk")[0].as_py() if responses.num_rows else 0
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * CHUNK, pa.int32()), pa.array(sums.ravel()))
    return pa.table(
        {"feature": names.dictionary, "chunk": pa.array(np.full(len(sums), chunk), pa.int32()), "sums": lists, "sx": x.sum(axis=1), "sxx": (x * x).sum(axis=1)}
    )


def slopes(profile: DataFrame, responses: DataFrame, feature: str, key: str, rounds: int = 1000, x: str = "x", y: str = "y", seed: int = 1) -> DataFrame:
    """feature, round, slope: the least-squares slope of y on x for every feature and round (0: the responses as they are).

    profile: feature, key and x, one row where x isn't 0 (repeated rows add up); responses: key and y, all rows. A feature without spread has null slopes.
    """
    base = _numbered(responses, key, y)
    n, mean = base.agg(F.count("*"), F.avg("y")).first()
    value = F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    cells = profile.select(F.col(feature).cast("string").alias("feature"), key, value.alias("x")).where("feature is not null").join(base.select(key, "row"), key)
    chunks = F.explode(F.sequence(F.lit(0), F.lit(rounds // CHUNK))).alias("chunk")
    place = [F.floor(F.col("row") / BLOCK).alias("block"), F.pmod("row", F.lit(BLOCK)).cast("int").alias("at")]
    left = cells.select(*place, "feature", "x").select("*", chunks)
    right = _dealt(base, n, key, rounds, seed)
    parts = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(
        _multiply, "feature string, chunk int, sums array<double>, sx double, sxx double"
    )
    each = parts.select("feature", "chunk", "sx", "sxx", F.posexplode("sums").alias("place", "s")).select(
        "feature", (F.col("chunk") * CHUNK + F.col("place")).alias("round"), "s", "sx", "sxx"
    ).where(F.col("round") <= rounds)
    # each round meets all of x once
    sums = each.groupBy("feature", "round").agg(F.sum("s").alias("sxy"), F.sum("sx").alias("sx"), F.sum("sxx").alias("sxx"))
    sxx = F.col("sxx") - F.col("sx") * F.col("sx") / n if n else F.lit(0.0)
    return sums.select("feature", "round", F.when(sxx > 1e-9 * F.col("sxx"), (F.col("sxy") - F.col("sx") * (mean or 0.0)) / sxx).alias("slope"))


def upper_tail(z: Column) -> Column:
    """P(N > z) of the normal distribution, of relative error under 1.2e-7."""
    a = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + a / 2)
    power = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        power = power * t + c
    half = t * F.exp(power - a * a) / 2
    return F.when(z < 0, 1 - half).otherwise(half)


def normality(n: Column, skewness: Column, kurtosis: Column) -> tuple[Column, Column, Column]:
    """Z of the skewness, Z of the kurtosis, and the chance of both squares' sum under chi-square of 2: the omnibus test of normality.

    skewness: m3 / m2^1.5; kurtosis: m4 / m2^2 - 3, as Spark's aggregates of these names give them. Null under 8 values or without spread.
    """
    n = n.cast("double")
    y = skewness * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w = F.sqrt(2 * (beta - 1)) - 1
    a = y / F.sqrt(2 / (w - 1))
    skew = F.log(F.abs(a) + F.sqrt(a * a + 1)) * F.signum(a) / F.sqrt(F.log(w) / 2)
    expected = 3 * (n - 1) / (n + 1)
    x = (kurtosis + 3 - expected) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    free = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    divisor = 1 + x * F.sqrt(2 / (free - 4))
    cube = F.signum(divisor) * F.pow((1 - 2 / free) / F.nullif(F.abs(divisor), F.lit(0.0)), F.lit(1 / 3))
    kurt = (1 - 2 / (9 * free) - cube) / F.sqrt(2 / (9 * free))
    enough = (n >= 8) & skewness.isNotNull() & ~F.isnan(skewness)
    skew, kurt = F.when(enough, skew), F.when(enough, kurt)
    return skew, kurt, F.exp((skew * skew + kurt * kurt) / -2)


def null_summary(lines: DataFrame) -> DataFrame:
    """feature, slope, p, q25, q50, q75, z_skewness, z_kurtosis, normal_p: of slopes()' rows, the observed slope against its null.

    p: two-sided, from a Gaussian kernel density of the shuffled slopes with Scott's bandwidth. normal_p: the omnibus test whether those slopes are normal. Moments
    merge, so that partial aggregation does the work; the exact quartiles hold a feature's rounds. Features without spread have nulls.
    """
    lines = checkpoint(lines)
    null = lines.where("round > 0 and slope is not null")
    of = null.groupBy("feature").agg(
        F.count("*").alias("n"), F.stddev_samp(
            "slope"
        ).alias("sd"), F.skewness("slope").alias("g1"), F.kurtosis("slope").alias("g2"), F.percentile("slope", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    )
    observed = lines.where("round = 0").select("feature", F.col("slope").alias("observed")).join(of, "feature", "left")
    width = F.greatest(F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)), F.lit(1e-300))
    z = (F.col("observed") - F.col("slope")) / width
    tails = null.join(observed.select("feature", "observed", "sd", "n"), "feature").groupBy("feature").agg(
        F.avg(upper_tail(z)).alias("above"), F.avg(upper_tail(-z)).alias("below")
    )
    skew, kurt, p = normality(F.col("n"), F.col("g1"), F.col("g2"))
    out = observed.join(tails, "feature", "left")
    return out.select(
        "feature",
        F.col("observed").alias("slope"),
        F.when(F.col("above").isNotNull(), F.least(F.lit(1.0), 2 * F.least("above", "below"))).alias("p"),
        *[F.get("q", F.lit(i)).alias(f"q{25 * (i + 1)}") for i in range(3)],
        skew.alias("z_skewness"),
        kurt.alias("z_kurtosis"),
        p.alias("normal_p"),
    )


def resampled_ratios(
    scores: DataFrame, key: list[str], replicates: int = 1000, one: str = "m1", two: str = "m2", joint: str = "joint", seed: int = 1
) -> DataFrame:
    """replicate, ratio: -2 log L(joint) + 2 (log L1 + log L2), for the rows' own sets (replicate 0) and for sets drawn anew.

    scores: set (1 or 2), the columns one, two and joint, and key, by which draws hash; in each replicate a row is of set 1 with the chance of set 1's share of all
    rows. All replicates are one aggregation that adds up before its shuffle, of a row a replicate and task. Rows alike in key are drawn alike; reruns agree.
    """
    first, n = scores.agg(F.count_if(F.col("set") == 1), F.count("*")).first()
    limit = f"{min(int(first / n * 2**32), 2**32 - 1) if n else 0:08x}"
    row = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    logs = scores.select(
        row.alias("_row"),
        (F.col("set") == 1).alias("_own"),
        (2 * F.log(one)).alias("_a"),
        (2 * F.log(two)).alias("_b"),
        (2 * F.log(joint)).alias("_j"),
    )
    each = logs.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("replicate"))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("_row"))) < F.lit(limit)
    is_one = F.when(F.col("replicate") == 0, F.col("_own")).otherwise(drawn)
    return each.groupBy("replicate").agg((F.sum(F.when(is_one, F.col("_a")).otherwise(F.col("_b"))) - F.sum("_j")).alias("ratio"))


def empirical(ratios: DataFrame) -> DataFrame:
    """One row of resampled_ratios()' rows: ratio (replicate 0), q25, q50, q75 of the others, and p, the share of all whose ratio is the own one or more."""
    own = F.max(F.when(F.col("replicate") == 0, F.col("ratio")))
    rows = ratios.withColumn("own", own.over(Window.partitionBy()))  # a row a replicate
    null = F.when(F.col("replicate") > 0, F.col("ratio"))
    quartiles = [F.percentile(null, F.lit(q)).alias(f"q{round(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return rows.groupBy().agg(F.max("own").alias("ratio"), *quartiles, (F.count_if(F.col("ratio") >= F.col("own")) / F.count("*")).alias("p"))
