"""Tag counts, normalization, extension and signal: sparse long form throughout, dense only at sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import interval_join
from .ordered import checkpoint, next_value, running_sum

STRAND_KEY = ["chr", "strand", "loc"]


def tag_counts(tags: DataFrame) -> DataFrame:
    """chr, strand, loc, n."""
    return tags.groupBy(*STRAND_KEY).agg(F.count("*").alias("n"))


def at_least(tags: DataFrame, mapq: int | None) -> DataFrame:
    """Tags of that mapping quality or more; None or 0 keeps all."""
    return tags.where(F.col("mapq") >= mapq) if mapq else tags


def first_tags(tags: DataFrame, mapq: int | None = None, line: str = "line") -> DataFrame:
    """One tag a position and strand: the first accepted, in the order of line, then of the other columns."""
    tags = at_least(tags, mapq)
    rest = [line, *[c for c in tags.columns if c not in (*STRAND_KEY, line)]]
    return tags.groupBy(*STRAND_KEY).agg(F.min(F.struct(*rest)).alias("_first")).select(*STRAND_KEY, "_first.*").select(*tags.columns)


def totals(tags: DataFrame, mapq: int | None = None) -> DataFrame:
    """One row: total, unique (positions), suppressed (tags beyond the first of a position), stored (after the quality cut)."""
    kept = F.col("mapq") >= mapq if mapq else F.lit(True)
    return tags.agg(
        F.count("*").alias("total"), F.count_distinct(*STRAND_KEY).alias("unique"), F.count_if(kept).alias("stored")
    ).select("total", "unique", (F.col("total") - F.col("unique")).alias("suppressed"), "stored")


def limit_tags(counts: DataFrame, limit: int = 3) -> DataFrame:
    return counts.withColumn("n", F.least("n", F.lit(limit)))


def normalize(counts: DataFrame, to: float = 1e6, total: float | None = None) -> DataFrame:
    """counts with norm: n scaled so that all together make `to`. total: that of another experiment instead of their own."""
    if total is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.withColumn("norm", F.col("n") * to / total if total else F.lit(0.0))


def normalize_files(signal: DataFrame, order: str, to: float = 1e6, cumulative: bool = True) -> DataFrame:
    """signal (order, chr, loc, val) with norm: by the total of its file and, if cumulative, of the files before it."""
    sums = signal.groupBy(order).agg(F.sum("val").alias("_t"))
    if cumulative:
        sums = sums.withColumn("_t", F.sum("_t").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))  # a row a file
    return signal.join(sums, order).withColumn("norm", F.col("val") * to / F.col("_t")).drop("_t")


def histogram(counts: DataFrame, genome: int | None = None) -> DataFrame:
    """bin, positions, share: positions by tag count, bins 0 to most - 1, the last closed on both sides; bin 0 from the genome's length."""
    most = counts.agg(F.max("n")).first()[0] or 0
    seen = counts.groupBy(F.least(F.col("n"), F.lit(max(most - 1, 0))).cast("long").alias("bin")).agg(F.count("*").alias("positions"))
    dense = counts.sparkSession.range(max(most, 1)).select(F.col("id").alias("bin")).join(seen, "bin", "left").fillna(0, ["positions"])
    if genome is not None:
        covered = counts.where("n > 0").count()
        dense = dense.withColumn("positions", F.when(F.col("bin") == 0, F.lit(genome - covered)).otherwise(F.col("positions")))
    return _shares(dense, "positions")


def _shares(rows: DataFrame, of: str) -> DataFrame:
    """rows with share: of a column's total, which one row carries."""
    total = rows.agg(F.sum(of).alias("_total"))
    return rows.join(F.broadcast(total)).withColumn("share", F.col(of) / F.col("_total")).drop("_total")  # one row


def extend(counts: DataFrame, ext: int, length: DataFrame | None = None) -> DataFrame:
    """chr, start, end, val: the signal of tags extended downstream by ext, run-length coded, without zeros.

    A plus tag at x covers x+1 to x+ext, a minus tag x-ext to x-1; below 0, and from the chromosome's length (chr, length) on, is
    cut off. Starts and ends become steps, their running sum the signal.
    """
    plus = F.col("strand") == "+"
    start = F.when(plus, F.col("loc") + 1).otherwise(F.greatest(F.col("loc") - ext, F.lit(0)))
    end = F.when(plus, F.col("loc") + ext + 1).otherwise(F.col("loc"))
    spans = counts.select("chr", start.alias("a"), end.alias("b"), "n")
    if length is not None:
        spans = spans.join(length, "chr").select("chr", "a", F.least("b", "length").alias("b"), "n")
    spans = spans.where("a < b")
    steps = spans.select(
        "chr",
        F.explode(
            F.array(F.struct(F.col("a").alias("pos"), F.col("n").alias("d")), F.struct(F.col("b").alias("pos"), (-F.col("n")).alias("d")))
        ).alias("s"),
    )
    # few steps share a position, so adding up before the shuffle would hold them all beside the counts' own groups
    n = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = steps.select("chr", "s.pos", "s.d").repartition(n, "chr", "pos").groupBy("chr", "pos").agg(F.sum("d").alias("d"))
    steps = checkpoint(steps.where("d != 0"))  # the running sum and the next position read them four times
    signal = running_sum(steps, ["chr"], [], "pos", F.col("d"), "val")
    signal = next_value(signal, ["chr"], "pos", "end")
    return signal.where("val != 0 and end is not null").select("chr", F.col("pos").alias("start"), "end", "val")


def shift_bins(counts: DataFrame, shift: int, width: int) -> DataFrame:
    """chr, bin, val: tags shifted downstream by shift, summed in windows of width named by their start; windows before 0 go."""
    plus = F.floor((F.col("loc") + shift) / width) * width
    minus = (F.floor((F.col("loc") - shift) / width) + 1) * width
    rows = counts.withColumn("bin", F.when(F.col("strand") == "+", plus).otherwise(minus).cast("long"))
    return rows.where("bin >= 0").groupBy("chr", "bin").agg(F.sum("n").alias("val"))


def shift_windows(counts: DataFrame, shift: int, width: int) -> DataFrame:
    """chr, bin, val: at each multiple x of width, plus tags in (x - shift, x] and minus tags in [x, x + shift)."""
    plus = F.col("strand") == "+"
    low = F.when(plus, F.col("loc")).otherwise(F.greatest(F.lit(0), F.col("loc") - shift + 1))
    high = F.when(plus, F.col("loc") + shift - 1).otherwise(F.col("loc"))
    first, last = F.ceil(low / width), F.floor(high / width)
    bins = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return counts.withColumn("_k", F.explode(bins)).groupBy("chr", (F.col("_k") * width).alias("bin")).agg(F.sum("n").alias("val"))


def spread_bins(bins: DataFrame, ext: int) -> DataFrame:
    """chr, bin, val: each bin's value in bins bin - ext to bin + ext - 1, without negative ones. bin: its number."""
    reach = F.sequence(F.greatest(F.col("bin") - ext, F.lit(0)), F.col("bin") + ext - 1)
    return bins.select("chr", F.explode(reach).alias("bin"), "val").groupBy("chr", "bin").agg(F.sum("val").alias("val"))


def binned(counts: DataFrame, step: int) -> DataFrame:
    """chr, start, val: sums in steps of `step`."""
    return counts.groupBy("chr", (F.floor(F.col("loc") / step) * step).cast("long").alias("start")).agg(F.sum("n").alias("val"))


def wig_means(counts: DataFrame, span: int) -> DataFrame:
    """chr, start, val: sums / span in spans from position 1 on; position 0 is left out, a short last span still divides by span."""
    return counts.where("loc >= 1").groupBy(
        "chr", (F.floor((F.col("loc") - 1) / span) * span + 1).cast("long").alias("start")
    ).agg((F.sum("n") / span).alias("val"))


def smooth(bins: DataFrame, steps: int = 5, step: int = 1) -> DataFrame:
    """bins (chr, start, val) with smooth: the mean of `steps` neighbouring steps, the nearest value standing in past the edges; bins without a row count 0. Chromosomes of no more bins than that keep their values."""
    half = steps // 2
    rows = bins.select("chr", "start", F.floor(F.col("start") / step).alias("k"), "val")
    ends = rows.groupBy("chr").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.min_by("val", "k").alias("first"), F.max_by("val", "k").alias("last"))
    near = rows.withColumn(
        "d", F.explode(F.sequence(F.lit(-half), F.lit(half)))
    ).groupBy("chr", (F.col("k") + F.col("d")).alias("k")).agg(F.sum("val").alias("around"))
    out = rows.join(near, ["chr", "k"]).join(ends, "chr")
    pad = F.greatest(F.lit(0), F.col("lo") - F.col("k") + half) * F.col("first") + F.greatest(F.lit(0), F.col("k") + half - F.col("hi")) * F.col("last")
    mean = (F.col("around") + pad) / (2 * half + 1)
    return out.select("chr", "start", "val", F.when(F.col("hi") - F.col("lo") + 1 > steps, mean).otherwise(F.col("val").cast("double")).alias("smooth"))


def _joined_signal(peaks: DataFrame, points: DataFrame, key: str, on) -> DataFrame:
    """Pairs of peaks and points (chr, loc, values), in bins about as wide as a peak is long."""
    length = peaks.agg(F.avg(F.abs(F.col("e") - F.col("s")))).first()[0] or 0
    width = max(64, 1 << int(length).bit_length())
    return interval_join(peaks.select(key, "chr", "s", "e"), points.withColumns({"s": F.col("loc"), "e": F.col("loc")}), on, width=width)


def peak_means(peaks: DataFrame, experiments: dict[str, DataFrame], key: str = "pid", value: str = "n") -> DataFrame:
    """peaks with total_, most_ and mean_ of each experiment: its signal in the peak's [s, e), 0 where there's none; mean is total / length, 0 for no length. One join serves all."""
    tagged = None
    for name, counts in experiments.items():
        rows = counts.select(F.lit(name).alias("_x"), "chr", "loc", F.col(value).alias("_v"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    # one row a position: of each experiment its sum there
    points = tagged.groupBy("chr", "loc").agg(*[F.sum(F.when(F.col("_x") == name, F.col("_v"))).alias(f"v_{name}") for name in experiments])
    inside = _joined_signal(peaks, points, key, lambda: (F.col("r_s") >= F.col("l_s")) & (F.col("r_s") < F.col("l_e")))
    each = [f(f"r_v_{n}").alias(f"{c}_{n}") for n in experiments for c, f in (("total", F.sum), ("most", F.max))]
    sums = inside.groupBy(F.col(f"l_{key}").alias(key)).agg(*each)
    length = F.col("e") - F.col("s")
    out = peaks.join(sums, key, "left").withColumns({f"{c}_{n}": F.coalesce(f"{c}_{n}", F.lit(0)) for n in experiments for c in ("total", "most")})
    return out.withColumns({f"mean_{n}": F.when(length > 0, F.col(f"total_{n}") / length).otherwise(F.lit(0.0)) for n in experiments})


def peak_signal(peaks: DataFrame, counts: DataFrame, key: str = "pid", value: str = "n") -> DataFrame:
    """key, total, most, mean: the signal in each peak's [s, e), 0 where there's none; mean is total / length, 0 for no length."""
    return peak_means(peaks, {"x": counts}, key, value).select(key, *[F.col(f"{c}_x").alias(c) for c in ("total", "most", "mean")])


def enrichment(peaks: DataFrame, experiments: dict[str, DataFrame], reference: str, key: str = "pid") -> DataFrame:
    """key, a mean column for each experiment, and rank by the reference's, from 1, most first."""
    out = peak_means(peaks, experiments, key).select(key, *[F.col(f"mean_{n}").alias(n) for n in experiments])
    return with_rank(out, F.col(reference).desc(), key)


def with_rank(rows: DataFrame, by, key: str, name: str = "rank") -> DataFrame:
    """rows with their place in a global order, from 1: a range-partitioned sort, then places within partitions on top of the sizes before.

    The ranges are drawn from a sample, so they are checkpointed before they are used twice.
    """
    ranged = checkpoint(rows.repartitionByRange(by, F.col(key)).withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(by, key)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")  # a row a partition


def _both_means(peaks: DataFrame, x: DataFrame, y: DataFrame, key: str) -> DataFrame:
    return peak_means(peaks, {"x": x, "y": y}, key).select(key, F.col("mean_x").alias("x"), F.col("mean_y").alias("y"))


def difference_rank(peaks: DataFrame, x: DataFrame, y: DataFrame, relative: bool = False, absolute: bool = False, key: str = "pid") -> DataFrame:
    """key, diff, rank: mean signal of x less that of y, over x if relative; peaks with neither are left out."""
    both = _both_means(peaks, x, y, key).where("x != 0 or y != 0")
    diff = F.col("x") - F.col("y")
    diff = F.when(F.col("x") != 0, diff / F.col("x")).otherwise(F.lit(0.0)) if relative else diff
    return with_rank(both.select(key, (F.abs(diff) if absolute else diff).alias("diff")), F.col("diff").desc(), key)


def input_ratio(peaks: DataFrame, sample: DataFrame, control: DataFrame, key: str = "pid") -> DataFrame:
    """key, diff, ratio: sums over [s, e] less the control's; ratio is the plain sum where the control has none. Regions with fewer than two samples are left out."""
    def sums(counts: DataFrame, name: str) -> DataFrame:
        points = counts.groupBy("chr", "loc").agg(F.sum("n").alias("v"))
        inside = _joined_signal(peaks, points, key, lambda: F.col("r_s").between(F.col("l_s"), F.col("l_e")))
        return inside.groupBy(F.col(f"l_{key}").alias(key)).agg(F.sum("r_v").alias(name), F.count("*").alias(f"n_{name}"))

    both = sums(sample, "a").where("n_a >= 2").join(sums(control, "b"), key, "left").fillna(0, ["b"])
    return both.select(
        key,
        (F.col("a") - F.col("b")).alias("diff"),
        F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(F.col("a").cast("double")).alias("ratio"),
    )


def region_profile(counts: DataFrame, chrom, start: int, end: int) -> DataFrame:
    """loc, val, rel: the signal in [start, end) and its share of the region's most."""
    rows = counts.where((F.col("chr") == chrom) & (F.col("loc") >= start) & (F.col("loc") < end)).groupBy("loc").agg(F.sum("n").alias("val"))
    most = rows.agg(F.max("val").alias("_most"))
    return rows.join(F.broadcast(most)).withColumn("rel", F.col("val") / F.col("_most")).drop("_most")  # one row


def signal_slice(signal: DataFrame, chrom, start: int, end: int) -> DataFrame:
    """One row: lo, hi, step (second position less the first), n and the sum of values between both ends."""
    rows = signal.where((F.col("chr") == chrom) & F.col("loc").between(start, end))
    out = rows.agg(F.min("loc").alias("lo"), F.max("loc").alias("hi"), F.count("*").alias("n"), F.sum("val").alias("total"))
    second = rows.join(F.broadcast(out.select("lo"))).where("loc > lo").agg(F.min("loc").alias("_second"))  # one row each
    return out.join(F.broadcast(second)).select("lo", "hi", (F.col("_second") - F.col("lo")).alias("step"), "n", "total")


def top_peaks(peaks: DataFrame, tags: DataFrame, control: DataFrame, n: int, one_less: bool = False, key: str = "pid") -> DataFrame:
    """key, score: the n peaks of the greatest mean signal less the control's; one_less: n - 1, as the older scripts give."""
    both = _both_means(peaks, tags, control, key)
    return both.select(key, (F.col("x") - F.col("y")).alias("score")).orderBy(F.col("score").desc(), key).limit(n - one_less)


def chromosome_share(rows: DataFrame) -> DataFrame:
    """chr, n, share."""
    return _shares(rows.groupBy("chr").agg(F.count("*").alias("n")), "n")


def expand_steps(signal: DataFrame, step: int) -> DataFrame:
    """chr, loc, val: each value at every position of its step."""
    return signal.select("chr", F.explode(F.sequence(F.col("loc"), F.col("loc") + step - 1)).alias("loc"), "val")


def scaffold(sizes: DataFrame, step: int = 1) -> DataFrame:
    """chr, strand, loc, n = 0 for every step-th position of each chromosome (chr, length)."""
    return sizes.select("chr", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"), "length").where("length > 0").select(
        "chr",
        "strand",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("loc"),
        F.lit(0).alias("n"),
    )
