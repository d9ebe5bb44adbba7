"""Interval joins, neighbours, unions. Coordinates are inclusive as in the peak formats unless said otherwise.

Spark has no interval join. A join here puts both sides into bins of a width, joins bins by equality and keeps a pair in
the bin where the later of its starts lies, so that each pair comes once and no chromosome is one task.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import BIN, carried_scan, checkpoint, running_max, running_sum, running_sums

#: The least width of a join's bins, and rows of a stretch of merge_runs.
WIDTH, MERGED = 16, 1 << 15
#: packed_join: the most rows that are packed into one, and rows of both sides a task.
PACK, DEALT = 64, 1 << 16
#: Copies of a row that filter_by_regions makes at once.
PIECE = 1 << 10


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def fitting_width(left: DataFrame, right: DataFrame, pad: int = 0) -> int:
    """A bin's width of about the mean length of all rows: wider bins pair rows that are far apart, in narrower ones a row has many bins. As it is the mean, bins are at most some two a row."""
    return _fitting(left, right, pad)[0]


def _fitting(left: DataFrame, right: DataFrame, pad: int) -> tuple[int, int]:
    """fitting_width, and the number of rows of both sides."""
    lengths = left.select(F.abs(F.col("e") - F.col("s")) + 2 * pad).union(right.select(F.abs(F.col("e") - F.col("s")))).toDF("n")
    mean, rows = lengths.agg(F.avg("n"), F.count("*")).first()
    return max(WIDTH, 1 << int(mean or 0).bit_length()), rows


def interval_join(left: DataFrame, right: DataFrame, on: Callable[[], Column], how: str = "inner", pad: int = 0, width: int | None = None) -> DataFrame:
    """Pairs of rows with equal chr for which on() holds; columns of the sides are named l_ and r_.

    on() may only accept pairs whose spans, the left one padded by pad, touch. how: inner, left (unmatched left rows with
    nulls), semi or anti (left columns, unprefixed). Rows with a null chr, s or e match nothing. left, semi and anti
    need rows of left to differ. semi and anti stop at a row's first match in a bin. width: of the bins; None for one that fits.
    """
    width = width or fitting_width(left, right, pad)
    a, b = _named(left, "l_"), _named(right, "r_")
    low, high = F.col("l_s") - pad, F.col("l_e") + pad
    bins = lambda x, y: F.sequence(F.floor(F.least(x, y) / width), F.floor(F.greatest(x, y) / width))
    x = a.withColumn("_bin", F.explode(bins(low, high)))
    y = b.withColumn("_bin", F.explode(bins(F.col("r_s"), F.col("r_e"))))
    owner = F.floor(F.greatest(F.least(low, high), F.least("r_s", "r_e")) / width)
    pairs = x.join(y, (F.col("l_chr") == F.col("r_chr")) & (x["_bin"] == y["_bin"])).where(x["_bin"] == owner).where(on()).select(*a.columns, *b.columns)
    if how == "inner":
        return pairs
    alike = (F.col("l_chr") == F.col("r_chr")) & (x["_bin"] == y["_bin"])
    keys = (pairs if how == "left" else x.join(y, alike & on(), "left_semi")).select(*a.columns).distinct()
    same = lambda t: [t[c].eqNullSafe(keys[c]) for c in a.columns]
    if how in ("semi", "anti"):
        out = a.join(keys, same(a), f"left_{how}")
        return out.select([F.col(f"l_{c}").alias(c) for c in left.columns])
    return pairs.unionByName(a.join(keys, same(a), "left_anti"), allowMissingColumns=True)


def _packed(df: DataFrame, side: str, pad: int) -> DataFrame:
    """A row for up to PACK rows of one start and of lengths alike: chr, s, the others as an array of structs by end, and the span _low to _high of all, padded."""
    chrom, s, e = (f"{side}_{c}" for c in ("chr", "s", "e"))
    rest = [e, *(c for c in df.columns if c not in (chrom, s, e))]
    # a long row would take short ones of its start into all of its bins
    rows = df.where(F.col(chrom).isNotNull() & F.col(s).isNotNull() & F.col(e).isNotNull()).withColumn("_size", F.floor(F.log2(F.abs(F.col(e) - F.col(s)) + 1) / 2))
    place = [chrom, s, "_size"]
    rank = F.row_number().over(Window.partitionBy(*place).orderBy(e))
    blocks = rows.withColumn("_block", F.floor((rank - 1) / PACK)).groupBy(*place, "_block")
    out = blocks.agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(f"_{side}"), F.min(e).alias("_least"), F.max(e).alias("_most"))
    return out.select(chrom, s, f"_{side}", (F.least(s, "_least") - pad).alias("_low"), (F.greatest(s, "_most") + pad).alias("_high"))


def packed_join(left: DataFrame, right: DataFrame, on: Callable[[], Column], pad: int = 0, width: int | None = None) -> DataFrame:
    """The pairs of interval_join, for dense tables, where pairs are many times the rows.

    Rows of one start are packed before they meet in bins, and unpacked after it, so that the join compares starts and not rows. Pairs come start by start, and a task has the
    pairs of few rows (DEALT), so that columnar files hold them in a fraction of the bytes of pairs in no order. A bin's memory is that of its packed rows; columns need an order.
    """
    fits, n = _fitting(left, right, pad)
    width, n = width or 2 * fits, max(left.sparkSession.sparkContext.defaultParallelism, -(-n // DEALT))
    a, b = _named(left, "l_"), _named(right, "r_")
    binned = lambda df, side, n: _packed(df, side, n).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))))
    x, y = binned(a, "l", pad), binned(b, "r", 0)
    near = (x["_low"] <= y["_high"]) & (y["_low"] <= x["_high"]) & (x["_bin"] == F.floor(F.greatest(x["_low"], y["_low"]) / width))
    x = x.repartition(n, "l_chr", "_bin")
    met = x.join(y.hint("merge"), (F.col("l_chr") == F.col("r_chr")) & (x["_bin"] == y["_bin"]) & near)
    # the filter isn't compiled into the join's loop, so the join hands on one pair of packs after the other and keeps no pairs of rows
    reach = F.filter("_r", lambda r: r["r_e"].isNotNull())
    l_rows = met.select("l_chr", "l_s", "r_chr", "r_s", "_l", reach.alias("_r")).select("l_chr", "l_s", "r_chr", "r_s", "_r", F.inline("_l"))
    return l_rows.select(*(c for c in l_rows.columns if c != "_r"), F.inline("_r")).where(on()).select(*a.columns, *b.columns)


def touches() -> Column:
    """The peak overlap: touching at the left side's end counts, at its start doesn't, unless the left side is that point."""
    return (F.col("r_s") <= F.col("l_e")) & ((F.col("r_e") > F.col("l_s")) | ((F.col("l_s") == F.col("l_e")) & (F.col("r_e") == F.col("l_s"))))


def symmetric() -> Column:
    return (F.col("r_s") <= F.col("l_e")) & (F.col("r_e") >= F.col("l_s"))


def overlap(left: DataFrame, right: DataFrame, zero_is_missing: bool = False, how: str = "inner", **options) -> DataFrame:
    """touches() pairs with the shared span os, oe. zero_is_missing: a span that starts or ends at 0 doesn't count."""
    pairs = packed_join(left, right, touches, **options) if how == "inner" else interval_join(left, right, touches, how, **options)
    out = pairs.withColumns({"os": F.greatest("l_s", "r_s"), "oe": F.least("l_e", "r_e")})
    return out.where("os != 0 and oe != 0") if zero_is_missing else out


def overlap_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of first with an end inside a row of every other table; u_s and u_e: the least start and greatest end of those rows. A row that strictly contains its partner is missed."""
    inside = lambda: F.col("l_s").between(F.col("r_s"), F.col("r_e")) | F.col("l_e").between(F.col("r_s"), F.col("r_e"))
    out = first
    for other in others:
        # of rows with one start the longest holds all that another one does, and a point's answer serves all rows that end there
        longest = other.groupBy("chr", "s").agg(F.max("e").alias("e"))
        found = interval_join(_ends(first), longest, inside).groupBy("l_chr", "l_s").agg(F.min("r_s").alias("_s"), F.max("r_e").alias("_e"))
        at = [found.select(F.col("l_chr").alias("chr"), F.col("l_s").alias(c), F.col("_s").alias(f"_s_{c}"), F.col("_e").alias(f"_e_{c}")) for c in ("s", "e")]
        out = out.join(at[0], ["chr", "s"], "left").join(at[1], ["chr", "e"], "left").where("_s_s is not null or _s_e is not null")
        low, high = F.least("_s_s", "_s_e"), F.greatest("_e_s", "_e_e")
        out = out.withColumns(
            {"u_s": F.least("u_s", low), "u_e": F.greatest("u_e", high)} if "u_s" in out.columns else {"u_s": low, "u_e": high}
        ).select(*first.columns, "u_s", "u_e")
    return out


def _ends(rows: DataFrame) -> DataFrame:
    """chr, s, e: the different starts and ends of rows, as points."""
    each = rows.select("chr", F.explode(F.array("s", "e")).alias("s")).where("chr is not null and s is not null").distinct()
    return each.withColumn("e", F.col("s"))


def shorter_of_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """chr, s, e, different: of each strictly overlapping pair the shorter row, the left one of two as long. Pairs with an equal start, or a left side inside the right, are missed unless an end lies strictly inside.

    Asked from each side whether there is such a partner, so that no list of pairs is made: a left row goes with a right one at least as long that holds one of its ends; a
    right row with a longer left one, and of those with one start, or one end, the longest will do.
    """
    l_s, l_e, r_s, r_e = (F.col(c) for c in ("l_s", "l_e", "r_s", "r_e"))
    cols = ["chr", "s", "e"]
    a, b = left.select(cols).distinct(), right.select(cols).distinct()
    longest = b.groupBy("chr", "s").agg(F.max("e").alias("e"))
    best = interval_join(_ends(a), longest, lambda: (r_s < l_s) & (l_s < r_e)).groupBy("l_chr", "l_s").agg(F.max(r_e - r_s).alias("_n"))
    at = [best.select(F.col("l_chr").alias("chr"), l_s.alias(c), F.col("_n").alias(f"_n_{c}")) for c in ("s", "e")]
    held = F.greatest("_n_s", "_n_e") >= F.col("e") - F.col("s")
    of_left = a.join(at[0], ["chr", "s"], "left").join(at[1], ["chr", "e"], "left").where(held).select(cols)
    partners = a.groupBy("chr", "s").agg(F.max("e").alias("e")).union(a.groupBy("chr", "e").agg(F.min("s").alias("s")).select(cols)).distinct()
    # sides are turned round: l_ is the right row
    inside = ((r_s > l_s) & (r_s < l_e)) | ((r_e > l_s) & (r_e < l_e)) | ((l_s > r_s) & (l_e < r_e))
    of_right = interval_join(b, partners, lambda: inside & ((r_e - r_s) > (l_e - l_s)), "semi")
    return of_left.union(of_right.select(cols)).distinct()


def filter_by_regions(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows that overlap a region strictly, once for each match.

    Matches are counted, not paired: regions that begin before the row's end less those that end up to its start. Where an end lies before its start, or a region has no length, rows are paired.
    """
    over = lambda: (F.col("r_e") > F.col("l_s")) & (F.col("r_s") < F.col("l_e"))
    plain, proper = rows.where("s <= e"), regions.where("s < e")
    none = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    events = proper.select("chr", F.col("s").alias("pos"), one.alias("_b"), none.alias("_e")).union(proper.select("chr", "e", none, one))
    events = events.union(plain.select("chr", F.explode(F.array("s", "e")), none, none)).where("chr is not null")
    places = events.groupBy("chr", "pos").agg(F.sum("_b").alias("_b"), F.sum("_e").alias("_e"))
    places = running_sums(places, ["chr"], [], "pos", {"_begun": (F.col("_b"), False), "_ended": (F.col("_e"), True)})
    places = checkpoint(places.select("chr", "pos", "_begun", "_ended"))
    counted = plain.join(places.select("chr", F.col("pos").alias("e"), "_begun"), ["chr", "e"]).join(places.select("chr", F.col("pos").alias("s"), "_ended"), ["chr", "s"])
    counted = counted.withColumn("_n", F.col("_begun") - F.col("_ended")).where("_n > 0")
    # in pieces: the transform isn't compiled into a loop, so no more than a piece of a row's copies is in memory
    pieces = F.transform(F.sequence(none, F.floor((F.col("_n") - 1) / PIECE)), lambda k: F.least(F.lit(PIECE).cast("long"), F.col("_n") - k * PIECE))
    out = counted.select(*rows.columns, F.explode(pieces).alias("_n")).select(*rows.columns, F.explode(F.sequence(one, "_n")).alias("_k")).drop("_k")
    turned, points = (x.where(odd).take(1) for x, odd in ((rows, "s > e"), (regions, "s >= e")))
    for some, others, there in ((plain, regions.where("s >= e"), points), (rows.where("s > e"), regions, turned)):
        if not there:
            continue
        out = out.union(interval_join(some, others, over).select([F.col(f"l_{c}").alias(c) for c in rows.columns]))
    return out


def region_annotations(regions: DataFrame, features: DataFrame, spanning: bool = False) -> DataFrame:
    """Features with an end inside the region; with spanning also those that contain it."""
    inside = lambda: F.col("r_s").between(F.col("l_s"), F.col("l_e")) | F.col("r_e").between(F.col("l_s"), F.col("l_e"))
    return interval_join(regions, features, symmetric if spanning else inside)


def contained(inner: DataFrame, outer: DataFrame, **options) -> DataFrame:
    """Pairs with inner strictly inside outer at both ends."""
    return interval_join(inner, outer, lambda: (F.col("l_s") > F.col("r_s")) & (F.col("l_e") < F.col("r_e")), **options)


def flag_overlap(hits: DataFrame, peaks: DataFrame) -> DataFrame:
    """hits with overlap: 1 if strictly inside a peak, else 0. Rows of hits differ."""
    found = contained(hits, peaks, how="semi").withColumn("overlap", F.lit(1))
    return hits.join(found, hits.columns, "left").select(*hits.columns, F.coalesce("overlap", F.lit(0)).alias("overlap"))


def nearest(peaks: DataFrame, features: DataFrame, key: str, feature: str, n: int = 1) -> DataFrame:
    """key, chr, feature, distance, rank: the n features nearest to each peak's middle, of distance middle - start on '+', middle - end else; ties by feature.

    Both sides are put in one order along the chromosome and features numbered on it, so a peak's candidates are the n
    numbers before and after it; no pair of all rows is made. Keys are unique. One feature only is the last before or the first after: a pass over bins without joins of candidates.
    """
    mid = F.floor((F.col("s") + F.col("e")) / 2)
    a = features.select("chr", F.when(F.col("strand") == "+", F.col("s")).otherwise(F.col("e")).alias("pos"), F.col(feature).alias("_id"))
    if n == 1:
        return _nearest_one(peaks.select("chr", mid.alias("pos"), F.col(key).alias("_key")), a, key, feature)
    one = F.when(F.col("_kind") != 2, 1).otherwise(0)
    candidates = []
    for back in (True, False):
        # looking back, the last ones up to the middle count, and of equals the least id is last
        order = F.col("_id").desc() if back else F.col("_id").asc()
        ranked = a.withColumns({"_key": F.lit(None).cast(peaks.schema[key].dataType), "_kind": F.lit(1 if back else 3)})
        asked = peaks.select(
            "chr",
            mid.alias("pos"),
            F.lit(None).cast(features.schema[feature].dataType).alias("_id"),
            F.col(key).alias("_key"),
            F.lit(2).alias("_kind"),
        )
        rows = running_sum(ranked.unionByName(asked), ["chr"], ["_kind", order], "pos", one, "_n")
        numbered = rows.where("_kind != 2").select("chr", F.col("_n").alias("_at"), "_id", F.col("pos").alias("_pos"))
        steps = F.sequence(F.lit(0), F.lit(n - 1)) if back else F.sequence(F.lit(1), F.lit(n))
        wanted = rows.where("_kind = 2").select(
            "chr", "_key", "pos", F.explode(F.transform(steps, lambda k: F.col("_n") - k if back else F.col("_n") + k)).alias("_at")
        )
        candidates.append(wanted.join(numbered, ["chr", "_at"]).select("chr", "_key", "_id", (F.col("pos") - F.col("_pos")).alias("distance")))
    both = candidates[0].unionByName(candidates[1]).distinct()
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(F.abs("distance"), "_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("_key").alias(key), "chr", F.col("_id").alias(feature), "distance", "rank")


def _nearest_one(asked: DataFrame, features: DataFrame, key: str, feature: str, width: int = BIN) -> DataFrame:
    """The nearest of features (chr, pos, _id) to each of asked (chr, pos, _key)."""
    # of features at one place only the least can be nearest
    places = features.where("chr is not null and pos is not null").groupBy("chr", "pos").agg(F.min("_id").alias("_id"))
    none = F.lit(None)
    rows = places.select("chr", "pos", "_id", none.cast(asked.schema["_key"].dataType).alias("_key"), F.lit(1).alias("_kind"))
    rows = rows.unionByName(asked.select("chr", "pos", none.cast(features.schema["_id"].dataType).alias("_id"), "_key", F.lit(2).alias("_kind")))
    at = F.when(F.col("_kind") == 1, F.struct("pos", "_id"))
    rows = rows.withColumns({"_bin": F.floor(F.col("pos") / width), "_f": at})
    ends = rows.groupBy("chr", "_bin").agg(F.max("_f").alias("_last"), F.min("_f").alias("_first"))  # a row a bin
    bins = Window.partitionBy("chr").orderBy("_bin")
    back = Window.partitionBy("chr").orderBy(F.col("_bin").desc())
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "chr",
        "_bin",
        F.last("_last", ignorenulls=True).over(earlier(bins)).alias("_before"),
        F.last("_first", ignorenulls=True).over(earlier(back)).alias("_after"),
    )
    up, down = Window.partitionBy("chr", "_bin").orderBy("pos", "_kind"), Window.partitionBy("chr", "_bin").orderBy(F.col("pos").desc(), F.col("_kind").desc())
    so_far = lambda w: F.last("_f", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = rows.join(carried, ["chr", "_bin"]).withColumns({"_l": F.coalesce(so_far(up), "_before"), "_r": F.coalesce(so_far(down), "_after")}).where("_kind = 2")
    apart = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("pos") - F.col(f"{c}.pos")).alias("d"), F.col(f"{c}._id").alias("id"), (F.col("pos") - F.col(f"{c}.pos")).alias("distance")))
    best = found.select("_key", "chr", F.least(apart("_l"), apart("_r")).alias("b")).where("b is not null")
    return best.select(F.col("_key").alias(key), "chr", F.col("b.id").alias(feature), "b.distance", F.lit(1).alias("rank"))


def stream_nearest(peaks: DataFrame, genes: DataFrame, window: int, upstream: bool, key: str, gene: str, zero_is_unset: bool = False) -> DataFrame:
    """key, gene, distance: the nearest gene with an end within window of the peak's start whose transcription start lies before it (upstream) or after.

    Distances are not negative; of equal ones the last gene counts. zero_is_unset: once 0 was the best, any later
    gene replaces it, as in the older scripts.
    """
    loc = F.col("l_s")
    tss = F.when(F.col("r_strand") == "+", F.col("r_s")).otherwise(F.col("r_e"))
    near = lambda: F.col("r_s").between(loc - window, loc + window) | F.col("r_e").between(loc - window, loc + window)
    distance = (loc - tss) if upstream else (tss - loc)
    pairs = interval_join(peaks.withColumn("e", F.col("s")), genes, near, pad=window).select(
        F.col(f"l_{key}").alias(key), F.col(f"r_{gene}").alias(gene), distance.alias("distance")
    ).where("distance >= 0")
    if not zero_is_unset:
        rank = F.row_number().over(Window.partitionBy(key).orderBy("distance", F.col(gene).desc()))
        return pairs.withColumn("rank", rank).where("rank = 1").drop("rank")
    # a fold over the genes around one peak
    items = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(gene, "distance"))).alias("items"))
    best = F.expr("aggregate(slice(items, 2, size(items)), items[0], (b, x) -> if(b.distance = 0 or x.distance <= b.distance, x, b))")
    return items.select(key, best.alias("b")).select(key, f"b.{gene}", "b.distance")


def union_runs(peaks: DataFrame, pad: int = 0, drop_last: bool = False, width: int = 1 << 16) -> DataFrame:
    """chr, s, e, n, sets: overlapping intervals of all sets (column st) as one run; a run starts where its start isn't before all ends so far.

    sets: how many different sets it has. pad widens intervals first; those of no length are left out. drop_last:
    without the last run of all, as the older scripts do.
    """
    rows = peaks.select("chr", (F.col("s") - pad).alias("s"), (F.col("e") + pad).alias("e"), "st").where("e > s")
    rows = running_max(rows, ["chr"], ["e", "st"], "s", F.col("e"), "_reach", width)
    rows = running_sum(rows, ["chr"], ["e", "st"], "s", F.when(F.col("_reach") > F.col("s"), 0).otherwise(1), "_run", width=width)
    runs = rows.groupBy("chr", "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"), F.count_distinct("st").alias("sets"))
    if drop_last:
        last = runs.agg(F.max(F.struct("chr", "s")).alias("l")).select("l.*")
        runs = runs.join(F.broadcast(last), ["chr", "s"], "left_anti")  # one row
    return runs.select("chr", "s", "e", "n", "sets")


def merge_runs(peaks: DataFrame, join_cut: float, pad: int = 0, drop_last: bool = False, stretch: int = MERGED) -> DataFrame:
    """As union_runs, but neighbours merge only if their overlap is more than join_cut of either one's length; else the earlier one is cut before the later.

    The outcome depends on the order, so it's a scan that carries the open run (chr, s, e) from stretch to stretch. Once a run is so long that no peak can be
    enough of its length, how long it is doesn't matter, so it's carried no longer than that: what lies far behind is forgotten even where
    runs never end, and stretches settle in few rounds. Counts and sets are added up from the stretches' parts of runs.
    """
    kinds = dict(peaks.dtypes)
    rows = peaks.select("chr", (F.col("s") - pad).alias("s"), (F.col("e") + pad).alias("e"), "st").where("chr is not null and st is not null and e > s")
    longest = rows.agg(F.max(F.col("e") - F.col("s"))).first()[0] or 0
    enough = int(longest / join_cut) + 2 if join_cut > 0 else 2

    def fold(rows: pd.DataFrame, now: list | None, last: bool) -> tuple[pd.DataFrame, list | None]:
        parts, n = [], {}  # parts of runs: chr, place, whether it begins there, s, e, its rows by set
        for chrom, s, e, st, at in zip(*(rows[c].tolist() for c in ("chr", "s", "e", "st", "_rank")), strict=True):
            merged = False
            if now and now[0] == chrom and s < now[2]:
                shared = min(now[2], e) - s
                merged = max(shared / (e - s), shared / (now[2] - now[1])) > join_cut
            now = [chrom, now[1], max(now[2], e)] if merged else [chrom, s, e]
            now[1] = max(now[1], now[2] - enough)
            if not merged or not parts:
                n = {}
                parts.append([chrom, at, 0 if merged else 1, s, e, n])
            parts[-1][4] = max(parts[-1][4], e)
            n[st] = n.get(st, 0) + 1
        flat = [(c, at, new if k == 0 else 0, s, e, st, m) for c, at, new, s, e, n in parts for k, (st, m) in enumerate(n.items())]
        return pd.DataFrame(flat, columns=["chr", "_at", "_new", "s", "e", "st", "n"]), now

    schema = f"chr {kinds['chr']}, _at long, _new long, s long, e long, st {kinds['st']}, n long"
    parts = checkpoint(carried_scan(rows, ["chr", "s", "e", "st"], fold, schema, stretch))
    numbered = running_sum(parts, [], [F.col("_new").desc()], "_at", F.col("_new"), "_run")
    runs = numbered.groupBy("_run").agg(
        F.min("chr").alias("chr"), F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n"), F.count_distinct("st").alias("sets")
    )
    runs = checkpoint(runs)
    after = runs.select((F.col("_run") - 1).alias("_run"), F.col("chr").alias("_chr"), F.col("s").alias("_s"))
    cut = F.when((F.col("_chr") == F.col("chr")) & (F.col("_s") < F.col("e")), F.col("_s") - 1).otherwise(F.col("e"))
    runs = runs.join(after, "_run", "left").select("chr", "s", cut.alias("e"), "n", "sets")
    if drop_last:
        last = runs.agg(F.max(F.struct("chr", "s")).alias("l")).select("l.*")
        runs = runs.join(F.broadcast(last), ["chr", "s"], "left_anti")  # one row
    return runs


def intersect_runs(peaks: DataFrame, pad: int = 0) -> DataFrame:
    """Runs with intervals of more than one set."""
    return union_runs(peaks, pad).where("sets > 1")


def nonoverlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side, different ones, that overlap none of the other."""
    cols = ["chr", "s", "e"]
    a, b = left.select(cols).distinct(), right.select(cols).distinct()
    return interval_join(a, b, touches, "anti").union(interval_join(b, a, touches, "anti")).distinct()


def hit_vector(rows: DataFrame, chrom, start: int, end: int) -> DataFrame:
    """rows with hit: 1 where the row overlaps chrom:start-end, ends included; a point at the row's start counts only if the row is that point."""
    touching = (F.col("s") <= end) & ((F.col("e") > start) | ((F.col("s") == F.col("e")) & (F.col("e") == start)))
    return rows.withColumn("hit", F.when((F.col("chr") == chrom) & touching, 1).otherwise(0))
