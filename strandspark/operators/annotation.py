"""Peaks, hits and regions annotated by each other: ranks, members, lists, fetched sequences."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import revcomp
from .coverage import peak_means, with_rank
from .intervals import interval_join, touches, union_runs
from .motif import hits_in_windows, scan


def least_not_negative(values: Column, in_order: bool = False) -> Column:
    """The least value of an array that isn't negative, else its first. in_order: the older scripts' fold, in which a 0 doesn't replace a negative value."""
    if not in_order:
        return F.coalesce(F.array_min(F.filter(values, lambda x: x >= 0)), F.get(values, 0))
    better = lambda b, x: ((b < 0) & (x > 0)) | ((b >= 0) & (x >= 0) & (x < b))
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.get(values, 0), lambda b, x: F.when(better(b, x), x).otherwise(b))


def without(rows: DataFrame, unwanted: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """rows for which the predicate, a Column or a function of the rows, isn't true."""
    found = unwanted(rows) if callable(unwanted) else unwanted
    return rows.where(~F.coalesce(found, F.lit(False)))


def renamed_peaks(peaks: DataFrame, prefix: str = "chr") -> DataFrame:
    """peaks with the chromosome's prefix and length e - s."""
    return peaks.withColumns({"chr": F.concat(F.lit(prefix), F.col("chr").cast("string")), "length": F.col("e") - F.col("s")})


def gene_locations(genes: DataFrame, names: DataFrame, name: str = "name", first_only: bool = True) -> DataFrame:
    """name, found, and chr, s, e, strand of the genes called so, found being how many there are; first_only: the first by place. Names without a gene stay, with nulls."""
    order = F.row_number().over(Window.partitionBy(name).orderBy("chr", "s", "e"))
    hits = genes.select(name, "chr", "s", "e", "strand").join(names.select(name).distinct(), name, "left_semi")
    hits = hits.withColumns({"_k": order, "found": F.count("*").over(Window.partitionBy(name))})
    hits = hits.where("_k = 1") if first_only else hits
    return names.select(name).distinct().join(hits.drop("_k"), name, "left").fillna(0, ["found"]).select(name, "found", "chr", "s", "e", "strand")


def heat_matrix(peaks: DataFrame, experiments: dict[str, DataFrame], order: str, key: str = "pid") -> DataFrame:
    """key, rank, values: mean signals of all experiments as an array, the ordering one first; rank 1 is its greatest."""
    means = peak_means(peaks, experiments, key)
    names = [order, *[n for n in experiments if n != order]]
    rows = means.select(key, F.array(*[F.col(f"mean_{n}") for n in names]).alias("values"))
    return with_rank(rows, F.get("values", 0).desc(), key).select(key, "rank", "values")


def overlap_ranks(peaks: DataFrame, others: dict[str, DataFrame], key: str = "pid") -> DataFrame:
    """key and for each other set the least rank (column rank) of its peaks that overlap; null for none."""
    rows = peaks.select(key, "chr", "s", "e")
    out = peaks.select(key)
    for name, other in others.items():
        # ranks that begin inside the peak, of which a start's least will do, and those that hold its start, the same for all peaks that begin there
        proper, rest = other.where("s <= e").select("chr", "s", "e", "rank"), other.where("s > e").select("chr", "s", "e", "rank")
        plain = rows.where("s < e")
        spans = plain.select("chr", "s", "e").distinct()
        starts = proper.groupBy("chr", "s").agg(F.min("rank").alias("rank")).withColumn("e", F.col("s"))
        within = interval_join(spans, starts, lambda: (F.col("r_s") > F.col("l_s")) & (F.col("r_s") <= F.col("l_e")))
        within = within.groupBy(*[F.col(f"l_{c}").alias(c) for c in ("chr", "s", "e")]).agg(F.min("r_rank").alias("_in"))
        points = spans.select("chr", "s").distinct().withColumn("e", F.col("s"))
        held = interval_join(points, proper, lambda: (F.col("r_s") <= F.col("l_s")) & (F.col("r_e") > F.col("l_s")))
        held = held.groupBy(F.col("l_chr").alias("chr"), F.col("l_s").alias("s")).agg(F.min("r_rank").alias("_at"))
        found = plain.join(within, ["chr", "s", "e"], "left").join(held, ["chr", "s"], "left").select(key, F.least("_in", "_at").alias("_r"))
        # points, and rows whose end lies before their start, are paired
        for some, against in ((rows.where("s >= e"), other.select("chr", "s", "e", "rank")), (plain, rest)):
            found = found.union(interval_join(some, against, touches).select(f"l_{key}", "r_rank"))
        out = out.join(found.groupBy(key).agg(F.min("_r").alias(name)), key, "left")
    return out


def window_enrichment(hits: DataFrame, signal: DataFrame, window: int, key: str = "gid") -> DataFrame:
    """key, samples, nearest, by_mean, by_median: samples closer to the hit's start than window / 2; the nearest one (of equal ones the first) over their mean and median, null over 0."""
    at = hits.select(key, "chr", F.col("start").alias("s"), F.col("start").alias("e"))
    points = signal.select("chr", F.col("loc").alias("s"), F.col("loc").alias("e"), "val")
    distance = F.abs(F.col("r_s") - F.col("l_s"))
    pairs = interval_join(at, points, lambda: distance * 2 < window, pad=window // 2, width=max(64, window))
    found = pairs.groupBy(F.col(f"l_{key}").alias(key)).agg(
        F.count("*").alias("samples"),
        F.min_by("r_val", F.struct(distance, F.col("r_s"))).alias("nearest"),
        F.avg("r_val").alias("_mean"),
        F.median("r_val").alias("_median"),
    )
    over = lambda c: F.when(F.col(c) != 0, F.col("nearest") / F.col(c))
    return found.select(key, "samples", "nearest", over("_mean").alias("by_mean"), over("_median").alias("by_median"))


def greatest_starts(rows: DataFrame, start: str = "s") -> DataFrame:
    """chr, most: the greatest start of each chromosome."""
    return rows.groupBy("chr").agg(F.max(start).alias("most"))


def chromosomes(*tables: DataFrame) -> DataFrame:
    """chr: those of any table, once each."""
    out = tables[0].select("chr")
    for t in tables[1:]:
        out = out.unionByName(t.select("chr"))
    return out.distinct()


def run_members(peaks: DataFrame, key: str = "pid", least: int = 2) -> DataFrame:
    """chr, s, e, st, members: of each run with peaks of `least` sets or more, its peaks by set, their keys in order."""
    runs = union_runs(peaks).where(F.col("sets") >= least).select("chr", "s", "e")
    inside = lambda: (F.col("r_s") >= F.col("l_s")) & (F.col("r_e") <= F.col("l_e"))
    pairs = interval_join(runs, peaks.where("e > s").select("chr", "s", "e", "st", key), inside)
    return pairs.groupBy(
        F.col("l_chr").alias("chr"), F.col("l_s").alias("s"), F.col("l_e").alias("e"), F.col("r_st").alias("st")
    ).agg(F.sort_array(F.collect_list(f"r_{key}")).alias("members"))


def overlap_combinations(tables: dict[str, DataFrame], key: str = "pid") -> DataFrame:
    """tables, key: of every combination of two tables or more, the rows of its first one that overlap rows of all its others. Each pair of tables is joined once."""
    names = list(tables)
    hits = {}
    for a, b in combinations(names, 2):
        others = tables[b].select("chr", "s", "e").distinct()
        hits[a, b] = interval_join(tables[a].select(key, "chr", "s", "e"), others, touches, "semi").select(key).distinct()
    out = None
    for size in range(2, len(names) + 1):
        for first, *rest in combinations(names, size):
            rows = hits[first, rest[0]]
            for other in rest[1:]:
                rows = rows.join(hits[first, other], key, "left_semi")
            rows = rows.select(F.lit("+".join([first, *rest])).alias("tables"), key)
            out = rows if out is None else out.unionByName(rows)
    return out


def distance_lists(peaks: DataFrame, hits: DataFrame, window: int, key: str = "pid") -> DataFrame:
    """key, matrix, distances: peak less start of every hit in the window, in rising order; peaks and matrices without hits have no row."""
    pairs = hits_in_windows(peaks, hits, window)
    return pairs.groupBy(F.col(f"l_{key}").alias(key), F.col("r_matrix").alias("matrix")).agg(
        F.sort_array(F.collect_list(F.col("l_loc") - F.col("r_start"))).alias("distances")
    )


def fraction_by_matrix(peaks: DataFrame, hits: DataFrame, window: int, key: str = "pid") -> DataFrame:
    """matrix, with_hit, fraction: peaks with a hit of the matrix in the window, of all peaks."""
    n = peaks.count()
    found = hits_in_windows(peaks, hits, window).groupBy(F.col("r_matrix").alias("matrix")).agg(F.count_distinct(f"l_{key}").alias("with_hit"))
    return found.withColumn("fraction", F.col("with_hit") / max(n, 1))


def prioritised_hits(peaks: DataFrame, hits: DataFrame, window: int, priority: list, key: str = "pid") -> DataFrame:
    """key, class, reference, matrix, offset: as motif.oriented_hits(), the reference being the first matrix of the list that has a hit at the peak; the reference's own hit comes first by offset 0."""
    pairs = hits_in_windows(peaks, hits, window).select(
        F.col(f"l_{key}").alias(key),
        F.col("r_matrix").alias("matrix"),
        F.col("r_strand").alias("strand"),
        (F.col("r_start") - F.col("l_loc")).alias("offset"),
    )
    place = F.array_position(F.array(*[F.lit(m) for m in priority]), F.col("matrix"))
    per = pairs.groupBy(key).agg(F.count_distinct("matrix").alias("class"))
    lead = F.row_number().over(Window.partitionBy(key).orderBy("_p", F.abs("offset"), "offset", "strand"))
    ref = pairs.withColumn("_p", place).where("_p > 0").withColumn("_r", lead).where("_r = 1")
    ref = ref.select(key, F.col("matrix").alias("reference"), F.col("strand").alias("_strand"), F.col("offset").alias("_at"))
    turned = F.when(F.col("_strand") == "-", F.col("_at") - F.col("offset")).otherwise(F.col("offset") - F.col("_at"))
    return pairs.join(ref, key).join(per, key).select(key, "class", "reference", "matrix", turned.alias("offset"))


def fetched(seqs: DataFrame, regions: DataFrame, code: str = "code") -> DataFrame:
    """Columns of regions (name, start, end from 0, half open) and seq: code k as it is, r reverse complemented; rows of other codes go."""
    part = F.substring(F.col("_seq"), F.col("start") + 1, F.col("end") - F.col("start"))
    rows = regions.where(F.col(code).isin("k", "r")).join(seqs.select("name", F.col("seq").alias("_seq")), "name")
    return rows.select(*regions.columns, F.when(F.col(code) == "r", revcomp(part)).otherwise(part).alias("seq"))


def region_hits(seqs: DataFrame, regions: DataFrame, columns: list[dict[str, float]], cutoff: float) -> DataFrame:
    """Columns of regions (name, start, end, strand), and at, hit_strand, score of hits in them: '-' regions are scanned as their reverse complement; at is in the sequence's own coordinates."""
    rows = fetched(seqs, regions.withColumn("code", F.when(F.col("strand") == "-", "r").otherwise("k"))).drop("code")
    found = scan(rows.withColumnRenamed("strand", "_s"), columns, cutoff)
    at = F.when(F.col("_s") == "-", F.col("end") - F.col("pos") - len(columns)).otherwise(F.col("start") + F.col("pos"))
    own = F.when(F.col("_s") == "-", F.translate("strand", "+-", "-+")).otherwise(F.col("strand"))
    return found.select("name", "start", "end", F.col("_s").alias("strand"), at.alias("at"), own.alias("hit_strand"), "score")


def five_prime(hits: DataFrame, width: int) -> DataFrame:
    """hits with five: the start of '+' hits, the end of others."""
    return hits.withColumn("five", F.when(F.col("strand") == "-", F.col("pos") + width).otherwise(F.col("pos")))


def chimera(parts: DataFrame, seqs: DataFrame, key: str = "id") -> DataFrame:
    """key, seq: slices (name, start, end from 0, half open, turned where strand is '-') one after another in the order of part."""
    rows = parts.join(seqs.select("name", F.col("seq").alias("_seq")), "name")
    cut = F.substring(F.col("_seq"), F.col("start") + 1, F.col("end") - F.col("start"))
    rows = rows.select(key, F.struct("part", F.when(F.col("strand") == "-", revcomp(cut)).otherwise(cut).alias("seq")).alias("_p"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda x: x["seq"]), "").alias("seq"))


def reversed_records(seqs: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """seqs reverse complemented, their names ending in _rc."""
    return seqs.withColumns({name: F.concat(F.col(name), F.lit("_rc")), seq: revcomp(F.col(seq))})


def stepped(signal: DataFrame, step: int, strand: str = "strand") -> DataFrame:
    """chr, strand, loc, val: each value at every position of its step; on '-' positions run down from the step's end."""
    k = F.explode(F.sequence(F.lit(0), F.lit(step - 1))).alias("_k")
    rows = signal.select("chr", strand, "loc", "val", k)
    return rows.select("chr", strand, F.when(F.col(strand) == "-", F.col("loc") - F.col("_k")).otherwise(F.col("loc") + F.col("_k")).alias("loc"), "val")


def peaks_by_gene(nearest: DataFrame, gene: str = "gid", key: str = "pid") -> DataFrame:
    """gene, n, peaks: the peaks nearest to each gene, in the order of their keys."""
    return nearest.groupBy(gene).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(key)).alias("peaks"))


def regional_orders(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """rows with rank_c for each column c: its place by that column, greatest first."""
    for c in columns:
        rows = with_rank(rows, F.col(c).desc(), key, f"rank_{c}")
    return rows


def conservation_counts(windows: DataFrame, a: DataFrame, b: DataFrame, key: str = "pid") -> DataFrame:
    """One row: windows (key, chr, s, e) with sites of both, of a only, of b only, of neither."""
    out = windows.select(key)
    for name, sites in (("_a", a), ("_b", b)):
        held = interval_join(windows.select(key, "chr", "s", "e"), sites.select("chr", "s", "e"), touches).select(F.col(f"l_{key}").alias(key)).distinct()
        out = out.join(held.withColumn(name, F.lit(True)), key, "left").fillna(False, [name])
    return out.agg(
        *[
            F.count_if((F.col("_a") == x) & (F.col("_b") == y)).alias(n) for n, x, y in (
                ("both", True, True), ("only_a", True, False), ("only_b", False, True), ("neither", False, False)
            )
        ],
    )


def domain_rates(domains: DataFrame, rates: DataFrame, species: list[str], family: str | None = None, genes: DataFrame | None = None) -> DataFrame:
    """Rates (protein, species, rate) of proteins with a domain (protein, family), of those species and that family; genes (protein, gene) adds their genes."""
    picked = domains if family is None else domains.where(F.col("family") == family)
    out = picked.select("protein", "family").distinct().join(rates.where(F.col("species").isin(species)), "protein")
    return out if genes is None else out.join(genes.select("protein", "gene"), "protein")


def marked_rates(rates: DataFrame, pattern: str, name: str = "name") -> DataFrame:
    """family, species, median, n, marked: medians of a family by species, and how many of its rows have a name like the pattern."""
    return rates.groupBy("family", "species").agg(
        F.median("rate").alias("median"), F.count("*").alias("n"), F.count_if(F.col(name).rlike(pattern)).alias("marked")
    )


def with_cluster(peaks: DataFrame, clusters: DataFrame, key: str = "pid") -> DataFrame:
    """peaks with the cluster that has their key; others go."""
    return peaks.join(clusters.select(key, "cluster"), key)


def intergenic(peaks: DataFrame, genes: DataFrame) -> DataFrame:
    """peaks that no gene overlaps."""
    return interval_join(peaks, genes, touches, "anti")


def ortholog_claims(lines: DataFrame, species: str, source: str = "FlyBase", kind: str = "orthologous_to") -> DataFrame:
    """key1, fbid, chr, s, e of lines (value) of that source and type whose to_species is the one asked, in any case: key1 is ID= up to its first underscore, the partner is in to_name= and its place in Target=."""
    parts = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.get(parts, 1) == source) & (F.get(parts, 2) == kind)).select(F.get(parts, 8).alias("_a"))
    get = lambda p: F.nullif(F.regexp_extract("_a", p, 1), F.lit(""))
    place = r"(?:^|;)\s*Target=(\S+) (\d+) (\d+)"
    at = lambda k: F.nullif(F.regexp_extract("_a", place, k), F.lit(""))
    rows = rows.where(F.lower(get(r"(?:^|;)\s*to_species=([^;]*)")) == species.lower())
    return rows.select(
        F.substring_index(get(r"(?:^|;)\s*ID=([^;]*)"), "_", 1).alias("key1"),
        get(r"(?:^|;)\s*to_name=([^;]*)").alias("fbid"),
        at(1).alias("chr"),
        at(2).cast("long").alias("s"),
        at(3).cast("long").alias("e"),
    )
