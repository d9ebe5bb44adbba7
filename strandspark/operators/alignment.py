"""Alignments in long form: a row for each block, species and column.

block (block, species, seq, p_start, strand): equal-length gapped rows with where they lie in their parent sequence.
Running counts of bases carry over column bins, so long blocks are not one task's window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.sequence import revcomp, ungapped
from .intervals import interval_join
from .ordered import checkpoint, running_sum

COLUMN_BIN = 1 << 12


def parse_fasta_text(rows: DataFrame, text: str, key: str) -> DataFrame:
    """key, i, name, description, seq of each `>name description` record of a text column; blank lines are skipped."""
    found = rows.select(key, F.posexplode(F.filter(F.split(F.col(text), r"(?m)^>"), lambda x: F.trim(x) != "")).alias("i", "_r"))
    head = F.regexp_extract("_r", r"^([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("_r", r"^[^\n]*\n?", ""), r"\s", "")
    return found.select(
        key,
        "i",
        F.regexp_extract(head, r"^(\S*)", 1).alias("name"),
        F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"),
        body.alias("seq"),
    )


def columns(block: DataFrame, gap: str = "-") -> DataFrame:
    """block, species, col from 0, base, u: how many bases come before; gaps have the u of the next base."""
    base = F.posexplode(F.split("seq", "")).alias("col", "base")
    long = block.select("block", "species", base).where("base != ''")
    out = running_sum(long, ["block", "species"], [], "col", F.when(F.col("base") != gap, 1).otherwise(0), "u", inclusive=False, width=COLUMN_BIN)
    return out.select("block", "species", "col", "base", "u")


def with_parent(cols: DataFrame, block: DataFrame, gap: str = "-") -> DataFrame:
    """cols with parent: a base's place in its parent, null for gaps; on '-' counted back from the end."""
    place = block.select("block", "species", "p_start", "strand", F.length(ungapped(F.col("seq"), gap)).alias("_n"))
    at = F.when(F.col("strand") == "-", F.col("p_start") + F.col("_n") - F.col("u")).otherwise(F.col("p_start") + F.col("u"))
    return cols.join(place, ["block", "species"]).select(*cols.columns, F.when(F.col("base") != gap, at).alias("parent"))


def unaligned(cols: DataFrame, block: DataFrame) -> DataFrame:
    """cols with u resolved: a gap after the last base falls back to the first base."""
    n = block.select("block", "species", F.length(ungapped(F.col("seq"))).alias("_n"))
    return cols.join(n, ["block", "species"]).withColumn("u", F.when(F.col("u") >= F.col("_n"), F.lit(0)).otherwise(F.col("u"))).drop("_n")


def lift(cols: DataFrame, source, target) -> DataFrame:
    """block, col, from, to: parent places of both species at each column that the source has a base in; a gap of the target is null."""
    a = cols.where((F.col("species") == source) & F.col("parent").isNotNull()).select("block", "col", F.col("parent").alias("from"))
    b = cols.where(F.col("species") == target).select("block", "col", F.col("parent").alias("to"))
    return a.join(b, ["block", "col"])


def slice_columns(block: DataFrame, start: int, end: int, gap: str = "-") -> DataFrame:
    """Blocks cut to columns [start, end), p_start moved by the bases before (on '-' by those after)."""
    part = F.substring("seq", start + 1, end - start)
    before = F.length(ungapped(F.substring("seq", 1, start), gap))
    after = F.length(ungapped(F.substring(F.col("seq"), F.lit(end + 1), F.length("seq")), gap))
    return block.select(
        "block",
        "species",
        part.alias("seq"),
        (F.col("p_start") + F.when(F.col("strand") == "-", after).otherwise(before)).alias("p_start"),
        "strand",
    )


def slice_by_reference(cols: DataFrame, reference, start: int, end: int) -> DataFrame:
    """block, species, seq: the columns in which the reference's bases [start, end) lie, gap columns between them kept."""
    edge = cols.where(
        (F.col("species") == reference) & (F.col("base") != "-") & (F.col("u") >= start) & (F.col("u") < end)
    ).groupBy("block").agg(F.min("col").alias("_lo"), F.max("col").alias("_hi"))
    return joined_rows(cols.join(edge, "block").where("col between _lo and _hi"))


def reference_columns(cols: DataFrame, reference) -> DataFrame:
    """block, species, seq: only columns in which the reference has a base."""
    kept = cols.where((F.col("species") == reference) & (F.col("base") != "-")).select("block", "col")
    return joined_rows(cols.join(kept, ["block", "col"], "left_semi"))


def joined_rows(cols: DataFrame) -> DataFrame:
    """block, species, seq from columns."""
    parts = F.array_sort(F.collect_list(F.struct("col", "base")))
    return cols.groupBy("block", "species").agg(F.array_join(F.transform(parts, lambda x: x["base"]), "").alias("seq"))


def revcomp_blocks(block: DataFrame) -> DataFrame:
    return block.withColumns({"seq": revcomp(F.col("seq")), "strand": F.when(F.col("strand") == "-", "+").otherwise("-")})


def column_stats(cols: DataFrame) -> DataFrame:
    """block, col, match ('*' if all bases are the same upper-case one), bases (different ones, gaps not), gaps."""
    upper = F.upper("base")
    return cols.groupBy("block", "col").agg(
        F.when((F.count_distinct(upper) == 1) & F.max(F.col("base") == upper) & (F.max("base") != "-"), "*").otherwise(" ").alias("match"),
        F.count_distinct(F.when(F.col("base") != "-", F.col("base"))).alias("bases"),
        F.count_if(F.col("base") == "-").alias("gaps"),
    )


def _line(stats: DataFrame, mark: Column) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("col", mark.alias("m"))))
    return stats.groupBy("block").agg(F.array_join(F.transform(parts, lambda x: x["m"]), "").alias("line"))


def match_line(cols: DataFrame) -> DataFrame:
    return _line(column_stats(cols), F.col("match"))


def no_gap_line(cols: DataFrame, most: int = 0) -> DataFrame:
    """'.' where at most that many rows have gaps."""
    return _line(column_stats(cols), F.when(F.col("gaps") <= most, ".").otherwise(" "))


def segregating_sites(cols: DataFrame, gaps: bool = False) -> DataFrame:
    """block, col with more than one base; gaps: a gap counts as one."""
    base = F.col("base") if gaps else F.when(F.col("base") != "-", F.col("base"))
    return cols.groupBy("block", "col").agg(F.count_distinct(base).alias("n")).where("n > 1").select("block", "col", F.col("n").alias("bases"))


def private_alleles(cols: DataFrame, species, snps_only: bool = True, keep_n: bool = False) -> DataFrame:
    """block, col, base: where the species differs from all others. snps_only: no column with a gap or N."""
    own = F.max(F.when(F.col("species") == species, F.col("base")))
    per = cols.groupBy("block", "col").agg(
        own.alias("base"),
        F.collect_set(F.when(F.col("species") != species, F.col("base"))).alias("_others"),
        F.count_if(F.col("base").isin("-", "N")).alias("_odd"),
    )
    out = per.where(F.col("base").isNotNull() & (F.size("_others") > 0) & ~F.array_contains("_others", F.col("base")))
    out = out.where("_odd = 0") if snps_only else out
    return (out if keep_n else out.where("base != 'N'")).select("block", "col", "base")


def fill_gaps(cols: DataFrame) -> DataFrame:
    """cols with near: a gap's left half takes the parent place before it, the right half the one after."""
    # runs of gaps are rows: between bases of number u - 1 and u; no run needs more than both
    bases = cols.where(F.col("parent").isNotNull()).select("block", "species", F.col("u").alias("_u"), F.col("parent").alias("_p"))
    runs = cols.where(F.col("parent").isNull()).groupBy("block", "species", "u").agg(F.min("col").alias("_lo"), F.max("col").alias("_hi"))
    after = bases.select("block", "species", F.col("_u").alias("u"), F.col("_p").alias("_after"))
    before = bases.select("block", "species", (F.col("_u") + 1).alias("u"), F.col("_p").alias("_before"))
    edges = runs.join(before, ["block", "species", "u"], "left").join(after, ["block", "species", "u"], "left")
    left = (F.col("col") - F.col("_lo")) * 2 < F.col("_hi") - F.col("_lo") + 1
    near = F.when(F.col("parent").isNotNull(), F.col("parent")).when(left, F.coalesce("_before", "_after")).otherwise(F.coalesce("_after", "_before"))
    return cols.join(edges, ["block", "species", "u"], "left").withColumn("near", near).select(*cols.columns, "near")


def signal_on_columns(cols: DataFrame, signal: DataFrame, species) -> DataFrame:
    """block, col, val: a species' signal (loc, val by parent place) on alignment columns, gaps repeating the base before."""
    rows = cols.where(F.col("species") == species)
    on_base = rows.where(F.col("parent").isNotNull()).join(signal.select(F.col("loc").alias("parent"), "val"), "parent", "left").select(
        "block", (F.col("u") + 1).alias("_k"), F.coalesce("val", F.lit(0.0)).alias("val")
    )
    k = F.when(F.col("parent").isNotNull(), F.col("u") + 1).otherwise(F.col("u"))
    return rows.withColumn("_k", k).join(on_base, ["block", "_k"], "left").select("block", "col", F.coalesce("val", F.lit(0.0)).alias("val"))


def blocks_on_target(block: DataFrame, targets: DataFrame, species, key: str = "pid") -> DataFrame:
    """key, block, s, e: the parts of targets (chr = the species' parent, s, e inclusive) that the species' blocks cover, first base last."""
    rows = block.where(F.col("species") == species)
    spans = rows.select("chr", F.col("p_start").alias("s"), (F.col("p_start") + F.length(ungapped(F.col("seq"))) - 1).alias("e"), "block").where("e >= s")
    pairs = interval_join(targets.select(key, "chr", "s", "e"), spans, lambda: (F.col("r_s") <= F.col("l_e")) & (F.col("r_e") >= F.col("l_s")))
    return pairs.select(F.col(f"l_{key}").alias(key), F.col("r_block").alias("block"), F.greatest("l_s", "r_s").alias("s"), F.least("l_e", "r_e").alias("e"))


def lift_intervals(cols: DataFrame, parts: DataFrame, source, target, key: str = "pid") -> DataFrame:
    """key, block, t_s, t_e, n: where parts (key, block, s, e in the source's parent) lie in the target's, n bases aligned; parts that hit gaps only are left out."""
    both = lift(cols, source, target).where("to is not null")
    points = both.select(F.col("block").alias("chr"), F.col("from").alias("s"), F.col("from").alias("e"), "to")
    hit = interval_join(parts.select(key, F.col("block").alias("chr"), "s", "e"), points, lambda: F.col("r_s").between(F.col("l_s"), F.col("l_e")), width=256)
    return hit.groupBy(F.col(f"l_{key}").alias(key), F.col("l_chr").alias("block")).agg(
        F.min("r_to").alias("t_s"), F.max("r_to").alias("t_e"), F.count("*").alias("n")
    )


def part_columns(cols: DataFrame, parts: DataFrame, species, key: str = "pid", most: int | None = None) -> DataFrame:
    """key, block, lo, hi, status: the columns from the first to the last base of the species' parent that a part (key, block, s, e inclusive) has.

    status: unmapped where either end isn't in the block, wide where the columns are more than `most` times the part, else ok. Parts without any base have no row.
    """
    bases = cols.where((F.col("species") == species) & F.col("parent").isNotNull())
    points = bases.select(F.col("block").alias("chr"), F.col("parent").alias("s"), F.col("parent").alias("e"), "col")
    hit = interval_join(parts.select(key, F.col("block").alias("chr"), "s", "e"), points, lambda: F.col("r_s").between(F.col("l_s"), F.col("l_e")), width=256)
    span = hit.groupBy(F.col(f"l_{key}").alias(key), F.col("l_chr").alias("block"), "l_s", "l_e").agg(
        F.min("r_col").alias("lo"), F.max("r_col").alias("hi"), F.min("r_s").alias("_a"), F.max("r_s").alias("_b")
    )
    wide = F.col("hi") - F.col("lo") + 1 > most * (F.col("l_e") - F.col("l_s") + 1) if most else F.lit(False)
    status = F.when((F.col("_a") > F.col("l_s")) | (F.col("_b") < F.col("l_e")), "unmapped").when(wide, "wide").otherwise("ok")
    return span.select(key, "block", "lo", "hi", status.alias("status"))


def trimmed(block: DataFrame, spans: DataFrame, key: str = "pid", species: list | None = None, gap: str = "-") -> DataFrame:
    """key, block, species, seq, p_start, p_end, strand: all rows of the blocks cut to columns lo to hi of each span, by slices of their strings; the strand is that of the order of parent places (one base: +), a row of gaps has none.

    species: those that must be there; one that a block lacks comes as gaps.
    """
    rows = block.select("block", "species", "seq", "p_start", F.col("strand").alias("_strand")).join(spans.select(key, "block", "lo", "hi"), "block")
    n = lambda text: F.length(ungapped(text, gap))
    width = (F.col("hi") - F.col("lo") + 1).cast("int")
    part = F.substring(F.col("seq"), F.col("lo").cast("int") + 1, width)
    found = rows.select(
        key,
        "block",
        "species",
        part.alias("seq"),
        "p_start",
        "_strand",
        n(F.substring(F.col("seq"), F.lit(1), F.col("lo").cast("int"))).alias("_before"),
        n(part).alias("_m"),
        n(F.col("seq")).alias("_n"),
    )
    back = F.col("_strand") == "-"
    low = F.col("p_start") + F.when(back, F.col("_n") - F.col("_before") - F.col("_m") + 1).otherwise(F.col("_before"))
    some = (F.col("_m") > 0) & F.col("p_start").isNotNull()
    strand = F.when(some, F.when(back & (F.col("_m") > 1), "-").otherwise("+"))
    out = found.select(
        key,
        "block",
        "species",
        "seq",
        F.when(some, low).alias("p_start"),
        F.when(some, low + F.col("_m") - 1).alias("p_end"),
        strand.alias("strand"),
    )
    if species is None:
        return out
    every = spans.select(key, "block", (F.col("hi") - F.col("lo") + 1).alias("_n"), F.explode(F.array(*[F.lit(x) for x in species])).alias("species"))
    filled = F.coalesce("seq", F.repeat(F.lit(gap), F.col("_n").cast("int")))
    return every.join(out, [key, "block", "species"], "left").withColumn("seq", filled).drop("_n")


def turned(rows: DataFrame, back: Column) -> DataFrame:
    """rows (seq, strand) reverse complemented, and on the other strand, where back holds."""
    strand = F.when(back & (F.col("strand") == "+"), "-").when(back & (F.col("strand") == "-"), "+").otherwise(F.col("strand"))
    return rows.withColumns({"seq": F.when(back, revcomp(F.col("seq"))).otherwise(F.col("seq")), "strand": strand})


def isolated(fn, by: list[str], schema: str, default: dict):
    """For applyInPandas over groups of the columns by: fn(frame) gives a dict of the schema's columns; where it raises, the group gets the default and the reason in the column error."""
    names = [c.name for c in StructType.fromDDL(schema)]

    def run(frame):
        import pandas as pd

        row = {c: frame[c].iloc[0] for c in by}
        try:
            row |= fn(frame.drop(columns=by)) | {"error": None}
        except Exception as e:  # whatever one group's callback does, the others go on
            row |= {c: default.get(c) for c in names} | {"error": f"{type(e).__name__}: {e}"}
        return pd.DataFrame([[row.get(c) for c in [*by, *names, "error"]]], columns=[*by, *names, "error"])

    return run


def map_slices(
    block: DataFrame,
    targets: DataFrame,
    species,
    fn,
    schema: str,
    default: dict,
    key: str = "pid",
    pad: int = 0,
    most: int | None = None,
    fill: list | None = None,
) -> DataFrame:
    """key, the schema's columns, error: fn of the alignment around each target (key, chr, s, e, strand), one row a target whatever happens.

    block: rows with chr; targets are padded and looked up in the species' rows. fn gets a pandas frame of the slice (species, seq, p_start, p_end, strand), turned
    where the target is on '-', and returns a dict. A target gets the default, and error says why, where no block has it ("not aligned"), several have ("several blocks"), an end isn't
    in the block ("unmapped"), columns are more than `most` times its length ("wide"), or fn raises; the others don't mind. fill: species that must be in a slice, as gaps if need be.
    """
    asked = targets.select(key, "chr", (F.col("s") - pad).alias("s"), (F.col("e") + pad).alias("e"), "strand")
    parts = checkpoint(blocks_on_target(block, asked, species, key))
    number = parts.groupBy(key).agg(F.count("*").alias("_n"))
    one = parts.join(number.where("_n = 1"), key, "left_semi").select(key, "block").join(asked.select(key, "s", "e"), key)
    own = block.where(F.col("species") == species).join(one.select("block").distinct(), "block", "left_semi")
    spans = checkpoint(part_columns(with_parent(columns(own), own), one, species, key, most))
    rows = trimmed(block, spans.where("status = 'ok'"), key, fill).join(targets.select(key, F.col("strand").alias("_strand")), key)
    rows = turned(rows, F.col("_strand") == "-").select(key, "species", "seq", "p_start", "p_end", "strand")
    kind = dict(targets.dtypes)[key]
    done = rows.groupBy(key).applyInPandas(isolated(fn, [key], schema, default), f"{key} {kind}, {schema}, error string")
    names = [c.name for c in StructType.fromDDL(schema)]
    why = F.when(F.col("_n").isNull(), "not aligned").when(F.col("_n") > 1, "several blocks").when(
        F.col("status") != "ok", F.col("status")
    ).when(F.col("_done").isNull(), "unmapped").otherwise(F.col("error"))
    found = targets.select(key).join(number, key, "left").join(spans.select(key, "status"), key, "left").join(
        done.withColumn("_done", F.lit(True)), key, "left"
    ).withColumn("error", why)
    types = {c.name: c.dataType for c in StructType.fromDDL(schema)}
    return found.select(key, *[F.when(F.col("_done"), F.col(c)).otherwise(F.lit(default.get(c)).cast(types[c])).alias(c) for c in names], "error")


def unlifted(targets: DataFrame, lifted: DataFrame, key: str = "pid") -> DataFrame:
    return targets.join(lifted.select(key).distinct(), key, "left_anti")


def shared_sites(a: DataFrame, b: DataFrame, slack: int = 3) -> DataFrame:
    """One row: sites (chr, s, e) of a and b, both in one coordinate system, and pairs with starts or ends under slack apart."""
    # pairs with near starts and those with near ends, less those with both: sums of products of counts, without a row a pair
    width = max(8, 2 * slack)
    bins = lambda c, reach: F.explode(F.sequence(F.floor((F.col(c) - reach) / width), F.floor((F.col(c) + reach) / width)))
    both = None
    for sign, at in ((1, ["s"]), (1, ["e"]), (-1, ["s", "e"])):
        x, y = (t.groupBy("chr", *at).agg(F.count("*").alias("n")) for t in (a, b))
        for c in at:
            x, y = x.withColumn(f"_{c}", bins(c, slack)), y.withColumn(f"_{c}", bins(c, 0))
        x = x.withColumnsRenamed({**{c: f"x{c}" for c in at}, "n": "nx"})
        pairs = x.join(y, ["chr", *[f"_{c}" for c in at]])
        for c in at:
            pairs = pairs.where(F.abs(F.col(f"x{c}") - F.col(c)) < slack)
        part = pairs.agg((sign * F.coalesce(F.sum(F.col("nx") * F.col("n")), F.lit(0))).alias("n"))
        both = part if both is None else both.union(part)
    both = both.agg(F.sum("n").alias("both"))
    counts = a.agg(F.count("*").alias("a")).join(b.agg(F.count("*").alias("b"))).join(both)  # one row each
    return counts.select("both", (F.col("a") - F.col("both")).alias("only_a"), (F.col("b") - F.col("both")).alias("only_b"))


def apply_to_slices(cols: DataFrame, parts: DataFrame, fn, schema: str, key: str = "pid") -> DataFrame:
    """fn(pandas frame of one part's columns: key, block, species, col, base) for each part (key, block, lo, hi in columns)."""
    rows = cols.join(parts.select(key, "block", "lo", "hi"), "block").where("col between lo and hi").select(key, "block", "species", "col", "base")
    return rows.groupBy(key, "block").applyInPandas(fn, schema)


def clustal(block: DataFrame, width: int = 60) -> DataFrame:
    """block, part, species, line: names padded to 20 and the row's stretch of that width."""
    n = F.ceil(F.length("seq") / width).cast("int")
    part = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("part")
    rows = block.select("block", "species", "seq", part)
    return rows.select(
        "block",
        "part",
        "species",
        F.concat(
            F.rpad(F.col("species").cast("string"), 20, " "), F.substring(F.col("seq"), F.col("part") * width + 1, F.lit(width))
        ).alias("line"),
    )


def fasta_lines(block: DataFrame) -> DataFrame:
    """block, species, text: '>species parent:start-end:strand' over the row."""
    end = F.col("p_start") + F.length(ungapped(F.col("seq")))
    head = F.concat(
        F.lit(">"),
        F.col("species").cast("string"),
        F.lit(" "),
        F.col("block").cast("string"),
        F.lit(":"),
        F.col("p_start").cast("string"),
        F.lit("-"),
        end.cast("string"),
        F.lit(":"),
        F.col("strand"),
    )
    return block.select("block", "species", F.concat(head, F.lit("\n"), F.col("seq")).alias("text"))
