"""Sinks: rows as lines of the text formats, and files of them partitioned by chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import next_value, running_sum


def bed(hits: DataFrame) -> DataFrame:
    """chr, value: chr, start, end, name, score, strand and ln_p where there is one, by tabs."""
    more = ["ln_p"] if "ln_p" in hits.columns else []
    return hits.select("chr", F.concat_ws("\t", *[F.col(c).cast("string") for c in ["chr", "start", "end", "name", "score", "strand", *more]]).alias("value"))


def tss_bed(genes: DataFrame, window: int, name: str = "gid") -> DataFrame:
    """value: the window around the start of '+' genes, the end of others."""
    tss = F.when(F.col("strand") == "-", F.col("e")).otherwise(F.col("s"))
    return genes.select(
        F.concat_ws(
            "\t",
            F.col("chr").cast("string"),
            (tss - window).cast("string"),
            (tss + window).cast("string"),
            F.col(name).cast("string"),
            F.lit("0"),
            F.col("strand"),
        ).alias("value"),
    )


def bedgraph(signal: DataFrame) -> DataFrame:
    """value of chr, start, end, val."""
    return signal.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("chr", "start", "end", "val")]).alias("value"))


def sgr_bedgraph(signal: DataFrame) -> DataFrame:
    """value of chr, loc, val: start and end are both loc."""
    return bedgraph(signal.select("chr", F.col("loc").alias("start"), F.col("loc").alias("end"), "val"))


def sgr(signal: DataFrame) -> DataFrame:
    return signal.select(F.concat_ws("\t", F.col("chr").cast("string"), F.col("loc").cast("string"), F.col("val").cast("string")).alias("value"))


def fixed_wig(signal: DataFrame, parity: bool = False, exclude: tuple = ()) -> DataFrame:
    """chr, n, value: a header (n 0) and the values of each chromosome in order. signal: chr, loc from 0, val.

    parity: as the older scripts write, the last value of every chromosome and the first of the first one are lost. The
    step is that of the first two rows of the first chromosome.
    """
    rows = signal.where(~F.col("chr").isin(list(exclude))) if exclude else signal
    first = rows.agg(F.min("chr").alias("c"))
    lead = rows.join(F.broadcast(first), F.col("chr") == F.col("c")).select("chr", "loc").distinct().orderBy("loc").limit(2).collect()
    step = lead[1]["loc"] - lead[0]["loc"] if len(lead) > 1 else 1
    placed = running_sum(next_value(rows, ["chr"], "loc", "_next"), ["chr"], [], "loc", F.lit(1), "n").withColumn("_last", F.col("_next").isNull())
    if parity:
        lost = F.col("_last") | ((F.col("chr") == lead[0]["chr"]) & (F.col("n") == 1)) if lead else F.lit(False)
        placed = placed.where(~lost)
    start = placed.groupBy("chr").agg((F.min("loc") + 1).alias("s"))
    head = start.select(
        "chr",
        F.lit(0).alias("n"),
        F.concat(
            F.lit("fixedStep chrom=chr"), F.col("chr").cast("string"), F.lit(" start="), F.col("s").cast("string"), F.lit(f" step={step}")
        ).alias("value"),
    )
    return head.unionByName(placed.select("chr", "n", F.col("val").cast("string").alias("value")))


def variable_wig(signal: DataFrame, span: int) -> DataFrame:
    """chr, start, value: a header (start 0) a chromosome, then start and value."""
    head = signal.select("chr").distinct().select(
        "chr",
        F.lit(0).cast("long").alias("start"),
        F.concat(F.lit("variableStep chrom=chr"), F.col("chr").cast("string"), F.lit(f" span={span}")).alias("value"),
    )
    return head.unionByName(
        signal.select(
            "chr",
            F.col("start").cast("long").alias("start"),
            F.concat_ws(" ", F.col("start").cast("string"), F.col("val").cast("string")).alias("value"),
        ),
    )


def fasta(seqs: DataFrame, name, width: int = 60) -> DataFrame:
    """value: '>name' and the sequence in lines of width; an empty or null sequence has no lines."""
    lines = F.rtrim(F.regexp_replace("seq", f"(.{{1,{width}}})", "$1\n"), F.lit("\n"))
    body = F.when(F.length("seq") > 0, F.concat(F.lit("\n"), lines)).otherwise("")
    return seqs.select(F.concat(F.lit(">"), name, body).alias("value"))


def region_name(chrom: str = "chr", start: str = "start", end: str = "end"):
    return F.concat(F.col(chrom).cast("string"), F.lit(":"), F.col(start).cast("string"), F.lit(".."), F.col(end).cast("string"))


def tba_header(seqs: DataFrame, file: str = "file", name: str = "name") -> DataFrame:
    return seqs.select(F.concat(F.lit(">"), F.concat_ws(":", file, name, F.lit("1"), F.lit("+"), F.length("seq").cast("string"))).alias("value"))


def fastq_from_export(rows: DataFrame) -> DataFrame:
    head = F.format_string("@%s_%04d:%s:%s:%s:%s#%s/%s", "machine", "run", "lane", "tile", "x", "y", "idx", "read")
    return rows.select(F.concat_ws("\n", head, "seq", F.lit("+"), "qual").alias("value"))


def gaussian_deck(atoms: DataFrame, title: str = "atoms") -> DataFrame:
    """n, value: coordinates of atoms below a title, in the order of n."""
    at = F.format_string("%-2s %12.6f %12.6f %12.6f", "element", "x", "y", "z")
    head = atoms.sparkSession.createDataFrame([(-2, "#P HF/6-31G*"), (-1, title)], "n long, value string")
    return head.unionByName(atoms.select("n", at.alias("value")))


def split_by(rows: DataFrame, key: str, path: str) -> None:
    """A folder of text for each key."""
    rows.select(key, "value").write.partitionBy(key).text(path)


def append_new(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows whose key the table lacks: what to append."""
    return rows.join(table.select(key).distinct(), key, "left_anti")


def mixed_fastq(a: DataFrame, b: DataFrame, share: float, n: int, seed: int = 1) -> DataFrame:
    """i, name, seq, qual: n draws, from a with that chance, each side taken in the order of name; a side that ran out gives nulls."""
    from ..operators.coverage import with_rank
    from ..operators.motif import drawn

    # 60 bits of a draw that other engines can repeat
    u = drawn(str(seed), F.col("id")) / float(1 << 60)
    draws = a.sparkSession.range(n).select(F.col("id").alias("i"), F.when(u <= share, 0).otherwise(1).alias("side"))
    draws = running_sum(draws, ["side"], [], "i", F.lit(1), "rank")
    both = with_rank(a, F.col("name"), "name").withColumn("side", F.lit(0)).unionByName(with_rank(b, F.col("name"), "name").withColumn("side", F.lit(1)))
    return draws.join(both, ["side", "rank"], "left").select("i", "name", "seq", "qual")


def with_new_ids(table: DataFrame, names: DataFrame, name: str, id_: str = "id") -> DataFrame:
    """table (id, name) and a row for each name that it lacks, numbered on in the order of names: what a get-or-create of keys leaves."""
    from ..operators.coverage import with_rank

    fresh = append_new(names.select(name).distinct(), table, name)
    last = table.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_last"))
    numbered = with_rank(fresh, F.col(name), name, "_rank").join(F.broadcast(last))  # one row
    return table.select(id_, name).unionByName(numbered.select((F.col("_last") + F.col("_rank")).alias(id_), name))


def count_stages(counts: DataFrame, to: float = 1e6, limit: int = 3) -> DataFrame:
    """stage (raw, norm, lim), chr, strand, loc, val: what a store keeps of one experiment."""
    from ..operators.coverage import limit_tags, normalize

    rows = limit_tags(normalize(counts, to).withColumn("_raw", F.col("n")), limit)
    # one pass, so that no stage of the store counts the tags again
    each = [F.struct(F.lit(s).alias("stage"), F.col(c).cast("double").alias("val")) for s, c in (("raw", "_raw"), ("norm", "norm"), ("lim", "n"))]
    return rows.select("chr", "strand", "loc", F.inline(F.array(*each))).select("stage", "chr", "strand", "loc", "val")


def write_store(stages: DataFrame, path: str) -> None:
    """Parquet by stage and chromosome, so that a reader opens only what it names."""
    stages.write.partitionBy("stage", "chr").parquet(path)
