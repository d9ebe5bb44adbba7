"""A store of whole-genome alignments that opens only what an interval needs.

Layout below the store's path: `rows/` holds a row a block and species, by partitions version, species, chr and bin (where the row begins in its parent),
sorted within; `members/` which partition each block's rows are in, by buckets of a hash of the block; `catalogue/`
a row a partition: how many rows it has and which interval they cover. An append writes rows and members under a version of its own and its catalogue
last, by one committed file, so that readers see all of an append or nothing, and old ones stay as they are.

A target interval is planned on the catalogue: the partitions whose cover meets it become partition filters of the scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import ungapped
from ..operators.intervals import interval_join

#: Bases of a parent in a bin.
BIN = 1 << 20
#: Buckets of blocks in the members table.
BUCKETS = 64
#: Partitions that are planned by name, at most; more are found by a join.
PLANNED = 4096
COLUMNS = ["block", "species", "chr", "p_start", "p_end", "strand", "seq", "score"]


def _bucket(block: str | Column) -> Column:
    return F.pmod(F.xxhash64(F.col(block).cast("string") if isinstance(block, str) else block), F.lit(BUCKETS)).cast("int")


def append(block: DataFrame, path: str, width: int = BIN) -> str:
    """Adds rows (block, species, chr, p_start, strand, seq, and score if there is one) and returns their version.

    block, species and chr are kept as text. p_end is the last base's place; a row of gaps ends before it begins. Rows without a place (null chr or p_start) are in bin -1.
    """
    version = uuid.uuid4().hex
    rows = block if "score" in block.columns else block.withColumn("score", F.lit(None).cast("double"))
    text = [F.col(c).cast("string").alias(c) for c in ("block", "species", "chr")]
    end = F.col("p_start") + F.length(ungapped(F.col("seq"))) - 1
    rows = rows.select(
        *text,
        F.col("p_start").cast("long").alias("p_start"),
        end.cast("long").alias("p_end"),
        "strand",
        "seq",
        F.col("score").cast("double").alias("score"),
    )
    placed = F.col("chr").isNotNull() & F.col("p_start").isNotNull()
    rows = rows.withColumns({"version": F.lit(version), "bin": F.when(placed, F.floor(F.col("p_start") / width)).otherwise(F.lit(-1)).cast("long")})
    # a partition's rows meet in one task and one file; partitions are many
    rows.repartition("species", "chr", "bin").sortWithinPartitions(
        "species", "chr", "bin", "p_start"
    ).write.mode("append").partitionBy("version", "species", "chr", "bin").parquet(f"{path}/rows")
    session = block.sparkSession
    written = _scan(session, path, [version])
    where = written.select("version", _bucket("block").alias("bucket"), "block", "species", "chr", "bin")
    where.repartition("bucket").sortWithinPartitions("bucket", "block").write.mode("append").partitionBy("version", "bucket").parquet(f"{path}/members")
    cover = written.groupBy("version", "species", "chr", "bin").agg(F.count("*").alias("n"), F.min("p_start").alias("lo"), F.max("p_end").alias("hi"))
    cover.coalesce(1).write.mode("append").parquet(f"{path}/catalogue")
    return version


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """version, species, chr, bin, n, lo, hi: a row a partition of all appends that are complete."""
    return spark.read.schema("version string, species string, chr string, bin long, n long, lo long, hi long").parquet(f"{path}/catalogue")


def _scan(spark: SparkSession, path: str, versions: list[str] | None = None) -> DataFrame:
    schema = "block string, p_start long, p_end long, strand string, seq string, score double, version string, species string, chr string, bin long"
    found = spark.read.schema(schema).parquet(f"{path}/rows")
    return found if versions is None else found.where(F.col("version").isin(versions))


def _committed(spark: SparkSession, path: str) -> DataFrame:
    """All rows of complete appends; their number is how often the store was appended to."""
    return _scan(spark, path, [r.version for r in catalogue(spark, path).select("version").distinct().collect()])


def _from(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Rows of the partitions wanted (version, species, chr, bin): by partition filters where they are few, else by a join on the partition columns."""
    keys = ["version", "species", "chr", "bin"]
    wanted = wanted.select(*keys).distinct()
    few = wanted.limit(PLANNED + 1).collect()
    rows = _scan(spark, path)
    if len(few) > PLANNED:
        same = rows["version"].eqNullSafe(
            wanted["version"]
        ) & rows["species"].eqNullSafe(wanted["species"]) & rows["chr"].eqNullSafe(wanted["chr"]) & (rows["bin"] == wanted["bin"])
        return rows.join(wanted, same, "left_semi")
    for k in keys:
        values = {r[k] for r in few}
        known = sorted(v for v in values if v is not None)
        rows = rows.where(F.col(k).isin(known) | F.col(k).isNull() if None in values else F.col(k).isin(known))
    if not few:
        return rows
    # the columns' filters open a superset; what they open too much goes by the whole key
    key = F.concat_ws("\x01", *[F.coalesce(F.col(k).cast("string"), F.lit("\x02")) for k in keys])
    return rows.where(key.isin(["\x01".join("\x02" if r[k] is None else str(r[k]) for k in keys) for r in few]))


def of_species(spark: SparkSession, path: str, species: list, strict: bool = True) -> DataFrame:
    """All rows of those species; only their partitions are read. strict: one that the store lacks fails, by the catalogue."""
    wanted = [str(s) for s in species]
    held = {r.species for r in catalogue(spark, path).where(F.col("species").isin(wanted)).select("species").distinct().collect()}
    if strict and held != set(wanted):
        raise ValueError(f"the store lacks {sorted(set(wanted) - held)}")
    return _committed(spark, path).where(F.col("species").isin(wanted)).select(*COLUMNS)


def on_interval(spark: SparkSession, path: str, species, chrom, start: int, end: int) -> DataFrame:
    """The species' rows that cover some of [start, end] of chrom, both included."""
    wanted = catalogue(spark, path).where((F.col("species") == str(species)) & (F.col("chr") == str(chrom)) & (F.col("lo") <= end) & (F.col("hi") >= start))
    return _from(spark, path, wanted).where((F.col("p_start") <= end) & (F.col("p_end") >= start)).select(*COLUMNS)


def on_targets(spark: SparkSession, path: str, targets: DataFrame, species, width: int = BIN) -> DataFrame:
    """The species' rows of the partitions whose cover meets a target (chr, s, e, both included); what of them meets which target is blocks_on_target()'s."""
    known = catalogue(spark, path).where(F.col("species") == str(species)).select(
        "version", "species", "bin", "chr", F.col("lo").alias("s"), F.col("hi").alias("e")
    ).where("e >= s")
    asked = targets.select(F.col("chr").cast("string").alias("chr"), "s", "e").distinct()
    pairs = interval_join(known, asked, lambda: (F.col("r_s") <= F.col("l_e")) & (F.col("r_e") >= F.col("l_s")), how="semi", width=width)
    return _from(spark, path, pairs).select(*COLUMNS)


def whole_blocks(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """All species' rows of those blocks (column block): their buckets of the members table name the partitions to read."""
    ids = blocks.select(F.col("block").cast("string").alias("block")).distinct()
    buckets = [r[0] for r in ids.select(_bucket("block")).distinct().collect()]  # at most BUCKETS
    versions = [r.version for r in catalogue(spark, path).select("version").distinct().collect()]
    members = spark.read.schema("block string, species string, chr string, bin long, version string, bucket int").parquet(f"{path}/members")
    members = members.where(F.col("version").isin(versions) & F.col("bucket").isin(buckets)).join(ids, "block", "left_semi")
    return _from(spark, path, members).join(ids, "block", "left_semi").select(*COLUMNS)


def load_maf(spark: SparkSession, files: str, path: str) -> str:
    """Appends the blocks of MAF files; a block is called by its file and place. On '-' the parent's start counts from its other end, and is turned."""
    from .readers import parse_maf, records

    pieces = records(spark, files, "\n\n").where(F.col("value").rlike(r"(?m)^a\b"))
    named = pieces.withColumn("block", F.concat_ws(":", F.regexp_extract("file", r"([^/]+)$", 1), F.lpad(F.hex(F.xxhash64("value")), 16, "0")))
    rows = named.select("block", F.struct("value").alias("_p")).select("block", "_p.value")
    parsed = parse_maf(rows, keep=["block"])
    start = F.when(F.col("strand") == "-", F.col("src_size") - F.col("start") - F.col("size")).otherwise(F.col("start"))
    return append(parsed.select("block", "species", "chr", start.alias("p_start"), "strand", "seq", "score"), path)
