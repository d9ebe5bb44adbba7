"""Merkle fixity audit of WARC replicas.

Records of a WARC file are hashed where they lie; ordered offset ranges of RANGE bytes hash their records' digests, and
FAN neighbouring ranges the node above them, up to one root a file. The audit compares the roots of two replicas
and goes down only where digests differ, a level at a time, until it reaches records. Each level of a tree is written apart, as a
checkpoint from which the next one up is made; going down, a level is read once and only children of differing nodes are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

FILE_PAGES = 1_000
RANGE = 1 << 16
FAN = 16
#: Files that records without a page_id are dealt over, by the first three digits of their digest.
NULL_FILES = 16**3


def records(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """file, offset, length, page_id, record: one WARC record a page; file_pages consecutive ids share a file.

    A null url is empty; a null html is an empty, truncated payload. Records without an id are
    dealt over NULL_FILES files, numbered down from -1, by their digest. Repeated rows are records one after another.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        url,
        F.when(F.col("html").isNull(), F.lit("\r\nWARC-Truncated: unspecified")).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
        html,
        F.lit("\r\n\r\n"),
    )
    spread = F.lit(-1) - F.conv(F.substring(F.sha2("record", 256), 1, 3), 16, 10).cast("long")
    file = F.when(F.col("page_id").isNull(), spread).otherwise(F.floor(F.col("page_id") / file_pages)).cast("long")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), record.alias("record")).select(file.alias("file"), "page_id", "record")


def index(rows: DataFrame, *more: str) -> DataFrame:
    """file, offset, length, page_id, digest and the columns named more: records in the order of page_id; digests are taken before the shuffle, so that no payload moves."""
    small = rows.select("file", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), *more)
    order = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return small.select("file", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"), "length", "page_id", "digest", *more)


def tree(located: DataFrame, extent: int, span: int = RANGE, fan: int = FAN) -> list[DataFrame]:
    """(file, node, digest) by level, each a checkpoint: level 0 are the offsets of records, level 1 ranges of span bytes, up to one node a file of extent bytes at most.

    located: file, offset, digest. Of records at one offset all digests count.
    """
    level = located.groupBy("file", F.col("offset").alias("node"), "digest").agg(F.count("*").alias("n"))
    level = level.groupBy("file", "node").agg(
        F.array_join(
            F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.concat_ws("x", "digest", "n")).otherwise(F.col("digest")))), "+"
        ).alias("digest"),
    )
    levels, size = [checkpoint(level)], 1
    while size < extent:
        step = span if len(levels) == 1 else fan
        size *= step
        parts = F.array_sort(F.collect_list(F.struct("node", "digest")))
        level = levels[-1].groupBy("file", F.floor(F.col("node") / step).alias("up")).agg(
            F.sha2(
                F.array_join(F.transform(parts, lambda x: F.concat_ws(":", x["node"].cast("string"), x["digest"])), "\n"), 256
            ).alias("digest"),
        )
        levels.append(checkpoint(level.withColumnRenamed("up", "node")))
    return levels


def audit(a: DataFrame, b: DataFrame, span: int = RANGE, fan: int = FAN) -> DataFrame:
    """file, offset, status, digest_a, digest_b of each record in which the replicas differ: changed, missing or extra in b.

    a, b: file, offset, digest. Null files are not audited. An empty replica makes all records of the other differ;
    two empty or equal ones give no rows.
    """
    a, b = a.where("file is not null"), b.where("file is not null")
    extent = max(x.agg(F.max("offset")).first()[0] or 0 for x in (a, b)) + 1
    trees = [tree(x, extent, span, fan) for x in (a, b)]
    found = front = None
    for number in reversed(range(len(trees[0]))):
        sides = []
        for levels, name in zip(trees, "ab", strict=True):
            rows = levels[number]
            if front is not None:
                up = F.floor(F.col("node") / (span if number == 0 else fan))
                rows = rows.withColumn("up", up).join(front, ["file", "up"], "left_semi")
            sides.append(rows.select("file", "node", F.col("digest").alias(f"digest_{name}")))
        found = checkpoint(sides[0].join(sides[1], ["file", "node"], "full").where("not (digest_a <=> digest_b)"))
        front = found.select("file", F.col("node").alias("up"))
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    return found.select("file", F.col("node").alias("offset"), status.alias("status"), "digest_a", "digest_b")


def damaged(pages: DataFrame) -> DataFrame:
    """file, offset, digest of a replica of these pages, hashed from its own bytes, with known damage: of some records a byte is changed, some are lost, and some are followed by a stray one.

    Records without an id are never damaged; repeated rows are damaged alike. No pages give no rows.
    """
    rotten = F.concat(F.lit("X"), F.substring(F.col("record"), F.lit(2), F.length("record")))
    rows = records(pages).withColumn("copy", F.when(F.col("page_id") % 101 == 7, rotten).otherwise(F.col("record")))
    rows = rows.withColumns({"digest_b": F.sha2("copy", 256), "stray": F.when(F.col("page_id") % 509 == 11, F.sha2(F.concat(F.lit("stray "), "copy"), 256))})
    found = index(rows, "digest_b", "stray")
    kept = found.where("page_id is null or page_id % 211 != 5").select("file", "offset", F.col("digest_b").alias("digest"))
    return kept.unionByName(found.where("stray is not null").select("file", (F.col("offset") + 1).alias("offset"), F.col("stray").alias("digest")))


SQL = r"""
with r as (
  select page_id, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''),
      case when html is null then concat(chr(13), chr(10), 'WARC-Truncated: unspecified') else '' end,
      chr(13), chr(10), 'Content-Length: ', cast(strlen(coalesce(html, '')) as varchar), chr(13), chr(10), chr(13), chr(10),
      coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) as record
  from pages),
d as (
  select coalesce(cast(floor(page_id / 1000.0) as bigint), -1 - ('0x' || substr(sha256(record), 1, 3))::bigint) as file, page_id, record, strlen(record) as length, sha256(record) as digest
  from r),
o as (
  select file, page_id, record, digest, cast(coalesce(sum(length) over (partition by file order by page_id, digest
    rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from d)
select file, "offset", 'changed' as status, digest as digest_a, sha256('X' || substr(record, 2)) as digest_b
from o where page_id % 101 = 7 and page_id % 211 != 5
union all
select file, "offset", 'missing', digest, null from o where page_id % 211 = 5
union all
select file, "offset" + 1, 'extra', null, sha256('stray ' || case when page_id % 101 = 7 then 'X' || substr(record, 2) else record end) from o where page_id % 509 = 11
"""
