"""Exact top-k search of binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into m segments. Two codes at distance d agree in some segment to within d / m bits, so after all
segments were searched to radius r, every code at distance m * (r + 1) - 1 or less has been seen. Radii grow by one a
round; a query leaves when its k-th verified distance is covered that way. Each round sends a query, for each segment, to the
buckets whose leading bits are within r of its own; there members at segment distance r exactly are verified, and only
those that may still enter the query's best go back. Equal codes are one class throughout, with the k + 1 least ids
of each, which no answer can exceed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, sorted_groups

BITS = 64
K = 10
#: Codes in a bucket, about.
BUCKET = 512
FOUND = pa.schema([("query", pa.int64()), ("code", pa.int64()), ("distance", pa.int32()), ("n", pa.int64()), ("least", pa.int64())])


def sign_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code: bit i is 1 where component i is positive; nulls count as not positive. Null ids and null vectors have no code; a vector of more than 64 components fails, as its code would be that of a prefix."""
    bits = F.transform("embedding", lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    shifted = F.transform(bits, lambda x, i: F.call_function("shiftleft", x, i))
    code = F.aggregate(shifted, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    short = F.when(F.size("embedding") > BITS, F.raise_error(F.lit(f"vectors have more than {BITS} components"))).otherwise(code)
    return vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), short.cast("long").alias("code"))


def _segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of each."""
    widths = [BITS // m + (k < BITS % m) for k in range(m)]
    return [(sum(widths[k + 1 :]), widths[k]) for k in range(m)]


def _value(code, shift: int, width: int):
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1)) if width < BITS else code


def _flipped(prefix, masks: list[int], segment: int):
    """Bucket keys: the prefix with each mask's bits flipped, under the segment's number."""
    all_masks = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>")
    return F.transform(all_masks, lambda x: prefix.bitwiseXOR(x).bitwiseOR(F.lit(segment << 48)))


def _keys(rows: DataFrame, m: int, lead: int, radius: int | None) -> DataFrame:
    """A row for each segment, of index rows in their bucket, of queries (radius given) in each bucket within the radius: key, segment."""
    parts = []
    for s, (shift, width) in enumerate(_segments(m)):
        bits = min(lead, width)
        prefix = F.shiftrightunsigned(_value(F.col("code"), shift, width), width - bits)
        masks = [sum(1 << b for b in c) for d in range(min(radius or 0, bits) + 1) for c in combinations(range(bits), d)]
        parts.append(_flipped(prefix, masks, s))
    return rows.withColumn("key", F.explode(F.concat(*parts)))


def _probe(m: int, radius: int, most: int):
    segments = _segments(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches):
            key, bound, code, n, least = (table.column(i).to_numpy() for i in range(5))
            code = code.view(np.uint64)
            edges = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))
            found: list[np.ndarray] = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                first = lo + int(np.searchsorted(bound[lo:hi], 0))  # members have the bound -1
                if first == lo or first == hi:
                    continue
                shift, width = segments[int(key[lo]) >> 48]
                mask = np.uint64(((1 << width) - 1) << shift)
                members = code[lo:first]
                for a in range(first, hi, max(1, 2_000_000 // len(members))):
                    b = min(hi, a + max(1, 2_000_000 // len(members)))
                    apart = code[a:b, None] ^ members[None, :]
                    distance = np.bitwise_count(apart)
                    i, j = np.nonzero((np.bitwise_count(apart & mask) == radius) & (distance <= bound[a:b, None]))
                    if not len(i):
                        continue
                    d = distance[i, j]
                    by = np.lexsort((least[lo + j], d, i))
                    i, j, d = i[by], j[by], d[by]
                    new = np.concatenate(([True], i[1:] != i[:-1]))
                    rank = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
                    keep = rank < most
                    i, j, d = i[keep] + a, j[keep] + lo, d[keep]
                    found.append(np.stack([code[i].view(np.int64), code[j].view(np.int64), d.astype(np.int64), n[j], least[j]]))
            if found:
                flat = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(flat, FOUND, strict=True)], schema=FOUND)

    return run


def top_k(codes: DataFrame, queries: DataFrame, k: int = K, m: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, distance: for each row of queries the k nearest other ids of codes, by (distance, vec_id).

    Both have vec_id and code; rows repeated in either count once. Fewer than k where there aren't as many. Without
    codes or queries there are no rows.
    """
    most = k + 1  # a query finds itself
    codes = checkpoint(codes.select("vec_id", "code").distinct())
    queries = checkpoint(queries.select("vec_id", "code").distinct())
    by_id = Window.partitionBy("code").orderBy("vec_id")
    members = codes.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= most).drop("place")
    classes = checkpoint(codes.groupBy("code").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")))
    total, rows = classes.count(), codes.count()
    m = m or max(1, min(16, round(BITS / math.log2(max(rows, 16)))))
    lead = max(0, round(math.log2(max(total, 1) / BUCKET)))
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = checkpoint(_keys(classes, m, lead, None).select("key", F.lit(-1).alias("bound"), "code", "n", "least"))
    active = checkpoint(queries.select("code").distinct().withColumn("bound", F.lit(BITS)))
    found = None
    done: list[DataFrame] = []
    for radius in range(max(w for _, w in _segments(m)) + 1):
        if not active.take(1):
            break
        probes = _keys(active, m, lead, radius).select("key", "bound", "code", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("least"))
        both = index.unionByName(probes).repartition(parts, "key").sortWithinPartitions("key", "bound")
        new = both.mapInArrow(_probe(m, radius, most), "query long, code long, distance int, n long, least long")
        best = Window.partitionBy("query").orderBy("distance", "least")
        merged = (new if found is None else found.unionByName(new)).distinct()
        merged = merged.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
        merged = merged.withColumn("before", F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        merged = checkpoint(merged)
        # the distance by which k others and itself are seen
        kth = merged.groupBy("query").agg(F.min(F.when(F.col("before") + F.col("n") >= most, F.col("distance"))).alias("kth"), F.count("*").alias("seen"))
        state = active.join(kth, active.code == kth.query, "left").select(
            "code", F.coalesce("kth", F.lit(BITS)).alias("bound"), F.coalesce("seen", F.lit(0)).alias("seen")
        )
        state = checkpoint(state.withColumn("over", (F.col("bound") <= m * (radius + 1) - 1) | (F.col("seen") >= total)))
        done.append(merged.join(state.where("over"), merged.query == state.code, "left_semi").select("query", "code", "distance"))
        found = checkpoint(merged.join(state.where("not over"), merged.query == state.code, "left_semi").drop("place", "before"))
        active = state.where("not over").select("code", "bound")
    out = found.select("query", "code", "distance") if found is not None else codes.sparkSession.createDataFrame([], "query long, code long, distance int")
    for d in done:
        out = out.unionByName(d)
    near = Window.partitionBy("query").orderBy("distance", "vec_id")
    ids = out.join(members, "code").withColumn("place", F.row_number().over(near)).where(F.col("place") <= most).select("query", "vec_id", "distance")
    named = ids.join(queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query")), "query").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return named.select("query_id", rank.alias("rank"), "vec_id", "distance").where(F.col("rank") <= k)


def search(vectors: DataFrame, k: int = K, every: int = 50) -> DataFrame:
    """The k nearest, by sign codes, of each vector whose id is divisible by every, among all vectors.

    Rows without an id or a vector take no part, null components count as not positive, rows alike in id and code count once, equal distances go by vec_id. Without
    vectors there are no rows. Other columns go.
    """
    codes = checkpoint(sign_codes(vectors))
    return top_k(codes, codes.where(F.col("vec_id") % every == 0), k)


SQL = """
with c as (select distinct vec_id, list_transform(embedding, lambda x: x > 0) as s from embeddings where vec_id is not null and embedding is not null),
d as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.s, c.s), lambda z: cast(z[1] != z[2] as integer))) as integer) as distance
  from c q join c on c.vec_id != q.vec_id where q.vec_id % 50 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by distance, vec_id) as integer) as rank, vec_id, distance from d)
select query_id, rank, vec_id, distance from r where rank <= 10
"""
