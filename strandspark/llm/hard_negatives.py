"""Hard negatives by a vantage-point tree over norm-augmented vectors.

With one component more, the root of M less its squared norm (M: the greatest squared norm), all vectors have equal norms, and the
distance from a query with a zero there falls as the inner product grows: a window of scores is an annulus around the query. A tree of vantage points,
fitted on a bounded sample, deals every row to a leaf by its distances from the points on its way; each leaf knows the least and
greatest of those. Triangle inequalities then bound the distances between a query and a leaf. A search takes, for each window, the leaves that
meet its annulus, nearest first, FIRST of them and then GROWTH times as many each round, until the k-th row found is nearer than any
leaf left. Leaves are cut into blocks of bounded size, so that no leaf is one task's; results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

SCALE = 256
#: Components of integer vectors stay under it either way; larger ones fail.
LARGEST = 2**27
#: Squared norms stay under it, so that a hundred times a score fits in 64 bits.
LARGEST_NORM = 2**55
#: Rows to fit the tree on, at most, by a hash of the id; 8 and more for a leaf.
SAMPLE = 16_384
#: Rows of a leaf, about; leaves, at most; rows of a block, about.
LEAF, MOST_LEAVES, BLOCK = 1024, 2048, 2048
FIRST, GROWTH = 4, 4
#: Bounds of scores give way by this share of the squared norms, for rounding.
SLACK = 1e-7
#: Scores of any row lie between.
ANY = 2**62
POSITIVES, NEGATIVES = 5, 10
FOUND = pa.schema(
    [
        ("anchor_id", pa.int64()),
        ("anchor_key", pa.int64()),
        ("win", pa.int32()),
        ("vec_id", pa.int64()),
        ("key", pa.int64()),
        ("score", pa.int64()),
    ],
)
PROBES = pa.schema(
    [
        ("block", pa.int64()),
        ("kind", pa.int32()),
        ("vec_id", pa.int64()),
        ("key", pa.int64()),
        ("label", pa.int32()),
        ("v", pa.list_(pa.int32())),
        ("lo", pa.list_(pa.int64())),
        ("hi", pa.list_(pa.int64())),
    ],
)
PROBES_DDL = "block long, kind int, vec_id long, key long, label int, v array<int>, lo array<long>, hi array<long>"


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, key, v: rows that have an id, a label and a vector without null or not finite components, as floor(scale * x).

    Shorter vectors are filled up with zeros. key is a hash of label and vector: it orders rows of one id, and rows equal in
    both count once. A component of LARGEST or more either way fails.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(
        "embedding",
        lambda x: F.when(F.abs(x) < LARGEST / scale, F.floor(x.cast("double") * scale).cast("int")).otherwise(
            F.raise_error(F.lit(f"components must be under {LARGEST} when scaled")).cast("int")
        ),
    )
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), whole.alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(width) - F.size("v"))))
    return rows.select("vec_id", "label", F.xxhash64("label", "v").alias("key"), "v")


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), kind)


def augmented(v: np.ndarray, most: float) -> np.ndarray:
    """v with the component that brings its squared norm to most."""
    return np.column_stack((v, np.sqrt(np.maximum(most - np.einsum("ij,ij->i", v, v), 0))))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", a - b, a - b))


@dataclass
class Tree:
    """A full binary tree in heap order: a vector within a node's radius of its point goes to child 2 i + 1, else to 2 i + 2."""

    depth: int
    points: np.ndarray
    radii: np.ndarray
    most: float
    low: np.ndarray | None = None  # of each leaf and level: the least distance of its rows from that level's point
    high: np.ndarray | None = None
    blocks: np.ndarray | None = None  # of each leaf

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, most: float, tries: int = 8) -> Tree:
        """Points are drawn from the sample, each the one of a few with the most varied distances; radii are medians."""
        rng = np.random.default_rng(0)
        n = 2**depth - 1
        points, radii = np.zeros((n, sample.shape[1])), np.full(n, np.inf)
        members = {0: np.arange(len(sample))}
        for node in range(n):
            own = members.pop(node, np.zeros(0, np.int64))
            if len(own):
                drawn = sample[rng.choice(own, min(tries, len(own)), replace=False)]
                points[node] = max(drawn, key=lambda p: np.var(np.sqrt(((sample[own] - p) ** 2).sum(1))))
                away = np.sqrt(((sample[own] - points[node]) ** 2).sum(1))
                radii[node] = np.median(away)
                members[2 * node + 1], members[2 * node + 2] = own[away <= radii[node]], own[away > radii[node]]
            elif node:
                points[node] = points[(node - 1) // 2]
        return cls(depth, points, radii, most)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each augmented vector, and its distances from the points on the way."""
        node, away = np.zeros(len(x), np.int64), np.zeros((len(x), self.depth))
        for level in range(self.depth):
            away[:, level] = apart(x, self.points[node])
            node = 2 * node + 1 + (away[:, level] > self.radii[node])
        return node - (2**self.depth - 1), away

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For queries by leaves: the least and the greatest score that the leaf's rows may have, and the least distance."""
        squared = np.einsum("ij,ij->i", q, q) + self.most
        away = np.sqrt(np.maximum(squared[:, None] - 2 * q @ self.points[:, :-1].T, 0))
        near, far = np.zeros((len(q), 2**self.depth)), np.full((len(q), 2**self.depth), np.inf)
        for level in range(self.depth):
            node = (np.arange(2**self.depth) >> (self.depth - level)) + 2**level - 1
            d = away[:, node]
            near = np.maximum(near, np.maximum(d - self.high[:, level], self.low[:, level] - d))
            far = np.minimum(far, d + self.high[:, level])
        slack = SLACK * squared[:, None] + 1e-6
        return (squared[:, None] - far**2) / 2 - slack, (squared[:, None] - near**2) / 2 + slack, near


def _assign(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf, away = tree.leaves(augmented(matrix(batch.column("v")), tree.most))
                offsets = pa.array(np.arange(len(leaf) + 1) * tree.depth, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(leaf), pa.ListArray.from_arrays(offsets, pa.array(away.ravel()))],
                    names=[*batch.schema.names, "leaf", "away"],
                )

    return run


def index(rows: DataFrame, sample: int = SAMPLE, leaf: int = LEAF) -> tuple[DataFrame, Tree]:
    """Every row in its block: block, vec_id, key, label, v; and the tree with what its leaves hold. rows as integer_vectors() gives them."""
    squares = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    most, n = rows.agg(F.max(squares), F.count("*")).first()
    most = most or 0
    if most >= LARGEST_NORM:
        raise ValueError("scores of these vectors don't fit in 64 bits")
    depth = max(0, min(int(np.log2(MOST_LEAVES)), int(np.log2(sample / 8)), round(np.log2(max(n, 1) / leaf))))
    drawn = [r.v for r in rows.orderBy(F.xxhash64(F.lit(12), "vec_id"), "vec_id", "key").limit(sample).select("v").collect()]  # at most sample rows
    tree = Tree.fit(augmented(np.array(drawn, np.float64).reshape(len(drawn), len(drawn[0]) if drawn else 0), most), depth, most)
    assigned = checkpoint(rows.mapInArrow(_assign(tree), "vec_id long, label int, key long, v array<int>, leaf long, away array<double>"))
    held = np.zeros(2**depth, np.int64)
    for r in assigned.groupBy("leaf").count().collect():  # a row a leaf
        held[r[0]] = r[1]
    tree.low, tree.high = np.full((2**depth, depth), np.inf), np.full((2**depth, depth), -np.inf)
    # leaves by levels
    for r in assigned.select(
        "leaf", F.posexplode("away").alias("level", "d")
    ).groupBy("leaf", "level").agg(F.min("d"), F.max("d")).collect():
        tree.low[r[0], r[1]], tree.high[r[0], r[1]] = r[2], r[3]
    tree.blocks = -(-held // BLOCK)
    first = F.array(*[F.lit(int(b)) for b in np.cumsum(tree.blocks) - tree.blocks])
    number = F.array(*[F.lit(max(int(b), 1)) for b in tree.blocks])
    place = F.col("leaf").cast("int")
    block = F.get(first, place) + F.pmod(F.xxhash64("vec_id", "key"), F.get(number, place))
    return assigned.select(block.cast("long").alias("block"), "vec_id", "key", "label", "v"), tree


def _route(tree: Tree, start: int, stop: int):
    """Rows of queries for the blocks of the leaves start to stop of each window's order; windows that don't need a leaf are empty there."""
    first = np.cumsum(tree.blocks) - tree.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                q = matrix(batch.column("v"))
                lo, hi, least = (matrix(batch.column(c)) for c in ("lo", "hi", "least"))
                worst, best, near = tree.bounds(q)
                squared = np.einsum("ij,ij->i", q, q) + tree.most
                needed = np.zeros((*best.shape, lo.shape[1]), bool)
                for w in range(lo.shape[1]):
                    meets = (tree.blocks > 0) & (best >= lo[:, w, None]) & (worst <= hi[:, w, None]) & (lo[:, w] <= hi[:, w])[:, None]
                    inner = np.sqrt(np.maximum(squared - 2 * hi[:, w], 0))
                    order = np.lexsort((near, np.maximum(near, inner[:, None]), ~meets), axis=1)
                    rank = np.empty_like(order)
                    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
                    needed[:, :, w] = meets & (rank >= start) & (rank < stop) & (best >= least[:, w, None])
                i, leaf = np.nonzero(needed.any(2))
                if not len(i):
                    continue
                again = tree.blocks[leaf]
                block = np.repeat(first[leaf], again) + np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
                asks = np.repeat(needed[i, leaf], again, axis=0)
                i = np.repeat(i, again)
                rows = batch.take(pa.array(i))
                floor = np.maximum(np.array(batch.column("lo").to_pylist(), np.int64), np.array(batch.column("least").to_pylist(), np.int64))[i]
                floor[~asks], n = ANY, asks.shape[1]
                offsets = pa.array(np.arange(len(i) + 1) * n, pa.int32())
                columns = [pa.array(block), pa.array(np.ones(len(i), np.int32)), *(rows.column(c) for c in ("vec_id", "key", "label", "v"))]
                columns += [pa.ListArray.from_arrays(offsets, pa.array(floor.ravel())), rows.column("hi")]
                yield pa.RecordBatch.from_arrays(columns, schema=PROBES)

    return run


def top_of(scores: np.ndarray, allowed: np.ndarray, low: int, high: int, k: int) -> np.ndarray:
    """Of members in the order of their ids: the k best by score between low and high, both included, and allowed."""
    some = np.flatnonzero(allowed & (scores >= low) & (scores <= high))
    if len(some) > 4 * k:
        kth = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= kth]
    return some[np.argsort(-scores[some], kind="stable")][:k]


def _probe(k: int, same: bool, exact: bool):
    """exact: products of these vectors are whole numbers in floating point as well."""
    kind = np.float64 if exact else np.int64

    def ask(members: list[pa.RecordBatch], asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(members)
        ids, keys, labels = (own.column(c).to_numpy() for c in ("vec_id", "key", "label"))
        new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])))
        v = matrix(own.column("v"), kind)
        for at in range(0, asked.num_rows, 256):
            part = asked.slice(at, 256)
            scores = matrix(part.column("v"), kind) @ v.T
            out = []
            rows = zip(*(part.column(c).to_pylist() for c in ("vec_id", "key", "label", "lo", "hi")), strict=True)
            for s, (anchor, key, label, lo, hi) in zip(scores, rows, strict=True):
                allowed = new & ((labels == label) == same) & ((ids != anchor) | (keys != key))
                for w, (a, b) in enumerate(zip(lo, hi, strict=True)):
                    if a <= b and len(some := top_of(s, allowed, a, b, k)):
                        n = len(some)
                        out.append((np.full(n, anchor), np.full(n, key), np.full(n, w), ids[some], keys[some], s[some]))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(np.int32 if f.name == "win" else np.int64)) for c, f in zip(columns, FOUND, strict=True)],
                    schema=FOUND,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            block, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (kinds[1:] != kinds[:-1]), [True]))) if len(block) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if block[a] != current:
                    members, current = [], block[a]
                if kinds[a] == 0:
                    members.append(batch.slice(a, b - a))
                elif members:
                    yield from ask(members, batch.slice(a, b - a))

    return run


def search(rows: DataFrame, tree: Tree, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor_id, anchor_key, win, vec_id, key, score, rank (from 1): for each window of each query the k best rows whose label is the same, or another.

    rows, tree: from index(). queries: vec_id, key, label, v and equally long arrays lo and hi, windows of scores with both
    ends included. A query's own row is no result. Ties go to the smaller vec_id. Of the windows' number nothing is assumed but that it is small.
    """
    session = rows.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    exact = tree.most < 2**52
    by = ["anchor_id", "anchor_key", "win"]
    best = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id", "key")
    members = rows.select("block", F.lit(0).alias("kind"), "vec_id", "key", "label", "v", *[F.lit(None).cast("array<long>").alias(c) for c in ("lo", "hi")])
    lowest = F.transform("lo", lambda x: F.lit(-ANY))
    active = queries.withColumn("least", lowest)
    found = session.createDataFrame([], "anchor_id long, anchor_key long, win int, vec_id long, key long, score long")
    start, stop = 0, FIRST
    while start < len(tree.blocks):
        probes = checkpoint(active.mapInArrow(_route(tree, start, stop), PROBES_DDL))
        if probes.take(1):
            asked = members.join(probes.select("block").distinct(), "block", "left_semi").select(*probes.columns)
            both = asked.unionByName(probes).repartition(parts, "block").sortWithinPartitions("block", "kind", "vec_id", "key")
            new = both.mapInArrow(_probe(k, same, exact), "anchor_id long, anchor_key long, win int, vec_id long, key long, score long")
            found = checkpoint(found.unionByName(new).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
            full = found.groupBy(*by).agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
            full = full.groupBy("anchor_id", "anchor_key").agg(F.map_from_entries(F.collect_list(F.struct("win", "kth"))).alias("_kth"))  # an entry a window
            state = queries.join(full, (F.col("vec_id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key")), "left")
            active = state.select(*queries.columns, F.transform("lo", lambda x, i: F.coalesce(F.element_at("_kth", i), F.lit(-ANY))).alias("least"))
        start, stop = stop, stop * GROWTH
    return found.withColumn("rank", F.row_number().over(best))


def mine(
    vectors: DataFrame,
    anchor: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = 30,
    high: int = 90,
    scale: int = SCALE,
    leaf: int = LEAF,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first positives (rows of its label, by score) the first rows of other labels whose score is low to high hundredths of the positive's.

    anchor: which rows are anchors, by default those whose vec_id is divisible by 100. Scores are inner products of
    floor(scale * x); ties go to the smaller vec_id. Rows without an id, a label or a whole finite vector take no part, shorter vectors
    are filled up with zeros, rows repeated as a whole count once, and rows of one id that differ are rows of their own. An anchor without positives, and a positive
    whose window holds no row, have no rows; so has an empty table. Other columns go.
    """
    rows = integer_vectors(vectors, scale)
    placed, tree = index(rows, leaf=leaf)
    anchors = placed.where(F.col("vec_id") % 100 == 0 if anchor is None else anchor).select("vec_id", "key", "label", "v").dropDuplicates(["vec_id", "key"])
    ask = lambda **ends: checkpoint(anchors.select("*", *[F.array(F.lit(x)).cast("array<long>").alias(c) for c, x in ends.items()]))
    everyone = ask(lo=-ANY, hi=ANY)
    pairs = checkpoint(search(placed, tree, everyone, positives, same=True))
    # windows: the whole numbers between low and high hundredths of the positive's score
    hundredth = lambda x: F.expr(f"({x} - pmod({x}, 100L)) div 100L")
    lo, hi = hundredth(f"(score * {low} + 99L)"), hundredth(f"(score * {high})")
    ends = pairs.select("anchor_id", "anchor_key", F.struct("rank", lo.alias("lo"), hi.alias("hi")).alias("w"))
    ends = ends.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list("w")).alias("w"))  # as many as positives
    # all queries have as many windows; those that are missing are empty
    pad = lambda c, x: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("w", i)[c], F.lit(x)))
    windows = everyone.drop("lo", "hi").join(ends, (F.col("vec_id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key")))
    windows = checkpoint(windows.select("vec_id", "key", "label", "v", pad("lo", ANY).alias("lo"), pad("hi", -ANY).alias("hi")))
    found = search(placed, tree, windows, negatives, same=False)
    positive = pairs.select(
        "anchor_id",
        "anchor_key",
        (F.col("rank") - 1).alias("win"),
        F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    out = found.join(positive, ["anchor_id", "anchor_key", "win"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def with_noise(vectors: DataFrame) -> DataFrame:
    """vectors with every seventh id's label moved on by one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.withColumn("label", moved)


SQL = f"""
with e as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id != b.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES}),
n as (
  select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and s.label != s.anchor_label and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}
"""
