"""Exact k-means by Exponion search.

Every vector carries an upper bound of the distance to its own centroid and a lower bound of that to any other. When centroids
have moved, bounds give way by the moves. A vector whose upper bound is under both its lower bound and half the way from its
centroid to the next one keeps its centroid. Else its distance is taken anew, and if that doesn't settle it, the nearest and second nearest
are searched among centroids inside a ball around its own centroid, of twice the distance plus the way to the next centroid: a prefix of that
centroid's list of others, sorted by distance. The radius is inclusive and bounds are rounded away from each other, so ties are
found and go to the smaller number. Vectors stay where they lie; a round moves k sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

DIMENSIONS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
#: Integer components beyond it fail: squared distances must fit in 64 bits.
LARGEST = 2**27
#: By how much a bound is rounded, as a share of it.
SLACK = 1e-12
STATE = "vec_id long, v array<int>, cluster int, upper double, lower double"


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: rows with exactly that many components, none of them null or not finite, as floor(scale * x).

    Other rows go. Null ids and repeated rows stay. A component of LARGEST or more either way fails.
    """
    wide = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(
        wide,
        lambda x: F.when(F.abs(x) < LARGEST / scale, F.floor(x * scale).cast("int")).otherwise(
            F.raise_error(F.lit(f"components must be under {LARGEST} when scaled")).cast("int")
        ),
    )
    return vectors.where(
        F.col("embedding").isNotNull() & (F.size("embedding") == dimensions) & finite
    ).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(rows: DataFrame, k: int = CENTROIDS, salt: int = 3) -> np.ndarray:
    """The k rows of the least lowercase-hex sha256 of `salt:vec_id`; equal ids by their vectors, rows without an id last."""
    draw = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(draw.alias("draw"), "v").orderBy(F.col("draw").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in found], np.int64)


def squared(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = v - centroid
    return np.einsum("ij,ij->i", apart, apart)


@dataclass
class Ways:
    """What a round knows of its centroids."""

    centroids: np.ndarray
    moved: np.ndarray  # how far each came since the last round, rounded up
    others: np.ndarray  # of each centroid: all numbers by distance from it, itself first
    away: np.ndarray  # and those distances, rounded down

    @classmethod
    def of(cls, centroids: np.ndarray, before: np.ndarray | None) -> Ways:
        apart = np.sqrt(np.array([squared(centroids, c) for c in centroids], np.float64))
        np.fill_diagonal(apart, -1.0)
        others = np.argsort(apart, axis=1, kind="stable")
        away = np.maximum(np.take_along_axis(apart, others, 1), 0) * (1 - SLACK)
        moved = np.zeros(len(centroids)) if before is None else np.sqrt(
            np.einsum("ij,ij->i", centroids - before, centroids - before).astype(np.float64)
        ) * (1 + SLACK)
        return cls(centroids, moved, others, away)

    def next(self) -> np.ndarray:
        """From each centroid to the nearest other one, rounded down."""
        return self.away[:, 1] if len(self.centroids) > 1 else np.full(1, np.inf)


def nearest_two(v: np.ndarray, ways: Ways, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Among those centroids: the nearest one's number, its squared distance, that of the second (or the largest integer)."""
    top = np.iinfo(np.int64).max
    best, second, which = np.full(len(v), top), np.full(len(v), top), np.full(len(v), -1)
    for j in np.sort(numbers):  # in their order, so that ties keep the smaller number
        d = squared(v, ways.centroids[j])
        nearer = d < best
        second = np.where(nearer, best, np.minimum(second, d))
        which, best = np.where(nearer, j, which), np.where(nearer, d, best)
    return which, best, second


def bounds(best: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lower = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second.astype(np.float64)) * (1 - SLACK))
    return np.sqrt(best.astype(np.float64)) * (1 + SLACK), lower


def reassigned(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, ways: Ways) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """cluster, upper and lower after the centroids' moves, and how many distances were taken."""
    cluster, next_way, taken = cluster.copy(), ways.next(), 0
    order = np.argsort(ways.moved)
    # the farthest move of any centroid but a vector's own
    rest = np.where(cluster == order[-1], ways.moved[order[-2]] if len(order) > 1 else 0.0, ways.moved[order[-1]])
    upper = (upper + ways.moved[cluster]) * (1 + SLACK)
    lower = (lower - rest) * np.where(lower > rest, 1 - SLACK, 1 + SLACK)
    safe = np.maximum(lower, next_way[cluster] / 2 * (1 - SLACK))
    rows = np.flatnonzero(upper >= safe)
    own = np.zeros(len(rows), np.int64)
    for a in np.unique(cluster[rows]):
        mine = cluster[rows] == a
        own[mine] = squared(v[rows[mine]], ways.centroids[a])
    taken += len(rows)
    upper[rows] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
    rows = rows[upper[rows] >= safe[rows]]
    for a in np.unique(cluster[rows]):
        mine = rows[cluster[rows] == a]
        radius = (2 * upper[mine] + next_way[a] * (1 + 3 * SLACK)) * (1 + SLACK)
        inside = np.searchsorted(ways.away[a], radius, side="right")
        for n in np.unique(inside):
            some = mine[inside == n]
            which, best, second = nearest_two(v[some], ways, ways.others[a][:n])
            taken += len(some) * int(n)
            upper[some], lower[some] = bounds(best, second)
            cluster[some] = which
    return cluster, upper, lower, taken


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of integers as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _round(ways: Ways, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"))
            if first:
                cluster, best, second = nearest_two(v, ways, np.arange(len(ways.centroids)))
                upper, lower = bounds(best, second)
            else:
                cluster, upper, lower = (batch.column(c).to_numpy() for c in ("cluster", "upper", "lower"))
                cluster, upper, lower, _ = reassigned(v, cluster, upper, lower, ways)
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "upper", "lower"])

    return run


def _labelled(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster = batch.column("cluster")
            apart = matrix(batch.column("v")) - centroids[cluster.to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), cluster, pa.array(np.einsum("ij,ij->i", apart, apart))], names=["vec_id", "cluster", "distance"]
            )

    return run


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors, component by component; an empty cluster's centroid stays. k rows reach the driver."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"c{i}") for i in range(centroids.shape[1])]
    new = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        new[row.cluster] = [total // row.n for total in row[2:]]
    return new


def clustered(rows: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared, to the final centroid) of each row (vec_id, v), and the final centroids.

    rounds times every vector goes to its nearest centroid and centroids become floored means, then vectors are assigned once
    more. Rows of equal ids count each for itself. Needs a row at least. A round's state is kept by Spark; what is lost is computed again
    from the rounds before.
    """
    rows = checkpoint(rows)
    state, before, old = rows, None, None
    for r in range(rounds + 1):
        ways = Ways.of(centroids, before)
        state = state.mapInArrow(_round(ways, first=r == 0), STATE).persist()
        if r < rounds:
            before, centroids = centroids, _means(state, centroids)
        else:
            out = checkpoint(state.mapInArrow(_labelled(centroids), "vec_id long, cluster int, distance long"))
        if old is not None:
            old.unpersist()
        old = state
    old.unpersist()
    return out, centroids


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that integer_vectors() keeps.

    Null ids stay null and are the last to be starting centroids; repeated rows are vectors of their own; equal distances go to the smaller
    number. With fewer than k vectors there are as many clusters as vectors. No vectors, no rows. Other columns go.
    """
    rows = integer_vectors(vectors, dimensions, scale)
    start = first_centroids(rows, k)
    if not len(start):
        return rows.select(
            "vec_id",
            *[
                F.lit(None).cast(t).alias(c) for c, t in (
                    ("cluster", "int"),
                    ("distance", "long"),
                    ("cluster_inertia", "long"),
                    ("inertia", "long"),
                    ("centroid_sha256", "string"),
                )
            ],
        )
    out, centroids = clustered(rows, start, rounds)
    found = {r.cluster: r.inertia for r in out.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    own = [found.get(j, 0) for j in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    return out.select(
        "vec_id",
        "cluster",
        "distance",
        by_cluster(own).cast("long").alias("cluster_inertia"),
        F.lit(sum(own)).cast("long").alias("inertia"),
        by_cluster(names).alias("centroid_sha256"),
    )


def sql(k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> str:
    """Lloyd's rounds, one after the other, every vector against every centroid."""
    steps = [
        f"""kept as materialized (
  select row_number() over (order by vec_id, embedding) as row, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = {dimensions} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dimensions})""",
        f"c0 as materialized (select row_number() over (order by sha256('3:' || vec_id) nulls last, v) - 1 as cluster, v as c from kept order by sha256('3:' || vec_id) nulls last, v limit {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} as (
  select row, vec_id, v, cluster, cast(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as distance from kept, c{r})""")
        steps.append(f"a{r} as materialized (select * from d{r} qualify row_number() over (partition by row order by distance, cluster) = 1)")
        if r < rounds:
            steps.append(f"""m{r} as (
  select cluster, i, sum(x) as s, count(*) as n from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by cluster, i)""")
            # sum - mod(sum, n), with a mod that isn't negative: exact for any sum
            steps.append(f"""c{r + 1} as materialized (
  select c{r}.cluster, coalesce(n.c, c{r}.c) as c from c{r} left join (select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c from m{r} group by cluster) n on n.cluster = c{r}.cluster)""")
    return (
        "with "
        + ",\n".join(steps)
        + f"""
select vec_id, cast(a.cluster as integer) as cluster, distance, cast(sum(distance) over (partition by a.cluster) as bigint) as cluster_inertia,
  cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on c.cluster = a.cluster"""
    )


SQL = sql()
