"""Exponion search against plain Lloyd rounds."""

import hashlib

import duckdb
import numpy as np
import pytest

from strandspark.llm import centroid_clustering as cc

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v int"


def lloyd(rows, k, rounds, dimensions, scale):
    kept = [
        (
            i, np.floor(scale * np.array(v, np.float32).astype(float)).astype(np.int64)
        ) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)
    ]
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]
    c = np.array([v for _, v in first])
    v = np.array([v for _, v in kept])
    for r in range(rounds + 1):
        d = ((v[:, None] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if r < rounds:
            c = np.array([v[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    least = d.min(1)
    return [
        (
            i,
            int(j),
            int(x),
            int(least[a == j].sum()),
            int(least.sum()),
            hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest(),
        ) for (i, _), j, x in zip(kept, a, least, strict=True)
    ]


def made(dimensions, n=300, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-3, 4, dimensions) / 2).astype(np.float32).tolist()) for i in range(n)]
    middle = rng.normal(size=(5, dimensions))
    rows += [(n + i, (middle[i % 5] + rng.normal(size=dimensions) / 8).astype(np.float32).tolist()) for i in range(n)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(7000, None), (7001, []), (7002, [0.5] * (dimensions - 1)), (7003, [0.5] * (dimensions + 1)), (7004, [None] + [0.5] * (dimensions - 1))]
    return rows + [(7005 + j, [x] + [0.5] * (dimensions - 1)) for j, x in enumerate((float("nan"), float("inf"), float("-inf")))]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("dimensions,k,rounds", [(2, 8, 10), (64, 8, 10), (3, 30, 4), (2, 1, 3)])
def test_agrees_with_lloyd(spark, dimensions, k, rounds):
    rows = made(dimensions)
    table = spark.createDataFrame([(i, v, 1, "clash", 2) for i, v in rows], SCHEMA).repartition(3)
    got = cc.cluster(table, k, rounds, dimensions)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert order(got.collect()) == order(lloyd(rows, k, rounds, dimensions, cc.SCALE))


def test_few_equal_and_no_vectors(spark):
    same = [(i, [0.25] * 64) for i in range(20)]
    table = lambda rows: spark.createDataFrame([(i, v, 1, "clash", 2) for i, v in rows], SCHEMA)
    assert {r.cluster for r in cc.cluster(table(same)).collect()} == {0}  # all centroids alike: the smallest number
    assert order(cc.cluster(table(same[:3])).collect()) == order(lloyd(same[:3], 8, 10, 64, cc.SCALE))
    none = cc.cluster(table([]))
    assert none.collect() == [] and none.dtypes == cc.cluster(table(same)).dtypes


def test_pruning_saves_distances():
    """Separate clusters: few distances are taken once the centroids rest."""
    rng = np.random.default_rng(1)
    middle = rng.integers(-5000, 5000, (20, 16))
    v = middle[rng.integers(0, 20, 4000)] + rng.integers(-50, 50, (4000, 16))
    ways = cc.Ways.of(middle, None)
    which, best, second = cc.nearest_two(v, ways, np.arange(20))
    upper, lower = cc.bounds(best, second)
    moved = middle + rng.integers(-3, 4, middle.shape)
    found, _, _, taken = cc.reassigned(v, which, upper, lower, cc.Ways.of(moved, middle))
    assert taken < len(v) // 10
    assert (found == ((v[:, None] - moved[None]) ** 2).sum(2).argmin(1)).all()


def test_too_large_components_fail(spark):
    with pytest.raises(Exception, match="components must be under"):
        cc.cluster(spark.createDataFrame([(1, [1e9] * 64, 1, "", 1)], SCHEMA)).collect()


def test_sql(spark):
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    rows = [r for r in made(64, 60) if r[0] is not None]
    con.executemany("insert into embeddings values (?, ?)", rows)
    table = spark.createDataFrame([(i, v, 1, "", 1) for i, v in rows], SCHEMA)
    assert order(con.sql(cc.SQL).fetchall()) == order(cc.cluster(table).collect())
