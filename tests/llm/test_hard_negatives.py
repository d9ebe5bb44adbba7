"""The vantage-point tree against brute force over all rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score string, v int"


def made(n=700, width=8, seed=4):
    """Clusters of several labels, few different values (ties), repeated rows, rows of one id, rows that take no part."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, width))
    rows = [(i, (middle[rng.integers(6)] + rng.normal(size=width) / 4).round(1).tolist(), int(rng.integers(3))) for i in range(n)]
    rows += [(n + i, rows[5][1], i % 3) for i in range(n // 3)]  # a third of all alike
    rows += [rows[0], rows[0], rows[100], (100, rows[7][1], 1), (200, rows[100][1], 2), (300, [], 0), (400, [1.0, 2.0], 1)]
    rows += [
        (500, None, 1),
        (600, [None] * width, 1),
        (601, [float("nan")] * width, 1),
        (602, [float("inf")] * width, 1),
        (603, rows[0][1], None),
        (None, rows[0][1], 1),
    ]
    return rows


def brute(rows, every=100, positives=5, negatives=10):
    finite = [(i, tuple(v), y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v, _ in finite)
    whole = {(i, y, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v) + (0,) * (width - len(v))) for i, v, y in finite}
    out = []
    for i, y, v in whole:
        if i % every:
            continue
        scored = [(-int(np.dot(v, w)), j, label, w) for j, label, w in whole if (j, label, w) != (i, y, v)]
        best = sorted((s, j) for s, j, label, _ in scored if label == y)[:positives]
        for p, j in best:
            p = -p
            inside = sorted((s, k) for s, k, label, _ in scored if label != y and 30 * p <= -100 * s <= 90 * p)[:negatives]
            out += [(i, j, r + 1, k, p, -s) for r, (s, k) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("leaf", [8, 60, 10_000])
def test_agrees_with_brute_force(spark, leaf):
    rows = made()
    table = spark.createDataFrame([(i, v, y, "clash", 1) for i, v, y in rows], SCHEMA).repartition(3)
    got = hn.mine(table, leaf=leaf)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_few_rows_and_none(spark):
    table = lambda rows: spark.createDataFrame([(i, v, y, "clash", 1) for i, v, y in rows], SCHEMA)
    none = hn.mine(table([]))
    assert none.collect() == [] and none.columns[0] == "anchor_id"
    assert hn.mine(table([(0, [1.0], 1)])).collect() == []
    assert hn.mine(table([(0, [1.0], 1), (1, [1.0], 1)])).collect() == []
    few = [(0, [1.0, 0.5], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (100, [-1.0, 0.0], 2)]
    assert sorted(map(tuple, hn.mine(table(few)).collect())) == brute(few)


def test_bounds_hold_and_prune(spark):
    """Every row's score lies within its leaf's bounds; of separate clusters most leaves are out of a narrow window's reach."""
    rows = made(2000, 4)
    table = spark.createDataFrame([(i, v, y, "", 1) for i, v, y in rows], SCHEMA)
    whole = hn.integer_vectors(table)
    placed, tree = hn.index(whole, leaf=30)
    v = np.array([r.v for r in whole.collect()], float)
    leaf, _ = tree.leaves(hn.augmented(v, tree.most))
    worst, best, _ = tree.bounds(v[:40])
    scores = v[:40] @ v.T
    assert (scores >= worst[:, leaf]).all() and (scores <= best[:, leaf]).all()
    top = np.sort(scores, axis=1)[:, -10]
    assert (best >= top[:, None]).mean() < 0.6
    assert placed.count() == whole.count() and placed.groupBy("block").count().agg(F.max("count")).first()[0] <= 2 * hn.BLOCK


def test_sql(spark):
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label integer)")
    rows = [r for r in made(300, 6)[:-13] if r[0] is not None]
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    table = spark.createDataFrame([(i, v, y, "", 1) for i, v, y in rows], SCHEMA)
    assert sorted(map(tuple, hn.mine(hn.with_noise(table)).collect())) == sorted(con.sql(hn.SQL).fetchall())


def test_too_large_components_fail(spark):
    with pytest.raises(Exception, match="components must be under"):
        hn.mine(spark.createDataFrame([(1, [1e9], 1, "", 1)], SCHEMA)).collect()
