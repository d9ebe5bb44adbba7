"""Shared permutations, normality and resampling against numpy and plain formulas."""

import hashlib
import math

import numpy as np
import pytest

from strandspark.operators import permutation as P

ROUNDS = 150


def made(n=2500, seed=2):
    rng = np.random.default_rng(seed)
    x = {f: {int(k): float(rng.integers(1, 5)) for k in rng.choice(n, size, replace=False)} for f, size in (("AA", 900), ("AC", 40), ("AG", 3))}
    x["AT"] = dict.fromkeys(range(n), 2.0)  # no spread
    return x, {k: float(rng.normal()) + (0.3 * x["AA"].get(k, 0)) for k in range(n)}


def orders(n, rounds, seed=1):
    for r in range(1, rounds + 1):
        yield sorted(range(n), key=lambda k: (hashlib.md5(f"{seed}:{r}:{k}".encode()).hexdigest(), k))


@pytest.fixture(scope="module")
def tables(spark):
    x, y = made()
    profile = spark.createDataFrame([(f, k, v) for f, own in x.items() for k, v in own.items()], "kmer string, id long, x double").repartition(3)
    responses = spark.createDataFrame([*y.items(), (None, 1.0), (9999, None)], "id long, y double").repartition(3)
    return x, y, profile, responses


def test_slopes_equal_numpy(spark, tables):
    x, y, profile, responses = tables
    got = {(r.feature, r.round): r.slope for r in P.slopes(profile, responses, "kmer", "id", ROUNDS).collect()}
    n = len(y)
    own = np.array([y[k] for k in range(n)])
    rounds = [own]
    for order in orders(n, ROUNDS):
        given = np.empty(n)
        given[order] = own
        rounds.append(given)
    for f, cells in x.items():
        v = np.array([cells.get(k, 0.0) for k in range(n)])
        for r, given in enumerate(rounds):
            if f == "AT":
                assert got[f, r] is None
            else:
                assert got[f, r] == pytest.approx(np.polyfit(v, given, 1)[0], rel=1e-9, abs=1e-12)
    assert len(got) == len(x) * (ROUNDS + 1)


def normaltest(v):
    """The omnibus test by its published formulas, in plain arithmetic."""
    n = len(v)
    d = v - v.mean()
    m2 = (d**2).mean()
    b1, b2 = (d**3).mean() / m2**1.5, (d**4).mean() / m2**2
    y = b1 * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n**2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta2 - 1))
    zs = math.asinh(y / math.sqrt(2.0 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    e = 3.0 * (n - 1) / (n + 1)
    x = (b2 - e) / math.sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)))
    s = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / s * (2.0 / s + math.sqrt(1 + 4.0 / s**2))
    t = 1 + x * math.sqrt(2 / (a - 4.0))
    zk = (1 - 2 / (9.0 * a) - math.copysign(abs((1 - 2.0 / a) / abs(t)) ** (1 / 3), t)) / math.sqrt(2 / (9.0 * a))
    return zs, zk, math.exp(-(zs * zs + zk * zk) / 2)


def test_summary(spark, tables):
    _, _, profile, responses = tables
    lines = P.slopes(profile, responses, "kmer", "id", ROUNDS)
    rows = {}
    for r in lines.collect():
        rows.setdefault(r.feature, {})[r.round] = r.slope
    for r in P.null_summary(lines).collect():
        null = np.array([rows[r.feature][k] for k in range(1, ROUNDS + 1)], float)
        if r.feature == "AT":
            assert r.slope is None and r.p is None and r.normal_p is None
            continue
        width = null.std(ddof=1) * ROUNDS**-0.2
        z = (rows[r.feature][0] - null) / width
        below = np.mean([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
        above = np.mean([0.5 * math.erfc(v / math.sqrt(2)) for v in z])
        assert r.p == pytest.approx(min(1.0, 2 * min(below, above)), rel=1e-6, abs=1e-300)
        assert (r.q25, r.q50, r.q75) == pytest.approx(tuple(np.quantile(null, [0.25, 0.5, 0.75])), rel=1e-9)
        assert (r.z_skewness, r.z_kurtosis, r.normal_p) == pytest.approx(normaltest(null), rel=1e-6)


def test_ratio(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 1 + i % 3 // 2, *rng.uniform(0.1, 1, 3).tolist()) for i in range(400)]
    table = spark.createDataFrame(rows, "id long, set int, m1 double, m2 double, joint double").repartition(4)
    got = {r.replicate: r.ratio for r in P.resampled_ratios(table, ["id"], 30).collect()}
    share = sum(s == 1 for _, s, *_ in rows) / len(rows)
    limit = f"{int(share * 2**32):08x}"
    for k in range(31):
        ones = [s == 1 if k == 0 else hashlib.md5(f"1:{k}:{i}".encode()).hexdigest() < limit for i, s, *_ in rows]
        assert got[k] == pytest.approx(sum(2 * math.log(a if o else b) - 2 * math.log(j) for o, (_, _, a, b, j) in zip(ones, rows, strict=True)))
    null = [got[k] for k in range(1, 31)]
    one = P.empirical(P.resampled_ratios(table.repartition(2), ["id"], 30)).first()
    assert one.ratio == pytest.approx(got[0]) and (one.q25, one.q50, one.q75) == pytest.approx(tuple(np.quantile(null, [0.25, 0.5, 0.75])))
    assert one.p == pytest.approx((1 + sum(v >= got[0] for v in null)) / 31)


def test_empty(spark):
    profile, responses = spark.createDataFrame([], "kmer string, id long, x double"), spark.createDataFrame([], "id long, y double")
    assert P.null_summary(P.slopes(profile, responses, "kmer", "id", 10)).collect() == []
