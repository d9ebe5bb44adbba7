"""Callbacks on alignment slices: every target comes back, failing ones with the default and the reason."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.operators import alignment as A
from strandspark.operators import motif as M
from strandspark.plans import sequence_queries as Q

BLOCK = "block int, species string, chr string, seq string, p_start long, strand string"
ROWS = [
    (1, "mel", "X", "AC-GTTA", 100, "+"), (1, "yak", "2", "ACCGT-A", 500, "-"),
    (2, "mel", "X", "GGGG", 104, "+"), (2, "yak", "2", "GG-G", 900, "+"),
    (3, "mel", "X", "A-----------C", 300, "+"), (3, "pse", "4", "ACGTACGTACGTA", 1, "+"),
]


def test_every_target_comes_back(spark):
    block = spark.createDataFrame(ROWS, BLOCK)
    targets = [
        (1, "X", 101, 102, "+"),
        (2, "X", 101, 102, "-"),
        (3, "X", 103, 104, "+"),
        (4, "X", 106, 107, "+"),
        (5, "X", 300, 301, "+"),
        (6, "Y", 1, 2, "+"),
        (7, "X", 106, 109, "+"),
        (8, "X", 100, 101, "+"),
    ]
    table = spark.createDataFrame(targets, "pid int, chr string, s long, e long, strand string").repartition(3)

    def fn(rows) -> dict:
        own = {r.species: r for r in rows.itertuples()}
        if own["mel"].p_start == 100:
            raise KeyError("refused")
        return {"text": "|".join(f"{s}:{r.seq}:{r.strand}" for s, r in sorted(own.items())), "n": len(rows)}

    got = {
        r.pid: tuple(r)[1:] for r in A.map_slices(
            block, table, "mel", fn, "text string, n int", {"text": "-", "n": 0}, most=3, fill=["mel", "yak"]
        ).collect()
    }
    assert got == {
        1: ("mel:C-G:+|yak:CCG:-", 2, None),
        2: ("mel:C-G:-|yak:CGG:+", 2, None),
        3: ("-", 0, "several blocks"),
        4: ("mel:GG:+|yak:-G:+", 2, None),
        5: ("-", 0, "wide"),
        6: ("-", 0, "not aligned"),
        7: ("-", 0, "unmapped"),
        8: ("-", 0, "KeyError: 'refused'"),
    }
    padded = A.map_slices(block, table.where("pid = 1"), "mel", lambda rows: {"n": len(rows.iloc[0].seq)}, "n int", {}, pad=1, fill=["mel"]).first()
    assert padded.error is None and padded.n == 5
    assert A.map_slices(block, table.limit(0), "mel", fn, "text string, n int", {}).collect() == []


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test data")
def test_p_of_slopes_by_integration(spark):
    """Student's t, its density added up over a fine grid, for all lines of the query."""
    for r in M.with_p(M.regressions(Q.kmer_signal(spark, SF), "kmer")).collect():
        v = r.n - 2
        x = np.linspace(0, abs(r.t), 200_001)
        density = np.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) - (v + 1) / 2 * np.log1p(x * x / v))
        assert r.p == pytest.approx(1 - 2 * np.trapezoid(density, x), abs=1e-8)


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test data")
def test_p_of_cooccurrence_by_summation(spark):
    """All terms of the binomial tail, for all pairs of the query."""
    targets = spark.createDataFrame([(t,) for t in Q.TARGETS], "kmer string")
    positions = M.kmer_positions(Q.view(spark, SF, "seqs"), "doc_id", 6, 50)
    n = positions.select("doc_id", "bin").distinct().count()
    logs = np.cumsum(np.concatenate(([0.0], np.log(np.arange(1, n + 1)))))
    k = np.arange(n + 1)
    tails = {}
    rows = M.cooccurrence(positions, "doc_id", n, targets).collect()
    assert len(rows) > 100
    for r in rows:
        p = r.n_a / n * (r.n_b / n)
        if p not in tails:
            terms = np.exp(logs[n] - logs - logs[::-1] + k * math.log(p) + (n - k) * math.log1p(-p))
            tails[p] = np.cumsum(terms[::-1])[::-1]
        assert r.p == pytest.approx(min(1.0, tails[p][r.both]), rel=1e-6, abs=1e-12)


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test data")
def test_isolation_of_groups(spark):
    """A search for each chromosome goes on when one fails."""
    seqs = spark.createDataFrame([("X", "ACGT"), ("Y", None), ("Z", "GGAC")], "name string, seq string")
    run = A.isolated(lambda g: {"at": g["seq"].iloc[0].index("AC")}, ["name"], "at int", {"at": -1})
    got = {r.name: (r.at, r.error is None) for r in seqs.groupBy(F.col("name")).applyInPandas(run, "name string, at int, error string").collect()}
    assert got == {"X": (0, True), "Y": (-1, False), "Z": (2, True)}
