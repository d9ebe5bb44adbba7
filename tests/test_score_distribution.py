"""The distribution of scores against all words of the matrix's width."""

import itertools
import math
import random
from collections import Counter

import pytest

from strandspark.operators import score_distribution as D

SEQS = ["ACGTTGCAACGGATTACAGATTACA", "acgtNNacgatcgatgactagcta", "GGGGGGGGCC", "", None, "A"]


def counted(order, both=False):
    after = Counter()
    for s in SEQS:
        s = (s or "").upper()
        for i in range(len(s) - order):
            w = s[i : i + order + 1]
            if set(w) <= set("ACGT"):
                after.update([w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))] if both else [w])
    out = {}
    for k in range(order + 1):
        for c in map("".join, itertools.product("ACGT", repeat=k)):
            n = {b: sum(v for w, v in after.items() if w.startswith(c + b)) for b in "ACGT"}
            out |= {(c, b): n[b] / sum(n.values()) if sum(n.values()) else 0.25 for b in "ACGT"}
    return out


def enumerated(columns, chances, order):
    out = Counter()
    for word in itertools.product("ACGT", repeat=len(columns)):
        p = math.prod(chances["".join(word[max(0, i - order) : i]), b] for i, b in enumerate(word))
        out[sum(round(c[b] / D.GRAIN) for c, b in zip(columns, word, strict=True))] += p
    return {s: p for s, p in out.items() if p}


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SEQS)], "i int, seq string")


@pytest.mark.parametrize("order,both", [(0, False), (1, False), (2, True)])
def test_background(spark, seqs, order, both):
    got = {(r.context, r.base): r.p for r in D.background(seqs, order, both=both).collect()}
    assert got == pytest.approx(counted(order, both))


@pytest.mark.parametrize("order", [0, 1, 2])
def test_distribution_equals_enumeration(spark, seqs, order):
    rng = random.Random(order)
    matrices = {f"m{w}": [{b: rng.choice([-1.5, 0.25, rng.gauss(0, 2)]) for b in "ACGT"} for _ in range(w)] for w in (1, 3, 8)}
    rows = D.distribution(D.catalogue(spark, matrices), D.background(seqs, order)).collect()
    for name, columns in matrices.items():
        want = enumerated(columns, counted(order), order)
        own = {r.units: r for r in rows if r.matrix == name}
        assert {u: r.p for u, r in own.items()} == pytest.approx(want, abs=1e-15)
        for u in list(want)[:50]:
            assert own[u].tail == pytest.approx(sum(p for s, p in want.items() if s >= u), rel=1e-9)
        assert sum(want.values()) == pytest.approx(1)


def test_cutoff_and_scan(spark, seqs):
    columns = [{"A": 1.0, "C": -1.0, "G": 0.3, "T": -2.0}, {"A": -1.0, "C": 0.7, "G": 0.1, "T": 1.5}, {"A": 0.0, "C": 2.0, "G": -1.0, "T": 0.5}]
    want = enumerated(columns, counted(1, True), 1)
    tail = {u: sum(p for s, p in want.items() if s >= u) for u in want}
    got = D.scan_with_p(seqs, columns, D.background(seqs, 1, both=True), p=0.2).collect()
    found = set()
    for i, s in enumerate(SEQS):
        for pos in range(len(s or "") - 2):
            w = s[pos : pos + 3].upper()
            for strand, word in (("+", w), ("-", w[::-1].translate(str.maketrans("ACGT", "TGCA")))):
                if "N" not in word and tail[u := sum(round(c[b] / D.GRAIN) for c, b in zip(columns, word, strict=True))] <= 0.2:
                    found.add((i, pos, strand, u * D.GRAIN, round(math.log(tail[u]), 9)))
    assert found and {(r.i, r.pos, r.strand, r.score, round(r.ln_p, 9)) for r in got} == found and len(got) == len(found)
    assert D.scan_with_p(seqs, columns, D.background(seqs, 1), p=1e-9).count() == 0
    assert D.scan_with_p(seqs, columns, D.background(seqs, 1), cutoff=3.0).where("score < 3").count() == 0


def test_no_sequences(spark, seqs):
    rows = D.background(seqs.limit(0), 1).collect()
    assert len(rows) == 20 and {r.p for r in rows} == {0.25}
