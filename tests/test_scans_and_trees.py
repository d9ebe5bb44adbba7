"""Scans with carried state against plain folds, and pruned trees against recursion."""

import random

import pytest

from strandspark.operators import genes as G
from strandspark.operators import intervals as I
from strandspark.sources import readers as R


def peaks(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        s = rng.randrange(0, 2 * n if seed % 2 else 20 * n)
        rows.append((rng.choice("XY"), s, s + rng.choice([0, 5, 60, 200]), rng.randrange(4)))
    return [*rows, rows[0], rows[0], (None, 1, 5, 1)]


def merged(rows, cut):
    out = []
    for chrom in "XY":
        now = None
        for _, s, e, st in sorted(r for r in rows if r[0] == chrom and r[2] > r[1]):
            if now:
                shared = min(now[1], e) - max(now[0], s)
                if s < now[1] and max(shared / (e - s), shared / now[4]) > cut:
                    end = max(now[1], e)
                    now = [now[0], end, now[2] + 1, now[3] | {st}, end - now[0]]
                    continue
                out.append((chrom, now[0], now[1] if s >= now[1] else s - 1, now[2], len(now[3])))
            now = [s, e, 1, {st}, e - s]
        if now:
            out.append((chrom, *now[:3], len(now[3])))
    return sorted(out)


@pytest.mark.parametrize("stretch", [60, 100_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_merge_runs(spark, seed, stretch):
    rows = peaks(seed, 300)
    table = spark.createDataFrame(rows, "chr string, s long, e long, st int").repartition(3)
    got = I.merge_runs(table, 0.4, stretch=stretch)
    assert sorted(map(tuple, got.collect())) == merged(rows, 0.4)
    assert got.count() - I.merge_runs(table, 0.4, drop_last=True, stretch=stretch).count() == 1


@pytest.mark.parametrize("stretch", [40, 100_000])
def test_gene_lanes(spark, stretch):
    rows = [(*r[:3], i) for i, r in enumerate(peaks(1, 120)) if r[0]]
    want = {}
    for chrom in "XY":
        placed = []
        for _, s, e, gid in sorted(r for r in rows if r[0] == chrom):
            before = [lane for end, lane in placed if end >= s]
            want[gid] = before[-1] + 0.11 if before else 0.0
            placed.append((e, want[gid]))
    got = G.gene_lanes(spark.createDataFrame(rows, "chr string, s long, e long, gid int"), stretch=stretch)
    assert {r.gid: r.lane for r in got.collect()} == want


def test_no_rows(spark):
    assert I.merge_runs(spark.createDataFrame([], "chr string, s long, e long, st int"), 0.5).collect() == []


def test_clusters_of_a_long_chain(spark):
    """A chain longer than any fixed number of rounds would settle."""
    rng = random.Random(1)
    names = list(range(100))
    rng.shuffle(names)
    pairs = [(names[i], i) for i in range(100)] + [(names[i], i + 1) for i in range(100)] + [(1000, 5000)]
    got = {r.pid: r.cluster for r in G.gene_clusters(spark.createDataFrame(pairs, "pid int, gene int")).collect()}
    assert got == {**dict.fromkeys(range(100), 0), 1000: 1000}


def random_tree(seed, n=60, chain=False):
    rng = random.Random(seed)
    return [("n0", None, 0.5)] + [(f"n{i}", f"n{i - 1 if chain else rng.randrange(max(0, i - 6), i)}", rng.randrange(1, 50) / 8) for i in range(1, n)]


def pruned(nodes, leaves):
    """By recursion: (node, parent, length), what is above the first kept node is its own length."""
    children = {}
    for node, parent, _ in nodes:
        children.setdefault(parent, []).append(node)
    length, out = {n: x for n, _, x in nodes}, []

    def walk(node, above):
        found = [t for c in children.get(node, []) if (t := walk(c, 0.0))]
        if node in leaves or len(found) > 1:
            return (node, above + length[node], found)
        return found and (found[0][0], found[0][1] + above + length[node], found[0][2])

    def rows(tree, parent):
        out.append((tree[0], parent, tree[1]))
        for t in tree[2]:
            rows(t, tree[0])

    top = walk("n0", 0.0)
    if top:
        rows(top, None)
    return out


@pytest.mark.parametrize("seed,chain", [(1, False), (2, False), (3, True)])
def test_pruned_trees(spark, seed, chain):
    nodes = random_tree(seed, 60, chain)
    tips = [n for n, _, _ in nodes if n not in {p for _, p, _ in nodes}]
    rng = random.Random(seed)
    subsets = {f"s{k}": set(rng.sample(tips, min(len(tips), 1 + 3 * k))) for k in range(5)} | {"inner": {"n3", tips[-1]}}
    leaves = [(s, n) for s, own in subsets.items() for n in own] + [("none", "absent")]
    got = G.pruned_trees(spark.createDataFrame(nodes, "node string, parent string, length double"), spark.createDataFrame(leaves, "subset string, node string"))
    want = [(s, *row) for s, own in subsets.items() for row in pruned(nodes, own)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_newick():
    edges = R.newick_edges("((a:1,'b c''s (x):':2.5e-1[&note,(;)])in:0.5,d)[c]'root';")
    assert edges == [("a", "in", 1.0), ("b c's (x):", "in", 0.25), ("in", "root", 0.5), ("d", "root", None), ("root", None, None)]
    assert R.newick_edges("(A,(B,C));") == [("A", "4", None), ("B", "3", None), ("C", "3", None), ("3", "4", None), ("4", None, None)]
    assert R.newick_edges("x:2;") == [("x", None, 2.0)] and R.newick_edges("") == [] and R.newick_edges(None) == []
    assert R.newick_edges("(,):1;") == [("0", "2", None), ("1", "2", None), ("2", None, 1.0)]
