"""What larger tables need: results of the plainer forms, with work that grows no faster than the input and the output."""

import random

import pytest
from pyspark.sql import functions as F

from strandspark.operators import alignment as A
from strandspark.operators import annotation as N
from strandspark.operators import coverage as C
from strandspark.operators import genes as G
from strandspark.operators import intervals as I
from strandspark.operators import motif as M
from strandspark.operators import ordered as O
from strandspark.operators import permutation as P
from strandspark.operators import score_distribution as D
from strandspark.sources import writers as W


def shuffles(df):
    """The operators of the plan that move rows."""
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]


@pytest.mark.parametrize("first", [False, True])
def test_orthogroups(spark, first):
    rng = random.Random(5)
    group = lambda: rng.choice([1, 2, 3, None])
    a = spark.createDataFrame([(k, group()) for k in range(60)] + [(None, 1)], "key long, nation int")
    b = spark.createDataFrame([(k, f"n{k}", group()) for k in range(40)] + [(None, "x", 2)], "key long, name string, nation int")
    orth = a.select(F.col("key").alias("key1"), "nation").join(b.select(F.col("key").alias("key2"), "nation"), "nation").select("key1", "key2")
    got, want = G.orthogroup_pairs(a, b, "nation", first), G.ortholog_pairs(a, orth, b, first)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 30
    # one join alone makes the pairs
    assert len(shuffles(got)) == 1


def test_orthogroup_pairs_come_in_runs(spark, tmp_path, monkeypatch):
    """Pairs are made from packs of genes, so that rows of one b_key follow each other over the same few a_key; packs and parts leave no seam."""
    a = spark.createDataFrame([(k * 7 % 601, 1) for k in range(601)] + [(5, 1), (5, 2)], "key long, nation int")
    b = spark.createDataFrame([(k * 7 % 211, f"n{k * 7 % 211}", 1) for k in range(211)] + [(3, "n3", 1), (900, None, 2)], "key long, name string, nation int")
    monkeypatch.setattr(G, "PARTS", 2)
    G.orthogroup_pairs(a, b, "nation").coalesce(1).write.parquet(str(tmp_path / "pairs"))
    found = list(map(tuple, spark.read.parquet(str(tmp_path / "pairs")).collect()))
    want = [(x.key, y.key, y.name) for x in a.collect() for y in b.collect() if x.nation == y.nation]
    assert sorted(found, key=str) == sorted(want, key=str) and len(found) > 100_000
    assert 1 + sum(x[1] != y[1] for x, y in zip(found, found[1:], strict=False)) < len(found) / 50
    monkeypatch.setattr(G, "PACK", 3)
    assert sorted(map(tuple, G.orthogroup_pairs(a, b, "nation").collect()), key=str) == sorted(want, key=str)


def sequences(spark, repeated):
    rng = random.Random(8)
    rows = [(k, "".join(rng.choices("ACGTNacgt", [9, 9, 9, 9, 1, 2, 2, 2, 2], k=rng.choice([0, 5, 6, 49, 55, 56, 300])))) for k in range(40)] + [(90, None), (91, "ACGTÄACGTACé" * 9)]
    rows += [(rows[k][0] if repeated else 100 + k, "ACGT" * 30) for k in range(7)] + [(None, "ATGCAT" * 20)]
    return spark.createDataFrame(rows + ([(None, "GATTACA" * 9)] if repeated else []), "doc_id long, seq string")


@pytest.mark.parametrize("repeated", [False, True])
def test_kmers_over_arrays(spark, repeated, monkeypatch):
    """Against windows as rows; without repeated keys nothing is shuffled by key, and pieces and stretches leave no seam."""
    seqs = sequences(spark, repeated)
    plain = M._canonical_windows(seqs, ["doc_id"], 6, "seq")
    letters = F.translate("code", "0123", "ATGC").alias("kmer")
    want = plain.groupBy("doc_id", letters).agg(F.count("*").alias("n")).select("doc_id", "kmer", "n")
    at = plain.select(letters, "doc_id", F.floor(F.col("pos") / 50).cast("long").alias("bin")).distinct()
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for piece in (1 << 20, 7, 120):
        monkeypatch.setattr(M, "PIECE", piece)
        profile, positions = M.kmer_profile(seqs, "doc_id", 6), M.kmer_positions(seqs, "doc_id", 6, 50)
        assert rows(profile) == rows(want) and rows(positions) == rows(at)
        for df in (profile, positions):
            assert ("Aggregate" in df._jdf.queryExecution().optimizedPlan().toString()) == repeated
    targets = spark.createDataFrame([("ACGTAC",), ("ATGCAT",), ("AAAAAA",), ("ATATAT",)], "kmer string")
    n = at.select("doc_id", "bin").distinct().count()
    got = M.cell_cooccurrence(M.kmer_cells(seqs, "doc_id", 6, 50), "doc_id", None, 6, targets)
    assert rows(got) == rows(M.cooccurrence(at, "doc_id", n, targets)) and got.count() > 5


def peaks_of(seed, n, place=60, odd=True):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        s = rng.randrange(place)
        out.append((k, rng.choice([1, 2]), s, s + rng.choice([0, 1, 3, 8, 15, -2] if odd else [1, 3, 8, 15, 30]), k % 2))
    return out


def both_sides(spark, seed, n=120, **options):
    rows = peaks_of(seed, n, **options)
    table = spark.createDataFrame(rows, "pid long, chr int, s long, e long, st int")
    named = [dict(zip(("pid", "chr", "s", "e", "st"), r, strict=True)) for r in rows]
    a, b = [r for r in named if not r["st"]], [r for r in named if r["st"]]
    return table.where("st = 0"), table.where("st = 1"), [(x, y) for x in a for y in b if x["chr"] == y["chr"]], a


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_intervals_without_pairs(spark, seed):
    """Many rows at few places, also points and rows turned round, against all pairs."""
    left, right, pairs, a = both_sides(spark, seed)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    strict = [(x["pid"], x["chr"], x["s"], x["e"], 0) for x, y in pairs if y["e"] > x["s"] and y["s"] < x["e"]]
    assert rows(I.filter_by_regions(left, right)) == sorted(strict, key=str) and len(strict) > 100
    best = {}
    for x, y in pairs:
        if y["s"] <= x["e"] and (y["e"] > x["s"] or (x["s"] == x["e"] and y["e"] == x["s"])):
            best[x["pid"]] = min(best.get(x["pid"], 999), y["pid"])
    assert rows(N.overlap_ranks(left, {"other": right.withColumn("rank", F.col("pid"))})) == sorted(((x["pid"], best.get(x["pid"])) for x in a), key=str)
    near = sum(abs(x["s"] - y["s"]) < 3 or abs(x["e"] - y["e"]) < 3 for x, y in pairs)
    assert A.shared_sites(left, right).first().both == near > 50
    left, right, pairs, a = both_sides(spark, seed, odd=False)
    short, span = set(), {}
    for x, y in pairs:
        if x["s"] > y["s"] and x["s"] < y["e"] or x["e"] > y["s"] and x["e"] < y["e"] or y["s"] > x["s"] and y["e"] < x["e"]:
            z = y if x["e"] - x["s"] > y["e"] - y["s"] else x
            short.add((z["chr"], z["s"], z["e"]))
        if y["s"] <= x["s"] <= y["e"] or y["s"] <= x["e"] <= y["e"]:
            low, high = span.get(x["pid"], (999, -999))
            span[x["pid"]] = min(low, y["s"]), max(high, y["e"])
    assert rows(I.shorter_of_pair(left, right)) == sorted(short, key=str)
    assert rows(I.overlap_all(left, right).select("pid", "u_s", "u_e")) == sorted(((k, *v) for k, v in span.items()), key=str)


@pytest.mark.parametrize("piece", [3, 1024])
def test_copies_in_pieces(spark, piece, monkeypatch):
    """A row comes once for each match, in pieces; where no row is turned round or a point, no rows are paired."""
    monkeypatch.setattr(I, "PIECE", piece)
    left, right, pairs, _ = both_sides(spark, 4, odd=False)
    got = I.filter_by_regions(left, right)
    want = [(x["pid"], x["chr"], x["s"], x["e"], 0) for x, y in pairs if y["e"] > x["s"] and y["s"] < x["e"]]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 500
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_bins_fit(spark):
    """Bins of a join are about as wide as rows are long, so that rows far apart don't meet."""
    left, right, *_ = both_sides(spark, 3, n=40)
    assert I.fitting_width(left, right) == 16
    longer = left.withColumn("e", F.col("s") + 1000)
    assert I.fitting_width(longer, right) == 512


@pytest.mark.parametrize("pack", [3, 64])
def test_pairs_of_packed_rows(spark, pack, monkeypatch):
    """Rows of one start are packed: odd rows, equal rows, nulls and long rows among short ones give all pairs of brute force."""
    monkeypatch.setattr(I, "PACK", pack)
    rng = random.Random(9)
    rows = peaks_of(7, 160) + [(500, 1, 5, 4000, 0), (501, 1, 5, 4000, 1), (502, 2, 3900, 3990, 1), (503, 1, 3990, 3950, 0)]
    rows += [(None, 1, 7, 9, k % 2) for k in range(9)] + [(600, None, 7, 9, 0), (601, 1, None, 9, 1), (602, 1, 7, None, 0)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "pid long, chr int, s long, e long, st int")
    got = I.overlap(table.where("st = 0"), table.where("st = 1").withColumn("note", F.concat(F.lit("n"), "pid")))
    proper = [r for r in rows if None not in r[1:4]]
    touch = lambda x, y: x[1] == y[1] and y[2] <= x[3] and (y[3] > x[2] or (x[2] == x[3] and y[3] == x[2]))
    want = [(x[0], y[0], max(x[2], y[2]), min(x[3], y[3]), f"n{y[0]}" if y[0] is not None else None) for x in proper for y in proper if (x[4], y[4]) == (0, 1) and touch(x, y)]
    assert sorted(map(tuple, got.select("l_pid", "r_pid", "os", "oe", "r_note").collect()), key=str) == sorted(want, key=str) and len(want) > 500


def test_pairs_come_in_runs(spark, tmp_path):
    """Dense rows in no order: a join of starts, whose pairs take less disk than one by one."""
    rng = random.Random(11)
    rows = [(k, 1, s := rng.randrange(40), s + rng.randrange(20, 24), k % 2) for k in range(1000)]
    table = spark.createDataFrame(rows, "pid long, chr int, s long, e long, st int").select("pid", "chr", "s", "e", "st")
    pairs = I.overlap(table.where("st = 0").drop("st"), table.where("st = 1").drop("st")).select("l_pid", "r_pid", "l_chr", "os", "oe")
    pairs.coalesce(1).write.parquet(str(tmp_path / "pairs"))
    found = spark.read.parquet(str(tmp_path / "pairs")).collect()
    assert len(found) == sum(y[2] <= x[3] and y[3] > x[2] for x in rows for y in rows if (x[4], y[4]) == (0, 1)) > 100_000
    runs = 1 + sum((x.os, x.oe) != (y.os, y.oe) for x, y in zip(found, found[1:], strict=False))
    assert runs < len(found) / 5


def test_merges_settle_where_runs_never_end(spark, monkeypatch):
    """A chromosome that is one run: the state forgets where it began, so stretches settle in a few rounds, not one a stretch."""
    rows = [(1, s, s + 20 + (s * 7) % 13, s % 3) for s in range(400) for _ in range(3)]
    table = spark.createDataFrame(rows, "chr int, s long, e long, st int").withColumn("e", F.col("e") + F.monotonically_increasing_id() % 3)
    made = []
    monkeypatch.setattr(O, "checkpoint", lambda df, real=O.checkpoint: (made.append(1), real(df))[1])
    got = I.merge_runs(table, 0.5, stretch=60).collect()
    assert [(r.s, r.n, r.sets) for r in got] == [(0, 1200, 3)] and len(made) < 40


def test_hits_of_many_rows_are_one_batch(spark, monkeypatch):
    """Hits of short sequences travel together, and come out the same when they don't fit into one batch."""
    seqs = sequences(spark, True)
    batches = []
    columns = [dict(zip("ACGT", v, strict=True)) for v in ((1.0, -0.5, 0.25, -1.0), (0.5, 1.5, -1.0, 0.0))]
    real = M.spread

    class Seen:
        def __init__(self, df):
            self.df = df

        def mapInArrow(self, run, schema):  # noqa: N802
            found = list(run(iter(self.df.toArrow().to_batches())))
            batches.append(len(found))
            return self.df.sparkSession.createDataFrame([tuple(r.values()) for x in found for r in x.to_pylist()], schema)

    whole = sorted(map(tuple, M.scan(seqs, columns, 1.0).collect()), key=str)
    monkeypatch.setattr(M, "spread", lambda df: Seen(real(df).coalesce(1)))
    assert sorted(map(tuple, M.scan(seqs, columns, 1.0).collect()), key=str) == whole and len(whole) > 500
    monkeypatch.setattr(M, "PIECE", 50)
    assert sorted(map(tuple, M.scan(seqs, columns, 1.0).collect()), key=str) == whole
    assert batches[0] <= 4 < batches[1]


def test_chances_of_hits_without_a_shuffle(spark):
    """All hits have a few scores: they aren't dealt by score."""
    columns = [{"A": 1.0, "C": -0.5, "G": 0.25, "T": -1.0}]
    seqs = sequences(spark, False)
    found = D.scan_with_p(seqs, columns, D.background(seqs.select("seq"), 0), 0.5)
    assert found.count() > 100
    assert "hashpartitioning(score" not in found._jdf.queryExecution().executedPlan().toString()


def test_slopes_by_parts_of_the_hashes(spark, monkeypatch):
    """The profile is made once, and many parts of the hashes give the slopes of one."""
    seqs = sequences(spark, False).where("doc_id is not null")
    responses = seqs.select("doc_id", (F.col("doc_id") * 7 % 11).cast("double").alias("y"))
    profile = M.kmer_profile(seqs, "doc_id", 2).withColumnRenamed("n", "x")
    run = lambda: P.slopes(profile, responses, "kmer", "doc_id", 130)
    assert run()._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    whole = {(r.feature, r.round): r.slope for r in run().collect()}
    monkeypatch.setattr(P, "RANKED", 30)
    got = {(r.feature, r.round): r.slope for r in run().collect()}
    assert got.keys() == whole.keys() and len(got) == 131 * 10
    assert all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in whole.items())
    drawn = P.shuffled(responses, "doc_id", 3).collect()
    assert len({(r.round, r.row) for r in drawn}) == len(drawn) == 4 * responses.count()
    assert all(sorted(r.y for r in drawn if r.round == k) == sorted(r.y for r in drawn if r.round == 0) for k in (1, 2, 3))


@pytest.mark.parametrize("kind", ["chain", "steps", "random"])
def test_clusters_in_few_rounds(spark, kind, monkeypatch):
    """Against a union of sets, in rounds that don't grow with a chain's length; a peak without genes is its own cluster."""
    rng = random.Random(4)
    if kind == "random":
        pairs = [(rng.randrange(300), rng.randrange(500)) for _ in range(330)]
    else:
        place = list(range(300)) if kind == "chain" else [k // 2 if k % 2 else 299 - k // 2 for k in range(300)]
        pairs = [(place[k], k) for k in range(300)] + [(place[k], k + 1) for k in range(300)]
    pairs += pairs[:5] + [(1000, None), (None, 3), (None, 7)]
    top = {p: p for p, _ in pairs if p is not None}

    def root(p):
        while top[p] != p:
            p = top[p]
        return p

    first = {}
    for p, g in pairs:
        if p is not None and g is not None:
            x, y = sorted((root(p), root(first.setdefault(g, p))))
            top[y] = x
    made = []
    monkeypatch.setattr(G, "checkpoint", lambda df, real=G.checkpoint: (made.append(1), real(df))[1])
    got = G.gene_clusters(spark.createDataFrame(pairs, "pid int, gene int")).collect()
    assert sorted(map(tuple, got)) == sorted((p, root(p)) for p in top) and len(made) < 40


def test_steps_of_tags_are_made_once(spark, monkeypatch):
    """Tags are counted once for the extension, whose steps are then kept, and once for all stages of a store."""
    rng = random.Random(6)
    tags = [(rng.choice([1, 2]), rng.choice("+-"), rng.choice([0, 3, 40, 41, 70000, 70001, 70049])) for _ in range(300)]
    table = spark.createDataFrame(tags, "chr int, strand string, loc long")
    got, want = {}, {}
    made = []
    monkeypatch.setattr(C, "checkpoint", lambda df, real=C.checkpoint: (made.append(1), real(df))[1])
    signal = C.extend(C.tag_counts(table), 50)
    assert len(made) == 1 and "loc" not in signal._jdf.queryExecution().optimizedPlan().toString()
    for r in signal.collect():
        got.update({(r.chr, x): r.val for x in range(r.start, r.end)})
    for c, strand, loc in tags:
        for x in range(loc + 1, loc + 51) if strand == "+" else range(max(0, loc - 50), loc):
            want[c, x] = want.get((c, x), 0) + 1
    assert got == want
    stages = W.count_stages(C.tag_counts(table), limit=3)
    assert stages._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    n = {}
    for t in tags:
        n[t] = n.get(t, 0) + 1
    rows = [(s, *t, v) for t, k in n.items() for s, v in (("raw", float(k)), ("norm", k * 1e6 / 300), ("lim", float(min(k, 3))))]
    assert sorted(map(tuple, stages.collect())) == sorted(rows)
