"""Micro fixtures: edges, quirks and their parity flags."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandspark.functions import sequence as S
from strandspark.operators import alignment as A
from strandspark.operators import coverage as C
from strandspark.operators import genes as G
from strandspark.operators import intervals as I
from strandspark.operators import motif as M
from strandspark.operators import points as Z
from strandspark.operators.ordered import running_max, running_sum


def iv(spark, *rows):
    return spark.createDataFrame([(0, s, e, st) for s, e, st in rows], "chr int, s long, e long, st int")


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("ACGTNacgt-", "-acgtNACGT"), ("", "")])
def test_revcomp(spark, text, want):
    assert one(spark, S.revcomp(F.col("t")), t=text) == want


@pytest.mark.parametrize("start,end,want", [(3, 5, "GTA"), (0, 3, "ACG"), (0, None, "ACGTACGTAC"), (9, 0, "AC")])
def test_slice(spark, start, end, want):
    assert one(spark, S.slice_(F.col("t"), start, end), t="ACGTACGTAC") == want


def test_codons(spark):
    assert one(spark, S.codon_variants(F.col("t")), t="ATG") == ["TTG", "GTG", "CTG", "AAG", "AGG", "ACG", "ATA", "ATT", "ATC"]
    assert one(spark, S.codon_variants(F.col("t"), "A", "T"), t="ATG") == ["TTG"]
    rows = S.classified_variants(spark.createDataFrame([("ATG",), ("TGG",)], "codon string"), "codon").collect()
    assert {r.kind for r in rows if r.codon == "ATG"} == {"nonsynonymous"}
    assert {r.variant for r in rows if r.codon == "TGG" and r.kind == "nonsense"} == {"TAG", "TGA"}
    assert one(spark, S.codons(F.col("t")), t="ATGCC") == ["ATG", "CC"]
    assert one(spark, S.translate(F.col("t")), t="ATGTAAGGNC") == "M*X"
    assert sorted(S.CODONS.values()).count("*") == 3 and len(S.CODONS) == 64
    assert one(spark, S.codons(F.col("t")), t="") == []


@pytest.mark.parametrize("n", [0, 3, 5, 255, 256, 257, 700])
def test_kmers_cross_pieces(spark, n):
    text = "".join(random.Random(n).choices("ACGT", k=n))
    assert one(spark, S.kmers(F.col("t"), 5), t=text) == [text[i : i + 5] for i in range(n - 4)]
    assert one(spark, S.codons(F.col("t")), t=text) == [text[i : i + 3] for i in range(0, n, 3)]


def test_canonical_takes_the_listed_order(spark):
    assert one(spark, S.canonical(F.col("t")), t="GGGTTT") == "AAACCC"
    assert one(spark, S.canonical(F.col("t")), t="CAC") == "GTG"


@pytest.mark.parametrize(
    "a,b,want",
    [
        ((10, 20), (20, 30), [(20, 20)]),
        ((10, 20), (5, 10), []),
        ((10, 20), (12, 15), [(12, 15)]),
        ((20, 20), (10, 20), [(20, 20)]),
        ((10, 9000), (0, 20000), [(10, 9000)]),
    ],
)
def test_touching(spark, a, b, want):
    got = I.overlap(iv(spark, (*a, 0)), iv(spark, (*b, 1)), width=7)
    assert [(r.os, r.oe) for r in got.collect()] == want


def test_zero_is_missing(spark):
    a, b = iv(spark, (0, 5, 0)), iv(spark, (0, 5, 1))
    assert I.overlap(a, b).count() == 1 and I.overlap(a, b, zero_is_missing=True).count() == 0


def test_older_overlaps_miss_containment(spark):
    assert I.overlap_all(iv(spark, (1, 100, 0)), iv(spark, (40, 60, 1))).count() == 0
    assert I.overlap_all(iv(spark, (45, 55, 0)), iv(spark, (40, 60, 1)), iv(spark, (50, 90, 2))).select("u_s", "u_e").first() == (40, 90)
    assert I.shorter_of_pair(iv(spark, (10, 20, 0)), iv(spark, (10, 20, 1))).count() == 0
    assert I.region_annotations(iv(spark, (40, 60, 0)), iv(spark, (1, 100, 1))).count() == 0
    assert I.region_annotations(iv(spark, (40, 60, 0)), iv(spark, (1, 100, 1)), spanning=True).count() == 1


def test_join_kinds_on_random_intervals(spark):
    rng = random.Random(2)
    make = lambda n: [(rng.randrange(3), s := rng.randrange(500), s + rng.randrange(60), k) for k in range(n)]
    a, b = make(150) + [(None, 1, 2, 999), (0, None, 5, 998)], make(150)
    left, right = (spark.createDataFrame(x, "chr int, s long, e long, st int") for x in (a, b))
    ok = lambda x, y: None not in (x[0], x[1]) and x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]
    pairs = sorted((x[3], y[3]) for x in a for y in b if ok(x, y))
    got = I.interval_join(left, right, I.symmetric, width=16)
    assert sorted((r.l_st, r.r_st) for r in got.collect()) == pairs
    semi = {r.st for r in I.interval_join(left, right, I.symmetric, "semi", width=16).collect()}
    anti = {r.st for r in I.interval_join(left, right, I.symmetric, "anti", width=16).collect()}
    assert semi == {p[0] for p in pairs} and anti == {x[3] for x in a} - semi
    assert I.interval_join(left, right, I.symmetric, "left", width=16).count() == len(pairs) + len(anti)


def test_stream_hits_and_the_unset_zero(spark):
    peaks = spark.createDataFrame([(1, 0, 100)], "pid int, chr int, s long")
    genes = spark.createDataFrame([(1, 0, 100, 150, "+"), (2, 0, 93, 150, "+")], "gid int, chr int, s long, e long, strand string")
    assert I.stream_nearest(peaks, genes, 50, True, "pid", "gid").first().distance == 0
    assert I.stream_nearest(peaks, genes, 50, True, "pid", "gid", zero_is_unset=True).first().distance == 7


def test_runs(spark):
    rows = iv(spark, (10, 20, 0), (40, 50, 0), (15, 30, 1))
    runs = lambda df: sorted((r.s, r.e, r.sets) for r in df.collect())
    assert runs(I.union_runs(rows)) == [(10, 30, 2), (40, 50, 1)]
    assert runs(I.union_runs(rows, drop_last=True)) == [(10, 30, 2)]
    assert runs(I.intersect_runs(rows)) == [(10, 30, 2)]
    assert runs(I.merge_runs(rows, 0.4)) == [(10, 30, 2), (40, 50, 1)]
    assert runs(I.merge_runs(rows, 0.5)) == [(10, 14, 1), (15, 30, 1), (40, 50, 1)]
    assert runs(I.union_runs(rows, pad=6)) == [(4, 56, 2)]


def test_runs_over_bins_match_one_window(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), s := rng.randrange(3000), s + 1 + rng.randrange(80), rng.randrange(2)) for _ in range(200)]
    got = sorted((r.chr, r.s, r.e, r.n) for r in I.union_runs(spark.createDataFrame(rows, "chr int, s long, e long, st int"), width=64).collect())
    want = []
    for c in (0, 1):
        now = None
        for s, e in sorted((r[1], r[2]) for r in rows if r[0] == c):
            if now and s < now[1]:
                now = [now[0], max(now[1], e), now[2] + 1]
                want[-1] = (c, *now)
            else:
                now = [s, e, 1]
                want.append((c, *now))
    assert got == sorted(want)


def test_running_values(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(100), rng.randrange(-5, 9)) for k in range(300)]
    df = spark.createDataFrame([(0, *r) for r in rows], "p int, k int, pos long, v int")
    total, most, sums, maxes = 0, None, {}, {}
    for k, pos, v in sorted(rows, key=lambda r: (r[1], r[0])):
        maxes[k] = most
        most = v if most is None else max(most, v)
        total += v
        sums[k] = total
    assert {r.k: r.x for r in running_sum(df, ["p"], ["k"], "pos", F.col("v"), "x", width=8).collect()} == sums
    assert {r.k: r.x for r in running_max(df, ["p"], ["k"], "pos", F.col("v"), "x", width=8).collect()} == maxes


def test_extension(spark):
    tags = spark.createDataFrame([(0, "+", 5, 1), (1, "-", 5, 1), (2, "-", 1, 2)], "chr int, strand string, loc long, n long")
    spans = lambda df: sorted((r.chr, r.start, r.end, r.val) for r in df.collect())
    assert spans(C.extend(tags, 3)) == [(0, 6, 9, 1), (1, 2, 5, 1), (2, 0, 1, 2)]
    sizes = spark.createDataFrame([(0, 7), (1, 100), (2, 100)], "chr int, length long")
    assert spans(C.extend(tags, 3, sizes))[0] == (0, 6, 7, 1)


def test_extension_sums_per_base(spark):
    rng = random.Random(9)
    rows = [(0, rng.choice("+-"), rng.randrange(200), rng.randrange(1, 4)) for _ in range(80)]
    want = [0] * 300
    for _, strand, x, n in rows:
        for p in range(x + 1, x + 11) if strand == "+" else range(max(0, x - 10), x):
            want[p] += n
    got = [0] * 300
    for r in C.extend(spark.createDataFrame(rows, "chr int, strand string, loc long, n long"), 10).collect():
        got[r.start : r.end] = [r.val] * (r.end - r.start)
    assert got == want


def test_normalization(spark):
    tags = spark.createDataFrame([(0, "+", 5, 1), (0, "-", 9, 3)], "chr int, strand string, loc long, n long")
    assert [r.norm for r in C.normalize(tags, 8).orderBy("loc").collect()] == [2, 6]
    assert [r.norm for r in C.normalize(tags, 8, 16).orderBy("loc").collect()] == [0.5, 1.5]
    files = spark.createDataFrame([("a", 0, 1, 4.0), ("b", 0, 1, 4.0)], "file string, chr int, loc long, val double")
    assert sorted(r.norm for r in C.normalize_files(files, "file", 8).collect()) == [4, 8]
    assert sorted(r.norm for r in C.normalize_files(files, "file", 8, cumulative=False).collect()) == [8, 8]
    assert C.normalize(tags.limit(0)).count() == 0


def test_histogram_and_totals(spark):
    tags = spark.createDataFrame([(0, "+", p, 30, k) for k, p in enumerate([1, 1, 1, 2, 3, 3])], "chr int, strand string, loc long, mapq int, line long")
    got = {r.bin: r.positions for r in C.histogram(C.tag_counts(tags), 100).collect()}
    assert got == {0: 97, 1: 1, 2: 2}
    assert tuple(C.totals(tags).first()) == (6, 3, 3, 6)
    assert C.first_tags(tags).orderBy("line").select("line").collect() == [(0,), (3,), (4,)]


def test_top_peaks_may_be_one_less(spark):
    peaks = spark.createDataFrame([(k, 0, 10 * k, 10 * k + 10) for k in range(5)], "pid int, chr int, s long, e long")
    tags = spark.createDataFrame([(0, "+", 10 * k + 1, k + 1) for k in range(5)], "chr int, strand string, loc long, n long")
    assert [r.pid for r in C.top_peaks(peaks, tags, tags.limit(0), 3).collect()] == [4, 3, 2]
    assert [r.pid for r in C.top_peaks(peaks, tags, tags.limit(0), 3, one_less=True).collect()] == [4, 3]


def test_small_signal_operators(spark):
    signal = spark.createDataFrame([(0, 0, 1.0), (0, 10, 2.0)], "chr int, loc long, val double")
    assert C.expand_steps(signal, 10).count() == 20
    sizes = spark.createDataFrame([(0, 5)], "chr int, length long")
    assert C.scaffold(sizes).count() == 10
    files = C.signal_slice(signal, 0, 0, 10).first()
    assert (files.lo, files.hi, files.step, files.n, files.total) == (0, 10, 10, 2, 3.0)


def test_pssm(spark):
    counts = spark.createDataFrame([(0, 0, b, n) for b, n in zip("ACGT", (8, 0, 0, 0), strict=True)], "matrix int, pos int, base string, n long")
    got = {r.base: r.score for r in M.pssm(counts).collect()}
    assert got["A"] == pytest.approx(1.165198, abs=1e-6) and got["C"] == pytest.approx(-0.771553, abs=1e-6)
    # pseudo counts are in the denominator twice: (8 + 1.5) / (8 + 1.5 + 1.5)
    assert sum(math.exp(r.score) for r in M.log_matrix(counts).collect()) == pytest.approx(9.5 / 11)


def test_scores(spark):
    columns = [{"A": 1.0, "C": 0.0, "G": 0.0, "T": 0.0}] * 2
    assert one(spark, M.literal_score(F.col("t"), columns), t="AC") == 1 and one(spark, M.literal_score(F.col("t"), columns), t="AN") is None
    best = one(spark, M.best_strand(F.col("t"), columns), t="TT")
    assert (best.score, best.strand) == (2, "-")
    assert one(spark, M.best_strand(F.col("t"), columns), t="AT").strand == "+"


def test_window_place_wraps(spark):
    peaks = spark.createDataFrame([(1, 0, 100)], "pid int, chr int, loc long")
    hits = spark.createDataFrame([(0, 90, "+", 0), (0, 110, "+", 0)], "chr int, start long, strand string, matrix int")
    assert [(r.bin, r.hits) for r in M.window_histogram(peaks, hits, 20).collect()] == [(19, 2)]


def test_binomial_tail():
    want = sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(4, 11))
    assert M.binomial_tail(4, 10, 0.3) == pytest.approx(want) and M.binomial_tail(0, 10, 0.3) == 1


def test_binomial_tail_far_from_the_mean():
    assert M.binomial_tail(5_000, 600_000_000, 1e4 / 6e8) == pytest.approx(1)
    assert M.binomial_tail(220_000, 600_000_000, 2.4e5 / 6e8) == pytest.approx(1)
    assert M.binomial_tail(20_000, 600_000_000, 1e4 / 6e8) == 0
    assert M.binomial_tail(11, 10, 0.3) == 0
    for x in range(1, 61):
        want = sum(math.comb(60, k) * 0.4**k * 0.6 ** (60 - k) for k in range(x, 61))
        assert M.binomial_tail(x, 60, 0.4) == pytest.approx(want)


def test_step_cut_ranks_by_slope(spark):
    rows = spark.createDataFrame([(k, float(-k), 0.04) for k in range(4)], "k int, slope double, p double")
    assert sorted(r.k for r in M.step_cut(rows, 0.1, "k").collect()) == [2, 3]


ROWS = [(0, 0, "AC-GT-", 10, "+"), (0, 1, "A-CGTT", 50, "-"), (0, 2, "ACCG-T", 90, "+")]


@pytest.fixture(scope="module")
def block(spark):
    return spark.createDataFrame(ROWS, "block long, species int, seq string, p_start long, strand string")


@pytest.fixture(scope="module")
def cols(block):
    return A.with_parent(A.columns(block), block)


def test_alignment_places(block, cols):
    at = {(r.species, r.col): (r.u, r.parent) for r in cols.collect()}
    assert [at[0, c] for c in range(6)] == [(0, 10), (1, 11), (2, None), (2, 12), (3, 13), (4, None)]
    assert [at[1, c][1] for c in range(6)] == [55, None, 54, 53, 52, 51]
    assert {r.col: r.u for r in A.unaligned(A.columns(block), block).where("species = 0").collect()}[5] == 0
    assert {(r["from"], r["to"]) for r in A.lift(cols, 0, 1).collect()} == {(10, 55), (11, None), (12, 53), (13, 52)}


def test_alignment_slices(block, cols):
    cut = {r.species: (r.seq, r.p_start) for r in A.slice_columns(block, 1, 4).collect()}
    assert cut == {0: ("C-G", 11), 1: ("-CG", 52), 2: ("CCG", 91)}
    assert {r.species: r.seq for r in A.slice_by_reference(cols, 0, 1, 3).collect()} == {0: "C-G", 1: "-CG", 2: "CCG"}
    assert {r.species: r.seq for r in A.reference_columns(cols, 0).collect()} == {0: "ACGT", 1: "A-GT", 2: "ACG-"}
    assert {r.species: (r.seq, r.strand) for r in A.revcomp_blocks(block).collect()}[0] == ("-AC-GT", "-")


def test_alignment_lines(block, cols):
    assert A.match_line(cols).first().line == "*  *  " and A.no_gap_line(cols, 0).first().line == ".  .  "
    assert A.segregating_sites(cols).count() == 0 and A.segregating_sites(cols, gaps=True).count() == 4
    assert {(r.col, r.base) for r in A.private_alleles(cols, 0, snps_only=False).collect()} == {(2, "-"), (5, "-")}
    near = {r.col: r.near for r in A.fill_gaps(cols).where("species = 0").collect()}
    assert near[2] == 11 and near[5] == 13
    assert A.clustal(block, 4).count() == 6
    assert A.fasta_lines(block).where("species = 0").first().text == ">0 0:10-14:+\nAC-GT-"


def test_fasta_text(spark):
    df = spark.createDataFrame([(1, ">a first one\nAC\n-T\n\n>b\nACGT\n")], "k int, t string")
    assert [tuple(r)[2:] for r in A.parse_fasta_text(df, "t", "k").orderBy("i").collect()] == [("a", "first one", "AC-T"), ("b", "", "ACGT")]


def test_apply_to_slices(spark, cols):
    import pandas as pd

    parts = spark.createDataFrame([(7, 0, 1, 3)], "pid int, block long, lo int, hi int")
    out = A.apply_to_slices(cols, parts, lambda d: pd.DataFrame({"pid": d["pid"][:1], "n": [len(d)]}), "pid int, n long")
    assert tuple(out.first()) == (7, 9)


def test_genes(spark):
    a = spark.createDataFrame([(1, "us", 5), (1, "ds", 6), (2, "ds", 6)], "pid int, side string, gene int")
    b = spark.createDataFrame([(9, "ds", 5), (9, "us", 6)], "pid int, side string, gene int")
    assert {tuple(r) for r in G.paired_peaks(a, b).collect()} == {(1, 9, 5, "us-ds"), (2, 9, 6, "ds-us")}
    pairs = spark.createDataFrame([(k, k // 2) for k in range(6)] + [(k + 1, k // 2) for k in range(6)] + [(50, 99)], "pid int, gene int")
    assert {r.pid: r.cluster for r in G.gene_clusters(pairs).collect()} == {**{k: 0 for k in range(7)}, 50: 50}
    rates = spark.createDataFrame([(1, 0.5), (1, 1.5), (2, -1.0), (3, float("nan"))], "family int, rate double")
    assert [tuple(r) for r in G.family_medians(rates, ["family"]).collect()] == [(1, 2, 1.0)]


def test_track(spark):
    f = spark.createDataFrame([("gene", 5, 9, {"b": "1", "a": "2"})], "type string, start int, end int, tags map<string,string>")
    assert f.select(G.feature_text().alias("t")).first().t == "gene|start:5|end:9|tags:(a:2),(b:1)"
    assert G.with_tag(f, "a", F.lit(7)).first().tags == {"b": "1", "a": "7"}
    assert G.features_in(f, 5, 9).count() == 1 and G.features_in(f, 6, 9).count() == 0
    assert G.checked_parent(f, F.lit("ACGT"), 4).first().seq == "ACGT"
    with pytest.raises(Exception, match="another length"):
        G.checked_parent(f, F.lit("ACG"), 4).collect()


def test_kernel_sums(spark):
    points = spark.createDataFrame([(0, 1.0, 0.0)], "k int, x double, y double")
    source = spark.createDataFrame([(0.0, 0.0, 2.0, 0.5, 0.5)], "x double, y double, a double, sx double, sy double")
    assert Z.gaussian_field(points, source, "k").first().field == pytest.approx(2 * math.exp(-1))
