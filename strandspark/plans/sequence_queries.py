"""Queries over sequences: codons, k-mers, motifs, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import motif as M
from .registry import registry
from .views import view

Q, SQL, query = registry()

#: A matrix of three columns for the queries.
MATRIX = [{"A": 1.0, "C": -0.5, "G": -1.0, "T": 0.25}, {"A": -1.0, "C": 1.25, "G": 0.5, "T": -0.75}, {"A": 0.5, "C": -1.0, "G": 1.5, "T": -0.25}]
WIDTH = len(MATRIX)


def sql_score(text: str) -> str:
    return " + ".join(
        f"case substr({text}, {k + 1}, 1) " + " ".join(
            f"when '{b}' then {v}::double" for b, v in c.items()
        ) + " end" for k, c in enumerate(MATRIX)
    )


RC = "reverse(translate({0}, 'ACGTacgt', 'TGCAtgca'))"
CANON = "translate(least(translate({0}, 'ATGC', '0123'), translate(" + RC + ", 'ATGC', '0123')), '0123', 'ATGC')"
CODE = ", ".join(f"('{c}', '{a}')" for c, a in S.CODONS.items())
CODE_TABLE = f"code(codon, aa) as (values {CODE})"


@query(f"select doc_id, {RC.format('seq')} as rc from seqs")
def revcomp(spark, d):
    return view(spark, d, "seqs").select("doc_id", S.revcomp(F.col("seq")).alias("rc"))


@query("select doc_id, substr(seq, 11, 40) as part, seq as whole from seqs")
def sequence_slice(spark, d):
    return view(spark, d, "seqs").select("doc_id", S.slice_(F.col("seq"), 11, 50).alias("part"), S.slice_(F.col("seq"), 0, None).alias("whole"))


@query(f"""with {CODE_TABLE}, c as (select doc_id, i, substr(seq, cast(i * 3 + 1 as int), 3) as codon from (select *, unnest(range(length(seq) // 3)) as i from seqs))
  select seqs.doc_id, coalesce(string_agg(aa, '' order by i), '') as protein from seqs left join (c join code using (codon)) on c.doc_id = seqs.doc_id group by seqs.doc_id""")
def translate(spark, d):
    return view(spark, d, "seqs").select("doc_id", S.translate(F.col("seq")).alias("protein"))


@query("select doc_id, i as index, substr(seq, cast(i * 3 + 1 as int), 3) as codon from (select *, unnest(range((length(seq) + 2) // 3)) as i from seqs)")
def codons(spark, d):
    return view(spark, d, "seqs").select(
        "doc_id", F.posexplode(S.codons(F.col("seq"))).alias("index", "codon")
    ).withColumn("index", F.col("index").cast("long"))


#: The different whole codons of all sequences, how often each occurs, and the codons one base away.
SEEN = f"""{CODE_TABLE}, seen as (select codon, aa, count(*) as n from (select substr(seq, cast(i * 3 + 1 as int), 3) as codon from (select seq, unnest(range(length(seq) // 3)) as i from seqs)) join code using (codon) group by codon, aa)"""
VARIANTS = f"""{SEEN}, b(base) as (values ('A'), ('T'), ('G'), ('C')), v as (
  select codon, n, aa, base || substr(codon, 2) as variant from seen, b where base != substr(codon, 1, 1)
  union all select codon, n, aa, substr(codon, 1, 1) || base || substr(codon, 3) from seen, b where base != substr(codon, 2, 1)
  union all select codon, n, aa, substr(codon, 1, 2) || base from seen, b where base != substr(codon, 3, 1))"""


def seen_codons(spark, d):
    """codon, n of all sequences' whole codons."""
    each = view(spark, d, "seqs").select(F.explode(S.codons(F.col("seq"))).alias("codon"))
    return each.where(F.length("codon") == 3).groupBy("codon").agg(F.count("*").alias("n"))


@query(f"with {VARIANTS} select codon, n, variant from v")
def codon_variants(spark, d):
    return seen_codons(spark, d).select("codon", "n", F.explode(S.codon_variants(F.col("codon"))).alias("variant"))


@query(f"""with {VARIANTS} select v.codon, v.n, variant, v.aa as aa_from, c.aa as aa_to,
  case when v.aa = c.aa then 'synonymous' when c.aa = '*' then 'nonsense' else 'nonsynonymous' end as kind from v join code c on c.codon = v.variant""")
def variant_classes(spark, d):
    return S.classified_variants(seen_codons(spark, d), "codon")


NAMES = ", ".join(f"('{a}', '{n[1]}')" for a, n in S.AMINO_NAMES.items())


@query(
    f"""with {SEEN}, n(aa, name) as (values {NAMES}) select codon, seen.n, case codon when 'TAA' then 'Stop (Ochre)' when 'TAG' then 'Stop (Amber)' when 'TGA' then 'Stop (Opal)' else name end as name from seen join n using (aa)""",
)
def codon_names(spark, d):
    return seen_codons(spark, d).select("codon", "n", S.codon_name(F.col("codon")).alias("name"))


@query("""with c as (select doc_id, i as index, substr(seq, cast(i * 3 + 1 as int), 3) as codon from (select *, unnest(range(length(seq) // 3)) as i from seqs)),
  p as (select *, case when substr(codon, 1, 1) != 'A' and substr(codon, 2, 2) = 'TG' then 1 when substr(codon, 2, 1) != 'T' and substr(codon, 1, 1) = 'A' and substr(codon, 3, 1) = 'G' then 2
    when substr(codon, 3, 1) != 'G' and substr(codon, 1, 2) = 'AT' then 3 end as place from c) select doc_id, cast(index as int) as index, codon, cast(place as int) as place from p where place is not null""")
def codons_one_away(spark, d):
    return S.one_away(view(spark, d, "seqs"), "seq", "ATG").select("doc_id", "index", "codon", "place")


KMERS = "k as (select doc_id, i as pos, substr(seq, cast(i + 1 as int), 6) as kmer from (select *, unnest(range(greatest(length(seq) - 5, 0))) as i from seqs))"


@query(f"with {KMERS} select doc_id, {CANON.format('kmer')} as kmer, count(*) as n from k group by 1, 2")
def kmer_profile(spark, d):
    return M.kmer_profile(view(spark, d, "seqs"), "doc_id", 6)


@query(f"with {KMERS} select distinct {CANON.format('kmer')} as kmer, doc_id, cast(floor(pos / 50) as bigint) as bin from k")
def kmer_positions(spark, d):
    return M.kmer_positions(view(spark, d, "seqs"), "doc_id", 6, 50)


TARGETS = ("AAAAAA", "ATGCAT", "ATATAT", "GCGCGC", "AATTCC")


@query(f"""with {KMERS}, o as (select distinct {CANON.format('kmer')} as kmer, doc_id, cast(floor(pos / 50) as bigint) as bin from k), c as (select kmer, count(*) as n from o group by kmer),
  p as (select x.kmer as a, y.kmer as b, count(*) as "both" from o x join o y on x.doc_id = y.doc_id and x.bin = y.bin and y.kmer > x.kmer where x.kmer in {TARGETS} group by 1, 2)
  select a, b, ca.n as n_a, cb.n as n_b, "both" from p join c ca on ca.kmer = a join c cb on cb.kmer = b""")
def kmer_cooccurrence(spark, d):
    targets = spark.createDataFrame([(t,) for t in TARGETS], "kmer string")
    return M.cell_cooccurrence(M.kmer_cells(view(spark, d, "seqs"), "doc_id", 6, 50), "doc_id", 10**6, 6, targets).drop("p")


@query(f"""with {KMERS}, o as (select distinct {CANON.format('kmer')} as kmer, doc_id, cast(floor(pos / 50) as bigint) as bin from k), c as (select kmer, count(*) as n from o group by kmer),
  p as (select x.kmer as a, y.kmer as b, count(*) as x from o x join o y on x.doc_id = y.doc_id and x.bin = y.bin and y.kmer > x.kmer where x.kmer in {TARGETS} group by 1, 2),
  m as (select count(*)::double as cells from (select distinct doc_id, bin from o)),
  q as (select a, b, x, cells, ca.n / cells * (cb.n / cells) as p from p join c ca on ca.kmer = a join c cb on cb.kmer = b, m),
  t as (select distinct x, cells, p, x <= cells * p as under from q),
  e as (select x, p, under, cells, unnest(case when under then range(greatest(0, x - 1000), x) else range(x, least(cells::bigint, x + 1000) + 1) end) as i from t),
  r as (select x, p, any_value(under) as under, sum(exp(lgamma(cells + 1) - lgamma(i + 1) - lgamma(cells - i + 1) + i * ln(p) + (cells - i) * ln(1 - p))) as side from e group by x, p)
  select a, b, round(case when under then 1 - side else side end, 6) as p from q join r on r.x = q.x and r.p = q.p""")
def kmer_cooccurrence_p(spark, d):
    targets = spark.createDataFrame([(t,) for t in TARGETS], "kmer string")
    cells = M.kmer_cells(view(spark, d, "seqs"), "doc_id", 6, 50)
    return M.cell_cooccurrence(cells, "doc_id", None, 6, targets).select("a", "b", F.round("p", 6).alias("p"))


def kmer_signal(spark, d):
    profile = M.kmer_profile(view(spark, d, "seqs"), "doc_id", 3)
    return profile.select("kmer", F.col("n").cast("double").alias("x"), (F.col("doc_id") % 97).cast("double").alias("y"))


K3 = f"""k as (select doc_id, substr(seq, cast(i + 1 as int), 3) as kmer from (select *, unnest(range(greatest(length(seq) - 2, 0))) as i from seqs)),
  x as (select {CANON.format('kmer')} as kmer, count(*)::double as x, (doc_id % 97)::double as y from k group by doc_id, 1)"""
SLOPES = "s as (select kmer, count(*) as n, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, regr_r2(y, x) as r2 from x group by kmer)"


@query(f"""with {K3}, {SLOPES} select kmer, n, round(slope, 6) as slope, round(intercept, 6) as intercept,
  round(case when n > 2 and r2 < 1 then sign(slope) * sqrt(r2 * (n - 2) / (1 - r2)) end, 6) as t from s""")
def kmer_regression(spark, d):
    return M.regressions(kmer_signal(spark, d), "kmer").select("kmer", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "t")])


@query(f"""with {K3}, {SLOPES}, p as (select kmer, slope, abs(slope) / 40 as p from s), r as (select kmer, p, row_number() over (order by slope desc, kmer) - 1 as rank from p)
  select kmer, rank from r where p < rank / (select count(*) from p)::double * 0.5""")
def fdr_cut(spark, d):
    rows = M.regressions(kmer_signal(spark, d), "kmer").select("kmer", "slope", (F.abs("slope") / 40).alias("p"))
    return M.step_cut(rows, 0.5, "kmer").select("kmer", "rank")


@query(f"""with {K3}, {SLOPES}, p as (select kmer, abs(slope) / 10 as p from s), r as (select kmer, p, row_number() over (order by p, kmer) as rank from p),
  l as (select max(rank) as last from r where p <= rank / (select count(*) from p)::double * 0.1) select kmer, rank from r, l where rank <= last""")
def fdr_benjamini_hochberg(spark, d):
    rows = M.regressions(kmer_signal(spark, d), "kmer").select("kmer", (F.abs("slope") / 10).alias("p"))
    return M.benjamini_hochberg(rows, 0.1, "kmer").select("kmer", "rank")


@query("select doc_id, row_number() over (order by length(seq), doc_id) - 1 as rank from seqs")
def score_ranks(spark, d):
    return M.ranks(view(spark, d, "seqs").select("doc_id", F.length("seq").alias("n")), F.col("n"), "doc_id").select("doc_id", "rank")


COUNTS = """m as (select cast(p_partkey % 20 as int) as matrix, cast(p_size % 8 as int) as pos, substr('ACGT', cast(p_partkey % 4 + 1 as int), 1) as base, count(*) as n from part group by 1, 2, 3),
  c as (select g.matrix, g.pos, b.base, coalesce(m.n, 0) as n from (select distinct matrix, pos from m) g cross join (values ('A'), ('C'), ('G'), ('T')) b(base) left join m on m.matrix = g.matrix and m.pos = g.pos and m.base = b.base)"""


def count_matrices(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    m = part.select(
        (F.col("p_partkey") % 20).cast("int").alias("matrix"),
        (F.col("p_size") % 8).alias("pos"),
        F.substring(F.lit("ACGT"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1)).alias("base"),
    )
    m = m.groupBy("matrix", "pos", "base").agg(F.count("*").alias("n"))
    grid = m.select("matrix", "pos").distinct().withColumn("base", F.explode(F.array(*[F.lit(b) for b in "ACGT"])))
    return grid.join(m, ["matrix", "pos", "base"], "left").fillna(0, ["n"])


@query(f"""with {COUNTS}, t as (select *, sum(n) over (partition by matrix, pos)::double as total from c)
  select matrix, pos, base, n, round(log2((n + sqrt(total)) / (total + 4 * sqrt(total)) / 0.25::double), 9) as score from t""")
def pssm(spark, d):
    return M.pssm(count_matrices(spark, d)).withColumn("score", F.round("score", 9))


@query(f"""with {COUNTS}, t as (select *, sqrt(n + 1) / 4 as p from c), u as (select *, sum(n + p) over (partition by matrix) + sum(p) over (partition by matrix) as total from t)
  select matrix, pos, base, n, round(ln((n + p) / total), 9) as score from u""")
def log_matrix(spark, d):
    return M.log_matrix(count_matrices(spark, d)).withColumn("score", F.round("score", 9))


HITS = f"""w as (select doc_id, i as pos, substr(seq, cast(i + 1 as int), {WIDTH}) as w from (select *, unnest(range(greatest(length(seq) - {WIDTH - 1}, 0))) as i from seqs)),
  h as (select doc_id, pos, '+' as strand, {sql_score('w')} as score from w union all select doc_id, pos, '-', {sql_score('r')} from (select *, {RC.format('w')} as r from w)),
  hits as (select doc_id, cast(pos as int) as pos, strand, score from h where score >= 2.0)"""


def hits(spark, d, cutoff=2.0):
    return M.scan(view(spark, d, "seqs").select("doc_id", "seq"), MATRIX, cutoff)


@query(f"with {HITS} select * from hits")
def motif_scan(spark, d):
    return hits(spark, d)


@query(
    f"select doc_id, greatest({sql_score('seq')}, {sql_score('r')}) as score, case when {sql_score('r')} > {sql_score('seq')} then '-' else '+' end as strand from (select *, {RC.format(f'substr(seq, 1, {WIDTH})')} as r from seqs where length(seq) >= {WIDTH})",
)
def motif_score(spark, d):
    return view(spark, d, "seqs").where(F.length("seq") >= WIDTH).select(
        "doc_id", M.best_strand(F.col("seq"), MATRIX).alias("b")
    ).select("doc_id", "b.score", "b.strand")


@query(
    f"with {HITS}, r as (select *, row_number() over (partition by doc_id order by score desc, pos, strand) as k from hits) select doc_id, pos, strand, score from r where k = 1",
)
def best_hit(spark, d):
    return M.best_hit(hits(spark, d), ["doc_id"])


@query(f"""with {HITS}, r as (select *, row_number() over (partition by doc_id order by score desc, pos, strand) as k from hits),
  b as (select r.doc_id, strand, seq, case when strand = '+' then pos else pos + {WIDTH} - 3 end as c from r join seqs on seqs.doc_id = r.doc_id where k = 1),
  t as (select doc_id, strand, substr(seq, greatest(c - 10, 0) + 1, c + 10 - greatest(c - 10, 0)) as w from b)
  select doc_id, case when strand = '+' then w else {RC.format('w')} end as "window" from t""")
def motif_oriented_window(spark, d):
    seqs = view(spark, d, "seqs").select("doc_id", "seq")
    return M.hit_window(M.best_hit(hits(spark, d), ["doc_id"]), seqs, "doc_id", 20, WIDTH)


#: Genomic hits for window queries: genes stand for hits of two matrices, their chromosomes as they are.
GENOMIC = "(select chr, s as start, strand, cast(gid % 3 as int) as matrix from genes)"
LOCI = "(select pid, chr, s as loc from peaks)"


def loci(spark, d):
    return view(spark, d, "peaks").select("pid", "chr", F.col("s").alias("loc")), view(spark, d, "genes").select(
        "chr", F.col("s").alias("start"), "strand", (F.col("gid") % 3).cast("int").alias("matrix")
    )


WINDOWED = f"x as (select p.pid, p.loc, h.start, h.strand, h.matrix from {LOCI} p join {GENOMIC} h on h.chr = p.chr and h.start between p.loc - 500 and p.loc + 500)"


@query(
    f"with {WINDOWED} select cast(((loc - start + 500 - 1) % 1000 + 1000) % 1000 as bigint) as bin, count(*) as hits, count(*)::double / (select count(*) from peaks) as rate from x group by 1",
)
def motif_window_hist(spark, d):
    return M.window_histogram(*loci(spark, d), 1000)


@query(
    f"with {WINDOWED} select count(distinct pid) as with_hit, (select count(*) from peaks) as peaks, count(distinct pid)::double / (select count(*) from peaks) as fraction from x",
)
def motif_fraction(spark, d):
    return M.motif_fraction(*loci(spark, d), 1000)


@query(f"""with {WINDOWED}, g as (select pid, matrix, count(*) as n, min(abs(loc - start)) as nearest from x group by 1, 2)
  select p.pid, m.matrix, coalesce(g.n, 0) as n, g.nearest from peaks p cross join (select distinct matrix from {GENOMIC}) m left join g on g.pid = p.pid and g.matrix = m.matrix""")
def motif_distances(spark, d):
    peaks, found = loci(spark, d)
    return M.distances_by_matrix(peaks, found, found.select("matrix").distinct(), 1000)


@query(f"""with {WINDOWED}, o as (select pid, matrix, strand, start - loc as "offset" from x), c as (select pid, count(distinct matrix) as class from o group by pid),
  r as (select pid, strand, row_number() over (partition by pid order by abs("offset"), "offset", strand) as k from o where matrix = 0)
  select o.pid, c.class, o.matrix, case when r.strand = '-' then -o."offset" else o."offset" end as "offset" from o join r on r.pid = o.pid and r.k = 1 join c on c.pid = o.pid""")
def motif_cooccurrence(spark, d):
    return M.oriented_hits(*loci(spark, d), 1000, 0)


#: The start of md5's hexadecimal digits as a number.
DRAW = "('0x' || left(md5({}), 15))::bigint"


@query(f"""with z as (select chr, max(s) as most from peaks group by chr), e as (select chr, sum(most) over (order by chr) as hi, most from z),
  d as (select i, {DRAW.format("'1:' || i")} % (select sum(most) from z) as x from range(200) t(i))
  select i, chr, cast(x - (hi - most) as bigint) as start, cast(x - (hi - most) + 500 as bigint) as "end" from d join e on x >= hi - most and x < hi""")
def random_windows(spark, d):
    return M.random_windows(view(spark, d, "peaks"), 200, 500)


@query("""select p_partkey as id, string_agg(substr('ACGT', (instr('0123456789abcdef', left(md5('1:' || p_partkey || ':' || i), 1)) - 1) % 4 + 1, 1), '' order by i) as seq
  from (select p_partkey, unnest(range(1, p_size + 1)) as i from part) t group by 1""")
def random_sequences(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("length"))
    return M.random_sequences(part)


@query(
    """select sum(case when pair = 'F' then 2 * ln(rate + 0.5) else 2 * ln(rate + 0.25) end) - 2 * sum(ln(rate + 0.4)) as ratio from rates""".replace("select sum", "select round(sum").replace(") as ratio", "), 6) as ratio"),
)
def likelihood_ratio(spark, d):
    rows = view(spark, d, "rates").select(
        F.when(F.col("pair") == "F", 1).otherwise(2).alias("set"),
        (F.col("rate") + 0.5).alias("m1"),
        (F.col("rate") + 0.25).alias("m2"),
        (F.col("rate") + 0.4).alias("joint"),
    )
    return M.likelihood_ratio(rows).select(F.round("ratio", 6).alias("ratio"))


def sql_stretches(columns: list[dict[str, float]], least: int = 5) -> str:
    """x rows (kmer) to y rows (kmer, total, most, one column w a width) over both strands, the better of each."""
    k = len(columns)

    def scored(text: str, z: int, at: int, width: int) -> str:
        return "(" + " + ".join(
            f"case substr({text}, {z + j + 1}, 1) " + " ".join(
                f"when '{b}' then {v}::double" for b, v in columns[at + j].items()
            ) + " end" for j in range(width)
        ) + ")"

    by_width = lambda text: [[scored(text, z, at, w) for at in range(k - w + 1) for z in range(k - w + 1)] for w in range(least, k + 1)]
    f, r = by_width("kmer"), by_width("rc")
    flat = lambda some: [x for y in some for x in y]
    top = lambda some: f"greatest({', '.join(some)})" if len(some) > 1 else some[0]
    widths = ", ".join(f"greatest({top(a)}, {top(b)}) as w{i}" for i, (a, b) in enumerate(zip(f, r, strict=True)))
    return f"y as (select kmer, greatest({' + '.join(flat(f))}, {' + '.join(flat(r))}) as total, greatest({top(flat(f))}, {top(flat(r))}) as most, {widths} from (select kmer, {RC.format('kmer')} as rc from x) x)"


SEEN = f"{KMERS}, x as (select distinct {CANON.format('kmer')} as kmer from k)"
WIDE = {"m1": MATRIX + MATRIX, "m2": MATRIX[::-1] + MATRIX}


@query(f"with {SEEN}, {sql_stretches(WIDE['m1'])} select kmer, total, most from y")
def kmer_matrix_scores(spark, d):
    return M.subseq_scores(M.kmer_profile(view(spark, d, "seqs"), "doc_id", 6).select("kmer").distinct(), WIDE["m1"]).drop("widths")


RANKED = """select '{n}' as matrix, kmer, row_number() over (order by total, kmer) - 1 as total_rank, round((total - min(total) over ()) / (max(total) over () - min(total) over ()), 9) as share,
  row_number() over (order by most, kmer) - 1 as most_rank, greatest(row_number() over (order by w0, kmer) - 1, row_number() over (order by w1, kmer) - 1) as width_rank from {y}"""


@query(
    f"with {SEEN}, {sql_stretches(WIDE['m1'])}, {sql_stretches(WIDE['m2']).replace('y as', 'y2 as', 1)} {RANKED.format(n='m1', y='y')} union all {RANKED.format(n='m2', y='y2')}",
)
def kmer_matrix_ranks(spark, d):
    seen = M.kmer_profile(view(spark, d, "seqs"), "doc_id", 6).select("kmer").distinct()
    return M.matrix_scores(seen, WIDE).withColumn("share", F.round("share", 9))
