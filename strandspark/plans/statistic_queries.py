"""Queries of score distributions, permutations and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import motif as M
from ..operators import permutation as P
from ..operators import score_distribution as D
from .registry import registry
from .sequence_queries import CANON, HITS, MATRIX, sql_score
from .views import view

Q, SQL, query = registry()

#: A chance for the queries' cutoffs.
CHANCE = 0.125
#: The background of order 1 of all sequences, and the chance and score of all words of the matrix's width.
WORDS = f"""k as (select substr(seq, cast(i as int), 2) as w, count(*) as n from (select seq, unnest(range(1, length(seq))) as i from seqs) group by 1),
  b(base) as (values ('A'), ('C'), ('G'), ('T')),
  f as (select base, (select sum(n) from k where w[1] = base) / (select sum(n) from k) as p from b),
  t as (select x.base as context, y.base, coalesce(k.n, 0) / sum(k.n) over (partition by x.base) as p from b x cross join b y left join k on k.w = x.base || y.base),
  words as (select x.base || y.base || z.base as word, x.p * y.p * z.p as p from f x join t y on y.context = x.base join t z on z.context = y.base),
  d as (select score, sum(p) as p from (select {sql_score('word')} as score, p from words where p > 0) group by score),
  dist as (select score, p, least(1, sum(p) over (order by score desc)) as tail from d)"""


def background(spark, d):
    return D.background(view(spark, d, "seqs").select("seq"), 1)


@query(f"with {WORDS} select score, round(p, 9) as p, round(tail, 9) as tail from dist")
def score_distribution(spark, d):
    rows = D.distribution(D.catalogue(spark, {"m": MATRIX}), background(spark, d))
    return rows.select("score", F.round("p", 9).alias("p"), F.round("tail", 9).alias("tail"))


@query(f"with {WORDS} select context, base, round(p, 9) as p from t union all select '', base, round(p, 9) from f")
def markov_background(spark, d):
    return background(spark, d).select("context", "base", F.round("p", 9).alias("p"))


@query(
    f"with {HITS}, {WORDS} select doc_id, cast(pos as int) as pos, strand, h.score, round(ln(tail), 9) as ln_p from h join dist on dist.score = h.score where tail <= {CHANCE}",
)
def motif_scan_p(spark, d):
    seqs = view(spark, d, "seqs").select("doc_id", "seq")
    return D.scan_with_p(seqs, MATRIX, background(spark, d), CHANCE).withColumn("ln_p", F.round("ln_p", 9))


#: Shuffles of the responses for the queries.
ROUNDS = 100
#: Slopes (feature, round, slope) of the count of each 3-mer against all documents' responses, shuffled by the order of a hash.
SLOPES = f"""docs as (select distinct doc_id, cast(doc_id % 97 as double) as y from seqs where doc_id is not null),
  base as (select doc_id, y, row_number() over (order by doc_id) as place from docs),
  h as (select r, doc_id, row_number() over (partition by r order by md5('1:' || r || ':' || doc_id), doc_id) as place from docs, range(1, {ROUNDS + 1}) t(r)),
  drawn as (select r, h.doc_id, base.y from h join base on base.place = h.place union all select 0, doc_id, y from docs),
  k as (select doc_id, substr(seq, cast(i + 1 as int), 3) as kmer from (select *, unnest(range(greatest(length(seq) - 2, 0))) as i from seqs)),
  x as (select doc_id, {CANON.format('kmer')} as feature, cast(count(*) as double) as x from k where doc_id is not null group by doc_id, 2),
  v as (select feature, sum(x) as sx, sum(x * x) - sum(x) * sum(x) / (select count(*) from docs) as sxx from x group by feature),
  s as (select feature, r, sum(x * y) as sxy from x join drawn on drawn.doc_id = x.doc_id group by feature, r),
  lines as (select feature, cast(r as int) as round, (sxy - sx * (select avg(y) from docs)) / sxx as slope from s join v using (feature))"""
ERFC = " + t * (".join(map(str, P.ERFC)) + ")" * (len(P.ERFC) - 1)


def kmer_slopes(spark, d):
    seqs = view(spark, d, "seqs").where("doc_id is not null")
    profile = M.kmer_profile(seqs, "doc_id", 3).withColumnRenamed("n", "x")
    responses = seqs.select("doc_id", (F.col("doc_id") % 97).cast("double").alias("y")).distinct()
    return P.slopes(profile, responses, "kmer", "doc_id", ROUNDS)


def rounded(rows, *names: str, digits: int = 6):
    return rows.withColumns({c: F.round(c, digits) for c in names})


@query(f"with {SLOPES} select feature, round, round(slope, 9) as slope from lines")
def permuted_slopes(spark, d):
    return rounded(kmer_slopes(spark, d), "slope", digits=9)


@query(f"""with {SLOPES}, o as (select feature, slope as observed from lines where round = 0),
  n as (select feature, greatest(stddev_samp(slope) * pow(count(*), -0.2), 1e-300) as width, quantile_cont(slope, 0.25) as q25, quantile_cont(slope, 0.5) as q50, quantile_cont(slope, 0.75) as q75 from lines where round > 0 group by feature),
  z as (select feature, (observed - slope) / width as z from lines join o using (feature) join n using (feature) where round > 0),
  e as (select feature, z, t * exp({ERFC} - a * a) / 2 as q from (select *, 1 / (1 + a / 2) as t from (select *, abs(z) / sqrt(2) as a from z))),
  p as (select feature, avg(case when z < 0 then 1 - q else q end) as above, avg(case when z < 0 then q else 1 - q end) as below from e group by feature)
  select feature as kmer, round(observed, 6) as slope, round(least(1, 2 * least(above, below)), 6) as p, round(q25, 6) as q25, round(q50, 6) as q50, round(q75, 6) as q75 from o join n using (feature) join p using (feature)""")
def permutation_null(spark, d):
    rows = P.null_summary(kmer_slopes(spark, d)).select(F.col("feature").alias("kmer"), "slope", "p", "q25", "q50", "q75")
    return rounded(rows, "slope", "p", "q25", "q50", "q75")


@query(f"""with {SLOPES}, c as (select feature, slope - avg(slope) over (partition by feature) as d from lines where round > 0),
  m as (select feature, count(*)::double as n, avg(d * d) as m2, avg(d * d * d) as m3, avg(d * d * d * d) as m4 from c group by feature),
  g as (select *, m3 / pow(m2, 1.5) * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) as y, m4 / (m2 * m2) as b2,
    3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) as beta, 3 * (n - 1) / (n + 1) as e,
    24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) as v,
    6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) as s from m),
  w as (select *, sqrt(2 * (beta - 1)) - 1 as w2, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) as a from g),
  z as (select feature, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) as zs, 1 + (b2 - e) / sqrt(v) * sqrt(2 / (a - 4)) as t, a from w),
  kz as (select feature, zs, (1 - 2 / (9 * a) - sign(t) * pow((1 - 2 / a) / abs(t), 1 / 3.0::double)) / sqrt(2 / (9 * a)) as zk from z)
  select feature as kmer, round(zs, 6) as z_skewness, round(zk, 6) as z_kurtosis, round(exp((zs * zs + zk * zk) / -2), 6) as normal_p from kz""")
def slope_normality(spark, d):
    rows = P.null_summary(kmer_slopes(spark, d)).select(F.col("feature").alias("kmer"), "z_skewness", "z_kurtosis", "normal_p")
    return rounded(rows, "z_skewness", "z_kurtosis", "normal_p")


#: Replicates of the likelihood ratio for the queries, and their ratios.
REPLICATES = 20
RATIOS = f"""rows as (select l_orderkey || ':' || l_linenumber as id, l_linestatus = 'F' as own, 2 * ln(l_discount + 0.5) as a, 2 * ln(l_discount + 0.25) as b, 2 * ln(l_discount + 0.4) as j from lineitem),
  f as (select printf('%08x', cast(least(floor(count(*) filter (own) / count(*) * 4294967296), 4294967295) as bigint)) as cut from rows),
  ratios as (select cast(r as int) as replicate, sum(case when case when r = 0 then own else md5('1:' || r || ':' || id) < cut end then a else b end) - sum(j) as ratio
    from rows, f, range({REPLICATES + 1}) t(r) group by r)"""


def ratios(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = items.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("set"),
        *[(F.col("l_discount").cast("double") + v).alias(n) for n, v in (("m1", 0.5), ("m2", 0.25), ("joint", 0.4))],
    )
    return P.resampled_ratios(rows, ["l_orderkey", "l_linenumber"], REPLICATES)


@query(f"with {RATIOS} select replicate, round(ratio, 6) as ratio from ratios")
def likelihood_ratio_resampled(spark, d):
    return rounded(ratios(spark, d), "ratio")


@query(f"""with {RATIOS}, o as (select ratio as own from ratios where replicate = 0)
  select round(max(own), 6) as ratio, round(quantile_cont(ratio, 0.25) filter (replicate > 0), 6) as q25, round(quantile_cont(ratio, 0.5) filter (replicate > 0), 6) as q50,
    round(quantile_cont(ratio, 0.75) filter (replicate > 0), 6) as q75, round(count(*) filter (ratio >= own) / count(*), 6) as p from ratios, o""")
def likelihood_ratio_empirical(spark, d):
    return rounded(P.empirical(ratios(spark, d)), "ratio", "q25", "q50", "q75", "p")
