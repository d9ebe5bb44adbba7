"""Queries that annotate peaks, hits and regions by each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation as N
from ..operators import coverage as C
from .registry import registry
from .sequence_queries import HITS, K3, MATRIX, RC, SLOPES, WIDTH, WINDOWED, loci, sql_score
from .views import view

Q, SQL, query = registry()

TOUCH = "b.s <= a.e and (b.e > a.s or (a.s = a.e and b.e = a.s))"


@query(
    "select event_id, case when least(v1, v2, v3) >= 0 then least(v1, v2, v3) when greatest(v1, v2, v3) < 0 then v1 else list_min(list_filter([v1, v2, v3], lambda x: x >= 0)) end as least from (select event_id, (event_id % 7 - 3)::bigint as v1, (event_id % 5 - 2)::bigint as v2, (event_id % 11 - 6)::bigint as v3 from events) e",
)
def least_not_negative(spark, d):
    values = F.array(F.col("event_id") % 7 - 3, F.col("event_id") % 5 - 2, F.col("event_id") % 11 - 6)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", N.least_not_negative(values).cast("long").alias("least"))


@query("select * from tags where not (mapq < 10 and strand = '-')")
def tags_without(spark, d):
    return N.without(view(spark, d, "tags"), lambda rows: (rows.mapq < 10) & (rows.strand == "-"))


@query("select pid, 'chr' || chr as chr, s, e, st, e - s as length from peaks")
def peaks_renamed(spark, d):
    return N.renamed_peaks(view(spark, d, "peaks"))


NAMED = "n as (select 'n' || (gid % 300) as name, chr, s, e, strand from genes), w as (select 'n' || (p_size * 8) as name from part group by 1)"


@query(f"""with {NAMED}, k as (select *, row_number() over (partition by name order by chr, s, e) as k, count(*) over (partition by name) as found from n)
  select w.name, coalesce(found, 0) as found, chr, s, e, strand from w left join k on k.name = w.name and k.k = 1""")
def gene_locations(spark, d):
    genes = view(spark, d, "genes").withColumn("name", F.concat(F.lit("n"), F.col("gid") % 300))
    names = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("n"), F.col("p_size") * 8).alias("name"))
    return N.gene_locations(genes, names)


def halves(spark, d):
    tags = view(spark, d, "tags")
    return {"x": C.tag_counts(tags.where("line % 2 = 0")), "y": C.tag_counts(tags.where("line % 2 = 1"))}


MEANS = """t as (select chr, loc, count(*) filter (line % 2 = 0) as x, count(*) filter (line % 2 = 1) as y from tags group by 1, 2),
  m as (select pid, case when p.e > p.s then coalesce(sum(t.x), 0)::double / (p.e - p.s) else 0 end as x, case when p.e > p.s then coalesce(sum(t.y), 0)::double / (p.e - p.s) else 0 end as y
  from peaks p left join t on t.chr = p.chr and t.loc >= p.s and t.loc < p.e group by pid, p.s, p.e)"""


@query(f"with {MEANS} select pid, row_number() over (order by x desc, pid) as rank, round(x, 9) as x, round(y, 9) as y from m")
def heat_matrix(spark, d):
    out = N.heat_matrix(view(spark, d, "peaks"), halves(spark, d), "x")
    return out.select("pid", "rank", F.round(F.get("values", 0), 9).alias("x"), F.round(F.get("values", 1), 9).alias("y"))


@query(
    f"""select a.pid, min(b.pid) as other from peaks a left join (select * from peaks where st = 1) b on a.chr = b.chr and {TOUCH} where a.st = 0 group by 1""",
)
def overlap_ranks(spark, d):
    peaks = view(spark, d, "peaks")
    return N.overlap_ranks(peaks.where("st = 0"), {"other": peaks.where("st = 1").withColumn("rank", F.col("pid"))})


@query("""with g as (select chr, loc, count(*)::double as val from tags group by 1, 2), x as (select gid, val, abs(loc - s) as far, loc from genes h join g on g.chr = h.chr and abs(g.loc - h.s) < 100),
  a as (select gid, count(*) as samples, arg_min(val, far * 100000000 + loc) as nearest, avg(val) as m, median(val) as md from x group by gid)
  select gid, samples, nearest, round(nearest / m, 9) as by_mean, round(nearest / md, 9) as by_median from a""")
def window_enrichment(spark, d):
    signal = view(spark, d, "tags").groupBy("chr", "loc").agg(F.count("*").cast("double").alias("val"))
    out = N.window_enrichment(view(spark, d, "genes").withColumnRenamed("s", "start"), signal, 200)
    return out.select("gid", "samples", "nearest", F.round("by_mean", 9).alias("by_mean"), F.round("by_median", 9).alias("by_median"))


@query("select chr, max(s) as most from peaks group by chr")
def greatest_starts(spark, d):
    return N.greatest_starts(view(spark, d, "peaks"))


@query("select chr from peaks union select chr + 2 from genes")
def chromosome_union(spark, d):
    return N.chromosomes(view(spark, d, "peaks"), view(spark, d, "genes").withColumn("chr", F.col("chr") + 2))


@query("""with o as (select *, max(e) over (partition by chr order by s, e, st rows between unbounded preceding and 1 preceding) as reach from peaks where e > s and pid % 40 < 3),
  r as (select *, sum(case when reach > s then 0 else 1 end) over (partition by chr order by s, e, st rows unbounded preceding) as run from o),
  u as (select chr, run, min(s) as s, max(e) as e from r group by 1, 2 having count(distinct st) > 1)
  select u.chr, u.s, u.e, r.st, string_agg(r.pid::varchar, ',' order by r.pid) as members from u join r on r.chr = u.chr and r.run = u.run group by 1, 2, 3, 4""")
def run_members(spark, d):
    out = N.run_members(view(spark, d, "peaks").where("pid % 40 < 3"))
    return out.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query(f"""with x as (select * from peaks where pid % 3 = 0), y as (select * from peaks where pid % 3 = 1), z as (select * from peaks where pid % 3 = 2),
  xy as (select distinct a.pid from x a join y b on a.chr = b.chr and {TOUCH}), xz as (select distinct a.pid from x a join z b on a.chr = b.chr and {TOUCH}), yz as (select distinct a.pid from y a join z b on a.chr = b.chr and {TOUCH})
  select 'x+y' as tables, pid from xy union all select 'x+z', pid from xz union all select 'y+z', pid from yz union all select 'x+y+z', pid from xy where pid in (select pid from xz)""")
def overlap_combinations(spark, d):
    peaks = view(spark, d, "peaks")
    return N.overlap_combinations({n: peaks.where(f"pid % 3 = {k}") for k, n in enumerate("xyz")})


@query(f"with {WINDOWED} select pid, matrix, string_agg((loc - start)::varchar, ',' order by loc - start) as distances from x group by 1, 2")
def distance_lists(spark, d):
    out = N.distance_lists(*loci(spark, d), 1000)
    return out.withColumn("distances", F.array_join(F.col("distances").cast("array<string>"), ","))


@query(
    f"with {WINDOWED} select matrix, count(distinct pid) as with_hit, count(distinct pid)::double / (select count(*) from peaks) as fraction from x group by 1",
)
def motif_fraction_by_matrix(spark, d):
    return N.fraction_by_matrix(*loci(spark, d), 1000)


@query(f"""with {WINDOWED}, o as (select pid, matrix, strand, start - loc as "offset" from x), c as (select pid, count(distinct matrix) as class from o group by pid),
  r as (select pid, matrix as reference, strand, "offset" as here, row_number() over (partition by pid order by case matrix when 2 then 1 else 2 end, abs("offset"), "offset", strand) as k from o where matrix in (2, 0))
  select o.pid, class, reference, o.matrix, case when r.strand = '-' then here - o."offset" else o."offset" - here end as "offset" from o join r on r.pid = o.pid and k = 1 join c on c.pid = o.pid""")
def motif_priority(spark, d):
    return N.prioritised_hits(*loci(spark, d), 1000, [2, 0])


REGIONS = "g as (select 'd' || doc_id as name, (doc_id % 40)::bigint as start, (doc_id % 40 + 60)::bigint as \"end\", case when doc_id % 2 = 0 then '+' else '-' end as strand, case doc_id % 3 when 0 then 'k' when 1 then 'r' else 'x' end as code, seq as whole from seqs)"


def named(spark, d):
    seqs = view(spark, d, "seqs").select(F.concat(F.lit("d"), "doc_id").alias("name"), "seq", "doc_id")
    regions = seqs.selectExpr(
        "name",
        "cast(doc_id % 40 as long) as start",
        "cast(doc_id % 40 + 60 as long) as end",
        "if(doc_id % 2 = 0, '+', '-') as strand",
        "case doc_id % 3 when 0 then 'k' when 1 then 'r' else 'x' end as code",
    )
    return seqs.select("name", "seq"), regions


@query(
    f"""with {REGIONS} select name, start, "end", code, case code when 'r' then {RC.format('substr(whole, cast(start + 1 as int), 60)')} else substr(whole, cast(start + 1 as int), 60) end as seq from g where code != 'x'""",
)
def fetched_regions(spark, d):
    return N.fetched(*named(spark, d)).drop("strand")


@query(f"""with {REGIONS}, p as (select name, start, "end", strand, substr(whole, cast(start + 1 as int), 60) as part from g), w as (select *, i, substr(part, cast(i + 1 as int), {WIDTH}) as w from (select *, unnest(range(greatest(length(part) - {WIDTH - 1}, 0))) as i from p)),
  h as (select *, '+' as hit_strand, {sql_score('w')} as score from w union all select * exclude (r), '-', {sql_score('r')} from (select *, {RC.format('w')} as r from w))
  select name, start, "end", strand, case when strand = '-' then "end" - ({WIDTH} + length(part) - i - {WIDTH}) else start + i end as at, hit_strand, score from h where score >= 2.0""")
def region_hits(spark, d):
    seqs, regions = named(spark, d)
    return N.region_hits(seqs, regions.drop("code"), MATRIX, 2.0)


@query(f"with {HITS} select doc_id, pos, strand, score, case when strand = '-' then pos + {WIDTH} else pos end as five from hits")
def motif_five_prime(spark, d):
    from .sequence_queries import hits

    return N.five_prime(hits(spark, d), WIDTH)


@query(
    f"""with {REGIONS}, p as (select name, substr(whole, cast(start + 1 as int), 60) as a, substr(whole, 11, 20) as b from g) select name as id, a || {RC.format('b')} as seq from p""",
)
def chimeric_sequences(spark, d):
    seqs, regions = named(spark, d)
    parts = regions.selectExpr("name as id", "name", "1 as part", "start", "end", "'+' as strand").unionByName(
        regions.selectExpr("name as id", "name", "2 as part", "10L as start", "30L as end", "'-' as strand")
    )
    return N.chimera(parts, seqs)


@query(f"select 'd' || doc_id || '_rc' as name, {RC.format('seq')} as seq from seqs")
def reversed_records(spark, d):
    return N.reversed_records(named(spark, d)[0])


@query(
    "select chr, strand, case when strand = '-' then loc - k else loc + k end as loc, val from (select chr, strand, s as loc, gid as val, unnest(range(5)) as k from genes) g",
)
def stepped_signal(spark, d):
    return N.stepped(view(spark, d, "genes").selectExpr("chr", "strand", "s as loc", "gid as val"), 5)


@query("select p_size as gid, count(*) as n, string_agg(p_partkey::varchar, ',' order by p_partkey) as peaks from part group by 1")
def peak_lists_by_gene(spark, d):
    near = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_size as gid", "p_partkey as pid")
    return N.peaks_by_gene(near).withColumn("peaks", F.array_join(F.col("peaks").cast("array<string>"), ","))


@query(
    f"with {MEANS} select pid, row_number() over (order by x desc, pid) as rank_x, row_number() over (order by y desc, pid) as rank_y, row_number() over (order by round(x - y, 9) desc, pid) as rank_xy, row_number() over (order by round(y - x, 9) desc, pid) as rank_yx from m",
)
def regional_orders(spark, d):
    means = C.peak_means(view(spark, d, "peaks"), halves(spark, d)).select("pid", F.col("mean_x").alias("x"), F.col("mean_y").alias("y"))
    rows = means.withColumns({"xy": F.round(F.col("x") - F.col("y"), 9), "yx": F.round(F.col("y") - F.col("x"), 9)})
    return N.regional_orders(rows, ["x", "y", "xy", "yx"], "pid").select("pid", "rank_x", "rank_y", "rank_xy", "rank_yx")


@query(f"""with g as (select * from genes where gid % 2 = 0), h as (select * from genes where gid % 2 = 1),
  x as (select pid, exists (select 1 from g b where b.chr = a.chr and {TOUCH}) as x, exists (select 1 from h b where b.chr = a.chr and {TOUCH}) as y from (select * from peaks where st = 0) a)
  select count(*) filter (x and y) as "both", count(*) filter (x and not y) as only_a, count(*) filter (y and not x) as only_b, count(*) filter (not x and not y) as neither from x""")
def conservation_counts(spark, d):
    genes = view(spark, d, "genes")
    return N.conservation_counts(view(spark, d, "peaks").where("st = 0"), genes.where("gid % 2 = 0"), genes.where("gid % 2 = 1"))


DOMAINS = "m as (select distinct p_partkey % 200 as protein, 'pf' || p_size as family from part), r as (select l_partkey % 200 as protein, l_returnflag as species, l_discount as rate from lineitem where l_orderkey % 20 = 0)"


def domain_tables(spark, d):
    domains = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey % 200 as protein", "concat('pf', p_size) as family").distinct()
    return domains, spark.read.parquet(f"{d}/lineitem.parquet").where("l_orderkey % 20 = 0").selectExpr(
        "l_partkey % 200 as protein", "l_returnflag as species", "l_discount as rate"
    )


@query(f"with {DOMAINS} select protein, family, species, rate from m join r using (protein) where species in ('A', 'N') and family = 'pf7'")
def domain_rates(spark, d):
    return N.domain_rates(*domain_tables(spark, d), ["A", "N"], "pf7")


@query(f"with {DOMAINS} select protein, family, species, rate, 'g' || protein as gene from m join r using (protein) where species in ('R') and protein % 2 = 0")
def domain_rates_with_genes(spark, d):
    domains, rates = domain_tables(spark, d)
    genes = domains.select("protein").distinct().where("protein % 2 = 0").select("protein", F.concat(F.lit("g"), "protein").alias("gene"))
    return N.domain_rates(domains, rates, ["R"], None, genes)


@query("select family, pair as species, median(rate) as median, count(*) as n, count(*) filter (family % 10 = 3) as marked from rates group by 1, 2")
def marked_rates(spark, d):
    rows = view(spark, d, "rates").select("family", F.col("pair").alias("species"), "rate", F.concat(F.lit("f"), "family").alias("name"))
    return N.marked_rates(rows, "3$")


@query("select pid, chr, s, e, st, pid // 10 as cluster from peaks where pid % 4 = 0")
def peaks_with_cluster(spark, d):
    peaks = view(spark, d, "peaks")
    return N.with_cluster(peaks, peaks.where("pid % 4 = 0").selectExpr("pid", "pid div 10 as cluster"))


@query(f"select * from peaks a where not exists (select 1 from genes b where b.chr = a.chr and {TOUCH})")
def intergenic_peaks(spark, d):
    return N.intergenic(view(spark, d, "peaks"), view(spark, d, "genes"))


@query("""select 'FBgn' || gid as key1, 'FBgn9' || gid as fbid, 'c' || chr as chr, s, e from genes where gid % 3 = 0 and gid % 4 > 0""")
def ortholog_claims(spark, d):
    line = "concat_ws('\\t', 'x', if(gid % 4 = 0, 'other', 'FlyBase'), 'orthologous_to', '1', '2', '.', '+', '.', concat('ID=FBgn', gid, '_o1;to_species=', if(gid % 3 = 0, 'DYak', 'Dsim'), ';to_name=FBgn9', gid, ';Target=c', chr, ' ', s, ' ', e))"
    return N.ortholog_claims(view(spark, d, "genes").selectExpr(f"{line} as value"), "dyak")


@query("""with q as (select cast(l_partkey % 50 as int) as family, l_quantity::double as x, l_discount::double as y, l_orderkey * 10 + l_linenumber as line from lineitem), f as (select family, regr_slope(y, x) as a, regr_intercept(y, x) as b from q group by 1)
  select line, round(y - (a * x + b), 6) as residual from q join f using (family)""")
def regression_residuals(spark, d):
    from ..operators import motif as M

    pairs = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(
        "cast(l_partkey % 50 as int) as family",
        "cast(l_quantity as double) as x",
        "cast(l_discount as double) as y",
        "l_orderkey * 10 + l_linenumber as line",
    )
    return M.residuals(pairs, "family").select("line", F.round("residual", 6).alias("residual"))


@query(f"""with {K3}, {SLOPES}, t as (select kmer, n - 2 as v, atan(sqrt(r2 / (1 - r2))) as a from s where n > 2 and r2 < 1),
  e as (select kmer, v, a, unnest(range(case when v % 2 = 0 then v // 2 else (v - 1) // 2 end)) as j from t),
  f as (select kmer, sum(case when v % 2 = 0 then exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * exp(2 * j * ln(cos(a)))
    else exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * exp((2 * j + 1) * ln(cos(a))) end) as total from e group by kmer)
  select s.kmer, round(1 - case when v % 2 = 0 then sin(a) * total else 2 / pi() * (a + sin(a) * coalesce(total, 0)) end, 6) as p from s left join t on t.kmer = s.kmer left join f on f.kmer = s.kmer""")
def regression_p(spark, d):
    from ..operators import motif as M
    from .sequence_queries import kmer_signal

    return M.with_p(M.regressions(kmer_signal(spark, d), "kmer")).select("kmer", F.round("p", 6).alias("p"))


FILES = "s as (select cast(line % 5 as int) as file, chr, loc, count(*)::double as val from tags group by 1, 2, 3)"


def by_file(spark, d):
    return view(spark, d, "tags").groupBy((F.col("line") % 5).cast("int").alias("file"), "chr", "loc").agg(F.count("*").cast("double").alias("val"))


@query(
    f"with {FILES}, t as (select file, sum(sum(val)) over (order by file) as t from s group by file) select file, chr, loc, round(val * 1e6::double / t, 6) as norm from s join t using (file)",
)
def normalized_files(spark, d):
    return C.normalize_files(by_file(spark, d), "file").select("file", "chr", "loc", F.round("norm", 6).alias("norm"))


@query(
    f"with {FILES}, t as (select file, sum(val) as t from s group by file) select file, chr, loc, round(val * 1e6::double / t, 6) as norm from s join t using (file)",
)
def normalized_each_file(spark, d):
    return C.normalize_files(by_file(spark, d), "file", cumulative=False).select("file", "chr", "loc", F.round("norm", 6).alias("norm"))


@query("select gid, gid % 17 as score, gid % 13 as suggested from genes where gid % 17 >= gid % 13")
def hits_above_their_cutoff(spark, d):
    from ..operators import motif as M

    return M.hits_above(view(spark, d, "genes").selectExpr("gid", "gid % 17 as score", "gid % 13 as suggested"), None)


@query("select gid, gid % 17 as score from genes where gid % 17 >= 0")
def hits_above_zero(spark, d):
    from ..operators import motif as M

    return M.hits_above(view(spark, d, "genes").selectExpr("gid", "gid % 17 as score"), 0)


@query("""with l as (select block, species, i, substr(seq, cast(i + 1 as int), 1) as base from (select block, species, seq, unnest(range(length(seq))) as i from aligned) a)
  select block, species, cast(row_number() over (partition by block, species order by i) - 1 as int) as u, cast(i as int) as col from l where base != '-'""")
def gap_map_columns(spark, d):
    from ..functions import sequence as S

    return view(spark, d, "aligned").select("block", "species", F.posexplode(S.gap_map(F.col("seq"))).alias("u", "col"))


@query("select doc_id, 'x' || doc_id || '.tar' as base from seqs")
def base_names(spark, d):
    from ..functions import sequence as S

    return view(spark, d, "seqs").select("doc_id", S.base_name(F.concat(F.lit("/a/b.c/x"), "doc_id", F.lit(".tar.gz"))).alias("base"))


@query(
    """with z as (select chr, max(gid) as length from genes group by chr) select chr, unnest(['+', '-']) as strand, loc, 0 as n from (select chr, unnest(range(0, length, 7)) as loc from z) x""",
)
def empty_counts(spark, d):
    sizes = view(spark, d, "genes").groupBy("chr").agg(F.max("gid").alias("length"))
    return C.scaffold(sizes, 7)


@query("select chr, s + k as loc, gid as val from (select chr, s, gid, unnest(range(4)) as k from genes) g")
def expanded_steps(spark, d):
    return C.expand_steps(view(spark, d, "genes").selectExpr("chr", "s as loc", "gid as val"), 4)


@query(
    """select chr, line, last_value(case when line % 5 = 1 then loc end ignore nulls) over (partition by chr order by line rows unbounded preceding) as carried from (select chr, line, min(loc) as loc from tags group by 1, 2) t""",
)
def carried_values(spark, d):
    from ..sources.readers import forward_filled

    rows = view(spark, d, "tags").groupBy("chr", "line").agg(F.min("loc").alias("loc")).selectExpr(
        "chr", "chr as file", "line div 1000 as block", "line", "loc"
    )
    return forward_filled(rows, F.when(F.col("line") % 5 == 1, F.col("loc")), "carried").select("chr", "line", "carried")


@query(
    """select block, species, 40 as columns, length(substr(seq, 11, 40)) - length(replace(substr(seq, 11, 40), 'A', '')) as n_a from aligned where length(seq) >= 50""",
)
def function_of_slices(spark, d):
    import pandas as pd

    from ..operators import alignment as A

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby(["block", "species"])["base"].agg(columns="size", n_a=lambda b: int((b == "A").sum())).reset_index()

    blocks = view(spark, d, "aligned").where("length(seq) >= 50")
    parts = blocks.select("block").distinct().selectExpr("block as pid", "block", "10 as lo", "49 as hi")
    return A.apply_to_slices(A.columns(blocks), parts, counted, "block long, species int, columns int, n_a int")
