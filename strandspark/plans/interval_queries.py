"""Queries over peaks, genes and tags: interval joins, runs, coverage and signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as C
from ..operators import intervals as I
from .registry import registry
from .views import view

Q, SQL, query = registry()


def sets(spark, d):
    peaks = view(spark, d, "peaks")
    return peaks.where("st = 0"), peaks.where("st = 1")


TOUCH = "a.chr = b.chr and b.s <= a.e and (b.e > a.s or (a.s = a.e and b.e = a.s))"
SIDES = "a as (select * from peaks where st = 0), b as (select * from peaks where st = 1)"


@query(f"with {SIDES} select a.pid, b.pid as other, a.chr, greatest(a.s, b.s) as os, least(a.e, b.e) as oe from a join b on {TOUCH}")
def interval_overlap(spark, d):
    a, b = (x.select("pid", "chr", "s", "e") for x in sets(spark, d))
    return I.overlap(a, b).select(F.col("l_pid").alias("pid"), F.col("r_pid").alias("other"), F.col("l_chr").alias("chr"), "os", "oe")


@query(f"""with {SIDES} select a.pid, min(b.s) as u_s, max(b.e) as u_e from a join b on a.chr = b.chr
  and (a.s between b.s and b.e or a.e between b.s and b.e) group by a.pid""")
def interval_overlap_all(spark, d):
    return I.overlap_all(*sets(spark, d)).select("pid", "u_s", "u_e")


@query(f"""with {SIDES} select distinct a.chr, case when a.e - a.s > b.e - b.s then b.s else a.s end as s,
  case when a.e - a.s > b.e - b.s then b.e else a.e end as e from a join b on a.chr = b.chr
  and ((a.s > b.s and a.s < b.e) or (a.e > b.s and a.e < b.e) or (b.s > a.s and b.e < a.e))""")
def interval_shorter(spark, d):
    return I.shorter_of_pair(*sets(spark, d))


@query(f"with {SIDES} select a.pid, a.chr, a.s, a.e from a join b on a.chr = b.chr and b.e > a.s and b.s < a.e")
def interval_filter(spark, d):
    return I.filter_by_regions(*sets(spark, d)).select("pid", "chr", "s", "e")


@query("select p.pid, g.gid from peaks p join genes g on p.chr = g.chr and (g.s between p.s and p.e or g.e between p.s and p.e)")
def region_annot_parity(spark, d):
    return I.region_annotations(view(spark, d, "peaks"), view(spark, d, "genes")).select(F.col("l_pid").alias("pid"), F.col("r_gid").alias("gid"))


@query("select p.pid, g.gid from peaks p join genes g on p.chr = g.chr and g.s <= p.e and g.e >= p.s")
def region_annot(spark, d):
    return I.region_annotations(
        view(spark, d, "peaks"), view(spark, d, "genes"), spanning=True
    ).select(F.col("l_pid").alias("pid"), F.col("r_gid").alias("gid"))


@query("select p.pid, g.gid from peaks p join genes g on p.chr = g.chr and p.s > g.s and p.e < g.e")
def interval_contained(spark, d):
    return I.contained(view(spark, d, "peaks"), view(spark, d, "genes")).select(F.col("l_pid").alias("pid"), F.col("r_gid").alias("gid"))


@query(
    "select p.pid, cast(max(case when g.gid is null then 0 else 1 end) as int) as overlap from peaks p left join genes g on p.chr = g.chr and p.s > g.s and p.e < g.e group by p.pid",
)
def bound_sites(spark, d):
    return I.flag_overlap(view(spark, d, "peaks"), view(spark, d, "genes")).select("pid", "overlap")


@query("select gid, chr, s, e from genes g where exists (select 1 from peaks p where p.chr = g.chr and p.s <= g.e and p.e >= g.s)")
def interval_semi(spark, d):
    return I.interval_join(view(spark, d, "genes"), view(spark, d, "peaks"), I.symmetric, "semi").select("gid", "chr", "s", "e")


@query("select gid, chr, s, e from genes g where not exists (select 1 from peaks p where p.chr = g.chr and p.s <= g.e and p.e >= g.s)")
def interval_anti(spark, d):
    return I.interval_join(view(spark, d, "genes"), view(spark, d, "peaks"), I.symmetric, "anti").select("gid", "chr", "s", "e")


@query("select p.pid, g.gid from peaks p left join genes g on p.chr = g.chr and g.s <= p.e and g.e >= p.s")
def interval_left(spark, d):
    return I.interval_join(
        view(spark, d, "peaks"), view(spark, d, "genes"), I.symmetric, "left"
    ).select(F.col("l_pid").alias("pid"), F.col("r_gid").alias("gid"))


NEAR = """with m as (select pid, chr, cast(floor((s + e) / 2) as bigint) as mid from peaks),
  d as (select m.pid, m.chr, g.gid, m.mid - case when g.strand = '+' then g.s else g.e end as distance from m join genes g on m.chr = g.chr),
  r as (select *, cast(row_number() over (partition by pid order by abs(distance), gid) as int) as rank from d)
  select pid, chr, gid, distance, rank from r where rank <= {n}"""


@query(NEAR.format(n=1))
def nearest_gene(spark, d):
    return I.nearest(view(spark, d, "peaks"), view(spark, d, "genes"), "pid", "gid")


@query(NEAR.format(n=3))
def nearest_three_genes(spark, d):
    return I.nearest(view(spark, d, "peaks"), view(spark, d, "genes"), "pid", "gid", 3)


STREAM = """with d as (select p.pid, g.gid, {sign} as distance from peaks p join genes g on p.chr = g.chr
  and (g.s between p.s - 2000 and p.s + 2000 or g.e between p.s - 2000 and p.s + 2000)),
  r as (select *, row_number() over (partition by pid order by distance, gid desc) as rank from d where distance >= 0)
  select pid, gid, distance from r where rank = 1"""
TSS = "case when g.strand = '+' then g.s else g.e end"


@query(STREAM.format(sign=f"p.s - {TSS}"))
def upstream_gene(spark, d):
    return I.stream_nearest(view(spark, d, "peaks"), view(spark, d, "genes"), 2000, True, "pid", "gid")


@query(STREAM.format(sign=f"{TSS} - p.s"))
def downstream_gene(spark, d):
    return I.stream_nearest(view(spark, d, "peaks"), view(spark, d, "genes"), 2000, False, "pid", "gid")


RUNS = """with m as (select *, max(e) over (partition by chr order by s, e, st rows between unbounded preceding and 1 preceding) as reach from peaks),
  g as (select *, sum(case when reach > s then 0 else 1 end) over (partition by chr order by s, e, st rows unbounded preceding) as run from m),
  u as (select chr, min(s) as s, max(e) as e, count(*) as n, count(distinct st) as sets from g group by chr, run) select chr, s, e, n, sets from u"""


@query(RUNS)
def peak_union(spark, d):
    return I.union_runs(view(spark, d, "peaks"))


@query(RUNS + " where sets > 1")
def peak_intersect(spark, d):
    return I.intersect_runs(view(spark, d, "peaks"))


@query("""with recursive o as materialized (select chr, s, e, st, row_number() over (partition by chr order by s, e, st) as i, count(*) over (partition by chr) as m from peaks where e > s),
  r(chr, i, m, s, e, n, sets, len, os, oe, o_n, o_sets) as (
    select chr, i, m, s, e, 1, [st], e - s, null::bigint, null::bigint, null::int, null::bigint from o where i = 1
    union all
    select chr, i, m, case when merge then s else s2 end, case when merge then greatest(e, e2) else e2 end, case when merge then n + 1 else 1 end,
      case when merge then list_distinct(list_append(sets, st)) else [st] end, case when merge then greatest(e, e2) - s else e2 - s2 end,
      case when not merge then s end, case when not merge then case when s2 >= e then e else s2 - 1 end end, case when not merge then n end, case when not merge then len(sets) end
    from (select r.chr, o.i, r.m, r.s, r.e, r.n, r.sets, o.st, o.s as s2, o.e as e2,
        o.s < r.e and greatest((least(r.e, o.e) - greatest(r.s, o.s))::double / (o.e - o.s), (least(r.e, o.e) - greatest(r.s, o.s))::double / r.len) > 0.5 as merge
      from r join o on o.chr = r.chr and o.i = r.i + 1) x)
  select chr, os as s, oe as e, o_n::bigint as n, o_sets::bigint as sets from r where os is not null
  union all select chr, s, e, n::bigint, len(sets)::bigint from r where i = m""")
def peak_merge_cut(spark, d):
    return I.merge_runs(view(spark, d, "peaks"), 0.5)


@query(f"""with {SIDES} select chr, s, e from a where not exists (select 1 from b where {TOUCH})
  union select chr, s, e from b where not exists (select 1 from a where a.chr = b.chr and a.s <= b.e and (a.e > b.s or (b.s = b.e and a.e = b.s)))""")
def peak_nonoverlap(spark, d):
    return I.nonoverlapping(*sets(spark, d))


@query("select pid, cast(case when chr = 2 and s <= 60000 and (e > 50000 or (s = e and e = 50000)) then 1 else 0 end as int) as hit from peaks")
def hit_vector(spark, d):
    return I.hit_vector(view(spark, d, "peaks"), 2, 50000, 60000).select("pid", "hit")


@query(
    NEAR.format(n=1).replace(
        "select pid, chr, gid, distance, rank from r where rank <= 1",
        "select gid, count(*) as peaks, min(pid) as first_pid from r where rank = 1 group by gid",
    ),
)
def peaks_by_gene(spark, d):
    return I.nearest(
        view(spark, d, "peaks"), view(spark, d, "genes"), "pid", "gid"
    ).groupBy("gid").agg(F.count("*").alias("peaks"), F.min("pid").alias("first_pid"))


COUNTS = "c as (select chr, strand, loc, count(*) as n from tags group by chr, strand, loc)"


@query(f"with {COUNTS} select * from c")
def tag_counts(spark, d):
    return C.tag_counts(view(spark, d, "tags"))


@query(
    "with r as (select *, row_number() over (partition by chr, strand, loc order by line, mapq) as k from tags where mapq >= 10) select chr, strand, loc, mapq, line from r where k = 1",
)
def tags_unique(spark, d):
    return C.first_tags(view(spark, d, "tags"), 10).select("chr", "strand", "loc", "mapq", "line")


@query("select chr, strand, loc, mapq, line from tags where mapq >= 30")
def tags_mapq(spark, d):
    return C.at_least(view(spark, d, "tags"), 30)


@query(
    'select count(*) as total, count(distinct (chr, strand, loc)) as "unique", count(*) - count(distinct (chr, strand, loc)) as suppressed, count(*) filter (mapq >= 10) as stored from tags',
)
def tag_totals(spark, d):
    return C.totals(view(spark, d, "tags"), 10)


@query(f"with {COUNTS} select chr, strand, loc, least(n, 2) as n from c")
def tags_limited(spark, d):
    return C.limit_tags(C.tag_counts(view(spark, d, "tags")), 2)


@query(f"with {COUNTS} select chr, strand, loc, n, n * 1000000.0::double / (select sum(n) from c)::double as norm from c")
def tags_normalized(spark, d):
    return C.normalize(C.tag_counts(view(spark, d, "tags")))


@query(f"""with {COUNTS}, m as (select max(n) as most from c), b as (select least(n, greatest(most - 1, 0)) as bin, count(*) as positions from c, m group by 1),
  x as (select r.range as bin, coalesce(b.positions, 0) as positions from m, range(0, 1000) r left join b on b.bin = r.range where r.range < greatest(m.most, 1)),
  y as (select bin, case when bin = 0 then 10000000 - (select count(*) from c) else positions end as positions from x)
  select bin, positions, positions / (select sum(positions) from y)::double as share from y""")
def tag_histogram(spark, d):
    return C.histogram(C.tag_counts(view(spark, d, "tags")), 10_000_000)


@query(f"""with {COUNTS}, p as (select chr, case when strand = '+' then loc + 1 else greatest(loc - 50, 0) end as a, case when strand = '+' then loc + 51 else loc end as b, n from c),
  s as (select chr, a as pos, n as d from p where a < b union all select chr, b, -n from p where a < b),
  t as (select chr, pos, sum(d) as d from s group by chr, pos having sum(d) != 0),
  u as (select chr, pos as start, lead(pos) over (partition by chr order by pos) as "end", sum(d) over (partition by chr order by pos) as val from t)
  select chr, start, "end", cast(val as bigint) as val from u where val != 0 and "end" is not null""")
def tag_extend(spark, d):
    return C.extend(C.tag_counts(view(spark, d, "tags")), 50)


@query(f"""with {COUNTS}, b as (select chr, cast(case when strand = '+' then floor((loc + 75) / 25) * 25 else (floor((loc - 75) / 25) + 1) * 25 end as bigint) as bin, n from c)
  select chr, bin, cast(sum(n) as bigint) as val from b where bin >= 0 group by chr, bin""")
def tag_shift_bins(spark, d):
    return C.shift_bins(C.tag_counts(view(spark, d, "tags")), 75, 25)


@query(f"""with {COUNTS}, x as (select distinct chr, unnest(range(0, 1200, 25)) + k * 1200 as bin from c, (select unnest(range(0, 3000)) as k) kk where k * 1200 <= (select max(loc) + 100 from c))
  select x.chr, cast(x.bin as bigint) as bin, cast(sum(n) as bigint) as val from x join c on c.chr = x.chr
  and ((strand = '+' and loc > x.bin - 75 and loc <= x.bin) or (strand != '+' and loc >= x.bin and loc < x.bin + 75)) group by x.chr, x.bin""")
def tag_shift_windows(spark, d):
    return C.shift_windows(C.tag_counts(view(spark, d, "tags")), 75, 25)


@query(f"""with {COUNTS}, b as (select chr, cast(floor(loc / 100) as bigint) as bin, sum(n) as val from c group by 1, 2),
  s as (select chr, unnest(range(greatest(bin - 3, 0), bin + 3)) as bin, val from b) select chr, bin, cast(sum(val) as bigint) as val from s group by chr, bin""")
def tag_spread_bins(spark, d):
    bins = C.binned(C.tag_counts(view(spark, d, "tags")), 100).select("chr", (F.col("start") / 100).cast("long").alias("bin"), "val")
    return C.spread_bins(bins, 3)


@query(f"with {COUNTS} select chr, cast(floor(loc / 100) * 100 as bigint) as start, cast(sum(n) as bigint) as val from c group by 1, 2")
def bedgraph_bins(spark, d):
    return C.binned(C.tag_counts(view(spark, d, "tags")), 100)


@query(f"with {COUNTS} select chr, cast(floor((loc - 1) / 50) * 50 + 1 as bigint) as start, sum(n)::double / 50 as val from c where loc >= 1 group by 1, 2")
def wig_means(spark, d):
    return C.wig_means(C.tag_counts(view(spark, d, "tags")), 50)


@query(f"""with {COUNTS}, b as (select chr, cast(floor(loc / 100) as bigint) as k, sum(n) as val from c group by 1, 2),
  e as (select chr, min(k) as lo, max(k) as hi, arg_min(val, k) as first, arg_max(val, k) as last from b group by chr)
  select b.chr, b.k * 100 as start, cast(b.val as bigint) as val, (sum(o.val) + greatest(0, e.lo - b.k + 2) * any_value(e.first) + greatest(0, b.k + 2 - e.hi) * any_value(e.last))::double / 5 as smooth
  from b join e on b.chr = e.chr join b o on o.chr = b.chr and o.k between b.k - 2 and b.k + 2 group by b.chr, b.k, b.val, e.lo, e.hi""")
def wig_smooth(spark, d):
    return C.smooth(C.binned(C.tag_counts(view(spark, d, "tags")), 100), 5, 100)


SIGNAL = """t as (select chr, loc, count(*) as n from tags group by chr, loc),
  s as (select p.pid, p.s, p.e, coalesce(sum(n), 0) as total, coalesce(max(n), 0) as most from peaks p left join t on t.chr = p.chr and t.loc >= p.s and t.loc < p.e group by p.pid, p.s, p.e)"""


@query(f"with {SIGNAL} select pid, cast(total as bigint) as total, most, case when e > s then total::double / (e - s) else 0 end as mean from s")
def peak_signal(spark, d):
    return C.peak_signal(view(spark, d, "peaks"), C.tag_counts(view(spark, d, "tags")))


TWO = """x as (select p.pid, coalesce(sum(n), 0)::double / any_value(p.e - p.s) as plus from peaks p left join (select chr, loc, count(*) as n from tags where strand = '+' group by 1, 2) t on t.chr = p.chr and t.loc >= p.s and t.loc < p.e group by p.pid),
  y as (select p.pid, coalesce(sum(n), 0)::double / any_value(p.e - p.s) as minus from peaks p left join (select chr, loc, count(*) as n from tags where strand = '-' group by 1, 2) t on t.chr = p.chr and t.loc >= p.s and t.loc < p.e group by p.pid)"""


def strands(spark, d):
    counts = C.tag_counts(view(spark, d, "tags"))
    return counts.where("strand = '+'"), counts.where("strand = '-'")


@query(f"with {TWO} select x.pid, plus, minus, row_number() over (order by plus desc, x.pid) as rank from x join y on x.pid = y.pid")
def peak_signal_rank(spark, d):
    plus, minus = strands(spark, d)
    return C.enrichment(view(spark, d, "peaks"), {"plus": plus, "minus": minus}, "plus")


@query(
    f"with {TWO} select x.pid, plus - minus as diff, row_number() over (order by plus - minus desc, x.pid) as rank from x join y on x.pid = y.pid where plus != 0 or minus != 0",
)
def diff_rank(spark, d):
    return C.difference_rank(view(spark, d, "peaks"), *strands(spark, d))


@query(f"with {TWO} select x.pid, plus - minus as score from x join y on x.pid = y.pid order by score desc, x.pid limit 20")
def top_peaks(spark, d):
    return C.top_peaks(view(spark, d, "peaks"), *strands(spark, d), 20)


@query("""with t as (select chr, strand, loc, count(*) as n from tags group by 1, 2, 3),
  a as (select p.pid, sum(n) as a from peaks p join t on t.chr = p.chr and t.loc between p.s and p.e where strand = '+' group by p.pid having count(*) >= 2),
  b as (select p.pid, sum(n) as b from peaks p join t on t.chr = p.chr and t.loc between p.s and p.e where strand = '-' group by p.pid)
  select a.pid, cast(a - coalesce(b, 0) as bigint) as diff, case when coalesce(b, 0) > 0 then a::double / b::double else a::double end as ratio from a left join b on a.pid = b.pid""")
def input_ratio(spark, d):
    return C.input_ratio(view(spark, d, "peaks"), *strands(spark, d))


@query("select chr, count(*) as n, count(*)::double / (select count(*) from peaks) as share from peaks group by chr")
def chr_distribution(spark, d):
    return C.chromosome_share(view(spark, d, "peaks"))


@query(
    "with t as (select loc, count(*) as val from tags where chr = 1 and loc >= 5000 and loc < 15000 group by loc) select loc, val, val::double / (select max(val) from t) as rel from t",
)
def region_profile_rel(spark, d):
    return C.region_profile(C.tag_counts(view(spark, d, "tags")), 1, 5000, 15000)


@query("""with t as (select loc, count(*)::double as val from tags where chr = 1 and strand = '+' and loc between 5000 and 15000 group by loc)
  select min(loc) as lo, max(loc) as hi, (select loc from t order by loc limit 1 offset 1) - min(loc) as step, count(*) as n, sum(val) as total from t""")
def sgr_slice(spark, d):
    counts = C.tag_counts(view(spark, d, "tags")).where("strand = '+'").select("chr", "loc", F.col("n").cast("double").alias("val"))
    return C.signal_slice(counts, 1, 5000, 15000)
