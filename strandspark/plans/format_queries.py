"""Queries over text formats: tables are rendered to lines, by sinks where there is one, and read back; or a sink's lines are the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import coverage as C
from ..sources import readers as R
from ..sources import writers as W
from .registry import registry
from .views import view

Q, SQL, query = registry()


def lines(rows: DataFrame, *values: str) -> DataFrame:
    """A line for each value, fields by tabs where it is a list."""
    out = None
    for v in values:
        some = rows.selectExpr(f"{v} as value")
        out = some if out is None else out.unionByName(some)
    return out


def tabs(*fields: str) -> str:
    return f"concat_ws('\\t', {', '.join(f'cast({f} as string)' for f in fields)})"


def atoms(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.selectExpr(
        "p_partkey as n",
        "element_at(array('C', 'N', 'O'), cast(p_partkey % 3 + 1 as int)) as element",
        "(p_partkey % 1000) / 8D as x",
        "-(p_partkey % 700) / 8D as y",
        "p_size / 4D as z",
    )


SAM = "select 'r' || line as name, strand, 'c' || chr as chr, loc, mapq from tags"


@query(SAM)
def read_sam(spark, d):
    body = lines(
        view(spark, d, "tags"),
        tabs(
            "concat('r', line)", "if(strand = '-', 16, 0)", "concat('c', chr)", "loc", "mapq", "'4M'", "'*'", "0", "0", "'ACGT'", "'IIII'"
        ),
    )
    head = spark.createDataFrame([("@HD\tVN:1.0",), ("@SQ\tSN:c1",)], "value string")
    return R.READS["sam"](head.unionByName(body)).select("name", "strand", "chr", "loc", "mapq")


@query("select 'r' || line as name, strand, 'c' || chr as chr, loc, cast(null as int) as mapq, 'ACGT' as seq, 'I;II' as qual from tags")
def read_bowtie(spark, d):
    return R.READS["bowtie"](
        lines(view(spark, d, "tags"), tabs("concat('r', line)", "strand", "concat('c', chr)", "loc", "'ACGT'", "'I;II'"))
    ).select("name", "strand", "chr", "loc", "mapq", "seq", "qual")


def summed(spark, d):
    return view(spark, d, "tags").groupBy("chr", "loc").agg(F.count("*").alias("val"))


@query("select chr::varchar as chr, loc, count(*)::double as val from tags group by chr, loc")
def sgr_round_trip(spark, d):
    return R.parse_sgr(W.sgr(summed(spark, d)))


@query("select chr || chr(9) || loc || chr(9) || loc || chr(9) || count(*) as value from tags group by chr, loc")
def sgr_as_bedgraph(spark, d):
    return W.sgr_bedgraph(summed(spark, d))


@query('select chr::varchar as chr, s as start, e as "end", st::double as val from peaks')
def bedgraph_round_trip(spark, d):
    rows = view(spark, d, "peaks").select("chr", F.col("s").alias("start"), F.col("e").alias("end"), F.col("st").alias("val"))
    head = spark.createDataFrame([("track type=bedGraph",), ("# note",), ("browser position x",)], "value string")
    return R.parse_bedgraph(head.unionByName(W.bedgraph(rows)))


def placed(spark, d):
    return view(spark, d, "peaks").select(
        "chr",
        F.col("s").alias("start"),
        F.col("e").alias("end"),
        F.concat(F.lit("p"), F.col("pid").cast("string")).alias("name"),
        F.col("st").alias("score"),
        F.when(F.col("st") == 1, "-").otherwise("+").alias("strand"),
    )


@query(
    """select chr, chr || chr(9) || s || chr(9) || e || chr(9) || 'p' || pid || chr(9) || st || chr(9) || case when st = 1 then '-' else '+' end as value from peaks""",
)
def bed_lines(spark, d):
    return W.bed(placed(spark, d))


@query(
    """select chr::varchar as chr, s as start, e as "end", 'p' || pid as name, st::double as score, case when st = 1 then '-' else '+' end as strand from peaks""",
)
def bed_round_trip(spark, d):
    return R.parse_bed(W.bed(placed(spark, d)).select("value"))


@query(
    """select chr::varchar || chr(9) || (case when strand = '-' then e else s end - 50) || chr(9) || (case when strand = '-' then e else s end + 50) || chr(9) || gid || chr(9) || '0' || chr(9) || strand as value from genes""",
)
def tss_bed_lines(spark, d):
    return W.tss_bed(view(spark, d, "genes"), 50)


@query(
    """select chr::varchar as chr, s as start, e as "end", e - s as length, (e - s) // 2 as summit, pid % 50 as tags, (pid % 40)::double / 4 as log_pval, (pid % 9)::double as fold, 0.5::double as log_qval from peaks""",
)
def read_macs(spark, d):
    body = lines(view(spark, d, "peaks"), tabs("chr", "s", "e", "e - s", "(e - s) div 2", "pid % 50", "(pid % 40) / 4D", "pid % 9", "0.5"))
    head = spark.createDataFrame([("# called by hand",), ("chr\tstart\tend\tlength\tsummit\ttags",), ("short",)], "value string")
    return R.parse_macs(head.unionByName(body))


@query("select chr::varchar as chr, s + (e - s) // 2 as loc from peaks")
def read_summits(spark, d):
    return R.peak_places(lines(view(spark, d, "peaks"), tabs("chr", "s", "e", "e - s", "(e - s) div 2", "7")), 1)


@query("select chr::varchar as chr, s as loc from peaks")
def read_starts(spark, d):
    return R.peak_places(lines(view(spark, d, "peaks"), tabs("chr", "s", "e", "e - s", "(e - s) div 2", "7")), 0)


GFF = tabs(
    "concat('chr', chr)",
    "'made'",
    "if(gid % 4 = 0, 'exon', 'gene')",
    "s",
    "e",
    "'.'",
    "strand",
    "'.'",
    "concat('ID=FBgn', gid, ';', if(gid % 3 = 0, concat('gene_id \"g', gid, '\";'), concat('Name=n', gid, ';')), if(gid % 5 = 0, concat('to_name=t', gid, ';'), ''), if(gid % 2 = 0, concat('Parent=p', gid, ';'), ''))",
)
GFF_SQL = """select 'chr' || chr as chr, case when gid % 4 = 0 then 'exon' else 'gene' end as type, s as start, e as "end", strand, case when gid % 3 = 0 then 'g' else 'n' end || gid as name,
  'FBgn' || gid as fbid, case when gid % 5 = 0 then 't' || gid when gid % 2 = 0 then 'p' || gid end as parent from genes"""


@query(f"select * from ({GFF_SQL}) g where type = 'gene' and chr in ('chr1', 'chr2')")
def read_gff(spark, d):
    return R.parse_gff(
        lines(view(spark, d, "genes"), GFF).unionByName(spark.createDataFrame([("##gff-version 3",)], "value string")),
        ["gene"],
        ["chr1", "chr2"],
    )


@query(f"select * from ({GFF_SQL}) g where type = 'gene' and start < 5000")
def read_genes_before_fasta(spark, d):
    genes = view(spark, d, "genes")
    rows = genes.selectExpr(f"{GFF} as value", "chr as file", "0L as block", "if(s < 5000, s, s + 1) as line")
    stop = genes.select("chr").distinct().selectExpr("'##FASTA' as value", "chr as file", "0L as block", "5000L as line")
    return R.flybase_genes(rows.unionByName(stop))


@query("""select 'r' || pid as id, chr::varchar as chr, s as start, e as "end", unnest([s, e]) as peak from peaks""")
def read_regions(spark, d):
    return R.parse_regions(lines(view(spark, d, "peaks"), tabs("concat('r', pid)", "chr", "s", "e", "concat(s, ',', e, ',')"), "'# note'"))


@query(
    """select 'mel' as sp1, chr::varchar as chr1, p1, 'yak' as sp2, (chr + 1)::varchar as chr2, p2 from (select chr, unnest([s, e]) as p1, pid, s from peaks) x, lateral (select unnest([x.pid::bigint, x.pid + 1]) as p2) y""",
)
def read_paired(spark, d):
    return R.parse_paired(lines(view(spark, d, "peaks"), tabs("'mel'", "chr", "concat(s, ',,', e)", "'yak'", "chr + 1", "concat(pid, ',', pid + 1)")))


@query("select pid, unnest([s::varchar, e::varchar]) as a, unnest(['x', 'y']) as b from peaks")
def read_zipped_lists(spark, d):
    return R.zipped_lists(view(spark, d, "peaks").selectExpr("pid", "concat(s, ',', e, ',') as a", "'x,y,' as b"), "a", "b")


@query("""select 'p' || p_partkey as protein, 'mel' as species, p_size / 4::double as rate from part
  union all select 'p' || p_partkey, 'yak', p_size / 8::double from part where p_partkey % 3 > 0""")
def read_rates(spark, d):
    head = "protein\tmel\tyak\t"
    body = lines(
        spark.read.parquet(f"{d}/part.parquet"),
        tabs("concat('p', p_partkey)", "p_size / 4D", "if(p_partkey % 3 > 0, cast(p_size / 8D as string), '-')", "''"),
    )
    return R.parse_rates(body.unionByName(spark.createDataFrame([(head,)], "value string")), head)


def runs(spark, d):
    return lines(view(spark, d, "tags").where("line % 7 = 0"), "concat_ws(' ', 'M1', chr, 3, mapq, loc, line, 'ACGT', 1, 'ACGTN', 'IIII#')")


@query(
    "select 'M1' as machine, chr as run, '3' as lane, mapq::varchar as tile, loc::varchar as x, line::varchar as y, 'ACGT' as idx, '1' as read, 'ACGTN' as seq, 'IIII#' as qual from tags where line % 7 = 0",
)
def read_export(spark, d):
    return R.parse_export(runs(spark, d))


@query(
    "select printf('@M1_%04d:3:%d:%d:%d#ACGT/1', chr::int, mapq, loc, line) || chr(10) || 'ACGTN' || chr(10) || '+' || chr(10) || 'IIII#' as value from tags where line % 7 = 0",
)
def export_as_fastq(spark, d):
    return W.fastq_from_export(R.parse_export(runs(spark, d)))


@query("select printf('M1_%04d:3:%d:%d:%d#ACGT/1', chr::int, mapq, loc, line) as name, 'ACGTN' as seq, 'IIII#' as qual from tags where line % 7 = 0")
def fastq_round_trip(spark, d):
    return R.parse_fastq(W.fastq_from_export(R.parse_export(runs(spark, d))))


ATOMS = "select p_partkey as n, ['C', 'N', 'O'][p_partkey % 3 + 1] as element, (p_partkey % 1000) / 8::double as x, -(p_partkey % 700) / 8::double as y, p_size / 4::double as z from part"


@query(f"select element, x, y, z from ({ATOMS}) a")
def read_pdb(spark, d):
    return R.parse_pdb(
        lines(
            atoms(spark, d),
            "concat(rpad('ATOM', 30, ' '), format_string('%8.3f%8.3f%8.3f', x, y, z), rpad('', 22, ' '), lpad(element, 2, ' '))",
            "concat('HETATM', n)",
        ),
    )


@query(f"select n, printf('%-2s %12.6f %12.6f %12.6f', element, x, y, z) as value from ({ATOMS}) a union all values (-2, '#P HF/6-31G*'), (-1, 'atoms')")
def gaussian_deck_lines(spark, d):
    return W.gaussian_deck(atoms(spark, d))


@query("""select p_partkey as file, pos, base, n from (select p_partkey, unnest([0, 0, 0, 0, 1, 1, 1, 1]) as pos, unnest(['A', 'C', 'G', 'T', 'A', 'C', 'G', 'T']) as base,
  unnest([p_size, p_size + 1, 0, 3, 7, p_size + 2, p_size % 5, 1])::bigint as n from part) m""")
def read_vertical_counts(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    rows = part.selectExpr(
        "p_partkey as file",
        "0L as block",
        "posexplode(array('A | C | G | T |', concat_ws(' | ', p_size, p_size + 1, 0, 3, ''), 'a note', concat_ws(' | ', 7, p_size + 2, p_size % 5, 1, ''))) as (line, value)",
    )
    return R.parse_vertical_counts(rows)


@query(
    """select unnest([0, 1, 2])::int as pos, ['A', 'C', 'G', 'T'][p_partkey % 4 + 1] as base, unnest([p_size, p_size + 1, p_partkey])::bigint as n from part""",
)
def read_horizontal_counts(spark, d):
    return R.parse_horizontal_counts(
        lines(
            spark.read.parquet(f"{d}/part.parquet"),
            "concat(element_at(array('A', 'C', 'G', 'T'), cast(p_partkey % 4 + 1 as int)), ' | ', concat_ws(' ', p_size, p_size + 1, p_partkey))",
            "'no counts'",
        ),
    )


@query(
    """select 'g' || gid as name, s as start, s + 6 + chr as "end", strand, (gid % 16)::double / 2 as score, -(gid % 10)::double as ln_p from genes where gid % 16 >= 8""",
)
def read_scanner_report(spark, d):
    genes = view(spark, d, "genes")
    hits = genes.selectExpr(
        "concat(' g', gid, ' position= ', s, if(strand = '-', 'C', ''), ' score= ', (gid % 16) / 2D, ' ln(p-value)= ', -(gid % 10)) as value",
        "chr as file",
        "0L as block",
        "gid as line",
    )
    chrs = genes.select("chr").distinct()
    head = [
        chrs.selectExpr(f"{v} as value", "chr as file", "0L as block", f"{k}L as line") for k, v in (
            (-2, "concat('width of matrix: ', 6 + chr)"), (-1, "'numerically calculated cutoff score: 4.0'")
        )
    ]
    return R.parse_scanner_report(hits.unionByName(head[0]).unionByName(head[1]))


@query(
    """select 't' || gid as name, 'a' || gid as template, '5' as direction, 'sense' as cdna, 'c' || chr as chr, s as start, e as "end", 99.5::double as identity from genes where gid % 3 = 1""",
)
def read_mapper_report(spark, d):
    number = lambda c: f"format_number({c}, 0)"
    record = f"concat('t', gid, ' TEMPLATE: a', gid, ' DIRECTION: 5\\nPaths (', gid % 3, '):\\ncDNA direction: sense\\n  Path 1: query 1..9 genome c', chr, ':', {number('s')}, '..', {number('e')}, ' (9 bp)\\n    Percent identity: 99.5\\n')"
    return R.parse_mapper_report(lines(view(spark, d, "genes"), record))


@query(
    """select block::double as score, 's' || species as species, 'c' || (block % 5) as chr, p_start as start, length(replace(seq, '-', ''))::bigint as size, strand, 1000000::bigint as src_size, seq from aligned""",
)
def read_maf(spark, d):
    row = F.concat_ws(
        " ",
        F.lit("s"),
        F.concat(F.lit("s"), F.col("species"), F.lit(".c"), F.col("block") % 5),
        "p_start",
        F.length(F.replace("seq", F.lit("-"), F.lit(""))),
        "strand",
        F.lit("1000000"),
        "seq",
    )
    blocks = view(spark, d, "aligned").groupBy("block").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    head = spark.createDataFrame([("##maf version=1",)], "value string")
    return R.parse_maf(head.unionByName(lines(blocks, "concat('a score=', block, '\\n', rows)")))


MAP = tabs(
    "gid",
    "concat('c', chr)",
    "s",
    "e",
    "strand",
    "if(gid % 2 = 0, 'NA', 'c9')",
    "if(gid % 2 = 0, 'NA', cast(s + 1 as string))",
    "if(gid % 2 = 0, 'NA', cast(e + 1 as string))",
    "if(gid % 2 = 0, 'NA', '-')",
)


@query("""select gid::varchar as block, 'mel' as species, 'c' || chr as chr, s as start, e as "end", strand from genes
  union all select gid::varchar, 'yak', case when gid % 2 = 1 then 'c9' end, case when gid % 2 = 1 then s + 1 end, case when gid % 2 = 1 then e + 1 end, case when gid % 2 = 1 then '-' end from genes""")
def read_mercator(spark, d):
    return R.parse_mercator(lines(view(spark, d, "genes"), MAP), ["mel", "yak"])


@query("select gid::varchar as block, case when gid % 2 = 0 then 'mel' else 'mel,yak' end as species, case when gid % 2 = 0 then 1 else 2 end as n from genes")
def mercator_species(spark, d):
    return R.mercator_species(R.parse_mercator(lines(view(spark, d, "genes"), MAP), ["yak", "mel"][::-1])).select(
        "block", F.array_join("species", ",").alias("species"), F.size("species").alias("n")
    )


@query("select 'd' || doc_id as name, length(seq) as length, seq from seqs where length(seq) > 0")
def fasta_round_trip(spark, d):
    seqs = view(spark, d, "seqs").where("length(seq) > 0")
    return R.parse_fasta(W.fasta(seqs, F.concat(F.lit("d"), F.col("doc_id").cast("string")))).select("name", "length", "seq")


@query("select 'd' || doc_id as name, 'x' || doc_id as organism, 7::bigint as length, seq from seqs where length(seq) > 0")
def fasta_attributes(spark, d):
    pieces = lines(view(spark, d, "seqs").where("length(seq) > 0"), "concat('d', doc_id, ' organism=x', doc_id, '; length=7; note\\n', seq)")
    return R.parse_fasta(pieces, strict=True).select("name", F.element_at("attrs", "organism").alias("organism"), "length", "seq")


@query(
    "select doc_id, unnest([0, 1])::int as i, unnest(['a' || doc_id, 'b']) as name, unnest(['first one', '']) as description, unnest([seq, 'ACGT']) as seq from seqs where length(seq) > 0",
)
def fasta_of_a_column(spark, d):
    rows = view(spark, d, "seqs").where("length(seq) > 0").select(
        "doc_id",
        F.concat(F.lit(">a"), F.col("doc_id").cast("string"), F.lit(" first one\n"), "seq", F.lit("\n\n>b\nAC\nGT\n")).alias("text"),
    )
    return A.parse_fasta_text(rows, "text", "doc_id")


@query(
    "select doc_id, k * 200 as start, substr(seq, cast(k * 200 + 1 as int), 205) as seq from (select doc_id, seq, unnest(range((length(seq) + 199) // 200)) as k from seqs) s",
)
def sequence_chunks(spark, d):
    return R.chunked(view(spark, d, "seqs").select("doc_id", "seq"), 200, 5, "doc_id")


def dense(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").selectExpr(
        "cast(p_partkey % 5 as int) as chr", "cast((p_partkey div 5) * 10 as long) as loc", "p_size as val"
    )


STEPS = "select cast(p_partkey % 5 as int) as chr, (p_partkey // 5) * 10 as loc, p_size as val from part"


@query(f"""select chr, n, value from (select chr, row_number() over (partition by chr order by loc) as n, val::varchar as value from ({STEPS}) s
  union all select chr, 0, 'fixedStep chrom=chr' || chr || ' start=' || (min(loc) + 1) || ' step=10' from ({STEPS}) s group by chr) x""")
def fixed_wig_lines(spark, d):
    return W.fixed_wig(dense(spark, d))


@query(f"select chr::varchar as chr, loc + 1 as start, 10::bigint as span, val::double as val from ({STEPS}) s")
def fixed_wig_round_trip(spark, d):
    rows = W.fixed_wig(dense(spark, d)).select("value", F.col("chr").alias("file"), F.lit(0).cast("long").alias("block"), F.col("n").cast("long").alias("line"))
    return R.parse_wig(rows)


@query("select chr::varchar as chr, s as start, 25::bigint as span, gid::double as val from genes")
def variable_wig_round_trip(spark, d):
    signal = view(spark, d, "genes").select("chr", F.col("s").alias("start"), F.col("gid").alias("val"))
    rows = W.variable_wig(signal, 25).select("value", F.col("chr").alias("file"), F.lit(0).cast("long").alias("block"), F.col("start").alias("line"))
    return R.parse_wig(rows)


@query("select '>f:d' || doc_id || ':1:+:' || length(seq) as value from seqs")
def tba_headers(spark, d):
    return W.tba_header(view(spark, d, "seqs").select(F.lit("f").alias("file"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), "seq"))


@query("select * from genes where gid % 3 > 0")
def rows_to_append(spark, d):
    genes = view(spark, d, "genes")
    return W.append_new(genes, genes.where("gid % 3 = 0"), "gid")


@query("""select * from (select row_number() over (order by name) + 3 as id, name from (select distinct 'm' || chr as name from genes) n where name not in ('m0', 'm1', 'm2')) x
  union all values (1, 'm0'), (2, 'm1'), (3, 'm2')""")
def matrix_ids(spark, d):
    known = spark.createDataFrame([(1, "m0"), (2, "m1"), (3, "m2")], "id long, name string")
    return W.with_new_ids(known, view(spark, d, "genes").select(F.concat(F.lit("m"), F.col("chr").cast("string")).alias("name")), "name")


STAGES = """with n as (select chr, strand, loc, count(*) as n from tags group by 1, 2, 3), t as (select sum(n)::double as t from n)
  select 'raw' as stage, chr, strand, loc, n::double as val from n union all select 'norm', chr, strand, loc, n * 1e6::double / t from n, t union all select 'lim', chr, strand, loc, least(n, 3)::double from n"""


@query(f"select stage, chr, strand, loc, round(val, 6) as val from ({STAGES}) s")
def count_stages(spark, d):
    return W.count_stages(C.tag_counts(view(spark, d, "tags"))).withColumn("val", F.round("val", 6))


@query(f"select chr, strand, loc, val from ({STAGES}) s where stage = 'lim' and chr in (1, 3)")
def stored_stage(spark, d):
    return R.stage(W.count_stages(C.tag_counts(view(spark, d, "tags"))), "lim", [1, 3])


@query("select block, species, length(seq) as n from aligned where species in (1, 4)")
def stored_species(spark, d):
    return R.of_species(view(spark, d, "aligned"), [1, 4]).select("block", "species", F.length("seq").alias("n"))


@query("""select r_regionkey as tree, 'n' || n_nationkey as node, 'r' || r_regionkey as parent, n_nationkey / 4::double as length from region join nation on n_regionkey = r_regionkey
  union all select r_regionkey, 'r' || r_regionkey, null, null from region""")
def read_newick(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet").selectExpr("n_regionkey as tree", "concat('n', n_nationkey, ':', n_nationkey / 4D) as leaf")
    text = nation.groupBy("tree").agg(F.array_join(F.collect_list("leaf"), ",").alias("l")).selectExpr("tree", "concat('(', l, ')r', tree, ';') as text")
    return R.parse_newick(text, "tree")
