"""Queries over indexed and stored files: tables are written to the shared folder in a format, indexed, and read in part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators.ordered import checkpoint, new_path
from ..sources import alignment_store as S
from ..sources import fasta_index as X
from ..sources import files
from ..sources import readers as R
from ..sources import writers as W
from .format_queries import SAM, lines, tabs
from .genome_queries import ON_TARGET, on_target
from .registry import registry
from .views import view

Q, SQL, query = registry()


def written_fasta(spark, d) -> tuple[str, str]:
    """Folders of the sequences as FASTA in lines of 60, and of their index."""
    files, index = new_path(spark), new_path(spark)
    # the format has no null sequence: the header tells it from an empty one
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("  kind=prose"), F.when(F.col("seq").isNull(), "; seq=none").otherwise(""))
    W.fasta(view(spark, d, "seqs").where("doc_id is not null"), name).write.text(files)
    X.build(spark, files).write.parquet(index)
    return files, index


@query("""select 'd' || doc_id as name, 'prose' as kind, length(seq) as length, case when seq != '' then least(length(seq), 60) end as width,
  case when seq != '' then least(length(seq), 60) + 1 end as step, length(seq) + (length(seq) + 59) // 60 as n_bytes from seqs where doc_id is not null""")
def fasta_index_table(spark, d):
    index = spark.read.parquet(written_fasta(spark, d)[1])
    known = F.element_at("attrs", "seq").isNull()
    n_bytes = F.col("stop") - F.col("offset")
    return index.select(
        "name", F.element_at("attrs", "kind").alias("kind"), F.when(known, F.col("length")).alias("length"), "width", "step", F.when(known, n_bytes).alias("n_bytes")
    )


@query("""with r as (select *, 1 + doc_id * 7919 % length(seq) as start from seqs where doc_id is not null and seq != ''),
  e as (select *, least(start + 149, length(seq)) as "end" from r)
  select 'd' || doc_id as name, start, "end", substr(seq, cast(start as int), cast("end" - start + 1 as int)) as seq,
    "end" - start + 1 + ("end" - 1) // least(length(seq), 60) - (start - 1) // least(length(seq), 60) as n_read from e""")
def fasta_random_access(spark, d):
    index = spark.read.parquet(written_fasta(spark, d)[1])
    # kept, so that the filter isn't pushed below the view, where sequences would be made a second time for it
    sized = checkpoint(view(spark, d, "seqs").where("doc_id is not null").select("doc_id", F.length("seq").alias("length")))
    start = 1 + F.col("doc_id") * 7919 % F.col("length")
    regions = sized.where("length > 0").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"),
        start.alias("start"),
        F.least(start + 149, F.col("length")).alias("end"),
    )
    return X.fetch(regions, index)


@query("""select 'd' || doc_id as name, length(seq) as bases, length(seq) - length(replace(seq, 'A', '')) as adenines, (length(seq) + 999) // 1000 as stretches
  from seqs where doc_id % 3 = 1 and seq != ''""")
def fasta_indexed_scan(spark, d):
    X.register(spark)
    rows = spark.read.format("indexed_fasta").option("stretch", 1000).load(written_fasta(spark, d)[1])
    a = F.length("seq") - F.length(F.replace("seq", F.lit("A"), F.lit("")))
    found = rows.where(F.substring("name", 2, 20).cast("long") % 3 == 1).groupBy("name")
    return found.agg(F.sum(F.length("seq")).alias("bases"), F.sum(a).alias("adenines"), F.count("*").alias("stretches"))


def stored(spark, d) -> str:
    """The alignment in a store of two appends."""
    path = new_path(spark)
    rows = view(spark, d, "aligned").withColumn("chr", F.lit("0"))
    for part in (0, 1):
        S.append(rows.where(F.col("block") % 2 == part), path)
    return path


@query("select block::varchar as block, species::varchar as species, p_start, strand, seq from aligned where species in (1, 4)")
def stored_species_rows(spark, d):
    return S.of_species(spark, stored(spark, d), [1, 4]).select("block", "species", "p_start", "strand", "seq")


@query(f"with {ON_TARGET} select pid, block::varchar as block, s, e from q where pid % 3 = 0")
def stored_blocks_on_target(spark, d):
    _, targets = on_target(spark, d)
    targets = targets.where("pid % 3 = 0").withColumn("chr", F.col("chr").cast("string"))
    return A.blocks_on_target(S.on_targets(spark, stored(spark, d), targets, 0), targets, 0)


@query(
    "select block::varchar as block, species::varchar as species, p_start, seq from aligned where block in (select block from aligned where species = 0 and p_start <= 9000000 and p_start + length(replace(seq, '-', '')) - 1 >= 2000000)",
)
def stored_whole_blocks(spark, d):
    path = stored(spark, d)
    hit = S.on_interval(spark, path, 0, 0, 2_000_000, 9_000_000)
    return S.whole_blocks(spark, path, hit).select("block", "species", "p_start", "seq")


GENOMES = ["mel", "yak", "pse"]


@query("""select block::varchar as block, (['mel', 'yak', 'pse'])[species + 1] as species, seq, case when (block + species) % 4 > 0 then 'c' || block % 5 end as chr,
  case when (block + species) % 4 > 0 then p_start end as p_start, case when (block + species) % 4 > 0 then p_start + 9 end as p_end, case when (block + species) % 4 > 0 then strand end as strand
  from aligned where species < 3 and length(seq) > 0""")
def mercator_folder_round_trip(spark, d):
    folder = new_path(spark)
    rows = view(spark, d, "aligned").where("species < 3 and length(seq) > 0")
    name = F.get(F.array(*[F.lit(g) for g in GENOMES]), F.col("species"))
    record = F.concat(F.lit(">"), name, F.lit("_r1 row\n"), F.regexp_replace("seq", "(.{1,50})", "$1\n"))
    place = F.when(
        (F.col("block") + F.col("species")) % 4 > 0,
        F.concat_ws("\t", F.concat(F.lit("c"), F.col("block") % 5), "p_start", F.col("p_start") + 9, "strand"),
    ).otherwise(F.lit("NA\tNA\tNA\tNA"))
    blocks = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("species", record.alias("r"), place.alias("p")))).alias("x"))  # three rows a block
    files.write_named(blocks.select(F.concat("block", F.lit(".mfa")).alias("name"), F.array_join(F.col("x.r"), "").alias("value")), folder)
    # the map has a place for every species, in the order of the genomes
    where = F.transform(
        F.sequence(F.lit(0), F.lit(2)),
        lambda i: F.coalesce(F.element_at(F.filter("x", lambda t: t["species"] == i)["p"], 1), F.lit("NA\tNA\tNA\tNA")),
    )
    blocks.select(F.concat_ws("\t", F.col("block").cast("string"), F.array_join(where, "\t")).alias("value")).write.text(f"{folder}/map")
    spark.createDataFrame([("\t".join(f"{g}_r1" for g in GENOMES),)], "value string").write.text(f"{folder}/genomes")
    return R.mercator_folder(spark, folder)


@query("""select set, protein, species, rate from (
  select 's' || p_partkey % 2 as set, 'p' || p_partkey as protein, unnest(case when p_partkey % 2 = 0 then ['mel', 'yak'] else ['yak', 'pse', 'sim'] end) as species,
    unnest(case when p_partkey % 2 = 0 then [p_size / 4::double, case when p_partkey % 3 > 0 then p_size / 8::double end] else [p_size / 2::double, null, p_size::double] end) as rate from part) t""")
def rate_folder_round_trip(spark, d):
    folder = new_path(spark)
    part = spark.read.parquet(f"{d}/part.parquet")
    name = F.concat(F.lit("s"), F.col("p_partkey") % 2)
    even = F.concat_ws(
        "\t",
        F.concat(F.lit("p"), "p_partkey"),
        F.col("p_size") / 4,
        F.when(F.col("p_partkey") % 3 > 0, (F.col("p_size") / 8).cast("string")).otherwise("-"),
        F.lit(""),
    )
    odd = F.concat_ws("\t", F.concat(F.lit("p"), "p_partkey"), F.col("p_size") / 2, F.lit("-"), F.col("p_size").cast("double"), F.lit(""))
    lines = part.groupBy(name.alias("s")).agg(F.array_join(F.collect_list(F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd)), "\n").alias("body"))
    head = F.when(F.col("s") == "s0", "protein\tmel\tyak\t").otherwise("protein\tyak\tpse\tsim\t")
    files.write_named(
        lines.select(
            F.concat("s", F.lit("_dom_rates/"), "s", F.lit("_pw_rates_domains")).alias("name"),
            F.concat(head, F.lit("\n"), "body", F.lit("\n")).alias("value"),
        ),
        folder,
    )
    return R.rate_folder(spark, folder).select("set", "protein", F.explode("rates").alias("species", "rate"))


@query(SAM)
def read_sam_gz(spark, d):
    """Compressed lines, told by their extension."""
    folder = new_path(spark)
    body = lines(view(spark, d, "tags"), tabs("concat('r', line)", "if(strand = '-', 16, 0)", "concat('c', chr)", "loc", "mapq", "'4M'", "'*'", "0", "0", "'ACGT'", "'IIII'"))
    body.write.option("compression", "gzip").text(folder)
    return R.reads(spark, f"{folder}/*.gz", "sam").select("name", "strand", "chr", "loc", "mapq")


@query("select chr, loc, count(*) as n from tags group by 1, 2")
def split_by_chromosome(spark, d):
    """A folder of text for each chromosome, read back with the folder's name as a column."""
    folder = new_path(spark)
    counts = view(spark, d, "tags").groupBy("chr", "loc").agg(F.count("*").alias("n"))
    W.split_by(counts.select("chr", F.concat_ws("\t", "loc", "n").alias("value")), "chr", folder)
    parts = F.split("value", "\t")
    return spark.read.text(folder).select("chr", F.get(parts, F.lit(0)).cast("long").alias("loc"), F.get(parts, F.lit(1)).cast("long").alias("n"))


@query("""with d as (select i, ('0x' || left(md5('1:' || i), 15))::bigint / 1152921504606846976.0 as u from range(2000) t(i)),
  s as (select i, case when u <= 0.3 then 0 else 1 end as side, row_number() over (partition by case when u <= 0.3 then 0 else 1 end order by i) as rank from d),
  r as (select 0 as side, 'p' || p_partkey as name, 'A' as seq, 'I' as qual, row_number() over (order by 'p' || p_partkey) as rank from part
    union all select 1, 'c' || c_custkey, 'C', '#', row_number() over (order by 'c' || c_custkey) from customer)
  select s.i, name, seq, qual from s left join r on r.side = s.side and r.rank = s.rank""")
def mixed_reads(spark, d):
    """Reads named by parts and by customers, mixed at random."""
    named = lambda table, name, seq, qual: spark.read.parquet(f"{d}/{table}.parquet").selectExpr(f"{name} as name", f"'{seq}' as seq", f"'{qual}' as qual")
    return W.mixed_fastq(named("part", "concat('p', p_partkey)", "A", "I"), named("customer", "concat('c', c_custkey)", "C", "#"), 0.3, 2000)
