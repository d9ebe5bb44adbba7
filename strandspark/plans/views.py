"""Genomic views over the star-schema tables: the same text runs in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PEAKS = """select o_orderkey as pid, cast(o_custkey % 5 as int) as chr,
  cast(1 + (o_orderkey*37) % 200000 as bigint) as s, cast(1 + (o_orderkey*37) % 200000 + 20 + o_custkey % 80 as bigint) as e,
  cast(o_orderkey % 2 as int) as st from orders"""
GENES = """select p_partkey as gid, cast(p_partkey % 5 as int) as chr, cast(p_partkey*100 as bigint) as s,
  cast(p_partkey*100 + p_size*10 as bigint) as e, case when p_size % 2 = 0 then '+' else '-' end as strand from part"""
TAGS = """select cast(l_suppkey % 5 as int) as chr, case when l_returnflag = 'R' then '-' else '+' end as strand,
  cast(l_partkey*10 + l_linenumber as bigint) as loc, cast(l_quantity as int) as mapq,
  cast(l_orderkey*10 + l_linenumber as bigint) as line from lineitem"""
SEQS = """select doc_id, translate(regexp_replace(lower(text),'[^a-z]',''{g}),
  'abcdefghijklmnopqrstuvwxyz','ACGTACGTACGTACGTACGTACGTAC') as seq, source from documents"""
#: Blocks of eight passages of the benchmark: an aligned row each, filled up to the block's longest; E's place among the letters is a gap.
ALIGNED = """select block, species, rpad(seq, cast(max(length(seq)) over (partition by block) as int), '-') as seq, p_start, strand from (
  select cast(floor(item_id / 8) as bigint) as block, cast(item_id % 8 as int) as species, translate(regexp_replace(lower(text),'[^a-z]',''{g}),
  'abcdefghijklmnopqrstuvwxyz','ACGT-CGTACGTACGTACGTACGTAC') as seq, cast(item_id * 100000 as bigint) as p_start,
  case when item_id % 3 = 0 then '-' else '+' end as strand from benchmark) t"""
RATES = """select cast(l_partkey % 50 as int) as family, l_linestatus as pair, l_discount as rate from lineitem"""

TABLES = {
    "peaks": (PEAKS, "orders"),
    "genes": (GENES, "part"),
    "tags": (TAGS, "lineitem"),
    "seqs": (SEQS, "documents"),
    "aligned": (ALIGNED, "benchmark"),
    "rates": (RATES, "lineitem"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, table = TABLES[name]
    return spark.sql(text.replace("{g}", "").replace(f"from {table}", "from {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def oracle(sql: str) -> str:
    """sql behind definitions of the views that it names."""
    used = [f"{n} as ({t.replace('{g}', ", 'g'")})" for n, (t, _) in TABLES.items() if n in sql]
    body = sql.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {', '.join([*used, body[15:]])}"
    if body.lower().startswith("with "):
        return f"with {', '.join([*used, body[5:]])}"
    return f"with {', '.join(used)} {body}" if used else body
