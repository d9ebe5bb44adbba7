"""Readers of text formats.

Each parser takes lines, a DataFrame with a string column `value`, so that it works on files, streams and columns alike;
`lines` reads files with the place of each line, which the formats with state need.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = ["file", "block", "line"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block, line: in the order of (block, line) within a file; compressed files by their extension."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return rows.withColumn("line", F.monotonically_increasing_id())


def records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """value, file: pieces of files between separators."""
    return spark.read.text(path, lineSep=separator).select("value", F.col("_metadata.file_path").alias("file"))


def fields(rows: DataFrame, separator: str, *names: str) -> DataFrame:
    """rows with the fields of value by position; a name ends in :type where it isn't a string, None skips one."""
    parts = F.split("value", separator)
    out = {}
    for k, name in enumerate(names):
        if name:
            n, _, kind = name.partition(":")
            out[n] = F.get(parts, k).cast(kind) if kind else F.get(parts, k)
    return rows.select([c for c in rows.columns if c != "value"] + [v.alias(n) for n, v in out.items()])


def forward_filled(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows (file, block, line) with the last value that wasn't null, up to and with this line; blocks carry over, so a file isn't one task."""
    rows = rows.withColumn("_v", value)
    last = rows.groupBy("file", "block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("line"))).alias("_b"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("file", "block", F.last("_b", ignorenulls=True).over(before).alias("_carry"))
    local = Window.partitionBy("file", "block").orderBy("line")
    return rows.join(carry, ["file", "block"]).withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(local), "_carry")).drop("_v", "_carry")


def parse_fasta(pieces: DataFrame, strict: bool = False) -> DataFrame:
    """name, attrs, length, seq of records split at a newline and '>'. attrs: k=v entries between '; '. strict: a length entry is a must."""
    text = F.regexp_replace("value", r"^>", "")
    head = F.regexp_extract(text, r"^([^\n]*)", 1)
    rows = pieces.where(F.trim("value") != "").select(head.alias("_h"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))
    entries = F.filter(F.split(F.trim(F.regexp_replace("_h", r"^\S+", "")), r";\s*"), lambda x: x.contains("="))
    attrs = F.map_from_entries(F.transform(entries, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), F.trim(F.regexp_replace(x, r"^[^=]*=", "")))))
    out = rows.select(F.regexp_extract("_h", r"^(\S*)", 1).alias("name"), attrs.alias("attrs"), "seq")
    out = out.select("name", "attrs", F.coalesce(F.element_at("attrs", "length").cast("long"), F.length("seq").cast("long")).alias("length"), "seq")
    if strict:
        out = out.withColumn("length", F.when(F.assert_true(F.map_contains_key("attrs", "length"), "a header has no length").isNull(), F.col("length")))
    return out


def fasta(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return parse_fasta(records(spark, path, "\n>"), strict)


def chunked(seqs: DataFrame, size: int, overlap: int, key: str = "name") -> DataFrame:
    """key, start, seq: sequences in stretches of size, each with the next overlap bases, so that windows may cross."""
    n = F.ceil(F.length("seq") / size).cast("int")
    rows = seqs.where(F.length("seq") > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select(
        key,
        (F.col("_k") * size).cast("long").alias("start"),
        F.substring(F.col("seq"), F.col("_k") * size + 1, F.lit(size + overlap)).alias("seq"),
    )


def parse_maf(blocks: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns to keep, score, species, chr, start, size, strand, src_size, seq of alignment blocks between blank lines; comments are skipped, the last block counts."""
    rows = blocks.withColumn("score", F.regexp_extract("value", r"(?m)^a\s.*?score=(\S+)", 1)).where(F.col("value").rlike(r"(?m)^a\b"))
    row = F.explode(F.filter(F.split("value", "\n"), lambda x: x.startswith("s ")))
    parts = F.split(F.trim("_s"), r"\s+")
    out = rows.withColumn("_s", row).withColumn("_p", parts)
    return out.select(
        *(keep or []),
        F.col("score").cast("double").alias("score"),
        F.substring_index(F.get("_p", 1), ".", 1).alias("species"),
        F.regexp_replace(F.get("_p", 1), r"^[^.]*\.", "").alias("chr"),
        F.get("_p", 2).cast("long").alias("start"),
        F.get("_p", 3).cast("long").alias("size"),
        F.get("_p", 4).alias("strand"),
        F.get("_p", 5).cast("long").alias("src_size"),
        F.get("_p", 6).alias("seq"),
    )


def maf(spark: SparkSession, path: str) -> DataFrame:
    return parse_maf(records(spark, path, "\n\n"))


def parse_mercator(rows: DataFrame, species: list[str]) -> DataFrame:
    """block, species, chr, start, end, strand: four fields a species; NA is null."""
    parts = F.split(F.trim("value"), r"\s+")
    each = F.array(
        *[
            F.struct(
                F.lit(s).alias("species"),
                *[F.nullif(F.get(parts, 1 + 4 * k + j), F.lit("NA")).alias(n) for j, n in enumerate(("chr", "start", "end", "strand"))],
            ) for k, s in enumerate(species)
        ],
    )
    out = rows.where(F.trim("value") != "").select(F.get(parts, 0).alias("block"), F.explode(each).alias("p"))
    return out.select("block", "p.species", "p.chr", F.col("p.start").cast("long").alias("start"), F.col("p.end").cast("long").alias("end"), "p.strand")


def mercator_folder(spark: SparkSession, folder: str) -> DataFrame:
    """block, species, seq, chr, p_start, p_end, strand of a folder of block files (block.mfa) with its `map` and `genomes` files.

    genomes: one line of species in the map's order; a name's part before '_' counts. A species without a place in the map has nulls there. Files are read
    whole, a task one at least; blocks that the map lacks are left out.
    """
    from ..operators.alignment import parse_fasta_text

    named = spark.read.text(f"{folder}/genomes").where(F.trim("value") != "").first()  # one line
    species = [s.split("_")[0] for s in named.value.split()] if named else []
    places = parse_mercator(spark.read.text(f"{folder}/map"), species).withColumnsRenamed({"start": "p_start", "end": "p_end"})
    files = spark.read.text(f"{folder}/*.mfa", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.mfa$", 1).alias("block"), "value")
    rows = parse_fasta_text(files, "value", "block").select("block", F.substring_index("name", "_", 1).alias("species"), "seq")
    return rows.join(places, ["block", "species"]).select("block", "species", "seq", "chr", "p_start", "p_end", "strand")


def rate_folder(spark: SparkSession, folder: str) -> DataFrame:
    """set, protein, rates (species to rate, null for '-') of files NAME_dom_rates/NAME_pw_rates_domains, each with a header of its own species."""
    rows = lines(spark, f"{folder}/*_dom_rates/*_pw_rates_domains")
    fields_of = lambda text: F.split(F.rtrim(text, F.lit("\t")), "\t")
    first = rows.groupBy("file").agg(F.min_by(F.struct("value", "block", "line"), F.struct("block", "line")).alias("_head"))  # a row a file
    is_row = ((F.col("block") != F.col("_head.block")) | (F.col("line") != F.col("_head.line"))) & (F.trim("value") != "")
    body = rows.join(first, "file").where(is_row)
    # filters move: a header's fields must be no error wherever they are looked at
    heads, cells = F.slice(fields_of(F.col("_head.value")), 2, 1 << 20), F.when(is_row, fields_of(F.col("value")))
    rate = lambda i: F.nullif(F.get(cells, i + 1), F.lit("-")).cast("double")
    rates = F.map_from_entries(F.transform(heads, lambda s, i: F.struct(s, rate(i))))
    return body.select(F.regexp_extract("file", r"([^/]+)_pw_rates_domains$", 1).alias("set"), F.get(cells, F.lit(0)).alias("protein"), rates.alias("rates"))


def parse_sam(rows: DataFrame) -> DataFrame:
    """name, strand, chr, loc, mapq, seq, qual; header lines are skipped, flag bit 16 is '-'."""
    out = fields(rows.where(~F.col("value").startswith("@")), "\t", "name", "flag:int", "chr", "loc:long", "mapq:int", None, None, None, None, "seq", "qual")
    return out.withColumn("strand", F.when(F.col("flag").bitwiseAND(16) > 0, "-").otherwise("+")).drop("flag")


def parse_bowtie(rows: DataFrame) -> DataFrame:
    """name, strand, chr, loc, mapq (null), seq, qual."""
    return fields(rows, "\t", "name", "strand", "chr", "loc:long", "seq", "qual").withColumn("mapq", F.lit(None).cast("int"))


READS = {"sam": parse_sam, "bowtie": parse_bowtie}


def reads(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return READS[kind](lines(spark, path).select("value"))


def parse_sgr(rows: DataFrame) -> DataFrame:
    return fields(rows.where(F.trim("value") != "").withColumn("value", F.trim("value")), r"\s+", "chr", "loc:long", "val:double")


def parse_bedgraph(rows: DataFrame) -> DataFrame:
    """chr, start, end, val; track lines and comments are skipped."""
    return fields(rows.where(~F.col("value").rlike(r"^(track|#|browser|\s*$)")), r"\s+", "chr", "start:long", "end:long", "val:double")


def parse_bed(rows: DataFrame) -> DataFrame:
    return fields(rows.where(~F.col("value").rlike(r"^(track|#|browser|\s*$)")), r"\t", "chr", "start:long", "end:long", "name", "score:double", "strand")


def parse_wig(rows: DataFrame) -> DataFrame:
    """chr (without chr), start, span, val of variable and fixed steps; rows as lines() gives them."""
    head = F.col("value").rlike(r"^(fixedStep|variableStep)")
    out = forward_filled(rows.where(~F.col("value").rlike(r"^(track|#|\s*$)")), F.when(head, F.struct("block", "line", "value")), "_head")
    get = lambda k: F.regexp_extract("_head.value", rf"{k}=(\S+)", 1)
    fixed = F.col("_head.value").startswith("fixedStep")
    out = out.where(~head & F.col("_head").isNotNull())
    # the number of a value below its header counts its steps: blocks carry over as above
    from ..operators.ordered import running_sum

    out = running_sum(
        out.withColumn("_key", F.struct("_head.block", "_head.line")),
        ["file", "_key"],
        [],
        "line",
        F.lit(1),
        "_n",
        inclusive=False,
        width=1 << 33,
    )
    start = F.when(
        fixed, get("start").cast("long") + F.col("_n") * F.coalesce(F.nullif(get("step"), F.lit("")).cast("long"), F.lit(1))
    ).otherwise(F.regexp_extract("value", r"^(\d+)", 1).cast("long"))
    value = F.when(fixed, F.trim("value")).otherwise(F.regexp_extract("value", r"^\d+\s+(\S+)", 1)).cast("double")
    span = F.coalesce(
        F.nullif(get("span"), F.lit("")).cast("long"),
        F.when(fixed, F.coalesce(F.nullif(get("step"), F.lit("")).cast("long"), F.lit(1))).otherwise(F.lit(1)),
    )
    return out.select(F.regexp_replace(get("chrom"), "^chr", "").alias("chr"), start.alias("start"), span.alias("span"), value.alias("val"))


def parse_macs(rows: DataFrame) -> DataFrame:
    """chr, start, end, length, summit, tags, log_pval, fold, log_qval; comments, the header and short lines are skipped."""
    good = rows.where(~F.col("value").startswith("#") & ~F.col("value").rlike(r"^chr\s") & (F.size(F.split(F.trim("value"), r"\s+")) > 1))
    return fields(good, r"\s+", "chr", "start:long", "end:long", "length:long", "summit:long", "tags:long", "log_pval:double", "fold:double", "log_qval:double")


def parse_gff(rows: DataFrame, types: list[str] | None = None, chrs: list[str] | None = None, cut: bool = False) -> DataFrame:
    """chr, type, start, end, strand, name, fbid, parent: to_name stands before Parent, gene_id before Name; attributes end in ';'. cut: names to 10 and ids to 11 symbols."""
    out = fields(rows.where(~F.col("value").startswith("#")), "\t", "chr", None, "type", "start:long", "end:long", None, "strand", None, "attributes")
    if types is not None:
        out = out.where(F.col("type").isin(types))
    if chrs is not None:
        out = out.where(F.col("chr").isin(chrs))
    get = lambda pattern: F.nullif(F.regexp_extract("attributes", pattern, 1), F.lit(""))
    name = F.coalesce(get(r'gene_id "([^"]*)";'), get(r"(?:^|;)\s*Name=([^;]*);"))
    fbid, parent = get(r"(?:^|;)\s*ID=([^;]*);"), F.coalesce(get(r"(?:^|;)\s*to_name=([^;]*);"), get(r"(?:^|;)\s*Parent=([^;]*);"))
    clip = (lambda c, n: F.substring(c, 1, n)) if cut else (lambda c, n: c)
    return out.select("chr", "type", "start", "end", "strand", clip(name, 10).alias("name"), clip(fbid, 11).alias("fbid"), clip(parent, 11).alias("parent"))


def before_fasta(rows: DataFrame) -> DataFrame:
    """Lines of a file before its ##FASTA."""
    stop = rows.where(F.col("value").startswith("##FASTA")).groupBy("file").agg(F.min(F.struct("block", "line")).alias("_stop"))
    return rows.join(stop, "file", "left").where(F.col("_stop").isNull() | (F.struct("block", "line") < F.col("_stop"))).drop("_stop")  # a row a file


def flybase_genes(rows: DataFrame) -> DataFrame:
    return parse_gff(before_fasta(rows).select("value"), ["gene"])


def parse_regions(rows: DataFrame) -> DataFrame:
    """id, chr, start, end, peak: a row for each place in the comma list."""
    out = fields(rows.where(~F.col("value").startswith("#") & (F.trim("value") != "")), r"\t", "id", "chr", "start:long", "end:long", "peaks")
    return out.select("id", "chr", "start", "end", F.explode(F.split(F.rtrim(F.col("peaks"), F.lit(",")), ",").cast("array<bigint>")).alias("peak"))


def peak_places(rows: DataFrame, kind: int) -> DataFrame:
    """chr, loc: kind 1, start plus summit offset; kind 0, the start."""
    f = fields(rows.where(~F.col("value").startswith("#") & ~F.col("value").rlike(r"^chr\s")), r"\s+", "chr", "a:long", None, None, "d:long")
    return f.select("chr", (F.col("a") + F.col("d") if kind else F.col("a")).alias("loc"))


def parse_paired(rows: DataFrame) -> DataFrame:
    """sp1, chr1, p1, sp2, chr2, p2: every pair of both lists; empty entries of the first are skipped."""
    f = fields(rows, "\t", "sp1", "chr1", "a", "sp2", "chr2", "b")
    one = f.withColumn("p1", F.explode(F.filter(F.split("a", ","), lambda x: x != ""))).withColumn("p2", F.explode(F.split("b", ",")))
    return one.select("sp1", "chr1", F.col("p1").cast("long").alias("p1"), "sp2", "chr2", F.col("p2").cast("long").alias("p2"))


def zipped_lists(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows for each place of two comma lists of equal length."""
    lists = F.arrays_zip(F.split(F.rtrim(F.col(a), F.lit(",")), ",").alias("x"), F.split(F.rtrim(F.col(b), F.lit(",")), ",").alias("y"))
    return rows.withColumn("_z", F.explode(lists)).withColumns({a: F.col("_z.x"), b: F.col("_z.y")}).drop("_z")


def parse_rates(rows: DataFrame, header: str) -> DataFrame:
    """protein, species, rate: a matrix's rows by its header line; '-' is missing."""
    names = header.split("\t")[1:]
    parts = F.split("value", "\t")
    each = F.array(
        *[
            F.struct(
                F.lit(n).alias("species"), F.nullif(F.get(parts, k + 1), F.lit("-")).cast("double").alias("rate")
            ) for k, n in enumerate(names) if n.strip()
        ],
    )
    out = rows.where(F.col("value") != header).select(F.get(parts, 0).alias("protein"), F.explode(each).alias("p")).select("protein", "p.*")
    return out.where("rate is not null")


def parse_fastq(pieces: DataFrame) -> DataFrame:
    """name, seq, qual of records split before a line of '@'; give records of four lines."""
    parts = F.split("value", "\n")
    return pieces.where(F.size(parts) >= 4).select(
        F.regexp_replace(F.get(parts, 0), "^@", "").alias("name"), F.get(parts, 1).alias("seq"), F.get(parts, 3).alias("qual")
    )


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, qual: lines in fours. Lines are numbered over blocks, so files split freely."""
    from ..operators.ordered import running_sum

    rows = running_sum(lines(spark, path), ["file"], [], "line", F.lit(1), "n", inclusive=False, width=1 << 33)
    four = rows.groupBy("file", F.floor(F.col("n") / 4).alias("r")).agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("l"))
    at = lambda k: F.get("l", k)["value"]
    return four.select(F.regexp_replace(at(0), "^@", "").alias("name"), at(1).alias("seq"), at(3).alias("qual"))


def parse_export(rows: DataFrame) -> DataFrame:
    """machine, run, lane, tile, x, y, idx, read, seq, qual of whitespace fields."""
    return fields(rows.withColumn("value", F.trim("value")), r"\s+", "machine", "run:int", "lane", "tile", "x", "y", "idx", "read", "seq", "qual")


def parse_pdb(rows: DataFrame) -> DataFrame:
    """element, x, y, z of ATOM lines."""
    atom = rows.where(F.col("value").startswith("ATOM"))
    at = lambda a, n: F.trim(F.substring("value", a, n))
    return atom.select(
        F.coalesce(F.nullif(at(77, 2), F.lit("")), F.substring(F.regexp_replace(at(13, 4), r"\d", ""), 1, 1)).alias("element"),
        at(31, 8).cast("double").alias("x"),
        at(39, 8).cast("double").alias("y"),
        at(47, 8).cast("double").alias("z"),
    )


def parse_vertical_counts(rows: DataFrame) -> DataFrame:
    """pos, base, n: a header of bases between bars, then a row of counts a position; rows as lines() gives them."""
    from ..operators.ordered import running_sum

    bars = rows.where(F.col("value").contains("|"))
    first = bars.groupBy("file").agg(F.min_by("value", F.struct("block", "line")).alias("_head"))  # a row a file
    rows = running_sum(bars, ["file"], ["line"], "block", F.lit(1), "_k", width=1).join(first, "file").withColumn("_p", F.split("value", r"\s*\|\s*"))
    pairs = F.arrays_zip(F.split("_head", r"\s*\|\s*").alias("base"), F.col("_p").alias("n"))
    out = rows.where("_k > 1").select("file", (F.col("_k") - 2).cast("int").alias("pos"), F.explode(pairs).alias("z"))
    return out.select("file", "pos", F.trim("z.base").alias("base"), F.trim("z.n").cast("long").alias("n")).where("base != '' and n is not null")


def parse_horizontal_counts(rows: DataFrame) -> DataFrame:
    """pos, base, n: a row of counts a base, after a bar."""
    parts = F.split("value", r"\s*\|\s*")
    out = rows.where(F.col("value").contains("|")).select(
        F.trim(F.get(parts, 0)).alias("base"), F.posexplode(F.split(F.trim(F.get(parts, 1)), r"\s+")).alias("pos", "n")
    )
    return out.select("pos", "base", F.col("n").cast("long").alias("n"))


def parse_scanner_report(rows: DataFrame, cutoff: float | None = None) -> DataFrame:
    """name, start, end, strand, score, ln_p: hits of a motif scanner's report at the cutoff, or the report's own; rows as lines() gives them."""
    number = r"(-?[0-9.]+(?:[eE][-+]?\d+)?)"
    width = F.regexp_extract("value", r"width[^=:]*[=:]\s*(\d+)", 1)
    own = F.regexp_extract("value", rf"cutoff score[^=:]*[=:]\s*{number}", 1)
    head = rows.groupBy("file").agg(F.max(F.nullif(width, F.lit("")).cast("int")).alias("_w"), F.max(F.nullif(own, F.lit("")).cast("double")).alias("_own"))
    hit = r"^\s*(\S+)\s+position=\s*(\d+)\s*(C?)\s+score=\s*" + number
    out = rows.where(F.col("value").rlike(hit)).join(head, "file")  # a row a report
    get = lambda k: F.regexp_extract("value", hit, k)
    start = get(2).cast("long")
    hits = out.select(
        get(1).alias("name"),
        start.alias("start"),
        (start + F.col("_w")).alias("end"),
        F.when(get(3) == "C", "-").otherwise("+").alias("strand"),
        get(4).cast("double").alias("score"),
        F.nullif(F.regexp_extract("value", rf"ln\(p-value\)=\s*{number}", 1), F.lit("")).cast("double").alias("ln_p"),
        "_own",
    )
    return hits.where(F.col("score") >= (F.col("_own") if cutoff is None else F.lit(cutoff))).drop("_own")


def parse_mapper_report(pieces: DataFrame) -> DataFrame:
    """name, template, direction, genome, chr, start, end, identity of records with one path, split at a newline and '>'; the last one counts."""
    get = lambda p: F.regexp_extract("value", p, 1)
    rows = pieces.where(F.col("value").rlike(r"TEMPLATE:") & (get(r"Paths \((\d+)\)") == "1"))
    at = r"Path 1:.*?genome (\S+?):"
    span = r"genome \S+?:([\d,]+)\.\.([\d,]+)"
    number = lambda k: F.replace(F.regexp_extract("value", span, k), F.lit(","), F.lit("")).cast("long")
    return rows.select(
        F.regexp_extract("value", r"^>?(\S+)", 1).alias("name"),
        get(r"TEMPLATE:\s*(\S+)").alias("template"),
        get(r"DIRECTION:\s*(\S+)").alias("direction"),
        get(r"cDNA direction:\s*(\S+)").alias("cdna"),
        get(at).alias("chr"),
        number(1).alias("start"),
        number(2).alias("end"),
        get(r"Percent identity:\s*([\d.]+)").cast("double").alias("identity"),
    )


def mercator_species(blocks: DataFrame) -> DataFrame:
    """block, species (sorted array), places (species to chr, start, end, strand) of parse_mercator()'s rows; species without a place are left out."""
    each = F.array_sort(F.collect_list(F.struct("species", "chr", "start", "end", "strand")))
    found = blocks.where("chr is not null").groupBy("block").agg(each.alias("_all"))
    return found.select(
        "block",
        F.transform("_all", lambda x: x["species"]).alias("species"),
        F.map_from_entries(F.transform("_all", lambda x: F.struct(x["species"], x))).alias("places"),
    )


def stage(stages: DataFrame, name: str, chrs: list | None = None) -> DataFrame:
    """chr, strand, loc, val of one stage of a count store, of some chromosomes if given: partitions that it doesn't name aren't read."""
    out = stages.where(F.col("stage") == name)
    return (out if chrs is None else out.where(F.col("chr").isin(chrs))).drop("stage")


def of_species(block: DataFrame, species: list) -> DataFrame:
    """Rows of those species; fails at run time for one that the alignment lacks."""
    found = block.where(F.col("species").isin(species)).select("species").distinct().agg(F.count("*").alias("_n"))
    known = F.assert_true(F.col("_n") == len(set(species)), "the alignment lacks a species").isNull()
    return block.where(F.col("species").isin(species)).join(F.broadcast(found)).where(known).drop("_n")  # one row


def parse_newick(trees: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, node, parent, length of each node of Newick texts; the root has no parent, nodes without a name are called by their number."""
    kind = dict(trees.dtypes)[key]

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(k, *edge) for k, t in zip(frame[key], frame[text], strict=True) for edge in newick_edges(t)]
            yield pd.DataFrame(rows, columns=[key, "node", "parent", "length"])

    return trees.select(key, text).mapInPandas(run, f"{key} {kind}, node string, parent string, length double")


#: Of Newick text: a comment, a quoted label ('' stands for '), a mark, or a bare label or number.
NEWICK = re.compile(r"\[[^\]]*\]|'((?:[^']|'')*)'|([(),:;])|([^\s(),:;\[\]']+)")


def newick_edges(text: str | None) -> list[tuple[str, str | None, float | None]]:
    """(node, parent, length): children come before their parents. Comments in brackets are skipped, quoted labels may hold anything."""
    out: list[list] = []  # name, parent's place, length
    open_: list[list[int]] = [[]]
    now: int | None = None  # the node being described
    expect_length = False

    def node() -> int:
        nonlocal now
        if now is None:
            now = len(out)
            out.append([None, None, None])
            open_[-1].append(now)
        return now

    for m in NEWICK.finditer(text or ""):
        quoted, mark, bare = m.groups()
        if mark == "(":
            open_.append([])
            now, expect_length = None, False
        elif mark in (",", ")", ";"):
            if open_[-1] or mark != ";":
                node()
            now, expect_length = None, False
            if mark == ")" and len(open_) > 1:
                children = open_.pop()
                parent = node()
                for i in children:
                    out[i][1] = parent
        elif mark == ":":
            node()
            expect_length = True
        elif quoted is not None or bare is not None:
            label = quoted.replace("''", "'") if quoted is not None else bare
            if expect_length:
                out[node()][2], expect_length = float(label), False
            else:
                i = node()
                out[i][0] = label if out[i][0] is None else f"{out[i][0]} {label}"
    names = [name if name else str(i) for i, (name, _, _) in enumerate(out)]
    return [(names[i], None if parent is None else names[parent], length) for i, (_, parent, length) in enumerate(out)]
