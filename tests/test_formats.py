"""Readers and writers on small files and literal lines."""

from pyspark.sql import functions as F

from strandspark.sources import readers as R
from strandspark.sources import writers as W


def text(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


def test_fasta(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_text(">chr1 organism=fly; length=8\nACGT\nACGT\n>chr2 note\nAC\n")
    got = rows(R.fasta(spark, str(path)), "name")
    assert got == [("chr1", {"organism": "fly", "length": "8"}, 8, "ACGTACGT"), ("chr2", {}, 2, "AC")]
    chunks = R.chunked(R.fasta(spark, str(path)), 3, 1)
    assert rows(chunks.where("name = 'chr1'").select("start", "seq"), "start") == [(0, "ACGT"), (3, "TACG"), (6, "GT")]
    again = tmp_path / "out"
    W.fasta(R.fasta(spark, str(path)), F.col("name"), 3).write.text(str(again))
    assert {r[0]: r[3] for r in rows(R.fasta(spark, str(again)))} == {"chr1": "ACGTACGT", "chr2": "AC"}


def test_maf(spark, tmp_path):
    path = tmp_path / "a.maf"
    path.write_text("##maf version=1\n\na score=2.5\ns mel.chr2L 10 4 + 100 AC-GT\ns yak.chr2 5 5 - 90 ACCGT\n\na score=1\ns mel.chr2L 20 2 + 100 AC\n")
    got = rows(R.maf(spark, str(path)).select("score", "species", "chr", "start", "size", "strand", "seq"), "score", "species")
    assert got == [(1.0, "mel", "chr2L", 20, 2, "+", "AC"), (2.5, "mel", "chr2L", 10, 4, "+", "AC-GT"), (2.5, "yak", "chr2", 5, 5, "-", "ACCGT")]


def test_mercator(spark):
    got = rows(R.parse_mercator(text(spark, "1 chr2 10 20 + NA NA NA NA"), ["mel", "yak"]), "species")
    assert got == [("1", "mel", "chr2", 10, 20, "+"), ("1", "yak", None, None, None, None)]


def test_reads(spark, tmp_path):
    sam = text(spark, "@HD\tx", "r1\t16\tchr1\t7\t30\t4M\t*\t0\t0\tACGT\tIIII", "r2\t0\tchr1\t9\t5\t4M\t*\t0\t0\tAAAA\tIIII")
    assert rows(R.parse_sam(sam).select("name", "strand", "loc", "mapq"), "name") == [("r1", "-", 7, 30), ("r2", "+", 9, 5)]
    path = tmp_path / "b.txt"
    path.write_text("r1\t-\tchr1\t7\tACGT\tIIII\n")
    assert rows(R.reads(spark, str(path), "bowtie").select("strand", "loc", "mapq")) == [("-", 7, None)]


def test_signal_formats(spark):
    assert rows(R.parse_sgr(text(spark, "chr1 5 2.5", " chr1\t6  1", ""))) == [("chr1", 5, 2.5), ("chr1", 6, 1.0)]
    assert rows(R.parse_bedgraph(text(spark, "track x", "1 0 5 2"))) == [("1", 0, 5, 2.0)]
    assert rows(R.parse_bed(text(spark, "1\t0\t5\tn\t2\t-"))) == [("1", 0, 5, "n", 2.0, "-")]
    signal = spark.createDataFrame([("1", 0, 1.0), ("1", 10, 2.0), ("1", 20, 3.0)], "chr string, loc long, val double")
    full = rows(W.fixed_wig(signal), "n")
    assert full[0][2] == "fixedStep chrom=chr1 start=1 step=10" and [x[2] for x in full[1:]] == ["1.0", "2.0", "3.0"]
    parity = rows(W.fixed_wig(signal, parity=True), "n")
    assert [x[2] for x in parity] == ["fixedStep chrom=chr1 start=11 step=10", "2.0"]
    assert rows(W.sgr_bedgraph(signal.limit(1))) == [("1\t0\t0\t1.0",)]


def test_wig(spark, tmp_path):
    path = tmp_path / "a.wig"
    path.write_text("track type=wiggle_0\nvariableStep chrom=chr2L span=5\n10 1.5\n30 2\nfixedStep chrom=chrX start=100 step=10\n1\n2\n3\n")
    got = rows(R.parse_wig(R.lines(spark, str(path))), "chr", "start")
    assert got == [("2L", 10, 5, 1.5), ("2L", 30, 5, 2.0), ("X", 100, 10, 1.0), ("X", 110, 10, 2.0), ("X", 120, 10, 3.0)]


def test_tables(spark, tmp_path):
    macs = text(spark, "# x", "chr start end length summit tags", "1 10 60 50 25 9 30.5 4 2", "short")
    assert rows(R.parse_macs(macs)) == [("1", 10, 60, 50, 25, 9, 30.5, 4.0, 2.0)]
    assert rows(R.peak_places(macs.where("value like '1 %'"), 1)) == [("1", 35)]
    gff = text(spark, "#c", "2L\tx\tgene\t5\t9\t.\t+\t.\tID=FBgn0001;Name=a-long-name-here;Parent=p;to_name=t;", "2L\tx\texon\t5\t9\t.\t-\t.\tID=e;")
    assert rows(R.parse_gff(gff, ["gene"])) == [("2L", "gene", 5, 9, "+", "a-long-name-here", "FBgn0001", "t")]
    assert R.parse_gff(gff, ["gene"], cut=True).first().name == "a-long-nam"
    path = tmp_path / "g.gff"
    path.write_text("2L\tx\tgene\t5\t9\t.\t+\t.\tID=a;\n##FASTA\n2L\tx\tgene\t6\t9\t.\t+\t.\tID=b;\n")
    assert [r.fbid for r in R.flybase_genes(R.lines(spark, str(path))).collect()] == ["a"]
    assert rows(R.parse_regions(text(spark, "# c", "r1\t1\t5\t90\t7,9,")), "peak") == [("r1", "1", 5, 90, 7), ("r1", "1", 5, 90, 9)]
    assert R.parse_paired(text(spark, "a\t1\t5,,6\tb\t2\t7,8")).count() == 4
    zipped = R.zipped_lists(spark.createDataFrame([("i", "1,2,", "x,y,")], "id string, a string, b string"), "a", "b")
    assert rows(zipped, "a") == [("i", "1", "x"), ("i", "2", "y")]
    assert rows(R.parse_rates(text(spark, "p\tmel\tyak\t", "q\t0.5\t-\t"), "p\tmel\tyak\t")) == [("q", "mel", 0.5)]


def test_sequencer_files(spark, tmp_path):
    path = tmp_path / "r.fq"
    path.write_text("@a\nAC\n+\nII\n@b\nGT\n+\n@I\n")
    assert rows(R.fastq(spark, str(path)), "name") == [("a", "AC", "II"), ("b", "GT", "@I")]
    export = R.parse_export(text(spark, "M 7 1 2 3 4 AC 1 ACGT IIII"))
    assert rows(W.fastq_from_export(export)) == [("@M_0007:1:2:3:4#AC/1\nACGT\n+\nIIII",)]
    reads = spark.createDataFrame([(f"r{k}", "A", "I") for k in range(9)], "name string, seq string, qual string")
    mixed = rows(W.mixed_fastq(reads, reads.withColumn("seq", F.lit("C")), 0.5, 8), "i")
    assert [x[1] for x in mixed if x[2] == "A"] == [f"r{k}" for k in range(sum(x[2] == "A" for x in mixed))]
    atom = "ATOM      1  CA  ALA A   1      11.104   6.134  -6.504  1.00  0.00           C"
    assert rows(R.parse_pdb(text(spark, atom, "HETATM"))) == [("C", 11.104, 6.134, -6.504)]
    deck = W.gaussian_deck(R.parse_pdb(text(spark, atom)).withColumn("n", F.lit(0).cast("long")))
    assert deck.count() == 3


def test_matrices_and_reports(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("A | C | G | T |\n1 | 2 | 3 | 4 |\n5 | 6 | 7 | 8 |\n")
    got = {(r.pos, r.base): r.n for r in R.parse_vertical_counts(R.lines(spark, str(path))).collect()}
    assert got[0, "A"] == 1 and got[1, "T"] == 8 and len(got) == 8
    assert rows(R.parse_horizontal_counts(text(spark, "A | 1 2")), "pos") == [(0, "A", 1), (1, "A", 2)]
    report = tmp_path / "p.txt"
    report.write_text(
        "width of matrix: 6\nnumerically calculated cutoff score: 5.5\n seq1 position= 10 score= 7.25 ln(p-value)= -9.5\n seq1 position= 20C score= 4.0 ln(p-value)= -3\n",
    )
    lines = R.lines(spark, str(report))
    assert rows(R.parse_scanner_report(lines)) == [("seq1", 10, 16, "+", 7.25, -9.5)]
    assert rows(R.parse_scanner_report(lines, 0.0), "start")[1] == ("seq1", 20, 26, "-", 4.0, -3.0)
    mapper = tmp_path / "s.txt"
    record = ">t{0} TEMPLATE: a{0} DIRECTION: 5\nPaths ({1}):\ncDNA direction: sense\n  Path 1: query 1..9 genome chr2L:1,000..2,000 (1001 bp)\n    Percent identity: 99.5\n"
    mapper.write_text(record.format(1, 1) + record.format(2, 3) + record.format(3, 1))
    got = rows(R.parse_mapper_report(R.records(spark, str(mapper), "\n>")), "name")
    assert [x[0] for x in got] == ["t1", "t3"] and got[0][1:] == ("a1", "5", "sense", "chr2L", 1000, 2000, 99.5)


def test_sinks(spark, tmp_path):
    hits = spark.createDataFrame(
        [("1", 5, 9, "m_hit", 2.5, "-", -3.0)], "chr string, start int, end int, name string, score double, strand string, ln_p double"
    )
    assert W.bed(hits).first().value == "1\t5\t9\tm_hit\t2.5\t-\t-3.0"
    genes = spark.createDataFrame([(1, "2L", 100, 200, "-")], "gid int, chr string, s long, e long, strand string")
    assert W.tss_bed(genes, 10).first().value == "2L\t190\t210\t1\t0\t-"
    W.split_by(W.bed(hits), "chr", str(tmp_path / "bed"))
    assert (tmp_path / "bed" / "chr=1").is_dir()
    assert W.append_new(genes, genes, "gid").count() == 0
    seqs = spark.createDataFrame([("f", "n", "ACGT")], "file string, name string, seq string")
    assert W.tba_header(seqs).first().value == ">f:n:1:+:4"
    wig = W.variable_wig(spark.createDataFrame([("1", 1, 2.0)], "chr string, start long, val double"), 50)
    assert rows(wig, "start") == [("1", 0, "variableStep chrom=chr1 span=50"), ("1", 1, "1 2.0")]
