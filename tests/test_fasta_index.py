"""The FASTA index against plain parsing, and how many bytes its readers touch."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandspark.sources import fasta_index as X


def record(rng, name):
    n = rng.choice([0, 1, 5, 59, 60, 61, 180, 700])
    seq = "".join(rng.choices("ACGTN", k=n))
    width = rng.choice([7, 60])
    newline = rng.choice(["\n", "\n", "\r\n"])
    lines = [seq[i : i + width] for i in range(0, n, width)]
    if rng.random() < 0.2 and len(lines) > 2:
        lines[1] = lines[1][:3] + " " + lines[1][3:]  # uneven
    if rng.random() < 0.2:
        lines += [""] * rng.randint(1, 3)
    if rng.random() < 0.1 and lines:
        lines.insert(rng.randrange(len(lines)), "")
    head = f">{name} length={n}; of=x{rng.randint(1, 9)}" if rng.random() < 0.5 else f"> {name}"
    return head, "".join(x + newline for x in [head, *lines]), seq


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(3)
    path, seqs = tmp_path_factory.mktemp("fasta"), {}
    for f in range(3):
        text = "" if f else "stray line\n"
        for k in range(40):
            _, own, seqs[f"r{f}_{k}"] = record(rng, f"r{f}_{k}")
            text += own
        (path / f"{f}.fa").write_bytes(text.rstrip("\n").encode() if f == 1 else text.encode())
    (path / "empty.fa").write_bytes(b"")
    return str(path), seqs


@pytest.mark.parametrize("split", [1, 13, 64, 500, 1 << 20])
def test_index_and_fetch(spark, folder, split):
    path, seqs = folder
    if split == 1:  # a range for each byte: one small file
        rows = {r.name: r.length for r in X.build(spark, f"{path}/2.fa", 37).collect()}
        assert rows == {k: len(s) for k, s in seqs.items() if k.startswith("r2")}
        return
    index = X.build(spark, path, split).cache()
    assert {r.name: r.length for r in index.collect()} == {k: len(s) for k, s in seqs.items()} and index.count() == len(seqs)
    assert index.where("width is null and length > 0").count() < 60
    rng = random.Random(split)
    regions = []
    for k, s in seqs.items():
        regions.append((k, None, 0, "all"))
        for _ in range(3):
            if s:
                a = rng.randint(1, len(s))
                regions.append((k, a, rng.randint(a, len(s)), "part"))
    table = spark.createDataFrame([*regions, ("absent", 1, 2, "none")], "name string, start long, end long, seq string")
    got = X.fetch(table.withColumnRenamed("seq", "kind"), index)
    assert got.columns == ["name", "start", "end", "kind", "seq", "n_read"]
    for r in got.collect():
        want = None if r.name == "absent" else seqs[r.name][(r.start or 1) - 1 : r.end or None]
        assert r.seq == want
    index.unpersist()


def test_attributes(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x  length=4; type=gene; a b=c\nACGT\n>y\nAC\n")
    rows = {r.name: (r.attrs, r.offset, r.stop, r.width, r.step) for r in X.build(spark, str(tmp_path)).collect()}
    assert rows == {"x": ({"length": "4", "type": "gene", "a b": "c"}, 31, 36, 4, 5), "y": ({}, 39, 42, 2, 3)}


def test_only_the_region_is_read(spark, tmp_path):
    seq = "".join(random.Random(1).choices("ACGT", k=1_000_000))
    text = ">big\n" + re.sub("(.{50})", r"\1\n", seq)
    (tmp_path / "a.fa").write_text(text + "\n>other\nAC\n")
    index = X.build(spark, str(tmp_path), 100_000)
    regions = spark.createDataFrame([("big", 500_001, 500_100), ("big", 1, 1), ("big", 999_990, 1_000_000)], "name string, start long, end long")
    got = {r.start: r for r in X.fetch(regions, index).collect()}
    assert got[500_001].seq == seq[500_000:500_100] and got[500_001].n_read == 101
    assert got[1].n_read == 1 and got[999_990].seq == seq[999_989:] and sum(r.n_read for r in got.values()) < 120


def test_wrong_regions_fail(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGT\n>y\nAC\n>y\nGG\n")
    index = X.build(spark, str(tmp_path))
    for region, why in ((("x", 2, 5), "out of range"), (("x", -1, 2), "out of range"), (("y", 1, 1), "several records")):
        with pytest.raises(Exception, match=why):
            X.fetch(spark.createDataFrame([region], "name string, start long, end long"), index).collect()
    assert X.fetch(spark.createDataFrame([], "name string, start long, end long"), index).collect() == []


def test_data_source(spark, folder, tmp_path):
    path, seqs = folder
    X.register(spark)
    X.build(spark, path).write.parquet(str(tmp_path / "index"))
    source = spark.read.format("indexed_fasta").option("stretch", 50).load(str(tmp_path / "index"))
    rows = source.collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (r.name, r.start)):
        assert r.start == len(whole.get(r.name, "")) + 1 and len(r.seq) <= 50
        whole[r.name] = whole.get(r.name, "") + r.seq
    assert whole == {k: s for k, s in seqs.items() if s}
    some = source.where(F.col("name").isin("r0_3", "r1_7", "r2_1") & (F.col("start") > 1))
    assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in rows if r.name in ("r0_3", "r1_7", "r2_1") and r.start > 1)
    # filters on the name plan fewer byte ranges
    reader = X.IndexedReader(str(tmp_path / "index"), 50)
    every = sum(s[5] - s[4] for p in reader.partitions() for s in p.stretches)
    left = list(reader.pushFilters([X.EqualTo(("name",), "r0_3"), X.EqualTo(("start",), 1)]))
    assert [f.attribute for f in left] == [("start",)]
    assert {s[1] for p in reader.partitions() for s in p.stretches} <= {"r0_3"}
    assert sum(s[5] - s[4] for p in reader.partitions() for s in p.stretches) < every / 10


def test_empty_and_null_sequences(spark, tmp_path):
    """A record without bases has no lines, and a null sequence isn't an empty one: the table has null where its SQL has."""
    from strandspark import plans

    texts = [(1, "abc " * 40, "x"), (2, "", "x"), (3, "12 -", "x"), (4, None, "x"), (5, "b" * 60, "x"), (6, "", "x")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.name: (r.kind, r.length, r.width, r.step, r.n_bytes) for r in plans.queries()["fasta_index_table"](spark, str(tmp_path)).collect()}
    empty, unknown = ("prose", 0, None, None, 0), ("prose", None, None, None, None)
    assert got == {"d1": ("prose", 120, 60, 61, 122), "d2": empty, "d3": empty, "d4": unknown, "d5": ("prose", 60, 60, 61, 61), "d6": empty}


def test_ranges_are_scanned_once_by_many_tasks(spark, tmp_path):
    """Ranges aren't merged into one task, small as their rows are, and no file is read again after the pieces were found."""
    for f in range(4):
        (tmp_path / f"{f}.fa").write_text("".join(f">r{f}_{k}\nACGT\nAC\n" for k in range(20)))
    index = X.build(spark, str(tmp_path), 100)
    for f in tmp_path.glob("*.fa"):
        f.unlink()
    placed = index.select("name", "length", F.spark_partition_id().alias("part")).collect()
    assert {(r.name, r.length) for r in placed} == {(f"r{f}_{k}", 6) for f in range(4) for k in range(20)} and len(placed) == 80
    assert len({r.part for r in placed}) > 2


def test_random_access_of_odd_texts(spark, tmp_path):
    from strandspark import plans

    texts = [(1, "abc " * 40, "x"), (2, "", "x"), (3, "12 -", "x"), (4, None, "x"), (None, "abc", "x"), (6, "B" * 60, "x")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in plans.queries()["fasta_random_access"](spark, str(tmp_path)).collect()}
    assert got == {("d1", 120, 120, "G", 1), ("d6", 55, 60, "C" * 6, 6)}
