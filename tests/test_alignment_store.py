"""The alignment store: equal rows, pruned scans, appends that are seen whole."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandspark.operators import alignment as A
from strandspark.sources import alignment_store as S
from strandspark.sources import readers as R

SCHEMA = "block long, species string, chr string, p_start long, strand string, seq string"


def made(seed=1, n=120, first=0):
    rng = random.Random(seed)
    rows = []
    for b in range(first, first + n):
        k = rng.choice([5, 60, 3000])
        for s in ("mel", "yak", "pse"):
            if rng.random() < 0.9:
                rows.append((b, s, rng.choice("XL"), rng.randrange(0, 50_000), rng.choice("+-"), "".join(rng.choices("ACGT-", k=k))))
    return [*rows, (first + n, "mel", None, None, None, "ACG-"), (first + n + 1, "mel", "X", 100, "+", "----")]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "s")
    rows = made()
    S.append(spark.createDataFrame(rows, SCHEMA).repartition(4), path, width=1000)
    return path, rows


def key(rows):
    return sorted(((str(r[0]), *r[1:]) for r in rows), key=str)


def test_whole_store(spark, store):
    path, rows = store
    got = S.of_species(spark, path, ["mel", "yak", "pse"])
    assert key((r.block, r.species, r.chr, r.p_start, r.strand, r.seq) for r in got.collect()) == key(rows)
    with pytest.raises(ValueError, match="lacks"):
        S.of_species(spark, path, ["mel", "sim"])
    assert S.of_species(spark, path, ["sim"], strict=False).collect() == []


def opened(df):
    """(partition filters of the scan, files that it opens)."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"PartitionFilters: \[(.*)\]", plan), len(df.select("seq", F.input_file_name().alias("f")).select("f").distinct().collect())


def test_interval_reads_few_files(spark, store):
    path, rows = store
    all_files = len(S.of_species(spark, path, ["mel", "yak", "pse"]).select(F.input_file_name()).distinct().collect())
    got = S.on_interval(spark, path, "mel", "X", 20_000, 24_000)
    want = [r for r in rows if r[1] == "mel" and r[2] == "X" and r[3] is not None and r[3] <= 24_000 and r[3] + len(r[5].replace("-", "")) - 1 >= 20_000]
    assert want and key((r.block, r.species, r.chr, r.p_start, r.strand, r.seq) for r in got.collect()) == key(want)
    filters, files = opened(got)
    assert any("species" in f and "bin" in f for f in filters) and files < all_files / 5


def test_targets_through_the_store(spark, store, monkeypatch):
    path, rows = store
    block = spark.createDataFrame(rows, SCHEMA)
    targets = spark.createDataFrame([(i, c, 500 * i, 500 * i + 200) for i in range(0, 100, 3) for c in "XL"], "pid int, chr string, s long, e long")
    want = sorted(map(tuple, A.blocks_on_target(block.withColumn("block", F.col("block").cast("string")), targets, "yak").collect()))
    assert want and sorted(map(tuple, A.blocks_on_target(S.on_targets(spark, path, targets, "yak"), targets, "yak").collect())) == want
    monkeypatch.setattr(S, "PLANNED", 2)  # too many to name
    assert sorted(map(tuple, A.blocks_on_target(S.on_targets(spark, path, targets, "yak"), targets, "yak").collect())) == want


def test_blocks_come_whole(spark, store):
    path, rows = store
    ids = spark.createDataFrame([("3",), ("77",), ("120",), ("nothing",)], "block string")
    got = S.whole_blocks(spark, path, ids)
    assert key((r.block, r.species, r.chr, r.p_start, r.strand, r.seq) for r in got.collect()) == key(r for r in rows if r[0] in (3, 77, 120))


def test_appends_are_seen_whole(spark, tmp_path):
    path = str(tmp_path / "s")
    S.append(spark.createDataFrame(made(1, 10), SCHEMA), path)
    one = S.of_species(spark, path, ["mel"]).count()
    S.append(spark.createDataFrame(made(2, 10, 100), SCHEMA), path)
    assert S.of_species(spark, path, ["mel"]).count() > one
    # an append that stopped before its catalogue was written
    stray = spark.createDataFrame(
        [("900", 1, 2, "+", "AC", None, "stopped", "mel", "X", 0)],
        "block string, p_start long, p_end long, strand string, seq string, score double, version string, species string, chr string, bin long",
    )
    before = S.of_species(spark, path, ["mel"]).count()
    stray.write.mode("append").partitionBy("version", "species", "chr", "bin").parquet(f"{path}/rows")
    assert S.of_species(spark, path, ["mel"]).count() == before and S.on_interval(spark, path, "mel", "X", 1, 2).where("block = '900'").count() == 0


def test_load_maf(spark, tmp_path):
    (tmp_path / "a.maf").write_text("##maf version=1\na score=5.5\ns mel.X 10 4 + 100 AC-GT\ns yak.2 20 5 - 100 ACCGT\n\na score=1\ns mel.X 50 3 + 100 ACG\n")
    S.load_maf(spark, str(tmp_path / "a.maf"), str(tmp_path / "s"))
    got = S.of_species(spark, str(tmp_path / "s"), ["mel", "yak"])
    assert sorted((r.species, r.chr, r.p_start, r.p_end, r.strand, r.seq, r.score) for r in got.collect()) == [
        ("mel", "X", 10, 13, "+", "AC-GT", 5.5), ("mel", "X", 50, 52, "+", "ACG", 1.0), ("yak", "2", 75, 79, "-", "ACCGT", 5.5)
    ]
    assert got.where("species = 'yak'").first().block == got.where("score = 5.5 and species = 'mel'").first().block


def test_mercator_folder(spark, tmp_path):
    (tmp_path / "genomes").write_text("mel_r5\tyak_1\tpse\n")
    (tmp_path / "map").write_text("1\tX\t5\t9\t+\t2L\t1\t4\t-\tNA\tNA\tNA\tNA\n2\tX\t50\t52\t+\tNA\tNA\tNA\tNA\t3\t7\t9\t+\n")
    (tmp_path / "1.mfa").write_text(">mel_r5 some\nAC-G\nT\n>yak_1\nACGG-\n>pse\n-----\n")
    (tmp_path / "2.mfa").write_text(">mel_r5\nACG\n>pse\nA-G\n")
    (tmp_path / "9.mfa").write_text(">mel_r5\nA\n")
    got = sorted(map(tuple, R.mercator_folder(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(
        [
            ("1", "mel", "AC-GT", "X", 5, 9, "+"),
            ("1", "yak", "ACGG-", "2L", 1, 4, "-"),
            ("1", "pse", "-----", None, None, None, None),
            ("2", "mel", "ACG", "X", 50, 52, "+"),
            ("2", "pse", "A-G", "3", 7, 9, "+"),
        ],
        key=str,
    )


def test_rate_folder(spark, tmp_path):
    for name, text in (("a", "protein\tmel\tyak\t\np1\t0.5\t-\t\np2\t1\t2\t\n"), ("b", "protein\tpse\t\np1\t3\t\n")):
        (tmp_path / f"{name}_dom_rates").mkdir()
        (tmp_path / f"{name}_dom_rates" / f"{name}_pw_rates_domains").write_text(text)
    got = {(r.set, r.protein): r.rates for r in R.rate_folder(spark, str(tmp_path)).collect()}
    assert got == {("a", "p1"): {"mel": 0.5, "yak": None}, ("a", "p2"): {"mel": 1.0, "yak": 2.0}, ("b", "p1"): {"pse": 3.0}}
