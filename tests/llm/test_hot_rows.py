"""Clashing column names, ids on many rows, and rows without an id."""

from collections import Counter

from pyspark.sql import functions as F

from strandspark.llm import mixing, secret_scan, simhash_dedup, toxicity


def test_keep_one_leaves_columns_alone(spark):
    schema = "doc_id long, text string, _h1 long, _kept string, _h2 int, id string, doc string, print long"
    rows = [(i, f"some {i % 3} words {i % 3} of text {i % 3}", 7, "mine", 8, "own", "d", 9) for i in range(9)]
    got = simhash_dedup.keep_one(spark.createDataFrame(rows, schema).repartition(3))
    assert got.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(map(tuple, got.collect())) == [
        rows[r.component_id] for r in simhash_dedup.groups(
            spark.createDataFrame(rows, schema)
        ).select("component_id").distinct().orderBy("component_id").collect()
    ]


def test_empty_tables_stay_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, _h1 long")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for out in (simhash_dedup.keep_one(empty), secret_scan.redact(empty), toxicity.clean(empty, labels), mixing.mixed(empty)):
        assert out.columns == empty.columns and out.collect() == []


def test_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(2, "a"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, 10).collect()
    assert len(rows) <= 10 and {r.toxic for r in rows} <= {0, 1}
    again = toxicity.training_rows(docs.repartition(7), labels, 10).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))  # the same text of the repeated id


def test_rows_without_an_id_are_spread_over_chunks(spark):
    """4,000 rows without an id and of one size, half of them alike in text too."""
    rows = [(None, f"word{i}" if i % 2 else "word", "s") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sized = mixing.sizes(docs)
    part = F.pmod(F.xxhash64(F.lit(mixing.SEED), F.lit(mixing.CHUNK), "who.seed"), F.lit(-(-len(rows) // mixing.CHUNK)))
    assert sized.count() == len(rows) and sized.groupBy(part.alias("part")).count().agg(F.max("count")).first()[0] < 3 * mixing.CHUNK
    got = mixing.mix(docs)
    taken = got.groupBy("copies").count().collect()
    assert got.count() == len(rows) and abs(sum(r.copies * r["count"] for r in taken) - 1.5 * len(rows)) <= 1
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies * r["count"] for r in taken)
    times = Counter(r.text for r in out.collect())
    assert max(n for t, n in times.items() if t != "word") <= 2 and abs(times["word"] - 3000) <= 120
    assert sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str) == sorted(map(tuple, got.collect()), key=str)


def test_more_rows_alike_than_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ALIKE", 10)
    docs = spark.createDataFrame([(1, "a b", "s")] * 37 + [(2, "a b", "s")] * 10 + [(3, "", None)], "doc_id long, text string, source string")
    assert Counter(r.who.doc_id for r in mixing.sizes(docs).collect()) == {1: 37, 2: 10, 3: 1}
