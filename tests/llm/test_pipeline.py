"""The pipeline on sf0.001, stage by stage, and the registered queries' columns."""

import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test data")


def test_stages(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from strandspark.llm import mixing, packing, secret_scan, simhash_dedup, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / name))
        kept[name] = out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert sorted(out.columns) == sorted(columns)
        before = out
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, labels).collect()}
    assert {r.doc_id for r in kept["toxicity"].collect()} == {i for i, p in scores.items() if not p}
    group = {r.doc_id: r.component_id for r in simhash_dedup.groups(kept["toxicity"]).collect()}
    assert {r.doc_id for r in kept["simhash_near_dedup"].collect()} == set(group.values())
    texts = {r.doc_id: r.text for r in kept["simhash_near_dedup"].collect()}
    assert {r.doc_id: r.text for r in kept["secret_scan"].collect()} == {i: secret_scan.redact_text(t) for i, t in texts.items()}
    whole = {r.doc_id: r.text for r in kept["secret_scan"].collect()}
    assert all(whole[r.doc_id] == r.text for r in kept["mixing"].collect())
    # mixing: each row as often as the operator says, by what tells rows of sf0.001 apart
    mixed = Counter((r.doc_id, r.text) for r in kept["mixing"].collect())
    decided = {r.doc_id: r.copies for r in mixing.mix(kept["secret_scan"]).collect()}
    assert mixed == {(i, t): decided[i] for i, t in whole.items() if decided[i]}
    # packing: whole documents, their token ids by the tokenizers library, in sequences without gaps
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = False
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in whole.items()}
    pieces, sequences = Counter(), {}
    for r in kept["packing"].collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id, r.piece, r.start, r.length] += 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces == {(i, k, a, n): decided[i] for i in whole if decided[i] for k, (a, n) in enumerate(packing.cut(len(ids[i])))}
    for placed in sequences.values():
        ends = [0]
        for offset, length in sorted(placed):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= packing.CAPACITY


def test_run_matches_the_stages(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns) and got.count() > 100


def test_each_operator_has_one_query():
    from strandspark.llm import queries

    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op3_suffix_dedup"])
def test_dedup_agrees_with_sql(spark, name):
    from strandspark.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
