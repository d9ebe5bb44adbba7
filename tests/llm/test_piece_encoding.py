"""Normalisation, spans and ids against the sentencepiece library itself."""

import hashlib
import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from strandspark.llm import piece_encoding

#: Letters, several blanks, symbols that a map turns into several, none or other characters, and combining marks.
SYMBOLS = list("aAe bß  \t\n　 ▁ﬁｗＷ１①ǅ́̈​é¨가각ｶﾞ㍿\x00\x07ﷺ")
AWKWARD = ["", " ", "  ", "a\0b", "漢字 😀😀 ‍", "<s></s><unk><0x0A>", " " * 30_000, "x" * 30_000, "▁▁ a▁b ", "\n" * 1000, "é" * 3, "\U0010ffff", "long " * 40_000]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(SYMBOLS, k=rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix,trim,escape", [(True, True, True), (True, False, True), (False, True, False)])
def test_normaliser_agrees_with_the_library(rule, prefix, trim, escape):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=trim, escape_whitespaces=escape)
    spec = pb.NormalizerSpec()
    spec.ParseFromString(library.serialized_normalizer_spec())
    own = piece_encoding.Normalizer(spec)
    for text in random_texts(1500):
        want, places = library.Normalize(text, with_offsets=True)
        got, source = own(text)
        assert got == want
        if want:
            first = piece_encoding.byte_starts(text)
            assert source.tolist() == [first[i] for i in places]


def model_with_a_map():
    """The given model, with a compiled map of another normaliser, trimming, and a symbol of the user."""
    library = sentencepiece.SentencePieceNormalizer(rule_name="nfkc_cf", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    model = pb.ModelProto()
    with open(piece_encoding.vocabulary(), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.ParseFromString(library.serialized_normalizer_spec())
    model.pieces[31_999].piece, model.pieces[31_999].type = "ＷＷ", pb.ModelProto.SentencePiece.USER_DEFINED
    return model.SerializeToString()


@pytest.mark.parametrize("proto", [None, model_with_a_map()], ids=["given", "mapped"])
def test_ids_spans_and_decoding(proto):
    if proto is None:
        with open(piece_encoding.vocabulary(), "rb") as f:
            proto = f.read()
    own, library = piece_encoding.Codec(proto=proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    texts = [*AWKWARD, *random_texts(400), "ＷＷａ ＷＷＷ"]
    found = own.encode(texts)
    assert own.decode([i for i, _, _ in found]) == library.decode(library.encode(texts, add_eos=True))
    for text, (ids, begins, ends) in zip(texts, found, strict=True):
        pieces = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [*(p.id for p in pieces), library.eos_id()]
        assert list(zip(begins.tolist(), ends.tolist(), strict=True))[:-1] == [(p.begin, p.end) for p in pieces]


def test_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_encoding.vocabulary())
    texts = [*AWKWARD, None, "twice", "twice"]
    rows = [(None if i == 4 else i // 2, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_bytes int").repartition(3)
    got = piece_encoding.digests(docs)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "spans_sha256"]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), len((t or "").encode())))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in got.collect()), key=key) == sorted(want, key=key)
    assert piece_encoding.digests(docs.limit(0)).collect() == []
