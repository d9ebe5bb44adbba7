"""Each operator against brute force on small made-up tables with awkward rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandspark.llm import hamming_search, mixing, packing, quality, secret_scan, simhash_dedup, substring_dedup, suffix_dedup, toxicity, warc_fixity

SCHEMA = "doc_id long, text string, source string, lang string, runs string, size int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def made(seed=7, n=60):
    """Random documents, copies, near copies, shared passages, loops; null, empty and long texts; a repeated row; a null id."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 6))) for _ in range(80)]
    prose = lambda k: " ".join(rng.choices(vocabulary, k=k))
    shared, texts = prose(60), []
    for i in range(n):
        t = prose(rng.randint(0, 120))
        if i % 7 == 0:
            t = f"{t[: len(t) // 2]} {shared} \n{t[len(t) // 2 :]}"
        if i % 9 == 0 and texts:
            t = rng.choice(texts) or ""
        if i % 11 == 0:
            words = (rng.choice([x for x in texts if x] or ["a b c"])).split(" ")
            words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
        texts.append(t)
    texts += [None, "", " \t\n", "one", "one two", "loop " * 300, "ab" * 400, prose(3000), shared.upper()]
    rows = [(i, t, None if i % 13 == 0 else f"s{i % 4}", "xx", "clash", 1) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, shared, "s1", "xx", "clash", 1)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(text):
    return (text or "").encode()


def key(doc_id):
    return -(2**63) if doc_id is None else doc_id


def same(got, want):
    assert Counter(map(str, got)) == Counter(map(str, want))


def test_substring_dedup(docs, rows, empty):
    first = {}
    for i, t, *_ in rows:
        words = raw(t).split()
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            first[w] = min(first.get(w, (2**63, 0)), (key(i), s))
    want = []
    for i, t, *_ in rows:
        words = raw(t).split()
        gone = {j for s in range(len(words) - 19) if first[tuple(words[s : s + 20])] < (key(i), s) for j in range(s, s + 20)}
        kept = [w for j, w in enumerate(words) if j not in gone]
        want.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    same([tuple(r) for r in substring_dedup.dedup(docs).collect()], want)
    assert sum(w[2] for w in want) > 500
    assert substring_dedup.dedup(empty).count() == 0


def test_substring_dedup_carries_leaders_over_blocks(docs):
    whole = substring_dedup.dedup(docs).collect()
    same([tuple(r) for r in substring_dedup.dedup(docs, block=3).collect()], [tuple(r) for r in whole])


def test_extension_finds_windows_with_an_earlier_equal():
    rng = np.random.default_rng(3)
    window, gram = 9, 3
    words = rng.integers(0, 3, 4000).astype(np.uint64)
    at = np.arange(10, 3900)
    grams = [tuple(words[i : i + gram]) for i in at]
    group = np.unique(grams, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((at, group))
    at, group = at[order], group[order]
    open_ = rng.integers(0, 1 << (window - gram + 1), len(at))
    seen = substring_dedup.extend(group, at, open_, lambda j, rows: words[at[rows] + j], window, gram)
    first: dict = {}
    for k, i in sorted(enumerate(at.tolist()), key=lambda x: x[1]):
        for o in range(window - gram + 1):
            if open_[k] >> o & 1:
                key = (o, tuple(words[i - o : i - o + window]))
                assert bool(seen[k] >> o & 1) == (key in first), (k, o)
                first.setdefault(key, i)
    assert seen.any()


def test_suffix_dedup(docs, rows, empty):
    places = defaultdict(set)
    for i, t, *_ in rows:
        for s in range(len(raw(t)) - 199):
            places[raw(t)[s : s + 200]].add((i, s))
    want = []
    for i, t, *_ in rows:
        b = raw(t)
        mark = bytearray(len(b))
        for s in range(len(b) - 199):
            if len(places[b[s : s + 200]]) > 1:
                mark[s : s + 200] = b"\1" * 200
        spans = len(re.findall(b"\1+", bytes(mark)))
        want.append((i, len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    same([tuple(r) for r in suffix_dedup.dedup(docs).collect()], want)
    assert sum(w[2] for w in want) > 1000
    assert suffix_dedup.dedup(empty).count() == 0


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(8)
    prose = lambda k: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(k))
    shared, a, b, c, d = prose(60), prose(90), prose(90), prose(90), prose(90)
    texts = [f"{a} {shared}", f"{shared} {b}", f"{shared} {c}", d]
    for i in (None, 5):
        docs = spark.createDataFrame([(i, t) for t in [*texts, d]], "doc_id long, text string").repartition(3)
        words = sorted(r.n_removed for r in substring_dedup.dedup(docs).collect())
        assert words == [0, 0, 0, 60, 60]
        got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(docs).collect())
        longer = len(os.path.commonprefix([f"{shared} {b}", f"{shared} {c}"]))
        assert sorted(n for _, n in got) == [0, 0, len(shared), longer, longer]


@pytest.mark.parametrize("letters", [1, 2, 200])
def test_multikey_quicksort_sorts_and_finds_equal_strings(letters):
    rng = np.random.default_rng(1)
    text = rng.integers(0, letters, 3000).astype(np.uint8)
    flat = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    words = sum((flat[j : len(flat) - 8 + j] << np.uint64(8 * (7 - j)) for j in range(8)), np.zeros(3000, np.uint64))
    at = rng.permutation(2980)
    group = np.sort(rng.integers(0, 3, 2980))
    order, equal = suffix_dedup.multikey_quicksort(at, group, words, 20)
    got = [(int(group[k]), text[at[k] : at[k] + 20].tobytes()) for k in order]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(2980))
    assert equal.tolist() == [False, *(x == y for x, y in zip(got[1:], got, strict=False))]


def test_suffix_dedup_compares_across_bucket_borders(spark):
    rng = random.Random(12)
    prose = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    shared = prose(400)
    # one passage with different surroundings in all documents: its leading bytes are most rows of the range partition
    docs = [(i, prose(250) + shared[: 400 - i % 150] + prose(250)) for i in range(120)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(60)
    places = defaultdict(set)
    for i, t in docs:
        for s in range(len(t) - 199):
            places[t[s : s + 200]].add((i, s))
    want = {i: len({j for s in range(len(t) - 199) if len(places[t[s : s + 200]]) > 1 for j in range(s, s + 200)}) for i, t in docs}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup(table).collect()} == want


def test_simhash(docs, rows, empty):
    def fingerprint(t):
        w = raw(t).lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))

    prints = [fingerprint(t) for _, t, *_ in rows]
    label = [key(i) for i, *_ in rows]
    while True:
        new = [min(label[b] for b in range(len(rows)) if (prints[a] ^ prints[b]).bit_count() <= 3) for a in range(len(rows))]
        if new == label:
            break
        label = new
    want = [(i, f"{p:016x}", None if c == -(2**63) else c) for (i, *_), p, c in zip(rows, prints, label, strict=True)]
    same([tuple(r) for r in simhash_dedup.groups(docs).collect()], want)
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    same([r.doc_id for r in kept.select("doc_id").collect()], {None if c == -(2**63) else c for c in label})
    assert simhash_dedup.groups(empty).count() == 0


def test_keep_one_tells_rows_of_one_id_apart(spark):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(80))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (None, c), (5, a), (6, d), (6, e), (7, d), (8, f), (8, f), (None, None), (9, "")]
    got = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    same([tuple(r) for r in got], [(None, a), (None, b), (None, c), (6, d), (6, e), (8, f), (None, None)])


@pytest.mark.parametrize("n", [3, 90, 900])
def test_gray_tree_links_all_and_only_close_prints(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 2**63, 6, dtype=np.uint64)[rng.integers(0, 6, n)]
    for _ in range(4):
        x = x ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    x = np.unique(x)
    x = x[np.argsort(simhash_dedup.gray_rank(x))]
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    label = np.arange(len(x))
    while not (new := np.where(near, label[None, :], n).min(1)).tolist() == label.tolist():
        label = new
    assert simhash_dedup.linked(x).tolist() == label.tolist()


def test_gray_rank_inverts_the_code():
    n = np.arange(5000, dtype=np.uint64)
    assert (simhash_dedup.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_components_settle_on_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)]
    got = {r.u: r.root for r in simhash_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100}


BASE = [
    ("my password=abc12 ok", []),
    ("PassWord : 'abcdef' token=secret=abcdefgh api-key", [("assign", 0, 18), ("assign", 20, 41)]),
    ("é AKIA" + "A" * 16 + " AKIAshort " + "0a" * 12 + " " + "f" * 23, [("access", 2, 22), ("hex", 33, 57)]),
]


@pytest.mark.parametrize("text,want", BASE)
def test_secret_base(text, want):
    base, _ = secret_scan.scan(text)
    assert sorted((k, a, b) for a, b, k in base) == sorted(want)


def test_secret_lexing(docs, rows, empty):
    text = 'A_KEY = "Qz7Lm2Xw9TbV"\nlimit = 12\nclient_secret = A_KEY + "k4"\nauth.password => "${ENV}"\nnote: plain words\n{"private_key": "Zx81LmQpw22"}'
    kinds = {text[a:b]: k for a, b, k in secret_scan.lex(text)}
    assert kinds == {"Qz7Lm2Xw9TbV": "literal", "k4": "literal", "Zx81LmQpw22": "literal"}
    late = 'part = "Qz7Lm2Xw9TbV"\npassword_for_db = part\n'
    assert [(late[a:b], k) for a, b, k in secret_scan.lex(late)] == [("Qz7Lm2Xw9TbV", "constant")]
    got = secret_scan.find(docs)
    assert got.count() == len(rows) and got.agg(F.sum("n_assign")).first()[0] == 0
    assert got.where("doc_id is null").count() == 1
    assert secret_scan.find(empty).count() == 0
    assert secret_scan.redact_text("x token=abcdef123 y") == "x [REDACTED] y"
    assert secret_scan.redact_text("plain") == "plain"


def program(rng):
    """A source text of random statements, and which literals of it reach a sensitive name: {literal: kind}."""
    made, lines, want, constants = 0, [], {}, {}

    def literal():
        nonlocal made
        made += 1
        return f"Qz7Lm2Xw{made:04d}TbVk"

    for k in range(rng.randint(5, 40)):
        x = literal()
        quote = rng.choice(['"', "'", '"""', "'''"])
        style = rng.randrange(14)
        name = rng.choice(["private_key", "credential", "auth.salt", "Bearer", "dbPwd"])
        if style == 0:
            lines.append(f"{rng.choice(['#', '//', '-- '])} {name} = {quote}{x}{quote}")
        elif style == 1:
            lines.append(f"/* {name} = {quote}{x}{quote}\n {name}: {x} */")
        elif style == 2:
            lines.append(f"msg{k} = \"set {name} = {x} now\"")
        elif style == 3:
            lines.append(f"{name} {rng.choice(['=', ':', ':=', '=>'])} {rng.choice(['', 'r', 'b', 'f'])}{quote}{x}{quote}  # {name} = {x}x")
            want[x] = "literal"
        elif style == 4:
            lines.append(f"{name}={x}")
            want[x] = "literal"
        elif style == 5:
            lines.append(f"CONST{k} = {quote}{x}{quote}")
            constants[f"CONST{k}"] = x
        elif style == 6 and constants:
            c = rng.choice(list(constants))
            lines.append(
                rng.choice(
                    ["{n} = {c}", "{n}: ${{{c}}}", '{n} = f"{{{c}}}"', '{n} = "${{{c}}}"', "{n} = `${{{c}}}`", "{n} = ({c})"]
                ).format(n=name, c=c),
            )
            want.setdefault(constants[c], "constant")
        elif style == 7 and constants:
            c = rng.choice(list(constants))
            lines.append(f"{name} = {c} + {quote}{x}{quote}")
            want.setdefault(constants[c], "constant")
            want[x] = "literal"
        elif style == 8 and constants:
            c = rng.choice(list(constants))
            lines.append(f"{c} = 12")  # assigned anew
            del constants[c]
        elif style == 9:
            lines.append(f"{name} = {rng.choice(['getenv', 'os.environ.get', 'vault'])}({quote}{x}{quote})")
        elif style == 10:
            y = literal()
            lines.append(f"{name} = (\n    {quote}{x}{quote}\n    {quote}{y}{quote}\n)")
            want |= {x: "literal", y: "literal"}
        elif style == 11:
            lines.append(f"{name}: |\n    {x}\n\n    {x}\nplain: 1")
            want[f"{x}\n\n    {x}"] = "literal"
        elif style == 12:
            lines.append(f"if {name} == {quote}{x}{quote}: pass")
        else:
            lines.append(f"limit{k} = {quote}{x}{quote}")
    return "\n".join(lines) + "\n", want


@pytest.mark.parametrize("seed", range(40))
def test_secret_lexing_of_made_programs(seed):
    text, want = program(random.Random(seed))
    found = {text[a:b]: k for a, b, k in secret_scan.lex(text)}
    assert found == want, text


def test_secret_lexing_stays_linear():
    for text in (
        "key: " * 50_000,
        "key: |\n" * 50_000,
        "key: |\n" + " a\n" * 100_000,
        "key = (\n" * 50_000,
        "/* " * 200_000,
        '"' * 200_000,
        "key = " + "\\\n" * 50_000,
        "Private_Key=Zx8:" * 10_000,
    ):
        secret_scan.scan(text)


def test_secret_lexing_of_very_long_runs_ends():
    dense = "a=b:" * 60_000
    assert secret_scan.scan(dense) == ([], [])
    many = 'token="abcdef1" x="y" ' * 20_000
    base, added = secret_scan.scan(many)
    assert len(base) == 20_000 and not added


@pytest.mark.parametrize("length", [1_024, 1_025, 1_600, 200_000])
def test_secret_bare_literals_of_any_length(length):
    value = "".join(random.Random(length).choices("ABCDEFGHIJabcdefghij0123456789+/", k=length))
    for head in ("PRIVATE_KEY=", "credentials: ", "bearer="):
        text = f"{head}{value} end"
        assert secret_scan.lex(text) == [(len(head), len(head) + length, "literal")]
        assert secret_scan.redact_text(text) == f"{head}[REDACTED] end"


def test_secret_constants_have_no_caps():
    many = "".join(f"n{k} = 1\n" for k in range(100_001)) + 'part = "Qz7Lm2Xw9TbV"\nprivate_key = part\n'
    assert [(many[a:b], k) for a, b, k in secret_scan.lex(many)] == [("Qz7Lm2Xw9TbV", "constant")]
    chain = "part = " + " + ".join(f'"Qz{k}"' for k in range(100)) + "\nprivate_key = part\n"
    assert [chain[a:b] for a, b, _ in sorted(secret_scan.lex(chain))] == [f"Qz{k}" for k in range(100)]
    doubled = 'part = "Qz7Lm2Xw9TbV"\n' + "part = part + part\n" * 2_000 + "private_key = part\n"
    assert [doubled[a:b] for a, b, _ in secret_scan.lex(doubled)] == ["Qz7Lm2Xw9TbV"]
    nested = "Private_Key=Zx8:" * 20_000
    assert len(secret_scan.lex(nested)) == 19_999  # the last one is too short


def test_secret_find_agrees_with_the_patterns(spark):
    rng = random.Random(3)
    parts = ["password=", "token: ", "AKIA", "0123456789abcdef", "ABCDEF0123", " ", "secret", "=", "x", '"', "api_key = '"]
    rows = [(i, "".join(rng.choices(parts, k=30))) for i in range(200)]
    want = {}
    for i, t in rows:
        spans = [
            (m.start(), 0, m.end()) for m in re.finditer(
                r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP]asswd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t
            ) if len(m[1]) >= 6
        ]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        want[i] = (*[sum(s[1] == k for s in spans) for k in range(3)], hashlib.sha256(text.encode()).hexdigest())
    got = {r[0]: tuple(r)[1:5] for r in secret_scan.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_search_is_exact(spark):
    rng = np.random.default_rng(5)
    codes = [(i, int(c)) for i, c in enumerate(rng.integers(-(2**63), 2**63 - 1, 400, dtype=np.int64))]
    codes += [(1000 + i, codes[0][1]) for i in range(60)] + [(2000 + i, codes[1][1] ^ (1 << i)) for i in range(40)] + [codes[5]]
    table = spark.createDataFrame(codes, "vec_id long, code long")
    queries = table.where("vec_id % 50 = 0")
    want = set()
    for q, c in {x for x in codes if x[0] % 50 == 0}:
        near = sorted(((c ^ o) & (2**64 - 1)).bit_count() * 10**6 + i for i, o in set(codes) if i != q)[:10]
        want |= {(q, r + 1, x % 10**6, x // 10**6) for r, x in enumerate(near)}
    assert {tuple(r) for r in hamming_search.top_k(table, queries).collect()} == want
    assert hamming_search.top_k(table.limit(0), queries).count() == 0
    few = hamming_search.top_k(table.where("vec_id < 3"), table.where("vec_id = 0"))
    assert few.count() == 2


def test_sign_codes(spark):
    rows = [(0, [1.0, -1.0, 0.0, 2.0]), (1, None), (None, [1.0]), (2, [])]
    got = hamming_search.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {tuple(r) for r in got} == {(0, 9), (2, 0)}
    with pytest.raises(Exception, match="more than 64"):
        hamming_search.sign_codes(spark.createDataFrame([(0, [1.0] * 65)], "vec_id long, embedding array<float>")).collect()


def test_mixing(docs, rows, empty):
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += len(raw(t).split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {s: 0.0 for s in order}, set(order), 1.5 * sum(sizes.values())
    while left > 1e-6 and open_:
        w = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / w for s in open_}
        left = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                open_.discard(s)
    source = {}
    for i, _, s, *_ in rows:
        source[i] = s
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == sizes[s]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 60
    again = mixing.mix(docs.repartition(3))
    same([tuple(r) for r in again.collect()], [tuple(r.values()) for r in got])
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mixed_takes_what_the_mix_decides_of_each_source(spark):
    """Rows of one id and size in different sources keep their own copies; helper names of the operator may be columns."""
    rows = [(None if i % 3 else i % 40, " ".join(f"w{i % 17}" for _ in range(1 + i % 6)), f"s{i % 4}", i, "x", i) for i in range(400)]
    rows += [(1, None, "s1", -1, "x", -1), (2, "", None, -2, "x", -2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, key string, `_id` int").repartition(4)
    out = [tuple(r) for r in mixing.mixed(table).collect()]
    times = Counter(r[5] for r in out)
    want, got = defaultdict(Counter), defaultdict(Counter)
    for r in mixing.mix(table).where("size > 0").collect():
        want[(r.doc_id, r.size, r.source_size)][r.copies] += 1
    words = defaultdict(int)
    for _, t, s, *_ in rows:
        words[s] += len((t or "").split())
    for i, t, s, _, _, n in rows:
        if t:
            got[(i, len(t.split()), words[s])][times[n]] += 1
    assert got == want and set(out) <= set(rows)


def test_targets_of_many_sources(spark):
    """Levels and ranks against the plain loop, with sources of many sizes, one of them empty."""
    sizes = {f"s{k:03}": (k * k * k) % 997 for k in range(300)}
    table = spark.createDataFrame([(f"{s}", n, 1) for s, n in sizes.items()], "key string, size long, n int").repartition(7)
    got = {r.key: r.target for r in mixing.targets(table).collect()}
    left, open_, target = 1.5 * sum(sizes.values()), set(sizes), dict.fromkeys(sizes, 0.0)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
    while left > 1e-9 and open_:
        total, spill = sum(weight[s] for s in open_), 0.0
        for s in sorted(open_):
            target[s] += left * weight[s] / total
            if target[s] >= 2 * sizes[s]:
                spill += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
        left = spill
    assert got == pytest.approx(target)
    everything = {r.key: r.target for r in mixing.targets(table, share=3).collect()}
    assert everything == {s: 2.0 * n for s, n in sizes.items()}


def test_pivotal_rounding_keeps_expectations(spark):
    rows = [(i, " ".join("w" * (1 + i % 5)), f"s{i % 3}") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    means = defaultdict(float)
    for seed in range(8):
        for r in mixing.mix(table, seed=seed * 1000).collect():
            means[r.doc_id % 3] += r.taken / 8
    target = {r.doc_id % 3: r.target for r in mixing.mix(table).collect()}
    for s, t in target.items():
        assert means[s] == pytest.approx(t, abs=3)


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t, *_ in rows:
        ids = hf.encode(t or "", add_special_tokens=False).ids + [0]
        for k, (a, n) in enumerate(packing.cut(len(ids))):
            want.append((i, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())))
    got = packing.pack(docs).collect()
    same([tuple(r)[:5] for r in got], want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 2048
    assert len(bins) == packing.lower_bound(np.array([w[3] for w in want]))
    many = packing.pack(docs, part=10)
    assert many.agg(F.count_distinct("sequence_id")).first()[0] <= len(bins) + 2
    assert packing.pack(empty).count() == 0
    whole = packing.pack(docs, ids=True).where("doc_id = 67").orderBy("piece").collect()
    assert [x for r in whole for x in r.ids] == hf.encode(rows[67][1] or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize(
    "text",
    [
        "",
        " ",
        "a<|endoftext|>b",
        "naïve ñandú — 漢字 🙂",
        "x" * 5000,
        "don't   stop\n\n\t12345",
        "\r\n\x00",
        " " * 1_000_000,
        "x" + "\n" * 1_000_000 + " y",
        "a" * 1_000_000,
    ],
)
def test_tokens_are_those_of_the_tokenizers_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.token_ids(text, packing.vocabulary()).tolist() == hf.encode(text, add_special_tokens=False).ids + [0]


def test_cut_and_bounds():
    assert packing.cut(1) == [(0, 1)] and packing.cut(2048) == [(0, 2048)]
    assert packing.cut(2049) == [(0, 1), (1, 2048)] and packing.cut(4096) == [(0, 2048), (2048, 2048)]
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = rng.integers(1, 2049, 40)
        bins, _, room = packing.best_fit(sizes)
        assert packing.lower_bound(sizes) <= len(room) and (np.bincount(bins, sizes) <= 2048).all()
    assert packing.lower_bound(np.array([1025] * 7)) == 7 and packing.lower_bound(np.array([700] * 6)) == 3


def test_quality(docs, rows, empty, spark):
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)] + [(None,), (0,), (99_999,)], "doc_id long")
    got = quality.verdicts(docs, trusted).collect()
    want = []
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        cover = {j + k for j in range(len(words) - 2) if grams[tuple(words[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), failed))
    same([tuple(r)[:7] for r in got], want)
    assert all(r.kept == (not r.base_failed and r.ratio >= quality.THRESHOLD) for r in got)
    assert quality.verdicts(empty, trusted).count() == 0
    plain = quality.verdicts(docs, trusted.limit(0)).collect()
    assert all(r.ratio == 0 and r.kept == (not r.base_failed) for r in plain)


def test_quality_ratio_is_the_mean_of_log_ratios(docs, rows, spark):
    ids = set(range(0, 60, 2))
    long_ = lambda x: x.to_bytes(8, "little")
    grams = []
    for i, t, *_ in rows:
        one = [xxhash.xxh64_intdigest(w, 42) for w in WORD.findall(raw(t))]
        two = [xxhash.xxh64_intdigest(long_(b), xxhash.xxh64_intdigest(long_(a), 42)) for a, b in zip(one, one[1:], strict=False)]
        grams.append((i, [h % quality.BUCKETS for h in one + two]))
    corpus = Counter(b for _, bs in grams for b in bs)
    target = Counter(b for i, bs in grams if i in ids for b in bs)
    share = target.total() / corpus.total()
    value = lambda b: np.log((target[b] + quality.PRIOR) / (corpus[b] * share + quality.PRIOR))
    want = sorted((key(i), float(np.mean([value(b) for b in bs])) if bs else 0.0) for i, bs in grams)
    got = sorted((key(r.doc_id), r.ratio) for r in quality.verdicts(docs, spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=2e-5)


def test_quality_ratio_tells_junk_from_prose(spark):
    rng = random.Random(1)
    prose, junk = [f"w{k}" for k in range(50)], [f"J{k}!" for k in range(50)]
    rows = [(i, " ".join(rng.choices(junk if i % 4 == 0 else prose, k=80))) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = table.where("doc_id % 4 = 1").select("doc_id")
    bad = [r for r in quality.verdicts(table, trusted).collect() if not r.base_failed and r.kept != (r.doc_id % 4 != 0)]
    assert not bad


def test_toxicity(spark, docs, rows, empty):
    rng = random.Random(4)
    prose, toxic = [f"word{k}" for k in range(300)], ["vilest", "scumbag", "awfulness", "nastyone"]
    made_docs, labels = [], []
    for i in range(1500):
        words = rng.choices(prose, k=rng.randint(20, 80))
        bad = i % 8 == 0
        if bad:
            for w in rng.sample(toxic, 3):
                words.insert(rng.randrange(len(words)), w)
        made_docs.append((i, " ".join(words), "s", "xx"))
        labels.append((i, 1, int(bad)))
    table = spark.createDataFrame(made_docs, "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(table, marks).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.doc_id % 8 == 0) and 0 <= r.score <= 1
    assert toxicity.clean(table, marks).count() == sum(i % 8 != 0 for i in range(1500))
    odd = toxicity.score(docs, marks).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 for r in odd)
    none = toxicity.score(docs, marks.limit(0)).collect()
    assert len(none) == len(rows)
    assert toxicity.score(empty, marks).count() == 0


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.15
    good = np.stack([np.where(truth, rng.random(4000) < 0.6, rng.random(4000) < 0.01) for _ in range(4)], axis=1)
    bad = np.repeat((rng.random((4000, 1)) < 0.05), 5, axis=1)
    votes = np.where(np.concatenate((good, bad), axis=1), 1, -1).astype(np.int8)
    post = toxicity.label_model(votes, 0.15)
    # any vote is right for 0.928 of the rows, two votes, which the five copies have, for 0.932
    assert np.mean((post > 0.5) == truth) > 0.96


PAGES = [(i, f"http://h{i % 3}/p", "x" * (i * 37 % 900)) for i in range(2500)] + [
    (2600, None, None), (2601, "u", ""), (None, "u", "null id"), (7, "http://again", "second row")
]


def test_fixity(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    good = warc_fixity.index(warc_fixity.records(pages))
    assert warc_fixity.audit(good, good).count() == 0
    bad = warc_fixity.damaged(pages)
    a = {(r.file, r.offset): r.digest for r in good.collect()}
    b = {(r.file, r.offset): r.digest for r in bad.collect()}
    want = {(k[0], k[1], "missing" if k not in b else "extra" if k not in a else "changed") for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    got = warc_fixity.audit(good, bad)
    assert {(r.file, r.offset, r.status) for r in got.collect()} == want and len(want) > 30
    small = warc_fixity.audit(good, bad, span=256, fan=2)
    same([tuple(r) for r in small.collect()], [tuple(r) for r in got.collect()])
    assert warc_fixity.audit(good.limit(0), good.limit(0)).count() == 0
    assert warc_fixity.audit(good, good.limit(0)).where("status = 'missing'").count() == good.count()


def test_fixity_spreads_records_without_an_id(spark):
    pages = spark.createDataFrame([(None, f"u{k}", "x" * k) for k in range(300)], "page_id long, url string, html string")
    good = warc_fixity.index(warc_fixity.records(pages))
    assert good.select("file").distinct().count() > 200 and good.agg(F.max("file")).first()[0] < 0
    assert warc_fixity.audit(good, warc_fixity.damaged(pages)).count() == 0


def test_fixity_offsets_are_those_of_a_file(spark):
    pages = spark.createDataFrame(PAGES[:50], "page_id long, url string, html string")
    rows = warc_fixity.records(pages).orderBy("page_id").collect()
    blob = "".join(r.record for r in rows).encode()
    for r in warc_fixity.index(warc_fixity.records(pages)).collect():
        assert hashlib.sha256(blob[r.offset : r.offset + r.length]).hexdigest() == r.digest
