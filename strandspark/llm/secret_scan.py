"""Secret scan: fixed patterns, and an assignment-aware lexer for source and configuration syntax.

The lexer goes over a text once, past comments and strings, and reads every `name = literal`, `name: literal`, `name: type = literal`,
`name ||= literal`, `name = test ? literal : literal`, `#define NAME literal`, `key="name" value="literal"`,
`"name" => "a" + B`, `name: |` with a deeper block and the like into name-literal pairs, in text order; literals may be in triple quotes,
in parentheses over several lines, or templates with ${NAME} in them. A name assigned a literal becomes a constant
until it is assigned anew; constants used later, alone, in `+` chains or in templates, stand for their value. Calls and
items (`getenv("X")`) are no literals. A literal that reaches a sensitive name (by assignment or through constants) is scored: weight of
the name times strength of the value. Those at THRESHOLD or above are reported: kind `literal` where assigned,
`constant` where a constant was defined whose value went there.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, real_id

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal", "constant")
RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
    ],
)

#: How telling a part of a target name is.
NAME_WEIGHTS = {
    "password": 1.0,
    "passwd": 1.0,
    "pwd": 1.0,
    "passphrase": 1.0,
    "secret": 1.0,
    "token": 0.9,
    "apikey": 1.0,
    "credential": 0.9,
    "credentials": 0.9,
    "private": 0.7,
    "bearer": 0.9,
    "auth": 0.7,
    "key": 0.6,
    "salt": 0.6,
    "signature": 0.6,
    "dsn": 0.6,
}
THRESHOLD = 0.45
PLACEHOLDER = re.compile(r"(?i)^(?:true|false|null|none|nil|undefined|changeme|example|placeholder|redacted|x+|\*+|\.+|your[-_].*|\$\{.*\}|<.*>|%\(.*\)s?)$")
#: Where a name may stand before an operator, in quotes or not.
OPERATOR = r"(?:\])?+[ \t]*+(?P<{}>:=|=>|\|\|=|\?\?=|\?=|[=:](?![=~:]))"
STRING = r"""(?:\"{3}[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"{3}|'{3}[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+'{3}|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')"""
#: A macro with a value, a comment up to the line's end, the start of a longer one, a string, or a name with its operator: what a scan stops at.
TOKEN = re.compile(
    rf"""(?a)(?<!\S)\#[ \t]*+define[ \t]++(?P<define>\w++)[ \t]++(?=["'\w(])|(?P<line>(?<!\S)(?:#|//|--[ \t])[^\n]*+)|(?P<block>/\*|<!--)|(?<![\w"'`\\])(?P<string>[rRbBuUfF]{{0,2}}+{STRING})|(?<![\w.-])(?P<name>[A-Za-z_][\w.-]*+){OPERATOR.format("op")}"""
)
KEYED = re.compile(rf"(?a){OPERATOR.format('op')}")
CLOSES = {"/*": "*/", "<!--": "-->"}
BARE = r"""[^\s"',;(){}<>\[\]#`]"""
RUN = re.compile(rf"{BARE}++")
#: A term of a value: a string with its prefix (also `a template`), a reference in shell style, or where a run without quotes starts.
TERM = re.compile(rf"""(?a)(?P<prefix>[rRbBuUfF]{{0,2}}+)(?P<string>{STRING}|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`)|\$\{{(?P<ref>\w++)\}}|(?={BARE})""")
SPACE = re.compile(r"(?:[ \t]|\\\r?\n)*+")
SPACES = re.compile(r"\s*+")
OPEN = re.compile(r"[ \t]*+\(")
#: A block of a configuration file: its lines are deeper than the name's.
SCALAR = re.compile(r"[ \t]*+[|>][0-9+-]{0,2}+[ \t]*+\r?\n")
INDENTED = re.compile(r"(?:[ \t]*+\r?\n)*+([ \t]++)(?=\S)")
HOLE = re.compile(r"(?a)\$\{(\w++)\}")
BRACES = re.compile(r"(?a)\$?\{(\w++)[^{}\n]*+\}")
#: A longer run without quotes is no name of a constant.
REACH = 128
#: Characters of either end by which a long placeholder is told.
ENDS = 64
#: A declared type between a colon and its `=`, which stands alone or before a string.
ATOM = r"[&*]*+(?:'\w++[ \t]++)?+(?:mut[ \t]++)?+[A-Za-z_][\w.]*+(?:\[[^\]\n]{0,128}+\]|<[^>\n]{0,128}+>)*+\??+"
TYPED = re.compile(rf"""(?a)[ \t]*+{ATOM}(?:[ \t]*+\|[ \t]*+{ATOM}){{0,8}}+(?:[ \t]++=|=(?=[ \t]*+["'`]))(?![=~>])(?=[ \t]*+\S)""")
#: What is asked before either arm of a choice, what stands between the arms, and the other order of the two.
ASKED = re.compile(r"""(?:[^\n"'`;?#]|"[^"\\\n]{0,64}+"|'[^'\\\n]{0,64}+'){1,96}+\?(?![?.=])[ \t]*+""")
OTHERWISE = re.compile(r"\s*+:(?![:=])[ \t]*+")
IF_ELSE = re.compile(r"""[ \t]++if[ \t][^\n#]{1,96}?[ \t]else[ \t]++""")
#: Attributes that name what the next one, `value`, holds.
NAMING = {"key", "name", "id"}
NAMED_VALUE = re.compile(r"""(?:\s++|\s*+,\s*+)["']?+[vV]alue["']?+\s*+[=:]\s*+""")
PLUS = re.compile(r"[ \t]*+\+(?!=)")
NAME_PARTS = re.compile(r"(?a)[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def name_weight(name: str) -> float:
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((NAME_WEIGHTS.get(p, 0.0) for p in [*parts, *joined]), default=0.0)


def strength(value: str) -> float:
    """0 to 1: long values of many different characters are strong; placeholders and short values are not. Of several words the strongest counts."""
    return max((_strength(len(w), Counter(w), w[:ENDS], w[-ENDS:]) for w in value.split()), default=0.0)


def _strength(n: int, counts: Counter, head: str, tail: str) -> float:
    """Of a value of n characters with these counts and ends; up to ENDS characters it is its head."""
    if n < 6:
        return 0.0
    if n > ENDS and (counts.keys() <= {"x", "X"} or counts.keys() == {"*"} or counts.keys() == {"."}):
        return 0.0
    if PLACEHOLDER.match(head if n <= ENDS else f"{head}-{tail}"):
        return 0.0
    entropy = -sum(p * math.log2(p) for c in counts.values() if (p := c / n))
    classes = len({0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in counts})
    return min(1.0, entropy / 4) * (0.55 + 0.15 * classes)


class _Chain:
    """Two literals or more in a row, each a span of the text or an earlier chain."""

    __slots__ = ("parts", "summary", "reported")

    def __init__(self, parts: list) -> None:
        self.parts, self.summary, self.reported = parts, None, False


class _Values:
    """What _strength() needs of spans and chains; each chain is summed up once, and spans with one end share a count."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tails: dict[int, list] = {}

    def _span(self, start: int, end: int) -> tuple[int, Counter, str, str]:
        text = self.text
        if end - start <= 1_024:
            counts = Counter(text[start:end])
        elif end not in self.tails:
            counts = Counter(text[start:end])
            self.tails[end] = [start, counts.copy()]
        else:
            tail = self.tails[end]
            at, held = tail
            for c, k in Counter(text[min(at, start) : max(at, start)]).items():
                held[c] += k if start < at else -k
                if not held[c]:
                    del held[c]
            tail[0] = start
            counts = held.copy()
        return end - start, counts, text[start : min(end, start + ENDS)], text[max(start, end - ENDS) : end]

    def summary(self, value: tuple[int, int] | _Chain) -> tuple[int, Counter, str, str]:
        if isinstance(value, tuple):
            return self._span(*value)
        todo = [value]
        while todo:
            chain = todo[-1]
            open_ = [] if chain.summary else [p for p in chain.parts if isinstance(p, _Chain) and not p.summary]
            if open_:
                todo += open_
                continue
            todo.pop()
            if chain.summary:
                continue
            n, counts, head, tail = 0, Counter(), "", ""
            for part in chain.parts:
                more, own, first, last = self._span(*part) if isinstance(part, tuple) else part.summary
                n += more
                for c, k in own.items():
                    counts[c] += k
                if len(head) < ENDS:
                    head = (head + first)[:ENDS]
                tail = (tail + last)[-ENDS:]
            chain.summary = n, counts, head, tail
        return value.summary

    def strength(self, value: tuple[int, int] | _Chain) -> float:
        """Of several words in one literal the strongest counts; of a chain that has spaces, its strongest literal."""
        n, counts, head, tail = self.summary(value)
        if not any(map(str.isspace, counts)):
            return _strength(n, counts, head, tail)
        if isinstance(value, tuple):
            return strength(self.text[value[0] : value[1]])
        return max(map(self.strength, (p for p in value.parts if isinstance(p, tuple))), default=0.0)


class _Lexer:
    """One pass over a text. Comments and what strings hold are never read as assignments."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.constants: dict[str, tuple[int, int] | _Chain | None] = {}
        self.run = (0, 0)
        self.unclosed: set[str] = set()
        self.choices = "?" in text

    def pairs(self) -> Iterator[tuple[str, tuple[int, int] | _Chain, int]]:
        """(name, value, where its operator is), in text order; the name is a constant of that value from there on."""
        text, at = self.text, 0
        while m := TOKEN.search(text, at):
            at = m.end()
            if m["line"] is not None:
                continue
            if m["block"]:
                if m["block"] not in self.unclosed:
                    close = text.find(CLOSES[m["block"]], at)
                    if close < 0:
                        self.unclosed.add(m["block"])  # there is none further on either
                    else:
                        at = close + len(CLOSES[m["block"]])
                continue
            name, start = m["name"] or m["define"], m.start()
            if name is None:
                key = KEYED.match(text, at)
                if not key:
                    continue
                name, m, at = m["string"].strip("rRbBuUfF\"'"), key, key.end()
            operator, place = ("=", at) if m.re is TOKEN and m["define"] else (m["op"], m.start("op"))
            asked = self.choices and operator != ":" and ASKED.match(text, at)
            found = []
            parts, end = self.value(asked.end() if asked else at, start, name, operator)
            at = max(at, end)
            while True:
                if parts:
                    found.append(parts[0] if len(parts) == 1 else _Chain(parts))
                    yield name, found[-1], place
                other = parts is not None and len(found) < 2 and self.other_arm(end, bool(asked))
                if not other:
                    break
                asked = None
                parts, end = self.value(other, start, name, "=")
                at = max(at, end)
            if parts is None:
                self.constants.pop(name, None)
            elif found:
                self.constants[name] = found[0] if len(found) == 1 else _Chain(found)
            if name.lower() in NAMING and len(found) == 1 and isinstance(found[0], tuple) and (named := NAMED_VALUE.match(text, at)):
                name = text[found[0][0] : found[0][1]]
                parts, end = self.value(named.end(), start, name, "=")
                at = max(at, end)
                if parts:
                    yield name, parts[0] if len(parts) == 1 else _Chain(parts), place

    def other_arm(self, end: int, asked: bool) -> int | None:
        """Where the second arm of a choice begins, if there is one after the first arm's end."""
        if asked:
            if RUN.match(self.text, end):
                end = self.run_end(end)
            m = OTHERWISE.match(self.text, end)
        else:
            m = IF_ELSE.match(self.text, end) if self.text.startswith((" ", "\t"), end) else None
        return m.end() if m else None

    def value(self, at: int, start: int, name: str, operator: str) -> tuple[list | None, int]:
        """(literals and constants that the value is made of, where to read on); None if it isn't made of such."""
        text = self.text
        if operator == ":" and (scalar := SCALAR.match(text, at)):
            return self.scalar(scalar.end(), start)
        if operator == ":" and (typed := TYPED.match(text, at)):
            at = typed.end()
        inside = OPEN.match(text, at)
        space = SPACES if inside else SPACE
        at = inside.end() if inside else at
        parts: list = []
        terms = 0
        while True:
            begin = space.match(text, at).end()
            if text.startswith(("#", "//"), begin) and (begin == 0 or text[begin - 1].isspace()):
                break
            term = TERM.match(text, begin)
            if not term:
                break
            terms += 1
            if term["string"]:
                at = term.end()
                parts += self.pieces(*term.span("string"), term["prefix"])
            elif term["ref"]:
                at = term.end()
                if self.constants.get(term["ref"]):
                    parts.append(self.constants[term["ref"]])
                if RUN.match(text, at):  # ${A}rest is no constant alone
                    at = self.run_end(at)
            else:
                at = self.run_end(begin)
                if text.startswith(("(", "["), at):
                    return None, begin  # a call or an item, whose arguments are read like anything else
                word = text[begin:at] if at - begin <= REACH else None
                if word in self.constants:
                    if self.constants[word]:
                        parts.append(self.constants[word])
                elif word is None or word.lower() != name.lower():
                    parts.append((begin, at))
                if terms == 1 and not PLUS.match(text, at):
                    return parts, begin  # a run may hold assignments itself, as addresses do
            plus = PLUS.match(text, at)
            if plus:
                at = plus.end()
            elif not inside or not term["string"]:
                break
        return parts, at

    def run_end(self, at: int) -> int:
        """The end of the run without quotes; found once for all places in it."""
        if not self.run[0] <= at < self.run[1]:
            self.run = (at, RUN.match(self.text, at).end())
        return self.run[1]

    def pieces(self, a: int, b: int, prefix: str) -> list:
        """What a string is made of: its text, or around ${NAME} (and {NAME} in templates) the pieces and the constants."""
        text = self.text
        quotes = 3 if b - a >= 6 and text[a : a + 3] in ('\"\"\"', "'''") else 1
        template = "f" in prefix.lower() or text[a] == "`"
        a, b = a + quotes, b - quotes
        out: list = []
        for hole in (BRACES if template else HOLE).finditer(text, a, b):
            if hole.start() > a:
                out.append((a, hole.start()))
            if self.constants.get(hole[1]):
                out.append(self.constants[hole[1]])
            a = hole.end()
        if b > a:
            out.append((a, b))
        return out

    def scalar(self, at: int, start: int) -> tuple[list, int]:
        """The lines of a block that is deeper than the line of its name."""
        text = self.text
        line = text.rfind("\n", max(0, start - REACH), start) + 1
        depth = len(text[line:start]) - len(text[line:start].lstrip(" \t-")) if line or start < REACH else 0
        begin = None
        end = at
        while (m := INDENTED.match(text, end)) and len(m[1]) > depth:
            begin = m.end() if begin is None else begin
            stop = text.find("\n", m.end())
            end = len(text) if stop < 0 else stop + 1
        return (
            [
                (begin, len(text[:end].rstrip()) if end - at < REACH else end - (len(text[at:end]) - len(text[at:end].rstrip())))
            ] if begin is not None else []
        ), end


def lex(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of literals that reach sensitive names."""
    found: dict[tuple[int, int], str] = {}
    values = _Values(text)
    for name, value, at in _Lexer(text).pairs():
        weight = name_weight(name)
        if weight and weight * values.strength(value) >= THRESHOLD:
            todo = [value]
            while todo:
                part = todo.pop()
                if isinstance(part, tuple):
                    if part[1] > part[0]:
                        found.setdefault(part, "literal" if part[0] >= at else "constant")
                elif not part.reported:
                    part.reported = True
                    todo += part.parts
    return [(a, b, kind) for (a, b), kind in found.items()]


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, added spans); a literal inside a base assignment isn't added."""
    base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    own = sorted(base)  # they don't overlap
    starts = [a for a, _, _ in own]
    base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    inside = lambda a, b: (k := bisect_right(starts, a)) > 0 and b <= own[k - 1][1]
    added = [x for x in lex(text) if not inside(x[0], x[1])] if "=" in text or ":" in text or "define" in text else []
    return base, added


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((a, KINDS.index(k), k, b) for a, b, k in found))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base, added = scan(text)
            kinds = Counter(k for _, _, k in base)
            out.append((i, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RESULT, strict=True)], schema=RESULT)


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: counts by kind, a digest of the base spans, all spans. Null is the empty text, which has no spans.

    Repeated rows give repeated results; equal starts are ordered by kind. Texts may be of any length; time is linear in it. An empty table
    gives no rows. Other columns are ignored.
    """
    return keyed(docs).mapInArrow(
        _rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    ).withColumn("doc_id", real_id())


def redact_text(text: str, mask: str = "[REDACTED]") -> str:
    out, at = [], 0
    for a, b, _ in sorted(sum(scan(text), [])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced in text, and n_chars, where there is one, as long as the new text; a null text stays null. Repeated rows are masked alike, texts may be of any length, an empty table gives no rows."""
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [None if t is None else redact_text(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if chars is not None:
                columns[chars] = pa.array(
                    [n if a == b else len(b) for n, a, b in zip(batch.column(chars).to_pylist(), old, new, strict=True)],
                    batch.schema.field(chars).type,
                )
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
