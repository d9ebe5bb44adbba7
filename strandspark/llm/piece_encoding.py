"""Offset-preserving encoding and decoding with SentencePiece models.

A text is normalised here, from the model's own compiled character map: at each place the longest source in the map is
replaced, user-defined symbols pass as they are, white space is trimmed, escaped and prefixed as the model says. Each
normalised character keeps the byte of the text that it comes from. The model's merges, without its normaliser, then cut the
normalised text, and every piece is projected back to a span of bytes of the original text; ids go back to text by the library's decode().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from .common import keyed, real_id, text_chunks

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Text encoded at a time, in bytes; a longer document is a chunk of its own.
CHUNK = 1 << 20
PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("ids", pa.list_(pa.int32())),
        ("begins", pa.list_(pa.int32())),
        ("ends", pa.list_(pa.int32())),
        ("decoded", pa.string()),
    ],
)


def vocabulary(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def character_map(compiled: bytes) -> dict[str, str]:
    """Source to target of a compiled map: the size of a double-array trie, the trie (32-bit units), targets that end with a zero byte."""
    if not compiled:
        return {}
    size = int.from_bytes(compiled[:4], "little")
    units = np.frombuffer(compiled, "<u4", size // 4, 4)
    targets = compiled[4 + size :]
    labels = (units & np.uint32(0x800000FF)).astype(np.int64)
    # where the children of a unit begin, before their own byte is added by exclusive or
    below = ((units >> np.uint32(10)).astype(np.int64)) << ((units & np.uint32(0x200)).astype(np.int64) >> 6)
    byte = np.arange(1, 256)
    found, todo = {}, [(int(below[0]), b"")]
    while todo:
        at, key = todo.pop()
        inside = byte[(at ^ byte) < len(units)]
        for c in inside[labels[at ^ inside] == inside].tolist():
            child, own = at ^ c, key + bytes([c])
            if units[child] >> np.uint32(8) & np.uint32(1):
                value = int(units[child ^ below[child]] & np.uint32(0x7FFFFFFF))
                found[own.decode()] = targets[value : targets.index(b"\0", value)].decode()
            todo.append((child ^ int(below[child]), own))
    return found


def byte_starts(text: str) -> np.ndarray:
    """The first byte of each character in UTF-8, and the length in bytes."""
    if text.isascii():
        return np.arange(len(text) + 1)
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


class Normalizer:
    """Text to normalised text with, for each of its characters and its end, the byte of the text where its source begins."""

    def __init__(self, spec, suffix: bool = False, symbols: tuple[str, ...] = ()) -> None:
        self.trim, self.prefix, self.suffix = spec.remove_extra_whitespaces, spec.add_dummy_prefix, suffix
        self.space = SPACE if spec.escape_whitespaces else " "
        self.map = character_map(spec.precompiled_charsmap)
        self.symbols = re.compile("|".join(map(re.escape, sorted(symbols, key=len, reverse=True)))) if symbols else None
        self.longest: dict[str, int] = {}
        for source in self.map:
            self.longest[source[0]] = max(self.longest.get(source[0], 0), len(source))
        several = [s for s in self.map if len(s) > 1]
        chars = lambda found: "[" + "".join(map(re.escape, sorted(set(found)))) + "]"
        # all places where a source may begin, and some more
        parts = [self.symbols.pattern] if symbols else []
        parts += [chars(s for s in self.map if len(s) == 1)] if len(several) < len(self.map) else []
        parts += [chars(s[0] for s in several) + f"(?={chars(s[1] for s in several)})"] if several else []
        self.candidates = re.compile("|".join(parts)) if parts else None

    def _longest(self, text: str, at: int) -> tuple[int, str] | None:
        """(length of the longest source here, its target)."""
        if self.symbols and (m := self.symbols.match(text, at)):
            return len(m[0]), m[0]
        for n in range(min(self.longest.get(text[at], 0), len(text) - at), 0, -1):
            if (target := self.map.get(text[at : at + n])) is not None:
                return n, target
        return None

    def _mapped(self, text: str, starts: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
        """Mapped text, sources, and which characters begin what one source became."""
        parts, sources, heads, done = [], [], [], 0

        def copy(end: int) -> None:
            parts.append(text[done:end])
            sources.append(starts[done:end])
            heads.append(np.ones(end - done, bool))

        for m in self.candidates.finditer(text):
            at = m.start()
            if at < done or not (hit := self._longest(text, at)):
                continue
            copy(at)
            n, target = hit
            parts.append(target)
            sources.append(np.full(len(target), starts[at]))
            heads.append(np.arange(len(target)) == 0)
            done = at + n
        copy(len(text))
        return "".join(parts), np.concatenate(sources), np.concatenate(heads)

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        starts = byte_starts(text)
        at, end, source = 0, int(starts[-1]), starts[:-1]
        while self.trim and at < len(text):
            n, unit = self._longest(text, at) or (1, text[at])
            if unit != " ":
                break
            at += n
        if at == len(text):
            return "", starts[-1:]
        first, heads = starts[at], np.ones(len(text), bool)
        if self.candidates:
            text, source, heads = self._mapped(text, starts)
        if self.trim:
            text, source, end = self._trimmed(text, source, heads, end)
            if not text:
                return "", np.array([end])
        text = text.replace(" ", self.space)
        if self.prefix and self.suffix:
            text, source = text + self.space, np.append(source, end)
        elif self.prefix:
            text, source = self.space + text, np.concatenate(([first], source))
        return text, np.append(source, end)

    def _trimmed(self, text: str, source: np.ndarray, heads: np.ndarray, end: int) -> tuple[str, np.ndarray, int]:
        """Without white space at either end, and with one space for several."""
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        blank = code == 32
        unit = np.flatnonzero(heads)
        nth = np.cumsum(heads) - 1
        # of what one source became, the blanks before its first other character go if a blank stands before it
        solid = np.cumsum(~blank)
        leading = blank & (solid == (solid - ~blank)[unit][nth])
        after_blank = np.concatenate(([True], blank[:-1]))[unit][nth]
        kept = np.flatnonzero(~(leading & after_blank))
        trailing = len(kept)
        stop = {32, ord(self.space)}
        while trailing and int(code[kept[trailing - 1]]) in stop:
            trailing -= 1
            end = int(source[kept[trailing]])
        kept = kept[:trailing]
        return code[kept].tobytes().decode("utf-32-le"), source[kept], end


class Codec:
    """Encodes with offsets and decodes, by the model of a file."""

    def __init__(self, path: str | None = None, proto: bytes | None = None) -> None:
        model = pb.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model.ParseFromString(proto)
        symbols = tuple(p.piece for p in model.pieces if p.type == pb.ModelProto.SentencePiece.USER_DEFINED)
        self.normalizer = Normalizer(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix, symbols)
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=proto)
        model.normalizer_spec.CopyFrom(pb.NormalizerSpec(name="identity", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False))
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        kinds = [p.type for p in model.pieces]
        self.bytes = np.array([int(p.piece[3:5], 16) if p.type == pb.ModelProto.SentencePiece.BYTE else -1 for p in model.pieces])
        self.chars = np.array([len(p.piece) for p in model.pieces])
        # an unknown piece stands for any number of characters: such models are asked for each piece's text
        self.exact = pb.ModelProto.SentencePiece.BYTE in kinds

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids with the closing id, first bytes, ends) of each text; the closing id has an empty span at the end. Of a character cut into byte pieces the last piece holds the span."""
        normal = [self.normalizer(t) for t in texts]
        ids = self.merges.encode([t for t, _ in normal], out_type=int, num_threads=1)
        return [self._spans(np.array(i, np.int32), t, source) for i, (t, source) in zip(ids, normal, strict=True)]

    def _spans(self, ids: np.ndarray, text: str, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.exact:
            value = self.bytes[ids]
            # of the byte pieces of one character all but the last have no width: a continuation byte follows them
            following = np.append(value, -1)[1:]
            inner = (value >= 0) & (following >= 0x80) & (following < 0xC0)
            width = np.where(inner, 0, np.where(value >= 0, 1, self.chars[ids]))
        else:
            width = np.array([len(p) for p in self.merges.encode(text, out_type=str)], np.int64)
        at = np.concatenate(([0], np.cumsum(width)))
        if at[-1] != len(source) - 1:
            raise ValueError("the pieces don't cover the normalised text")
        closing = [source[-1]]
        return np.append(
            ids, np.int32(self.decoder.eos_id())
        ), np.concatenate((source[at[:-1]], closing)).astype(np.int32), np.concatenate((source[at[1:]], closing)).astype(np.int32)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.decoder.decode([i.tolist() for i in ids], num_threads=1) if ids else []


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays), pa.int32()))


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, ids, begins, ends, decoded: each document's token ids, closing id last, each one's span of bytes of the text, and the text that the ids give back.

    One row a row of docs: repeated rows and equal texts are encoded each for itself, a null text is the empty one (only the
    closing id), a null doc_id stays null. Other columns go. An empty table gives no rows. Texts may be of any length; a task holds about CHUNK bytes
    of them, or one longer text. path: the model's file, at that place on all executors.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for doc, texts in text_chunks(batches, CHUNK):
            found = own.encode([t.decode() for t in texts])
            ids, begins, ends = (list(x) for x in zip(*found, strict=True))
            columns = [pa.array(doc), pa.array([len(t) for t in texts]), _lists(ids), _lists(begins), _lists(ends), pa.array(own.decode(ids), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=PIECES)

    rows = keyed(docs).mapInArrow(run, "doc_id long, n_bytes long, ids array<int>, begins array<int>, ends array<int>, decoded string")
    return rows.withColumn("doc_id", real_id())


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and of the spans n_bytes (that pieces cover) and spans_sha256 (begin:end, comma-joined)."""
    rows = encoded(docs, path)
    text = lambda c: F.col(c).cast("array<string>")
    covered = F.aggregate(F.zip_with("begins", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    spans = F.zip_with(text("begins"), text("ends"), lambda a, b: F.concat(a, F.lit(":"), b))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(text("ids"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        covered.alias("n_bytes"),
        F.sha2(F.array_join(spans, ","), 256).alias("spans_sha256"),
    )
