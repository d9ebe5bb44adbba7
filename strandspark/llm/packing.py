"""Best-fit packing with certified bin counts.

Documents become token ids plus a closing 0; longer ones than a sequence are cut from the end, so that only a
first piece is short. Pieces are dealt over partitions of about PART rows. A partition packs by best-fit decreasing and
certifies its number of bins by lower bounds from dual feasible functions. Partitions with a gap between the two give up
their bins with room, certified ones only their loosest; those bins are exchanged, whole, into new partitions,
which rerun best-fit decreasing on the pieces and keep the old bins unless the new ones are fewer. This goes on for ROUNDS
rounds or until nothing improves.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import checkpoint, keyed, real_id

CAPACITY = 2048
PART = 20_000
ROUNDS = 3
END = 0
SPECIAL = "<|endoftext|>"
#: A bin with less room than this isn't worth exchanging.
ROOM = 8
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(path: str):
    """The byte-level BPE of that file of ranks, the same vocabulary as byte_bpe_50k.json; about three times as fast as the tokenizers library, with the same ids."""
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


@cache
def slower_encoder(path: str) -> Tokenizer:
    """The same vocabulary by its .json beside that file: no text is too monotonous for it."""
    return Tokenizer.from_file(os.path.splitext(path)[0] + ".json")


def _encoded(text: str, path: str) -> np.ndarray | list[int]:
    try:
        return encoder(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:  # runs of white space beyond what its pattern's backtracking bears
        return slower_encoder(path).encode(text, add_special_tokens=False).ids


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of any text, however long or monotonous, and the closing id."""
    return np.append(_encoded(text, path) if text else np.zeros(0, np.uint32), END).astype("<u4")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    if n <= capacity:
        return [(0, n)]
    starts = list(range(n % capacity or capacity, n, capacity))
    return [(a, b - a) for a, b in zip([0, *starts], [*starts, n], strict=True)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and with ids its token ids."""
    path = path or vocabulary()
    schema = PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if ids else PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = token_ids(text, path)
                for k, (a, n) in enumerate(cut(len(own), capacity)):
                    part = own[a : a + n]
                    out.append((doc, k, a, n, zlib.crc32(part.tobytes()), part.astype(np.int32))[: len(schema)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return keyed(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer bins: the best of two families of dual feasible functions, summed over the pieces."""
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    # for each e: pieces over capacity - e fill a bin, those under e count nothing
    mass = np.concatenate((np.cumsum((count * size)[::-1])[::-1], [0]))
    number = np.concatenate((np.cumsum(count[::-1])[::-1], [0]))
    e = np.arange(capacity // 2 + 1)
    first = number[capacity - e + 1] * capacity + mass[e] - mass[capacity - e + 1]
    best = -(-int(first.max()) // capacity)
    for k in range(1, 25):
        # rounded to k-ths of a bin; exact multiples of a (k + 1)th keep their size
        x = (k + 1) * size
        value = np.where(x % capacity == 0, k * size, x // capacity * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: (bin, offset) of each piece, and each bin's room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                some ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i], room[b] = b, capacity - r, r - n
        if r > n:
            by_room[r - n].append(b)
            some |= 1 << (r - n)
    return bins, offsets, room


def _pack(capacity: int, number: int):
    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        part = int(table.column("part")[0].as_py())
        bins, offsets, room = best_fit(lengths, capacity)
        old = table.column("sequence_id")
        if number:
            names, old_bins = np.unique(old.to_numpy(), return_inverse=True)
            if len(names) <= len(room):
                bins, offsets = old_bins, table.column("offset").to_numpy()
                room = (capacity - np.bincount(bins, lengths)).astype(int).tolist()
                sequence = names[bins]
            else:
                sequence = number << 56 | part << 28 | bins
        else:
            sequence = part << 28 | bins
        spare = np.array(room)
        loose = spare >= ROOM if len(room) > lower_bound(lengths, capacity) else (np.arange(len(spare)) == spare.argmax()) & (spare > 0)
        for name, values in (("sequence_id", sequence), ("offset", offsets), ("loose", loose[bins])):
            table = table.set_column(table.column_names.index(name), name, pa.array(values))
        return table

    return run


def _packed(rows: DataFrame, parts: int, key, capacity: int, number: int) -> DataFrame:
    rows = rows.withColumn("part", F.pmod(key, F.lit(parts)))
    return checkpoint(rows.groupBy("part").applyInArrow(_pack(capacity, number), rows.schema))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, part: int = PART, rounds: int = ROUNDS, ids: bool = False) -> DataFrame:
    """One row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with ids its token ids.

    Null and empty texts are the closing id alone. Repeated rows are packed each; pieces of one length take any order, so which of them
    lies where may differ between runs, the lengths in a sequence don't. A null doc_id stays null. An empty table gives no rows; other columns are ignored.
    """
    found = checkpoint(pieces(docs, path, capacity, ids))
    rows = found.withColumns(
        {
            "row": F.monotonically_increasing_id(),
            "sequence_id": F.lit(0).cast("long"),
            "offset": F.lit(0).cast("long"),
            "loose": F.lit(True),
        },
    )
    done: list[DataFrame] = []
    left, bins = found.count(), None
    for number in range(rounds):
        if not left:
            break
        key = F.xxhash64(F.lit(number), "sequence_id" if number else "row")
        packed = _packed(rows, -(-left // part), key, capacity, number)
        done.append(packed.where("not loose"))
        rows = packed.where("loose")
        left, now = packed.agg(F.count_if("loose"), F.count_distinct("sequence_id")).first()
        if bins is not None and now >= bins:
            break
        bins = rows.agg(F.count_distinct("sequence_id")).first()[0]
    out = rows
    for d in done:
        out = out.unionByName(d)
    return out.select(real_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * ids)
