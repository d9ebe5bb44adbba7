"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id while rows travel; returned as null.
NULL_ID = -(2**63)
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (never null), text (never null) and the columns named, in that order; other columns go."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *more,
    )


def real_id(name: str = "doc_id"):
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(name)


#: Seeds of xxhash64(text) and of xxhash64(1, text), which hashes the text by the hash of 1.
TEXT_SEEDS = (42, xxhash.xxh64_intdigest(b"\1\0\0\0", 42))


def text_hash(which: int = 0, text: str = "text") -> Column:
    """One of two independent 64-bit hashes of text (null is empty), as text_hashes() has them."""
    column = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(F.lit(1), column) if which else F.xxhash64(column)


def text_hashes(texts: list[bytes], which: int = 0) -> np.ndarray:
    seed = TEXT_SEEDS[which]
    return np.fromiter((xxhash.xxh64_intdigest(t, seed) for t in texts), np.uint64, len(texts)).view(np.int64)


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir, which executors share; a private one only in local mode where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint(eager=True)


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(doc_ids, texts as UTF-8) of about limit bytes of text; a longer document makes a chunk of its own."""
    ids: list[int] = []
    texts: list[bytes] = []
    total = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if total and total + len(t) > limit:
                yield np.array(ids, np.int64), texts
                ids, texts, total = [], [], 0
            ids.append(i)
            texts.append(t)
            total += len(t) + 64
    if ids:
        yield np.array(ids, np.int64), texts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Powers:
    """base ** i and its inverse modulo 2 ** 64, for as many i as asked so far."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


def prefix(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums from which span() gets the polynomial hash of any span."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, powers: Powers) -> np.ndarray:
    return (sums[stop] - sums[start]) * powers(len(sums))[1][start]


def spans(sums: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """The hash of every span of this width, by its start."""
    n = len(sums) - width
    return (sums[width:] - sums[:n]) * powers(len(sums))[1][:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchor_runs(grams: np.ndarray, width: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing. Windows of `width` grams with the same rightmost least gram form a run: (starts, lengths, least gram).

    valid[t]: window t lies in one document. What run a window falls in and its least gram follow from its
    content alone, so equal windows have equal least grams; two windows of one run are never equal.
    """
    least = sliding_min(grams, width)[: len(valid)]
    new = np.empty(len(valid), bool)
    new[:1] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new |= grams[width - 1 : width - 1 + len(valid)] == least
    new[1:] |= valid[1:] != valid[:-1]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(valid)))
    keep = valid[starts]
    return starts[keep], lengths[keep], least[starts[keep]]


def anchor_places(grams: np.ndarray, width: int, starts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Where the anchor of each run lies: the last gram of its first window that is the least."""
    at = np.full(len(starts), -1)
    left = np.arange(len(starts))
    for j in range(width - 1, -1, -1):
        hit = grams[starts[left] + j] == least[left]
        at[left[hit]] = starts[left[hit]] + j
        left = left[~hit]
        if not len(left):
            break
    return at


def refine(classes: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Splits classes by key; what is alone in its class then leaves with -1."""
    out = np.full(len(classes), -1)
    rows = np.flatnonzero(classes >= 0)
    if len(rows):
        by = rows[np.lexsort((key[rows], classes[rows]))]
        new = np.concatenate(([True], (classes[by[1:]] != classes[by[:-1]]) | (key[by[1:]] != key[by[:-1]])))
        sizes = np.diff(np.append(np.flatnonzero(new), len(by)))
        keep = np.repeat(sizes > 1, sizes)
        out[by[keep]] = (np.cumsum(new) - 1)[keep]
    return out


def changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


#: A seed at a place of a document, or, where open is 0, a settled run of n windows from there on, with any anchor.
SEEDS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("at", pa.int32()), ("open", pa.int32()), ("n", pa.int32())])
SIEVED = pa.schema(list(SEEDS)[1:])


def shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From SEEDS sorted by anchor, doc_id, hash and at: settled ones (open 0), and one for each place whose anchor has another place.

    Rows of one place join their bits of open. One row is held between batches, however many share an anchor.
    """
    held, known = [np.zeros(0, np.int64)] * 5, False
    for batch in chain(batches, (None,)):
        more = held
        if batch is not None:
            anchor, doc, text, at, open_, n = (batch.column(i).to_numpy() for i in range(6))
            done = open_ == 0
            yield pa.RecordBatch.from_arrays([pa.array(x[done]) for x in (doc, text, at, open_, n)], schema=SIEVED)
            more = [np.concatenate((a, b[~done])) for a, b in zip(held, (anchor, doc, text, at, open_), strict=True)]
        anchor, doc, text, at, open_ = more
        if not len(anchor):
            continue
        starts = np.flatnonzero(changes(anchor, doc, text, at))
        open_ = np.bitwise_or.reduceat(open_, starts)
        anchor, doc, text, at = (x[starts] for x in (anchor, doc, text, at))
        group = np.cumsum(changes(anchor)) - 1
        several = np.bincount(group)[group] > 1
        if known:  # the held row's anchor has a place further up
            several |= group == 0
        if batch is not None:
            held, known, several = [x[-1:] for x in (anchor, doc, text, at, open_)], bool(several[-1]), several[:-1]
        out = np.flatnonzero(several)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc[out]),
                pa.array(text[out]),
                pa.array(at[out].astype(np.int32)),
                pa.array(open_[out].astype(np.int32)),
                pa.array(np.zeros(len(out), np.int32)),
            ],
            schema=SIEVED,
        )


def sorted_groups(batches: Iterator[pa.RecordBatch], key: int = 0, least: int = 100_000) -> Iterator[pa.Table]:
    """Tables of at least `least` rows that never cut a group of equal keys, from batches sorted by that column."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut == 0 and held[0].column(key)[0].as_py() == keys[-1]:
            least = rows + 100_000  # one group so far
            continue
        if cut == 0:
            table = pa.Table.from_batches(held)
            cut = int(np.searchsorted(table.column(key).to_numpy(), keys[-1]))
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
        else:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
        rows = sum(b.num_rows for b in held)
        least = rows + 100_000
    if held:
        yield pa.Table.from_batches(held)
