"""SimHash near-dedup on a Gray-order hierarchical index.

Fingerprints are 64 bits over hashed 3-word shingles. The index holds each different fingerprint in twenty orders: its bits
are cut into six blocks, an order moves three of them to the front, and fingerprints are sorted by the Gray rank of the
outcome. Two that differ in three bits at most agree on the leading blocks in one of the orders, so they meet under
one upper node, a shared masked bit pattern of about 32 bits; upper nodes are dealt over partitions. Below it the
members, in Gray order, form a tree: a node keeps a mask of the bits that all its members share and their pattern.
Pairs of nodes whose patterns already differ in more than three shared bits are pruned with all below; pairs that can't
differ in more are linked as a whole; only the rest is opened. A node gives a spanning forest, never all pairs.
Components of the forest come from alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, checkpoint, keyed, real_id, sorted_groups, text_chunks, text_hash, text_hashes

SHINGLE, DISTANCE, SEED = 3, 3, 42
BLOCKS = (11, 11, 11, 11, 10, 10)
FAN = 32
#: Bits that a shared upper node has at least: three blocks.
PREFIX = 31
CHUNK = 1 << 20
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])
FINGERPRINT_ROWS = pa.schema([("doc_id", pa.int64()), ("_h1", pa.int64()), ("_h2", pa.int64()), ("print", pa.int64())])
RANKED = pa.schema([("node", pa.int64()), ("rank", pa.int64())])
LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    digest, seed = xxhash.xxh64_intdigest, SEED
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    return [digest(line[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def fingerprints_of(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    hashes = [shingle_hashes(t, width) for t in texts]
    counts = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        flat = np.array([x for h in hashes for x in h], "<u8")
        starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_chunks(batches, CHUNK):
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fingerprints_of(texts).view(np.int64))], schema=FINGERPRINTS)


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same with two hashes of the text, which together with doc_id tell rows apart."""
    for ids, texts in text_chunks(batches, CHUNK):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids),
                pa.array(text_hashes(texts, 0)),
                pa.array(text_hashes(texts, 1)),
                pa.array(fingerprints_of(texts).view(np.int64)),
            ],
            schema=FINGERPRINT_ROWS,
        )


def _moves() -> list[list[tuple[int, int, int]]]:
    """For each order, (shift in the print, width, shift in the permuted print) of the blocks."""
    shifts = [64 - sum(BLOCKS[: k + 1]) for k in range(len(BLOCKS))]
    out = []
    for lead in combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE):
        at, moves = 64, []
        for k in [*lead, *(k for k in range(len(BLOCKS)) if k not in lead)]:
            at -= BLOCKS[k]
            moves.append((shifts[k], BLOCKS[k], at))
        out.append(moves)
    return out


ORDERS = _moves()


def _moved(x: np.ndarray, moves: list[tuple[int, int, int]], back: bool = False) -> np.ndarray:
    out = np.zeros_like(x)
    for a, width, b in moves:
        a, b = (b, a) if back else (a, b)
        out |= ((x >> np.uint64(a)) & np.uint64((1 << width) - 1)) << np.uint64(b)
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a code word in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column(0).to_numpy().view(np.uint64)
        for k, moves in enumerate(ORDERS):
            rank = gray_rank(_moved(x, moves))
            width = sum(w for _, w, _ in moves[: len(BLOCKS) - DISTANCE])
            node = np.uint64(k) << np.uint64(40) | rank >> np.uint64(64 - width)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(rank.view(np.int64))], schema=RANKED)


def _count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class _Forest:
    """Labels of items that are linked bit by bit."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            to = np.arange(len(self.label))
            np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(to, to[to]):
                to = to[to]
            self.label = to[self.label]


def linked(prints: np.ndarray, most: int = DISTANCE) -> np.ndarray:
    """Component labels (the first member's position) of prints in Gray order, linked at `most` differing bits."""
    n = len(prints)
    forest = _Forest(n)
    # levels[0]: the prints themselves; each level above joins FAN neighbours
    levels = [(prints, np.full(n, 2**64 - 1, np.uint64), np.arange(n))]
    while len(levels[-1][0]) > 1:
        pattern, mask, first = levels[-1]
        at = np.arange(0, len(pattern), FAN)
        shared = np.bitwise_and.reduceat(mask, at) & ~(np.bitwise_or.reduceat(pattern, at) ^ np.bitwise_and.reduceat(pattern | ~mask, at))
        levels.append((pattern[at] & shared, shared, first[at]))
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        k, a, b = todo.pop()
        pattern, mask, first = levels[k]
        least, top = np.minimum.reduceat(forest.label, first), np.maximum.reduceat(forest.label, first)
        one = least == top
        shared = mask[a] & mask[b]
        sure = _count((pattern[a] ^ pattern[b]) & shared)
        open_ = (sure <= most) & ~(one[a] & one[b] & (least[a] == least[b]))
        a, b, sure, free = a[open_], b[open_], sure[open_], 64 - _count(shared[open_])
        whole = sure + free <= most
        if whole.any():
            # every pair is close: a node's members hang on its first
            stop = np.append(first[1:], n)
            for node in np.unique(np.concatenate((a[whole], b[whole]))):
                members = np.arange(first[node], stop[node])
                if free[whole].any() and len(members) > 1 and np.bitwise_count(~mask[node]) <= most:
                    forest.link(members, np.full(len(members), first[node]))
            forest.link(first[a[whole]], first[b[whole]])
        a, b = a[~whole], b[~whole]
        if k == 0 or not len(a):
            continue
        size = len(levels[k - 1][0])
        for lo in range(0, len(a), 256):
            i = (a[lo : lo + 256, None, None] * FAN + np.arange(FAN)[None, :, None]) + np.zeros((1, 1, FAN), np.int64)
            j = (b[lo : lo + 256, None, None] * FAN + np.arange(FAN)[None, None, :]) + np.zeros((1, FAN, 1), np.int64)
            keep = (i <= j if k > 1 else i < j) & (i < size) & (j < size)
            todo.append((k - 1, i[keep], j[keep]))
    return forest.label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (node, rank), sorted: a spanning forest of the links under each upper node."""
    for table in sorted_groups(batches):
        node, rank = table.column(0).to_numpy(), table.column(1).to_numpy().view(np.uint64)
        same = node[1:] == node[:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        node, rank = node[keep], rank[keep]
        if not len(node):
            continue
        code = rank ^ (rank >> np.uint64(1))
        order = (node >> 40).astype(np.int64)
        prints = np.empty_like(code)
        for k in np.unique(order):
            prints[order == k] = _moved(code[order == k], ORDERS[k], back=True)
        starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        sizes = np.diff(np.append(starts, len(node)))
        two = starts[sizes == 2]
        two = two[_count(prints[two] ^ prints[two + 1]) <= DISTANCE]
        u, v = [prints[two]], [prints[two + 1]]
        for a, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            label = linked(prints[a : a + size])
            hung = np.flatnonzero(label != np.arange(size))
            u.append(prints[a + hung])
            v.append(prints[a + label[hung]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], schema=LINKS)


def fingerprints(docs: DataFrame) -> DataFrame:
    return keyed(docs).mapInArrow(_fingerprint, "doc_id long, print long")


def links(prints: DataFrame) -> DataFrame:
    """(u, v) of a forest that spans all links of different prints; prints: one column of them."""
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = prints.mapInArrow(_rank, "node long, rank long")
    return ranked.repartition(n, "node").sortWithinPartitions("node", "rank").mapInArrow(_links, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for each node of an edge that isn't its component's least: alternating large and small stars, until nothing changes.

    Nodes only ever move to lesser ones, so this ends; rounds grow with the logarithm of a component, squared at most.
    """
    edges = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("u", F.col("v").alias("root"))
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a node and its lesser neighbours hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "hub")
        near = large.join(low, large.u == low.hub)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("hub").alias("u"), F.col("m").alias("v")))
        edges = checkpoint(small.where("u != v").distinct())


def _rooted(prints: DataFrame, row: Column) -> DataFrame:
    """print, least, root for each different print: its least row, and what names its component."""
    different = prints.groupBy("print").agg(F.min(row).alias("least"))
    roots = components(links(different.select("print")))
    return different.join(roots, different.print == roots.u, "left").select("print", "least", F.coalesce("root", "print").alias("root"))


def groups(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint, component_id.

    Null and empty texts have the fingerprint zero and are linked like any other. Repeated rows are linked to each
    other, as they are alike. A null doc_id is less than all others; its components' id is null. An empty table gives no rows.
    """
    prints = checkpoint(fingerprints(docs))
    rooted = _rooted(prints, F.col("doc_id"))
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(by_root, "root").select("print", "component_id")
    return prints.join(named, "print").select(real_id(), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), real_id("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, the least by doc_id (null first) and then by hashes of the text; the columns stay.

    Rows are told apart by doc_id and 128 bits of text, so rows that share an id, or have none, count each by its own text; of rows
    alike in both any one stays. Columns may have any names. An empty table gives no rows.
    """
    prints = checkpoint(keyed(docs).mapInArrow(_fingerprint_rows, "doc_id long, _h1 long, _h2 long, print long"))
    kept = _rooted(prints, F.struct("doc_id", "_h1", "_h2")).groupBy("root").agg(F.min("least").alias("least"))
    kept = kept.select(F.col("least.doc_id").alias("id"), "least._h1", "least._h2")
    keys = ["id", "_h1", "_h2"]
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    rows = docs.select(F.struct("*").alias("doc"), key.alias("id"), text_hash(0).alias("_h1"), text_hash(1).alias("_h2"))
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select("doc.*")
