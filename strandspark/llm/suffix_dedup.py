"""Suffix-array dedup of byte strings: every 200-byte string that starts at two places goes, at both.

A suffix array of every byte would shuffle 200 bytes for each byte of text. It is kept sparse instead:

1. Sampling. Of each 200-byte window the rightmost least hash of its 16-byte grams is the anchor (winnowing); neighbouring
   windows with one anchor form a segment. Equal windows have equal anchors, so segments whose anchor lies at one place only
   hold no repeats and go no further. Copies are settled before the shuffle of bytes: of segments equal as a whole (anchor and another
   64 bits; within a chunk of text byte by byte) one goes on, marked as lying at many places.
2. Range partition. Different segments around one anchor fetch their bytes as sampled suffixes: one from the anchor on for windows
   with most of their bytes to the right of it, one from half a window to the left of it for the rest. repartitionByRange samples
   splitters and deals them by their leading bytes, all those that any of their windows must share, then by place, so
   that suffixes with equal leading bytes may lie in several neighbouring buckets, and no passage is one task.
3. Buckets. Of suffixes with equal leading bytes the different ones give all their windows' suffixes to a multikey
   quicksort: three-way partitions by the next eight bytes around a pivot, the equal part going eight bytes deeper. Suffixes
   still together after 200 bytes are repeats.
4. Across boundaries. What has a bucket's first or last leading bytes is compared with that of the neighbouring buckets:
   each sends its different segments, with a mark on those it has several of, and they are sorted once more.
5. Documents meet their repeats by doc_id and a hash of the text and lose the covered bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, anchor_places, anchor_runs, changes, checkpoint, keyed, mix, prefix, real_id, runs_of, span, spans, text_chunks, text_hash, text_hashes

LENGTH, GRAM, CHUNK = 200, 16, 3 << 19
#: Suffixes that are sorted together, about; a group of equal leading bytes isn't cut.
SORTED = 1_000_000
SEEDS = pa.schema(
    [
        ("anchor", pa.int64()),
        ("print", pa.int64()),
        ("doc_id", pa.int64()),
        ("hash", pa.int64()),
        ("at", pa.int32()),
        ("open", pa.int32()),
        ("n", pa.int32()),
    ],
)
SIEVED = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("at", pa.int32()), ("open", pa.int32()), ("n", pa.int32())])
SUFFIXES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("hash", pa.int64()),
        ("start", pa.int32()),
        ("n", pa.int32()),
        ("lead", pa.int32()),
        ("many", pa.bool_()),
        ("segment", pa.binary()),
    ],
)
SUFFIXES_DDL = "doc_id long, hash long, start int, n int, lead int, many boolean, segment binary"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
#: Random odd numbers, one for each value of a byte.
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _segments(length: int, gram: int):
    """SEEDS: one for each different segment of a chunk, open being its number of windows << 16 | bytes before the anchor. Settled ones, found twice in the chunk, have open 0 and n windows from `at` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(0x9E3779B97F4A7C15)
        for ids, texts in text_chunks(batches, CHUNK):
            hashed = text_hashes(texts)
            counts = np.array([len(t) for t in texts], np.int64)
            total = int(counts.sum())
            if total < length:
                continue
            flat = b"".join(texts)
            first = np.concatenate(([0], np.cumsum(counts)[:-1]))
            n = total - length + 1
            valid = np.zeros(n + 1, np.int8)
            real = counts >= length
            np.add.at(valid, first[real], 1)
            np.add.at(valid, (first + counts - length + 1)[real], -1)
            valid = np.cumsum(valid[:n], dtype=np.int8).view(bool)
            sums = prefix(BYTE_HASH[np.frombuffer(flat, np.uint8)], powers)
            grams = mix(spans(sums, gram, powers))
            runs, lengths, anchors = anchor_runs(grams, length - gram + 1, valid)
            if not len(runs):
                continue
            at = anchor_places(grams, length - gram + 1, runs, anchors)
            stops = runs + lengths + length - 1
            prints = mix(span(sums, runs, stops, powers) + lengths.astype(np.uint64))
            d = np.searchsorted(first + counts, runs, "right")
            doc, text, start = ids[d], hashed[d], (runs - first[d]).astype(np.int32)
            by = np.lexsort((start, text, doc, prints, anchors))
            same = ~changes(prints[by], anchors[by])
            a, b, size = runs[by].tolist(), stops[by].tolist(), len(by)
            for k in np.flatnonzero(same).tolist():
                same[k] = flat[a[k] : b[k]] == flat[a[k - 1] : b[k - 1]]
            group = np.cumsum(~same) - 1
            # repeated rows of a document are one: a segment at the same place of the same document is the same
            other = ~same | changes(doc[by], text[by], start[by])
            settled = by[np.bincount(group, other, size)[group] > 1]
            lead = by[~same]
            open_ = lengths[lead] << 16 | (at - runs)[lead]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(x) for x in (
                        anchors[lead].view(np.int64),
                        prints[lead].view(np.int64),
                        doc[lead],
                        text[lead],
                        start[lead],
                        open_.astype(np.int32),
                        np.zeros(len(lead), np.int32),
                    )
                ],
                schema=SEEDS,
            )
            # settled segments of one document next to each other become one row
            settled = np.sort(settled)
            if len(settled):
                a, b = runs[settled], (runs + lengths)[settled]
                new = np.concatenate(([True], a[1:] != b[:-1]))
                a, b = a[new], b[np.concatenate((new[1:], [True]))]
                d = np.searchsorted(first + counts, a, "right")
                spread = mix(ids[d].view(np.uint64) + a.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(x) for x in (
                            spread,
                            np.zeros(len(a), np.int64),
                            ids[d],
                            hashed[d],
                            (a - first[d]).astype(np.int32),
                            np.zeros(len(a), np.int32),
                            (b - a).astype(np.int32),
                        )
                    ],
                    schema=SEEDS,
                )

    return run


def _sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From SEEDS sorted by anchor, print, doc_id, hash and at: settled ones, segments that are equal as a whole at several places as settled
    too, and of each print one segment (open; n 1 if it lies at many places) if its anchor has other prints. Holds one row between batches, however many share an anchor."""
    held, known = [np.zeros(0, np.int64)] * 7, False  # the last column: many
    for batch in chain(batches, (None,)):
        now = held
        if batch is not None:
            anchor, print_, doc, text, at, open_, n = (batch.column(i).to_numpy() for i in range(7))
            done = open_ == 0
            yield pa.RecordBatch.from_arrays([pa.array(x[done]) for x in (doc, text, at, open_, n)], schema=SIEVED)
            new = (anchor, print_, doc, text, at, open_, np.zeros(len(done), np.int64))
            now = [np.concatenate((a, b[~done])) for a, b in zip(held, new, strict=True)]
        if not len(now[0]):
            continue
        starts = np.flatnonzero(changes(*now[:5]))  # repeated rows of a document are one place
        many0 = np.bitwise_or.reduceat(now[6], starts)
        anchor, print_, doc, text, at, open_ = (x[starts] for x in now[:6])
        first = changes(anchor, print_)
        run = np.cumsum(first) - 1
        many = (np.bincount(run) > 1) | (np.bincount(run, many0) > 0)
        whole = np.flatnonzero(many[run] & (many0 == 0))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(x[whole].astype(t)) for x, t in (
                    (doc, np.int64), (text, np.int64), (at, np.int32), (np.zeros_like(at), np.int32), (open_ >> 16, np.int32)
                )
            ],
            schema=SIEVED,
        )
        lead = np.flatnonzero(first)
        group = np.cumsum(changes(anchor[lead])) - 1
        several = np.bincount(group)[group] > 1
        if known:  # the held row's anchor has had another print
            several |= group == 0
        if batch is not None:
            last = lead[-1:]
            held, known, several = [x[last] for x in (anchor, print_, doc, text, at, open_)] + [many[-1:].astype(np.int64)], bool(several[-1]), several[:-1]
        out = lead[np.flatnonzero(several)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(x[out].astype(t)) for x, t in (
                    (doc, np.int64), (text, np.int64), (at, np.int32), (open_, np.int32), (many[run], np.int32)
                )
            ],
            schema=SIEVED,
        )


def _suffixes(length: int, gram: int):
    """The sampled suffixes of wanted segments: segment holds n windows from start on; the leading bytes are those from lead on."""
    half = (length - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, segments, hashed in zip(
                batch.column(0).to_pylist(),
                batch.column(1).cast(pa.binary()).to_pylist(),
                batch.column(2).to_pylist(),
                batch.column(3).to_pylist(),
                strict=True,
            ):
                for s in segments:
                    start, n, before, many = s["at"], s["open"] >> 16, s["open"] & 0xFFFF, s["n"] > 0
                    turn = min(n, max(0, before - half))  # windows before it have more than half of their other bytes left of the anchor
                    for a, b, lead in ((0, turn, before - half - 1), (turn, n, before)):
                        if a < b:
                            out.append((doc, hashed, start + a, b - a, lead - a, many, text[start + a : start + b + length - 1]))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SUFFIXES, strict=True)], schema=SUFFIXES)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SUFFIXES, strict=True)], schema=SUFFIXES)

    return run


def multikey_quicksort(at: np.ndarray, group: np.ndarray, words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the strings of `length` bytes at these offsets within their groups, which are in order: (order, whether each equals the one before it).

    words[i]: the eight bytes from offset i on as one key. All open partitions are split at once, each three ways around the
    key of its middle string; the equal part goes eight bytes deeper, a partition of one is done.
    """
    order, same = np.arange(len(at)), np.zeros(len(at), bool)
    place, part, depth = np.arange(len(at)), group, np.zeros(len(at), np.int64)
    while len(place):
        first = changes(part)
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(part)))
        if (sizes == 1).any():
            keep = np.repeat(sizes > 1, sizes)
            place, part, depth = place[keep], part[keep], depth[keep]
            sizes = sizes[sizes > 1]
            starts = np.cumsum(sizes) - sizes
            if not len(place):
                break
        string = order[place]
        key = words[at[string] + np.minimum(depth, length - 8)]  # the last key overlaps the one before it
        pivot = np.repeat(key[starts + sizes // 2], sizes)
        less, equal = key < pivot, key == pivot
        # a stable three-way partition of each: less, equal, greater
        seen_less, seen_equal = np.cumsum(less), np.cumsum(equal)
        base = np.repeat(starts, sizes)
        before_less, before_equal = (seen_less - less)[base], (seen_equal - equal)[base]
        ends = starts + sizes - 1
        n_less, n_equal = (np.repeat(x[ends], sizes) - b for x, b in ((seen_less, before_less), (seen_equal, before_equal)))
        rank_less, rank_equal = seen_less - less - before_less, seen_equal - equal - before_equal
        rank = np.arange(len(key)) - base
        to = base + np.where(less, rank_less, np.where(equal, n_less + rank_equal, n_less + n_equal + rank - rank_less - rank_equal))
        moved = np.empty_like(string)
        moved[to] = string
        order[place] = moved
        side = np.empty(len(key), np.int64)
        side[to] = np.where(less, 0, np.where(equal, 1, 2))
        part = np.cumsum(changes(np.repeat(np.arange(len(starts)), sizes), side))
        depth = depth + 8 * (side == 1)
        done = (side == 1) & (depth >= length)
        same[place[done & ~changes(part)]] = True
        place, part, depth = place[~done], part[~done], depth[~done]
    return order, same


def _repeated(segments: list[bytes], n: np.ndarray, group: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """Of different segments, groups being those with equal leading bytes: whether each of their windows, one segment after the other, is a repeat."""
    out = np.zeros(int(n.sum()), bool)
    first_window = np.cumsum(n) - n
    alone = np.bincount(group)[group] == 1
    out[np.repeat(many, n)] = True
    rows = np.flatnonzero(~alone)
    edges = np.append(np.flatnonzero(changes(group[rows])), len(rows))
    total = np.concatenate(([0], np.cumsum(n[rows])))
    lo = 0
    while lo < len(edges) - 1:  # as many groups at a time as have about SORTED suffixes
        hi = max(lo + 1, int(np.searchsorted(total[edges], total[edges[lo]] + SORTED, "right")) - 1)
        part = rows[edges[lo] : edges[hi]]
        lo = hi
        flat = np.frombuffer(b"".join([segments[i] for i in part.tolist()]) + b"\0" * 8, np.uint8).astype(np.uint64)
        words = flat[:-8].copy()
        for j in range(1, 8):
            words <<= np.uint64(8)
            words |= flat[j : len(flat) - 8 + j]
        size = n[part]
        row = np.repeat(np.arange(len(part)), size)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        at = (np.cumsum(size + length - 1) - size - length + 1)[row] + inner
        order, same = multikey_quicksort(at, group[part][row], words, length)
        # a class of equal suffixes is repeated if it has two, or one of a segment that lies at several places
        kind = np.cumsum(~same) - 1
        hit = np.bincount(kind, 1 + many[part][row][order])[kind] > 1
        out[(first_window[part][row] + inner)[order[hit]]] = True
    return out


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Table, list[bytes], np.ndarray, bool]]:
    """(rows, their leading bytes, group numbers, whether these are the last): some 50,000 rows sorted by leading bytes and place, no group cut."""
    held, rows, least, batches = [], 0, 50_000, iter(batches)
    while True:
        batch = next(batches, None)
        if batch is not None:
            held.append(batch)
            rows += batch.num_rows
            if rows < least:
                continue
        if not rows:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [s[a : a + width] for s, a in zip(table.column("segment").to_pylist(), table.column("lead").to_pylist(), strict=True)]
        group = np.cumsum([True, *(a != b for a, b in zip(keys[1:], keys, strict=False))]) - 1
        cut = rows if batch is None else int(np.searchsorted(group, group[-1]))
        if cut:
            yield table.slice(0, cut), keys[:cut], group[:cut], batch is None
        held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        least = 2 * rows + 50_000
        if batch is None:
            return


def _without_found(batches: Iterator[pa.RecordBatch], passed: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches without their rows that have no segment, which go to `passed`."""
    for batch in batches:
        found = batch.column(6).is_null()
        passed.append(batch.filter(found))
        yield batch.filter(pc.invert(found))


def _bucket(length: int, gram: int, borders: bool):
    """From suffixes sorted by leading bytes and place: the repeats, n windows from start on; with borders also the different segments of the first and the last leading bytes."""
    width = gram + (length - gram + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []  # what earlier buckets found
        opening = True
        for table, keys, group, last in _groups(_without_found(batches, passed), width):
            yield from passed
            passed.clear()
            doc, text, start, n, lead, many = (table.column(i).to_numpy() for i in range(6))
            parts = table.column("segment").to_pylist()
            # of each different segment one row; `of` leads from a row to it
            known: dict[tuple, int] = {}
            of = np.fromiter((known.setdefault(x, len(known)) for x in zip(group.tolist(), lead.tolist(), parts, strict=True)), np.int64, len(parts))
            one = np.unique(of, return_index=True)[1]
            new = changes(group, of, doc, text, start)  # repeated rows of one document are one place
            several = (np.bincount(of, new) > 1) | (np.bincount(of, many) > 0)
            seen = _repeated([parts[i] for i in one.tolist()], n[one].astype(np.int64), group[one], several, length)
            first_window = np.cumsum(n[one]) - n[one]
            rows = np.flatnonzero(new)
            size = n[rows].astype(np.int64)
            row = np.repeat(rows, size)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            hit = seen[first_window[of[row]] + inner]
            flags = np.zeros(len(row) + len(rows), bool)  # a gap after each row
            flags[np.arange(len(row)) + np.repeat(np.arange(len(rows)), size)] = hit
            x, y = runs_of(flags)
            r = np.repeat(rows, size + 1)[x]
            at = x - (np.cumsum(size + 1) - size - 1)[np.searchsorted(np.cumsum(size + 1), x, "right")]
            nothing = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc[r]),
                    pa.array(text[r]),
                    pa.array((start[r] + at).astype(np.int32)),
                    pa.array((y - x).astype(np.int32)),
                    pa.nulls(nothing, pa.int32()),
                    pa.nulls(nothing, pa.bool_()),
                    pa.nulls(nothing, pa.binary()),
                ],
                schema=SUFFIXES,
            )
            if borders:
                edge = one[(opening & (group[one] == 0)) | (last & (group[one] == group[-1]))]
                yield table.take(pa.array(edge)).set_column(
                    5, "many", pa.array(several[of[edge]])
                ).cast(SUFFIXES).combine_chunks().to_batches(max_chunksize=1 << 30)[0] if len(edge) else pa.RecordBatch.from_pylist([], SUFFIXES)
            opening = False
        yield from passed

    return run


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, hash, start, n), hash that of the text: runs of n byte offsets at which a string starts that also starts elsewhere."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = keyed(docs).mapInArrow(_segments(length, gram), "anchor long, print long, doc_id long, hash long, at int, open int, n int")
    sieve = segments.repartition(n, "anchor").sortWithinPartitions("anchor", "print", "doc_id", "hash", "at").mapInArrow(
        _sieve, "doc_id long, hash long, at int, open int, n int"
    )
    sieved = checkpoint(sieve)
    wanted = sieved.where("open > 0").groupBy("doc_id", "hash").agg(F.collect_list(F.struct("at", "open", "n")).alias("segments"))
    texts = keyed(docs, text_hash().alias("hash")).join(wanted, ["doc_id", "hash"]).select("doc_id", "text", "segments", "hash")
    suffixes = texts.mapInArrow(_suffixes(length, gram), SUFFIXES_DDL)
    leading = F.expr(f"substring(segment, lead + 1, {gram + (length - gram + 1) // 2})")
    order = [leading, "doc_id", "hash", "start"]
    found = suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_bucket(length, gram, True), SUFFIXES_DDL)
    # equal leading bytes meet across buckets; what is found already is dealt by document and passes
    route = F.when(F.col("segment").isNull(), F.xxhash64("doc_id", "hash")).otherwise(F.xxhash64(leading))
    across = found.repartition(n, route).sortWithinPartitions(*order).mapInArrow(_bucket(length, gram, False), SUFFIXES_DDL)
    return across.select("doc_id", "hash", "start", "n").unionByName(sieved.where("open = 0").select("doc_id", "hash", F.col("at").alias("start"), "n"))


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
                kept, n_spans = text, 0
                if runs.is_valid:
                    runs = np.sort(runs.values.to_numpy())
                    a = np.minimum(runs >> 32, len(text))
                    b = np.minimum((runs >> 32) + (runs & 0xFFFFFFFF) + length - 1, len(text))
                    reach = np.maximum.accumulate(b)
                    new = np.concatenate(([True], a[1:] > reach[:-1]))
                    a, b = a[new], reach[np.concatenate((new[1:], [True]))]
                    n_spans = int((b > a).sum())
                    kept = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True))
                out.append((i, len(text), len(text) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RESULT, strict=True)], schema=RESULT)

    return run


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty texts have no bytes. Repeated rows of a document are one document and don't remove each other;
    rows with one doc_id, or none, and different texts are different documents. An empty table gives no rows;
    other columns are ignored. length is 8 or more.
    """
    runs = repeats(docs, length, gram).groupBy("doc_id", "hash").agg(F.collect_list(F.expr("shiftleft(cast(start as long), 32) | n")).alias("runs"))
    joined = keyed(docs, text_hash().alias("hash")).join(runs, ["doc_id", "hash"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumn("doc_id", real_id())


#: For tables with one row a doc_id, none of them null; texts are read as hex in parts of 500 starts.
SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
parts as (select doc_id, k, h[2 * k + 1:2 * k + 1398] as part from (select doc_id, h, unnest(range(0, len(h) // 2, 500)) as k from d)),
starts as (select doc_id, k, part, unnest(range(1, least(len(part) // 2 - 198, 501))) as s from parts where len(part) >= 400),
strings as (select doc_id, k + s as s, md5_number(part[2 * s - 1:2 * s + 398]) as w from starts),
found as (select doc_id, s from strings qualify count(*) over (partition by w) > 1),
marked as (select *, coalesce(s - lag(s) over (partition by doc_id order by s) > 200, true)::int as new from found),
numbered as (select *, sum(new) over (partition by doc_id order by s) as run from marked),
runs as (select doc_id, run, min(s) as a, max(s) + 199 as b from numbered group by all),
removed as (select doc_id, count(*) as spans, sum(b - a + 1) as n, list({'a': a, 'b': b} order by a) as runs from runs group by doc_id),
whole as (
  select d.doc_id, h, coalesce(n, 0) as n, coalesce(spans, 0) as spans,
    list_concat([0], list_transform(coalesce(runs, []), lambda r: r.b)) as ends,
    list_append(list_transform(coalesce(runs, []), lambda r: r.a), len(h) // 2 + 1) as begins
  from d left join removed using (doc_id)),
kept as (select *, list_transform(list_zip(ends, begins), lambda z: h[2 * z[1] + 1:2 * z[2] - 2]) as rest from whole)
select doc_id, (len(h) // 2)::bigint as n_bytes, n::bigint as n_removed, spans::bigint as n_spans, sha256(unhex(array_to_string(rest, ''))) as kept_sha256 from kept
"""
