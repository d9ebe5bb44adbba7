"""Substring dedup by seed and extend: winnowed anchors join documents, matches are extended both ways, later copies go.

1. Seeds. Of each 20-word window the rightmost least hash of its 6-word grams is the anchor (winnowing); neighbouring
   windows with one anchor make a seed. Equal windows have equal anchors, so seeds whose anchor lies at one place
   only go no further. Seeds of one chunk of text meet there first, by the same steps as below, so that a
   passage in millions of documents sends on one seed a chunk.
2. Seeds that share an anchor fetch their words and extend. All seeds of an anchor extend together: classes of
   seeds that agree on l words to the left, on r words to the right, are split word by word, and a seed alone in its
   class stops. Where l + 6 + r reaches 20 words the earliest place of the class leads, the others are repeats.
   A window has 7 words or more on one side of its gram, so seeds are dealt by the gram and 7 words next
   to it on either side: a frequent gram is never one group, only a passage of 13 words is. Of such a group the leaders alone are
   carried from one block of rows to the next.
3. Neighbouring repeated windows join to maximal repeats, documents meet theirs by doc_id and a hash of the text and lose the words.

Words are compared by 64-bit hashes of each, all of a window's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEEDS, Powers, anchor_places, anchor_runs, changes, checkpoint, keyed, mix, prefix, real_id, refine, runs_of, shared_anchors, spans, text_chunks, text_hash, text_hashes

WINDOW, GRAM, CHUNK = 20, 6, 3 << 20
#: Rows that are extended together; of a longer group the leaders are carried on.
BLOCK = 100_000
CONTEXTS = pa.schema(
    [
        ("key", pa.int64()),
        ("doc_id", pa.int64()),
        ("hash", pa.int64()),
        ("at", pa.int32()),
        ("open", pa.int32()),
        ("before", pa.int32()),
        ("words", pa.binary()),
    ],
)
MATCHES = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("packed", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def extend(
    group: np.ndarray,
    place: np.ndarray,
    open_: np.ndarray,
    word: Callable[[int, np.ndarray], np.ndarray],
    window: int = WINDOW,
    gram: int = GRAM,
) -> np.ndarray:
    """The bits of open_ whose windows have an equal one earlier: bit o is the window that starts o words before the gram.

    Seeds are in the order of (group, place). word(j, seeds): hashes of the words j after the gram's first. Seeds of one
    place are one. Bits that aren't open neither match nor are matched.
    """
    reach = window - gram
    seen = np.zeros(len(group), np.int64)

    def step(classes: np.ndarray, j: int, wanted: np.ndarray) -> np.ndarray:
        rows = np.flatnonzero((classes >= 0) & wanted)
        out = np.full(len(classes), -1)
        out[rows] = refine(classes[rows], word(j, rows))
        return out

    for j in range(gram):
        group = step(group, j, open_ > 0)
    left, right = [group], [group]
    for k in range(1, reach + 1):
        left.append(step(left[-1], -k, open_ >> k > 0))  # a window starts so far left, or further
        right.append(step(right[-1], gram + k - 1, open_ & ((1 << (reach - k + 1)) - 1) > 0))
    for o in range(reach + 1):
        rows = np.flatnonzero((left[o] >= 0) & (right[reach - o] >= 0) & (open_ >> o & 1 > 0))
        classes = refine(left[o][rows], right[reach - o][rows])
        rows, classes = rows[classes >= 0], classes[classes >= 0]
        if len(rows):
            by = np.argsort(classes, kind="stable")
            rows, classes = rows[by], classes[by]
            first = np.concatenate(([True], classes[1:] != classes[:-1]))
            lead = place[rows][np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
            seen[rows] |= (place[rows] != lead).astype(np.int64) << o
    return seen


def _seeds(window: int, gram: int):
    """Seeds with windows that are open still, and settled runs of windows: open 0, n windows from `at` on, any anchor."""
    reach = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = _Hashes(), Powers(0x9E3779B97F4A7C15)
        for ids, texts in text_chunks(batches, CHUNK):
            hashed = text_hashes(texts)
            order = np.lexsort((hashed, ids))
            split = [texts[i].split() for i in order]
            counts = np.array([len(w) for w in split], np.int64)
            total = int(counts.sum())
            if total < window:
                continue
            h = np.fromiter((hashes[w] for words in split for w in words), np.uint64, total)
            first = np.concatenate(([0], np.cumsum(counts)[:-1]))
            doc_of = np.repeat(np.arange(len(counts)), counts)
            ids, hashed = ids[order], hashed[order]
            row = np.cumsum(changes(ids, hashed))
            n = total - window + 1
            valid = (first + counts - window)[doc_of[:n]] >= np.arange(n)
            grams = mix(spans(prefix(mix(h), powers), gram, powers))
            runs, lengths, anchors = anchor_runs(grams, reach + 1, valid)
            if not len(runs):
                continue
            at = anchor_places(grams, reach + 1, runs, anchors)
            d = doc_of[runs]
            # places order windows by (doc_id, hash, start): repeated rows of one document are one place
            place = row[d] * (int(counts.max()) + 1) + at - first[d]
            open_ = ((1 << lengths) - 1) << (at - runs - lengths + 1)
            by = np.lexsort((place, anchors))
            group = np.cumsum(changes(anchors[by])) - 1
            by = by[(np.bincount(group) > 1)[group]]
            settled = np.zeros(len(runs), np.int64)
            if len(by):
                settled[by] = extend(np.cumsum(changes(anchors[by])) - 1, place[by], open_[by], lambda j, rows, at=at, by=by: h[at[by[rows]] + j], window, gram)
            left = open_ & ~settled
            live = left > 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchors[live].view(np.int64)),
                    pa.array(ids[d[live]]),
                    pa.array(hashed[d[live]]),
                    pa.array((at - first[d])[live].astype(np.int32)),
                    pa.array(left[live].astype(np.int32)),
                    pa.array(np.zeros(int(live.sum()), np.int32)),
                ],
                schema=SEEDS,
            )
            flags = np.zeros(n, bool)
            for o in range(reach + 1):
                flags[at[settled >> o & 1 > 0] - o] = True
            s, e = runs_of(flags)
            d = doc_of[s]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(mix(ids[d].view(np.uint64) + s.view(np.uint64)).view(np.int64)),
                    pa.array(ids[d]),
                    pa.array(hashed[d]),
                    pa.array((s - first[d]).astype(np.int32)),
                    pa.array(np.zeros(len(s), np.int32)),
                    pa.array((e - s).astype(np.int32)),
                ],
                schema=SEEDS,
            )

    return run


def _contexts(window: int, gram: int):
    """Each seed with its words: once for windows with more to the left of the gram, once for the others, by the gram and what must be next to it."""
    reach = window - gram
    half = reach // 2
    right = (1 << (half + 1)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, seeds, hashed in zip(
                batch.column(0).to_pylist(),
                batch.column(1).cast(pa.binary()).to_pylist(),
                batch.column(2).to_pylist(),
                batch.column(3).to_pylist(),
                strict=True,
            ):
                words = text.split()
                for seed in seeds:
                    at = seed["at"]
                    for mask, key in (
                        (seed["open"] & right, words[at : at + gram + reach - half]),
                        (seed["open"] & ~right, words[max(0, at - half - 1) : at + gram]),
                    ):
                        if mask:
                            high, low = mask.bit_length() - 1, (mask & -mask).bit_length() - 1
                            out.append(
                                (
                                    xxhash.xxh3_64_intdigest(b" ".join(key), mask > right) - 2**63,
                                    doc,
                                    hashed,
                                    at,
                                    mask,
                                    high,
                                    b" ".join(words[at - high : at + gram + reach - low]),
                                ),
                            )
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), CONTEXTS, strict=True)], schema=CONTEXTS)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), CONTEXTS, strict=True)], schema=CONTEXTS)

    return run


def _extend(window: int, gram: int, block: int):
    """From contexts sorted by key, doc_id, hash and at: the windows found before, as runs (doc_id, hash, start << 32 | windows)."""
    reach = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        held, rows, least = [], 0, block
        for batch in chain(batches, (None,)):
            if batch is not None:
                held.append(batch)
                rows += batch.num_rows
                if rows < least:
                    continue
            if not rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("key").to_numpy()
            cut = rows if batch is None else int(np.searchsorted(keys, keys[-1]))
            whole = cut > 0  # else one group so far: what leads in it is carried on
            now = table.slice(0, cut) if whole else table
            keys, doc, text, at, open_, before = (now.column(i).to_numpy() for i in range(6))
            group = np.cumsum(changes(keys)) - 1
            place = np.cumsum(changes(keys, doc, text, at))
            live = np.flatnonzero((np.bincount(group) > 1)[group])
            seen = np.zeros(now.num_rows, np.int64)
            if len(live):
                split = [w.split() for w in now.column("words").take(pa.array(live)).to_pylist()]
                counts = np.array([len(w) for w in split], np.int64)
                h = np.fromiter((hashes[w] for words in split for w in words), np.uint64, int(counts.sum()))
                gram_at = np.cumsum(counts) - counts + before[live]
                seen[live] = extend(group[live], place[live], open_[live].astype(np.int64), lambda j, r, h=h, gram_at=gram_at: h[gram_at[r] + j], window, gram)
                flags = np.zeros((now.num_rows, reach + 2), bool)  # by window start; the last column parts rows
                flags[:, :-1] = seen[:, None] >> np.arange(reach, -1, -1) & 1
                s, e = runs_of(flags.ravel())
                r = s // (reach + 2)
                start = at[r] - reach + s % (reach + 2)
                yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(text[r]), pa.array(start.astype(np.int64) << 32 | (e - s))], schema=MATCHES)
            if whole:
                rest = table.slice(cut)
            else:
                left = open_ & ~seen
                lead = np.flatnonzero(left)
                rest = now.take(pa.array(lead)).set_column(4, "open", pa.array(left[lead].astype(np.int32)))
            held, rows = rest.cast(CONTEXTS).to_batches(), rest.num_rows
            least = block + 2 * rows

    return run


def matches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(doc_id, hash, packed): hash is that of the text, packed >> 32 is the first word of a run of repeated windows, the lower half their number."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seeds = keyed(docs).mapInArrow(_seeds(window, gram), "anchor long, doc_id long, hash long, at int, open int, n int")
    sieved = checkpoint(
        seeds.repartition(n, "anchor").sortWithinPartitions("anchor", "doc_id", "hash", "at").mapInArrow(
            shared_anchors, "doc_id long, hash long, at int, open int, n int"
        ),
    )
    wanted = sieved.where("open > 0").groupBy("doc_id", "hash").agg(F.collect_list(F.struct("at", "open")).alias("seeds"))
    texts = keyed(docs, text_hash().alias("hash")).join(wanted, ["doc_id", "hash"]).select("doc_id", "text", "seeds", "hash")
    contexts = texts.mapInArrow(_contexts(window, gram), "key long, doc_id long, hash long, at int, open int, before int, words binary")
    found = contexts.repartition(n, "key").sortWithinPartitions("key", "doc_id", "hash", "at").mapInArrow(
        _extend(window, gram, block), "doc_id long, hash long, packed long"
    )
    return found.unionByName(sieved.where("open = 0").select("doc_id", "hash", F.expr("shiftleft(cast(at as long), 32) | n").alias("packed")))


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
                words = text.split()
                kept = words
                if runs.is_valid:
                    runs = runs.values.to_numpy()
                    marks = np.zeros(len(words) + 1, np.int32)
                    np.add.at(marks, np.minimum(runs >> 32, len(words)), 1)
                    np.add.at(marks, np.minimum((runs >> 32) + (runs & 0xFFFFFFFF) + window - 1, len(words)), -1)
                    kept = [w for w, m in zip(words, np.cumsum(marks)[:-1].tolist(), strict=True) if not m]
                out.append((i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RESULT, strict=True)], schema=RESULT)

    return run


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256.

    Null and empty texts have no words. Repeated rows of a document are that document: each is returned, neither
    removes the other; rows with one doc_id and different texts are different documents, ordered by a hash of the text.
    A null doc_id comes before all others, and its rows are told apart likewise. An empty table gives no rows; other columns are ignored.
    """
    found = matches(docs, window, gram, block).groupBy("doc_id", "hash").agg(F.collect_list("packed").alias("runs"))
    joined = keyed(docs, text_hash().alias("hash")).join(found, ["doc_id", "hash"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, kept_sha256 string").withColumn("doc_id", real_id())


#: For tables with one row a doc_id, none of them null.
SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '') as words from documents),
starts as (select doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) as s from d),
windows as (select doc_id, s, md5(array_to_string(words[s:s + 19], ' ')) as w from starts),
again as (select doc_id, s from windows qualify row_number() over (partition by w order by doc_id, s) > 1),
marked as (select *, coalesce(s - lag(s) over (partition by doc_id order by s) > 20, true)::int as new from again),
numbered as (select *, sum(new) over (partition by doc_id order by s) as run from marked),
runs as (select doc_id, run, min(s) as a, max(s) + 19 as b from numbered group by all),
removed as (select doc_id, sum(b - a + 1) as n, list({'a': a, 'b': b} order by a) as runs from runs group by doc_id),
whole as (
  select d.doc_id, words, coalesce(n, 0) as n,
    list_concat([0], list_transform(coalesce(runs, []), lambda r: r.b)) as ends,
    list_append(list_transform(coalesce(runs, []), lambda r: r.a), len(words) + 1) as begins
  from d left join removed using (doc_id)),
kept as (select *, flatten(list_transform(list_zip(ends, begins), lambda z: words[z[1] + 1:z[2] - 1])) as rest from whole)
select doc_id, len(words)::bigint as n_words, n::bigint as n_removed, sha256(coalesce(array_to_string(rest, ' '), '')) as kept_sha256 from kept
"""
