"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

Each source has a target number of words, so each of its documents an expected number of copies: a whole part, and a
fraction to round. Rounding works on pairs: of two fractional documents one gives words to the other until one's copies are
whole, in the direction drawn so that both expectations hold; the source's words stay the same at every step. Chunks of
about CHUNK documents fold this way to one residual each; residuals meet in chunks again, a reduction tree of
log(documents) / log(CHUNK) levels, each one shuffle of partly aggregated rows. The last residual of a source is rounded
to the nearer side, and what it's off by is made up in one of the source's chunks, by flipping documents, large ones first, that fit into the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, WORD, checkpoint, real_id, text_hash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
CHUNK = 64
#: Rows of sources that are broadcast at most, some 100 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Rows alike that are written out together.
ALIKE = 4096
SEED = 20_240_611

#: seed is a hash of all that tells a row from others, for draws; row is its number in this run, for joins.
WHO = "struct<seed:bigint,row:bigint,doc_id:bigint,size:bigint,hash:bigint>"
ITEM = f"struct<who:{WHO},p:double>"
DONE = f"array<struct<who:{WHO},x:int>>"
GAIN_I, LOSS_I = "(1 - s.carry.p) * s.carry.who.size", "s.carry.p * s.carry.who.size"
GAIN_J, LOSS_J = "(1 - j.p) * j.who.size", "j.p * j.who.size"
#: t.up: the carried document gains, the next one loses; t.first: the carried one becomes whole.
STEP = f"""
transform(transform(
  array(named_struct('a', least({GAIN_I}, {LOSS_J}), 'b', least({GAIN_J}, {LOSS_I}))),
  t -> named_struct('a', t.a, 'b', t.b, 'up', j.u * (t.a + t.b) < t.b, 'first', if(j.u * (t.a + t.b) < t.b, {GAIN_I} <= {LOSS_J}, {GAIN_J} > {LOSS_I}))),
  t -> named_struct(
    'carry', if(t.first,
      named_struct('who', j.who, 'p', greatest(0D, least(1D, j.p + if(t.up, -t.a, t.b) / j.who.size))),
      named_struct('who', s.carry.who, 'p', greatest(0D, least(1D, s.carry.p + if(t.up, t.a, -t.b) / s.carry.who.size)))),
    'done', concat(s.done, array(if(t.first,
      named_struct('who', s.carry.who, 'x', cast(t.up as int)),
      named_struct('who', j.who, 'x', cast(not t.up as int)))))))[0]
"""
FOLD = f"""
aggregate(items, named_struct('carry', cast(null as {ITEM}), 'done', cast(array() as {DONE})),
  (s, j) -> if(s.carry is null,
    named_struct('carry', named_struct('who', j.who, 'p', j.p), 'done', s.done),
    {STEP}))
"""
#: Rows of the chunk's documents to flip: those taken too much (or too little) that fit into what's left, large ones first.
FLIPS = """
aggregate(sort_array(transform(done, d -> named_struct('size', d.who.size, 'seed', d.who.seed, 'row', d.who.row, 'x', d.x)), false),
  named_struct('left', abs(off), 'rows', cast(array() as array<bigint>)),
  (s, d) -> if(d.x = cast(off > 0 as int) and d.size <= s.left, named_struct('left', s.left - d.size, 'rows', concat(s.rows, array(d.row))), s)).rows
"""


def _known() -> list[Column]:
    """doc_id, key, size, hash: key is 's' and the source, 't' for a null one, so that keys sort as asked; hash is of the text."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t")).alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        text_hash().alias("hash"),
    ]


def sizes(docs: DataFrame) -> DataFrame:
    """key, size and who (see WHO) of each document; rows alike are told apart by a number from 0.

    Rows alike are counted where they lie and written out again in stretches of ALIKE, which are dealt anew, so that no group of them is one task's.
    """
    alike = docs.select(*_known()).groupBy("doc_id", "key", "size", "hash").agg(F.count("*").alias("c"))
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(ALIKE).cast("long"))).alias("low")
    dealt = alike.select("*", stretch).repartition("doc_id", "hash", "low")
    numbered = dealt.select("doc_id", "key", "size", "hash", F.explode(F.sequence("low", F.least(F.col("low") + ALIKE, "c") - 1)).alias("number"))
    seed = F.xxhash64("doc_id", "key", "size", "hash", "number").alias("seed")
    return numbered.select("key", "size", F.struct(seed, F.monotonically_increasing_id().alias("row"), "doc_id", "size", "hash").alias("who"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """key, n, source_size, target: share of all sizes by weight, none above most times its source.

    Sources may be many, so none of this sorts them in one task: ranks come from a range-partitioned sort, and the level,
    words for a weight of 1, rises until no further source is at its cap, each time from a sum for each weight.
    """
    by_source = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    place = F.monotonically_increasing_id()  # the partition and, in the lower 33 bits, the row within it
    ranged = checkpoint(by_source.orderBy("key").withColumn("part", F.shiftright(place, 33)).withColumn("at", place.bitwiseAND((1 << 33) - 1)))
    counts = ranged.groupBy("part").agg(F.count("*").alias("rows"))
    before = counts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    kind = F.pmod(F.col("before") + F.col("at"), F.lit(len(weights))).cast("int")
    rows = checkpoint(ranged.join(before, "part").select("key", "n", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), kind).alias("weight")))
    cap = F.col("source_size") * float(most)
    level, full = 0.0, -1
    while True:
        open_ = cap > level * F.col("weight")
        # a row for each weight
        sums = rows.groupBy("weight").agg(
            F.sum("source_size"), F.count_if(~open_), F.sum(F.when(~open_, F.col("source_size")).otherwise(0)), F.count_if(open_)
        ).collect()
        sums = sorted(tuple(r) for r in sums)
        now, weight = sum(r[2] for r in sums), sum(r[0] * r[4] for r in sums)
        if now == full or not weight:
            break
        full, level = now, (share * sum(r[1] for r in sums) - most * sum(r[3] for r in sums)) / weight
    return rows.select("key", "n", "source_size", F.when(open_, level * F.col("weight")).otherwise(cap).alias("target"))


def _with(rows: DataFrame, small: DataFrame, n: int, on: str, how: str = "inner") -> DataFrame:
    """A join with a table of n rows, broadcast if they're few."""
    return rows.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, how)


def _mix(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, chunk: int, seed: int) -> DataFrame:
    """doc_id (never null), key, size, hash (of the text), source_size, target, taken, copies."""
    sized = checkpoint(sizes(docs))
    sources = checkpoint(targets(sized, weights, share, most))
    n, largest = sources.agg(F.count("*"), F.max("n")).first()
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio))
    rows = _with(sized, sources.select("key", "n", "p"), n, "key")
    live = rows.where("p > 0 and size > 0").select("key", "n", "who", "p")
    done, span, first = [], 1, None
    while True:
        span *= chunk
        draw = [F.xxhash64(F.lit(seed + k), F.lit(span), "who.seed") for k in range(3)]
        part = F.pmod(draw[0], F.ceil(F.col("n") / span))
        item = F.struct(draw[1].alias("h"), "who", "p", (F.pmod(draw[2], F.lit(1 << 40)) / float(1 << 40)).alias("u"))
        chunks = live.withColumn("item", item).withColumn("part", part).groupBy("key", "part").agg(
            F.first("n").alias("n"), F.array_sort(F.collect_list("item")).alias("items")
        )
        chunks = checkpoint(chunks.select("key", "n", F.expr(FOLD).alias("out")))
        first = first or chunks
        done.append(chunks.select("key", F.explode("out.done").alias("d")).select("key", "d.*"))
        live = chunks.where("out.carry is not null").select("key", "n", "out.carry.*")
        if span >= (largest or 0):
            break
    last = live.withColumn("x", (F.col("p") >= 0.5).cast("int"))
    decided = done[0]
    for d in done[1:]:
        decided = decided.unionByName(d)
    off = last.select("key", ((F.col("x") - F.col("p")) * F.col("who.size")).alias("off"))
    words = F.aggregate("out.done", F.lit(0).cast("long"), lambda s, d: s + d["who"]["size"])
    largest_chunk = first.groupBy("key").agg(F.max_by("out.done", F.struct(words, F.col("out.done"))).alias("done"))
    flips = _with(largest_chunk, off, n, "key").select(F.explode(F.expr(FLIPS)).alias("row"), F.lit(True).alias("flip"))
    decided = decided.unionByName(last.select("key", "who", "x"))
    flips = checkpoint(flips)  # a few for each source
    decided = _with(decided.withColumn("row", F.col("who.row")), flips, flips.count(), "row", "left")
    decided = decided.select("key", "who", F.when(F.col("flip"), 1 - F.col("x")).otherwise(F.col("x")).alias("x"))
    settled = rows.where("not (p > 0 and size > 0)").select("key", "who", F.lit(0).alias("x"))
    out = _with(decided.unionByName(settled), sources.select("key", "source_size", "target", "whole"), n, "key")
    out = out.select("key", "who.doc_id", "who.size", "who.hash", "source_size", "target", "whole", "x")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("x")).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "key", "size", "hash", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, copies.

    A null source is a source, the last; a null text has size 0 and so has an empty one; such documents are never
    taken. Draws hash doc_id and size, so reruns agree whatever the partitions; repeated rows are rounded each and may differ
    in copies. An empty table gives no rows. Other columns are ignored.
    """
    return _mix(docs, weights, share, most, chunk, seed).select(real_id(), "size", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it; the columns stay.

    Rows of size 0 (null and empty texts) are never taken. Rows alike in doc_id (null is one), source, size and text share their
    copies evenly: they differ by one at most. An empty table gives no rows.
    """
    alike = ["doc_id", "key", "size", "hash"]
    decided = _mix(docs, WEIGHTS, SHARE, MOST, CHUNK, SEED).where("size > 0").groupBy(*alike)
    decided = decided.agg(F.min("copies").alias("least"), (F.sum("copies") - F.count("*") * F.min("copies")).alias("more"))
    rows = docs.select(F.struct("*").alias("doc"), *_known()).where("size > 0").join(decided, alike)
    turn = F.row_number().over(Window.partitionBy(*alike).orderBy("size"))
    rows = rows.withColumn("copies", (F.col("least") + (turn <= F.col("more")).cast("int")).cast("int")).where("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
