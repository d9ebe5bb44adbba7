"""Position weight matrices and k-mer statistics.

A matrix travels as a small DataFrame (matrix, pos from 0, base, score) or as a literal; sequences are rows of
bounded length (chunk chromosomes with an overlap of the width less one).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import revcomp, spread, windows
from .intervals import interval_join
from .ordered import checkpoint


def pssm(counts: DataFrame) -> DataFrame:
    """counts (matrix, pos, base, n) with score: log2 of ((n + r) / (total + 4 r)) / 0.25, r the root of the column's total."""
    total = F.sum("n").over(Window.partitionBy("matrix", "pos"))
    return counts.withColumn("score", F.log2((F.col("n") + F.sqrt(total)) / (total + 4 * F.sqrt(total)) / 0.25))


def log_matrix(counts: DataFrame) -> DataFrame:
    """counts with score: log of (n + p) / (all n + all p) over the whole matrix, p = sqrt(n + 1) / 4."""
    pseudo = F.sqrt(F.col("n") + 1) / 4
    everything = Window.partitionBy("matrix")
    return counts.withColumn("score", F.log((F.col("n") + pseudo) / (F.sum(F.col("n") + pseudo).over(everything) + F.sum(pseudo).over(everything))))


def literal_score(seq: Column, columns: list[dict[str, float]], upper: bool = True) -> Column:
    """Score of the first len(columns) bases; null with a symbol that isn't ACGT or too short a sequence."""
    parts = []
    for k, c in enumerate(columns):
        base = F.substring(seq, k + 1, 1)
        place = F.call_function("instr", F.lit("ACGT"), F.upper(base) if upper else base)
        # 0: no base, or the empty text, which stands before every text
        parts.append(F.when(base != "", F.get(F.array(F.lit(None).cast("double"), *[F.lit(float(c[b])) for b in "ACGT"]), place)))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def best_strand(seq: Column, columns: list[dict[str, float]]) -> Column:
    """struct(score, strand): the better of both strands, forward if equal."""
    head = F.substring(seq, 1, len(columns))
    a, b = literal_score(head, columns), literal_score(revcomp(head), columns)
    return F.when(b > a, F.struct(b.alias("score"), F.lit("-").alias("strand"))).otherwise(F.struct(a.alias("score"), F.lit("+").alias("strand")))


#: Bases that are scored at a time.
PIECE = 1 << 20
#: A base's number by its character, 4 for any other; and the numbers of the complements.
NUMBERS = np.full(256, 4, np.uint8)
NUMBERS[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3] * 2
COMPLEMENTS = np.array([3, 2, 1, 0, 4], np.uint8)


def numbers(text: str | None) -> np.ndarray:
    """0 to 3 for A, C, G and T in either case, 4 for other characters."""
    if not text:
        return np.zeros(0, np.uint8)
    if text.isascii():
        return NUMBERS[np.frombuffer(text.encode(), np.uint8)]
    return NUMBERS[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 255)]


def _in_pieces(batches: Iterator[pa.RecordBatch], seq: str, width: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray]]:
    """(batch, row, place, numbers) of the sequences in pieces of PIECE windows, which overlap by the width less one."""
    for batch in batches:
        for row, text in enumerate(batch.column(seq).to_pylist()):
            own = numbers(text)
            for at in range(0, len(own) - width + 1, PIECE):
                yield batch, row, at, own[at : at + PIECE + width - 1]


def scan(seqs: DataFrame, columns: list[dict[str, float]], cutoff: float, seq: str = "seq") -> DataFrame:
    """Other columns of seqs, pos (from 0), strand, score of every window of either strand at cutoff or above.

    Bases become numbers and a strand's scores are sums of looked-up columns, over arrays of a whole stretch; only hits become rows. The other strand adds up from its
    own first base on. Windows with other symbols than ACGT have no score.
    """
    width = len(columns)
    table = np.array([[c[b] for b in "ACGT"] + [np.nan] for c in columns], np.float64)
    keep = [c for c in seqs.columns if c != seq]

    signs = pa.array(["+", "-"])

    def joined(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        rows, pos, minus, score = (np.concatenate(x) for x in zip(*held, strict=True))
        kept = batch.select(keep).take(pa.array(rows))
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array(pos), signs.take(pa.array(minus)), pa.array(score)], names=[*keep, "pos", "strand", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, total = None, [], 0  # hits of one batch's rows, as arrays, until they are PIECE
        for batch, row, at, own in _in_pieces(batches, seq, width):
            if held and (batch is not now or total >= PIECE):
                yield joined(now, held)
                held, total = [], 0
            now = batch
            n = len(own) - width + 1
            other = COMPLEMENTS[own]
            forward, reverse = table[0][own[:n]], table[0][other[width - 1 :]]
            for k in range(1, width):
                forward = forward + table[k][own[k : k + n]]
                reverse = reverse + table[k][other[width - 1 - k : width - 1 - k + n]]
            plus, minus = np.flatnonzero(forward >= cutoff), np.flatnonzero(reverse >= cutoff)
            if len(plus) + len(minus):
                pos = (np.concatenate((plus, minus)) + at).astype(np.int32)
                held.append((np.full(len(pos), row), pos, np.repeat([0, 1], [len(plus), len(minus)]), np.concatenate((forward[plus], reverse[minus]))))
                total += len(pos)
        if held:
            yield joined(now, held)

    kinds = {f.name: f.dataType.simpleString() for f in seqs.schema}
    return spread(seqs).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "pos int", "strand string", "score double"]))


def hits_above(hits: DataFrame, cutoff: float | None) -> DataFrame:
    """Hits of at least the cutoff, or where it's None of their report's own (column suggested); 0 is a cutoff."""
    return hits.where(F.col("score") >= (F.col("suggested") if cutoff is None else F.lit(cutoff)))


def best_hit(hits: DataFrame, by: list[str]) -> DataFrame:
    """The hit of the best score in each group, of equal ones the first by pos, forward before reverse."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "pos", "strand"))
    return hits.withColumn("_r", rank).where("_r = 1").drop("_r")


def hit_window(best: DataFrame, seqs: DataFrame, key: str, width: int, motif: int, seq: str = "seq") -> DataFrame:
    """key, window: bases around the best hit's start; on '-' around its end less 3, reverse complemented."""
    centre = F.when(F.col("strand") == "+", F.col("pos")).otherwise(F.col("pos") + motif - 3)
    rows = best.join(seqs, key).withColumn("_c", centre)
    low = F.greatest(F.col("_c") - width // 2, F.lit(0))
    text = F.substring(F.col(seq), low + 1, F.col("_c") + width // 2 - low)
    return rows.select(key, F.when(F.col("strand") == "+", text).otherwise(revcomp(text)).alias("window"))


def hits_in_windows(peaks: DataFrame, hits: DataFrame, window: int, key: str = "pid") -> DataFrame:
    """Pairs with the hit's start within window / 2 of the peak (column loc), ends included; other columns as l_ and r_."""
    around = peaks.withColumns({"s": F.col("loc") - window // 2, "e": F.col("loc") + window // 2})
    points = hits.withColumns({"s": F.col("start"), "e": F.col("start")})
    return interval_join(around, points, lambda: F.col("r_start").between(F.col("l_s"), F.col("l_e")))


def window_histogram(peaks: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """bin, hits, rate: hits by place in the window, (peak - start) + window / 2 - 1, -1 counting as the last; rate over all peaks."""
    n = peaks.count()
    place = F.pmod(F.col("l_loc") - F.col("r_start") + window // 2 - 1, F.lit(window))
    found = hits_in_windows(peaks, hits, window).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("hits"))
    return found.withColumn("rate", F.col("hits") / n if n else F.lit(0.0))


def motif_fraction(peaks: DataFrame, hits: DataFrame, window: int, key: str = "pid") -> DataFrame:
    """One row: peaks with a hit in the window, all peaks and the fraction."""
    n = peaks.count()
    found = hits_in_windows(peaks, hits, window).agg(F.count_distinct(f"l_{key}").alias("with_hit"))
    return found.select("with_hit", F.lit(n).cast("long").alias("peaks"), (F.col("with_hit") / n if n else F.lit(0.0)).alias("fraction"))


def distances_by_matrix(peaks: DataFrame, hits: DataFrame, matrices: DataFrame, window: int, key: str = "pid") -> DataFrame:
    """key, matrix, n, nearest: for every peak and matrix the hits in the window, none included."""
    pairs = hits_in_windows(peaks, hits, window).groupBy(F.col(f"l_{key}").alias(key), F.col("r_matrix").alias("matrix")).agg(
        F.count("*").alias("n"), F.min(F.abs(F.col("l_loc") - F.col("r_start"))).alias("nearest")
    )
    every = peaks.select(key).crossJoin(matrices.select("matrix"))  # a row for each is what is asked for
    return every.join(pairs, [key, "matrix"], "left").select(key, "matrix", F.coalesce("n", F.lit(0)).alias("n"), "nearest")


def oriented_hits(peaks: DataFrame, hits: DataFrame, window: int, reference: str, key: str = "pid") -> DataFrame:
    """key, class, matrix, offset: hits around a peak, as seen from its reference motif.

    class: how many matrices have hits there. The reference's hit nearest to the peak decides the orientation; where it's on
    '-', offsets from the peak change sign. Peaks without the reference are left out.
    """
    pairs = hits_in_windows(peaks, hits, window).select(
        F.col(f"l_{key}").alias(key),
        F.col("r_matrix").alias("matrix"),
        F.col("r_strand").alias("strand"),
        (F.col("r_start") - F.col("l_loc")).alias("offset"),
    )
    per = pairs.groupBy(key).agg(F.count_distinct("matrix").alias("class"))
    lead = F.row_number().over(Window.partitionBy(key).orderBy(F.abs("offset"), "offset", "strand"))
    ref = pairs.where(F.col("matrix") == reference).withColumn("_r", lead).where("_r = 1").select(key, F.col("strand").alias("_strand"))
    return pairs.join(ref, key).join(per, key).select(
        key, "class", "matrix", F.when(F.col("_strand") == "-", -F.col("offset")).otherwise(F.col("offset")).alias("offset")
    )


#: Bases by their place in the order A, T, G, C, other symbols as N, and each one's complement.
ORDERED = ("ATGCatgc", "01230123")
OPPOSITE = {"0": "1", "1": "0", "2": "3", "3": "2"}


def _canonical_windows(seqs: DataFrame, keep: list[str], k: int, seq: str) -> DataFrame:
    """keep, pos, code: each k-mer without other symbols than ACGT by the lesser code of both strands."""
    coded = F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "N"), *ORDERED)
    found = windows(seqs.select(*keep, coded.alias(seq)), k, seq, mirrored=OPPOSITE)
    return found.where(~F.contains("w", F.lit("N"))).select(*keep, "pos", F.least("w", "m").alias("code"))


def _decoded(code: str) -> Column:
    return F.translate(code, "0123", "ATGC").alias("kmer")


#: A base's number in the order A, T, G, C, from its number in that of A, C, G, T.
LISTED = np.array([0, 3, 2, 1, 0], np.int64)


def _codes(own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, codes): canonical k-mers of base numbers as whole numbers, up to 31 bases, without those that hold other symbols."""
    n = len(own) - k + 1
    one, two = LISTED[own], LISTED[COMPLEMENTS[own]]
    forward, reverse = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(k):
        forward = forward * 4 + one[j : j + n]
        reverse = reverse * 4 + two[k - 1 - j : k - 1 - j + n]
    bad = np.concatenate(([0], np.cumsum(own == 4)))
    places = np.flatnonzero(bad[k:] == bad[:n])
    return places, np.minimum(forward, reverse)[places]


def _letters(code: str, k: int) -> Column:
    """The k-mer of a code, three letters at a time from a table."""
    parts = []
    for low in range((k - 1) // 3 * 3, -1, -3):  # the letters behind these
        size = min(3, k - low)
        words = ["".join("ATGC"[(i >> 2 * (size - 1 - j)) & 3] for j in range(size)) for i in range(4**size)]
        at = F.shiftright(code, 2 * low).bitwiseAND(4**size - 1).cast("int")
        parts.append(F.get(F.array(*[F.lit(w) for w in words]), at))
    return F.concat(*parts).alias("kmer")


def _repeats(seqs: DataFrame, key: str) -> bool:
    """Whether several rows have one key: then rows of the same key must meet."""
    return bool(seqs.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").take(1))


def kmer_profile(seqs: DataFrame, key: str, k: int, seq: str = "seq") -> DataFrame:
    """key, kmer, n: canonical k-mers; those with other symbols than ACGT are skipped.

    A sequence's k-mers are counted as whole numbers over arrays before they are rows, up to 31 bases fit; only where keys repeat (chunks of a chromosome) are rows shuffled.
    """
    if k > 31:
        return _canonical_windows(seqs, [key], k, seq).groupBy(key, "code").agg(F.count("*").alias("n")).select(key, _decoded("code"), "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, numbers_of = [], [], []
            for row, text in enumerate(batch.column(seq).to_pylist()):
                own = numbers(text)
                codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for at in range(0, len(own) - k + 1, PIECE):
                    more, n = np.unique(_codes(own[at : at + PIECE + k - 1], k)[1], return_counts=True)
                    if len(codes):
                        codes, place = np.unique(np.concatenate((codes, more)), return_inverse=True)
                        counts = np.bincount(place, np.concatenate((counts, n))).astype(np.int64)
                    else:
                        codes, counts = more, n
                rows.append(np.full(len(codes), row))
                found.append(codes)
                numbers_of.append(counts)
                if sum(map(len, rows)) > PIECE or row == batch.num_rows - 1:
                    kept = batch.column(key).take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([kept, pa.array(np.concatenate(found)), pa.array(np.concatenate(numbers_of))], names=[key, "code", "n"])
                    rows, found, numbers_of = [], [], []

    rows = seqs.select(key, seq)
    counted = spread(rows).mapInArrow(run, f"`{key}` {dict(seqs.dtypes)[key]}, code long, n long")
    if _repeats(rows, key):
        counted = counted.groupBy(key, "code").agg(F.sum("n").alias("n"))
    return counted.select(key, _letters("code", k), "n")


def kmer_cells(seqs: DataFrame, key: str, k: int, width: int, seq: str = "seq") -> DataFrame:
    """key, bin, codes: the different canonical k-mers, up to 31 bases, that start in each stretch of width bases, as whole numbers; a row a stretch with any."""

    size = max(1, PIECE // width) * width  # stretches don't cross pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, total = [], 0  # (rows, bins, sizes, codes)
            for row, text in enumerate(batch.column(seq).to_pylist()):
                own = numbers(text)
                for at in range(0, len(own) - k + 1, size):
                    places, codes = _codes(own[at : at + size + k - 1], k)
                    bins = places // width
                    order = np.lexsort((codes, bins))
                    bins, codes = bins[order], codes[order]
                    new = np.ones(len(bins), bool)
                    new[1:] = (bins[1:] != bins[:-1]) | (codes[1:] != codes[:-1])
                    bins, sizes = np.unique(bins[new], return_counts=True)
                    held.append((np.full(len(bins), row), bins + at // width, sizes, codes[new]))
                    total += len(codes)
                if held and (total > PIECE or row == batch.num_rows - 1):
                    at_rows, bins, sizes, codes = (np.concatenate(x) for x in zip(*held, strict=True))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(codes))
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at_rows)), pa.array(bins), lists], names=[key, "bin", "codes"])
                    held, total = [], 0

    rows = seqs.select(key, seq)
    cells = spread(rows).mapInArrow(run, f"`{key}` {dict(seqs.dtypes)[key]}, bin long, codes array<long>")
    if _repeats(rows, key):
        each = cells.select(key, "bin", F.explode("codes").alias("code")).distinct()
        cells = each.groupBy(key, "bin").agg(F.array_sort(F.collect_list("code")).alias("codes"))  # a stretch's different k-mers
    return cells


def kmer_positions(seqs: DataFrame, key: str, k: int, width: int, seq: str = "seq") -> DataFrame:
    """kmer, key, bin: which canonical k-mers start in which stretch of width bases."""
    if k > 31:
        found = _canonical_windows(seqs, [key], k, seq).select("code", key, F.floor(F.col("pos") / width).cast("long").alias("bin")).distinct()
        return found.select(_decoded("code"), key, "bin")
    return kmer_cells(seqs, key, k, width, seq).select(key, "bin", F.explode("codes").alias("code")).select(_letters("code", k), key, "bin")


def cell_cooccurrence(cells: DataFrame, key: str, n_cells: int | None, k: int, targets: DataFrame) -> DataFrame:
    """cooccurrence() of kmer_cells()' rows, in one pass: pairs come from within a row, so that only their counts are shuffled. n_cells: None for the number of rows."""
    wanted = targets.select(F.conv(F.translate("kmer", "ATGC", "0123"), 4, 10).cast("long").alias("a")).where(F.length("kmer") == k).distinct()
    codes = F.array(*[F.lit(r.a) for r in wanted.collect()]).cast("array<bigint>")  # a catalogue
    # -1 stands for any k-mer: -1 and a code counts its cells, -1 twice all cells
    any_ = F.array(F.lit(-1).cast("long"))
    here = F.when(F.col(key).isNotNull(), F.concat(F.array_intersect("codes", codes), any_)).otherwise(any_)  # a null key is no cell to share
    rows = cells.select(F.explode(here).alias("ca"), "codes")
    counts = rows.select("ca", F.explode(F.concat("codes", any_)).alias("cb")).groupBy("ca", "cb").agg(F.count("*").alias("both"))
    counts = checkpoint(counts)  # at most a row for each target and k-mer
    if n_cells is None:
        n_cells = (counts.where("ca = -1 and cb = -1").first() or {"both": 0})["both"]
    n = counts.where("ca = -1 and cb >= 0")
    pairs = counts.where("ca >= 0 and cb >= 0").join(n.select(F.col("cb").alias("ca"), F.col("both").alias("n_a")), "ca").join(n.select("cb", F.col("both").alias("n_b")), "cb")
    # letters and their numbers have different orders
    return _with_tails(pairs.select(_letters("ca", k).alias("a"), _letters("cb", k).alias("b"), "n_a", "n_b", "both").where("b > a"), n_cells)


def cooccurrence(positions: DataFrame, key: str, cells: int, targets: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, both, p: cells that k-mers share, a of targets (kmer) and b > a, with the binomial chance of so many or more.

    The pairs are of k-mers in one cell, at most a stretch's width squared.
    """
    n = positions.groupBy("kmer").agg(F.count("*").alias("n"))
    a = positions.join(targets.select("kmer"), "kmer").withColumnRenamed("kmer", "a")
    pairs = a.join(positions.withColumnRenamed("kmer", "b"), [key, "bin"]).where("b > a").groupBy("a", "b").agg(F.count("*").alias("both"))
    pairs = pairs.join(n.withColumnsRenamed({"kmer": "a", "n": "n_a"}), "a").join(n.withColumnsRenamed({"kmer": "b", "n": "n_b"}), "b")
    return _with_tails(pairs, cells)


def _with_tails(pairs: DataFrame, cells: int) -> DataFrame:
    @F.pandas_udf("double")
    def tail(both: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        chance = {}  # few different triples among many pairs
        for key in zip(both.tolist(), n_a.tolist(), n_b.tolist(), strict=True):
            if key not in chance:
                chance[key] = binomial_tail(key[0], cells, key[1] / cells * (key[2] / cells))
        return pd.Series([chance[k] for k in zip(both.tolist(), n_a.tolist(), n_b.tolist(), strict=True)])

    return pairs.select("a", "b", "n_a", "n_b", "both", tail("both", "n_a", "n_b").alias("p"))


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(X >= x) for n draws at p."""
    if x <= 0:
        return 1.0
    if p <= 0 or p >= 1:
        return float(p >= 1)
    if x > n:
        return 0.0
    lower = x <= n * p
    k = x - 1 if lower else x  # the greatest term of the side that is summed
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term = 0.0, 1.0  # in units of that term
    while 0 <= k <= n and term > total * 1e-16:
        total += term
        term *= k / (n - k + 1) * (1 - p) / p if lower else (n - k) / (k + 1) * p / (1 - p)
        k += -1 if lower else 1
    side = math.exp(min(0.0, log_term + math.log(total)))
    return 1.0 - side if lower else side


def regressions(pairs: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """by, n, slope, intercept, t: least squares of y on x in each group; t of the slope, null without spread."""
    out = pairs.groupBy(by).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("_r2")
    )
    t = F.when((F.col("n") > 2) & (F.col("_r2") < 1), F.signum("slope") * F.sqrt(F.col("_r2") * (F.col("n") - 2) / (1 - F.col("_r2"))))
    return out.select(by, "n", "slope", "intercept", t.alias("t"))


def residuals(pairs: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """pairs with residual: y less the group's line at x."""
    line = regressions(pairs, by, x, y).select(by, "slope", "intercept")
    return pairs.join(line, by).withColumn("residual", F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))).drop("slope", "intercept")


def with_p(lines: DataFrame) -> DataFrame:
    """regressions()' rows with p, the chance of so steep a slope either way: Student's t of n - 2 degrees of freedom."""

    @F.pandas_udf("double")
    def two_sided(t: pd.Series, n: pd.Series) -> pd.Series:
        free = np.maximum(n.to_numpy(float) - 2, 1)
        return pd.Series(incomplete_beta(free / 2, np.full(len(free), 0.5), free / (free + t.to_numpy(float) ** 2)))

    return lines.withColumn("p", F.when(F.col("t").isNotNull(), two_sided("t", "n")))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, over arrays; nan stays nan."""
    flip = x > (a + 1) / (a + b + 2)  # the fraction settles fast on the other side
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    z = np.clip(z, 1e-300, 1 - 1e-16)
    gamma = np.array([math.lgamma(i + j) - math.lgamma(i) - math.lgamma(j) for i, j in zip(p, q, strict=True)])
    front = np.exp(gamma + p * np.log(z) + q * np.log1p(-z)) / p
    c, d = np.ones_like(z), 1 / (1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 300):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            h = h * d * c
        if np.nanmax(np.abs(c * d - 1), initial=0) < 1e-15:
            break
    return np.where(flip, 1 - front * h, front * h)


def ranks(rows: DataFrame, by: Column, key: str) -> DataFrame:
    """rows with rank from 0, least first, ties by key."""
    from .coverage import with_rank

    return with_rank(rows, by, key).withColumn("rank", F.col("rank") - 1)


def step_cut(rows: DataFrame, fdr: float, key: str, p: str = "p", by: str = "slope") -> DataFrame:
    """Rows with p under (rank / m) * fdr, rank from 0 by `by`, greatest first, as the older scripts rank."""
    rows = checkpoint(rows)
    m = rows.count()
    return ranks(rows, F.col(by).desc(), key).where(F.col(p) < F.col("rank") / m * fdr) if m else rows.withColumn("rank", F.lit(0))


def benjamini_hochberg(rows: DataFrame, fdr: float, key: str, p: str = "p") -> DataFrame:
    """Rows up to the last whose p, in rising order, is at most rank / m * fdr."""
    rows = checkpoint(rows)
    m = rows.count()
    placed = checkpoint(ranks(rows, F.col(p), key).withColumn("rank", F.col("rank") + 1))
    last = placed.where(F.col(p) <= F.col("rank") / max(m, 1) * fdr).agg(F.max("rank").alias("_last"))
    return placed.join(F.broadcast(last)).where(F.col("rank") <= F.col("_last")).drop("_last")  # one row


def _stretch_scores(text: Column, columns: list[dict[str, float]], least: int) -> list[list[Column]]:
    """By width from least on: scores of all stretches of the text so wide laid over all places of the matrix."""
    k = len(columns)
    places = lambda width: [(at, z) for at in range(k - width + 1) for z in range(k - width + 1)]
    return [[literal_score(F.substring(text, z + 1, width), columns[at : at + width]) for at, z in places(width)] for width in range(least, k + 1)]


def subseq_scores(kmer_list: DataFrame, columns: list[dict[str, float]], least: int = 5) -> DataFrame:
    """kmer, total, most, widths: over all stretches of least to k bases of a k-mer laid over all places of the matrix, on the better strand; widths holds the most of each width."""
    sides = []
    for text in (F.col("kmer"), revcomp(F.col("kmer"))):
        scores = _stretch_scores(text, columns, least)
        flat = F.array(*[x for some in scores for x in some])
        total = F.aggregate(flat, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
        sides.append((total, F.array_max(flat), F.array(*[F.array_max(F.array(*some)) for some in scores])))
    (fs, fm, fw), (rs, rm, rw) = sides
    return kmer_list.select(
        "kmer",
        F.greatest(fs, rs).alias("total"),
        F.greatest(fm, rm).alias("most"),
        F.zip_with(fw, rw, lambda a, b: F.greatest(a, b)).alias("widths"),
    )


def _side_scores(codes: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one strand's k-mers as rows of base numbers: the sum and the most of all stretches' scores, and the most of each width; nan where a stretch has no score."""
    n, k = codes.shape
    total, tops = np.zeros(n), []
    for width in range(least, k + 1):
        top = np.full(n, np.nan)
        for at in range(k - width + 1):
            for z in range(k - width + 1):
                score = table[at][codes[:, z]]
                for j in range(1, width):
                    score = score + table[at + j][codes[:, z + j]]
                total = total + np.nan_to_num(score)
                top = np.fmax(top, score)
        tops.append(top)
    widths = np.stack(tops, axis=1)
    return total, np.fmax.reduce(widths, axis=1), widths


def matrix_scores(kmer_list: DataFrame, matrices: dict[str, list[dict[str, float]]], least: int = 5) -> DataFrame:
    """matrix, kmer, total_rank, share, most_rank, width_rank of k-mers under each matrix, of at least `least` columns: ranks from 0 of the summed and of the greatest score
    of subseq_scores(), the sum scaled from 0 to 1, the greatest of the ranks by width.

    One pass scores all matrices, which become rows; each matrix ranks its at most 4^k k-mers, ties go by k-mer.
    """
    tables = {name: np.array([[c[b] for b in "ACGT"] + [np.nan] for c in columns], np.float64) for name, columns in matrices.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kmers = batch.column(0)
            texts = kmers.to_pylist()
            for name, table in tables.items():
                k = len(table)
                strands = np.full((2, len(texts), k), 4, np.uint8)
                for row, text in enumerate(texts):
                    own = numbers(text)
                    for side, seq in zip(strands, (own, COMPLEMENTS[own[::-1]]), strict=True):
                        side[row, : min(k, len(seq))] = seq[:k]
                sides = [_side_scores(x, table, least) for x in strands]
                total, most, widths = (np.fmax(one, two) for one, two in zip(*sides, strict=True))
                offsets = pa.array(np.arange(len(texts) + 1) * widths.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(widths.ravel(), from_pandas=True))
                columns = [pa.array([name] * len(texts), pa.string()), kmers, pa.array(total), pa.array(most, from_pandas=True), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["matrix", "kmer", "total", "most", "widths"])

    rows = kmer_list.select("kmer").mapInArrow(run, "matrix string, kmer string, total double, most double, widths array<double>")
    rank = lambda c: F.row_number().over(Window.partitionBy("matrix").orderBy(c, "kmer")) - 1
    everything = Window.partitionBy("matrix")
    low, high = F.min("total").over(everything), F.max("total").over(everything)
    each = [F.when(F.size("widths") > k, rank(F.get("widths", F.lit(k)))) for k in range(max(map(len, matrices.values()), default=least) - least + 1)]
    return rows.select(
        "matrix",
        "kmer",
        rank("total").alias("total_rank"),
        F.when(high > low, (F.col("total") - low) / (high - low)).otherwise(F.lit(0.0)).alias("share"),
        rank("most").alias("most_rank"),
        (F.greatest(*each) if len(each) > 1 else each[0]).alias("width_rank"),
    )


def likelihood_ratio(scores: DataFrame, one: str = "m1", two: str = "m2", joint: str = "joint") -> DataFrame:
    """set1, set2 rows' log scores (columns set, m1, m2, joint) to one row: -2 log L(joint) + 2 (log L1 + log L2)."""
    own = F.when(F.col("set") == 1, F.log(one)).otherwise(F.log(two))
    return scores.agg((-2 * F.sum(F.log(joint)) + 2 * F.sum(own)).alias("ratio"))


def drawn(*parts) -> Column:
    """The first 15 hexadecimal digits of md5 of the parts, colon-joined, as a number: a draw that other engines can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def random_sequences(rows: DataFrame, key: str = "id", length: str = "length", seed: int = 1) -> DataFrame:
    """key, seq: for each row as many bases as its length, drawn alike; rows without a length of 1 or more are left out; reruns agree."""
    letters = rows.where(F.col(length) >= 1).select(key, F.explode(F.sequence(F.lit(1), F.col(length).cast("int"))).alias("i"))
    digit = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("i").cast("string"))), 1, 1)
    base = F.substring(F.lit("ACGT"), ((F.instr(F.lit("0123456789abcdef"), digit) - 1) % 4 + 1).cast("int"), F.lit(1))
    each = letters.select(key, "i", base.alias("b"))
    # one sequence's bases
    return each.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]), "").alias("seq")
    )


def random_windows(peaks: DataFrame, n: int, width: int, seed: int = 1) -> DataFrame:
    """i, chr, start, end: windows, chromosomes drawn by their greatest start, starts uniform up to it. Draws meet chromosomes by bins of the joint coordinate."""
    sizes = peaks.groupBy("chr").agg(F.max("s").alias("most"))
    ends = sizes.withColumn("hi", F.sum("most").over(Window.orderBy("chr"))).withColumn("lo", F.col("hi") - F.col("most"))  # a row a chromosome
    total = ends.agg(F.max("hi")).first()[0] or 0
    at = F.pmod(drawn(str(seed), F.col("id")), F.lit(max(total, 1)))
    draws = peaks.sparkSession.range(n).select(F.col("id").alias("i"), F.lit(0).alias("chr"), at.alias("s"), at.alias("e"))
    places = ends.select(F.lit(0).alias("chr"), F.col("lo").alias("s"), (F.col("hi") - 1).alias("e"), F.col("chr").alias("name")).where("e >= s")
    pairs = interval_join(draws, places, lambda: F.col("l_s").between(F.col("r_s"), F.col("r_e")), width=max(1, total // 256))
    start = F.col("l_s") - F.col("r_s")
    return pairs.select(F.col("l_i").alias("i"), F.col("r_name").alias("chr"), start.alias("start"), (start + width).alias("end"))
