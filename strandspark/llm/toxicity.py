"""Toxicity by weak supervision.

1. Voters. Labelled rows of a bounded sample are dealt over CROSS folds. For each fold lexicons are written from the other
   folds: terms (words and word stems) uneven beyond chance are dealt over lexicons by how telling they are, toxic ones and clean
   ones. On the fold's own rows, whose labels it never saw, a lexicon votes toxic (1) for a toxic term, else clean (0) for a clean one, else
   abstains (-1); pattern voters look at shouting, exclamation runs and symbols.
2. A generative label model learns, from the votes alone, the share of toxic rows, each voter's rates of every vote given the class
   (expectation maximisation) and the pairwise correlations of voters given the class: a voter's log-likelihood ratio
   is divided by one plus its summed correlations with others. The given label, which may err, is one more voter: how far to trust it
   is learnt like any other's accuracy.
3. A linear classifier on words and stems is trained on the posteriors of the same sample; its terms are chosen by them too.

Scoring reads whole texts of all documents and carries only the classifier, at most MAX_TERMS weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, mix, real_id, text_hash

#: Labelled rows that the model is fitted on, at most; taken in the order of a hash of doc_id.
SAMPLE = 16_000
#: Different words of a sampled row that the model is fitted on, at most: those of least hash. Scores read all words.
ROW_WORDS = 1_024
#: Folds of the sample; lexicons that vote on one are written from the others.
CROSS = 4
#: Terms of the classifier, at most.
MAX_TERMS = 4_096
#: Nats by which a term's split must surprise for a clean lexicon, a toxic one, the classifier.
TELLING = (11.0, 9.0, 5.0)
STEMS = (4, 5, 6)
LEXICONS = 12
FOLDS = 5
WORDS = re.compile(r"\w+")
PATTERNS = (re.compile(r"!{2,}"), re.compile(r"\b[A-Z]{4,}\b"), re.compile(r"[@#$%&*]{3,}"))
RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def fold():
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


def held_out():
    return F.coalesce(fold() == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(toxic, text) of at most `sample` labelled ids outside the held-out fold. A document labelled twice counts by its mean, 0.5 is toxic; of several rows of one id that of the least text hash is taken."""
    picked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    picked = picked.where(fold() != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_hash().alias("hash"))
    found = texts.join(F.broadcast(picked), "doc_id")  # picked: SAMPLE rows at most
    return found.groupBy("doc_id", "toxic").agg(
        F.min_by("text", F.struct("hash", "text")).alias("text")
    ).select(F.col("toxic").cast("long").alias("toxic"), "text")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, words, hits): each document's different words, space-joined, and which patterns it has."""
    for batch in batches:
        y, words, hits = [], [], []
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            y.append(toxic)
            different = set(WORDS.findall(text.lower()))
            if len(different) > ROW_WORDS:
                different = sorted(different, key=lambda w: (zlib.crc32(w.encode()), w))[:ROW_WORDS]
            words.append(" ".join(sorted(different)))
            hits.append(sum(1 << k for k, p in enumerate(PATTERNS) if p.search(text)))
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()), pa.array(words, pa.string()), pa.array(hits, pa.int64())], names=["toxic", "words", "hits"])


def label_model(votes: np.ndarray, prior: float | None = None, rounds: int = 50) -> np.ndarray:
    """P(toxic) of each row of votes (1, 0, -1 abstains): accuracies by expectation maximisation, correlations by residuals.

    prior: the share of toxic rows, learnt with the rest if None. Abstaining is no evidence. Class 1 starts as the rows with toxic votes.
    """
    m = votes.shape[1]
    values = np.array([1, 0, -1])
    said = (votes[:, :, None] == values).astype(np.float32)  # row, voter, what it says
    toxic = (votes == 1).sum(1)
    post = np.where(toxic >= 2, 0.9, np.where(toxic == 1, 0.5, 0.02))
    discount = np.ones(m)
    for k in range(rounds):
        weight = np.stack([1 - post, post])
        rates = np.einsum("cn,nmv->cmv", weight, said) + np.array([[1.0, 2.0, 1.0], [2.0, 1.0, 1.0]])[:, None, :]
        rates /= rates.sum(2, keepdims=True)
        learnt = float(np.clip(post.mean(), 1e-3, 0.5))
        share = learnt if prior is None else prior
        if k:  # correlations given the class shrink a voter's say
            total = np.zeros((m, m))
            for c in (0, 1):
                w = weight[c] / max(weight[c].sum(), 1e-9)
                x = said[:, :, 0] - w @ said[:, :, 0]
                cov = (x * w[:, None]).T @ x
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
                total += np.maximum(cov / np.outer(sd, sd), 0) * (learnt if c else 1 - learnt)
            discount = 1 / (1 + np.maximum(total.sum(1) - np.diag(total), 0))
        ratio = np.log(rates[1] / rates[0])
        ratio[:, 2] = 0
        logit = np.log(share / (1 - share)) + (np.einsum("nmv,mv->nm", said, ratio) * discount).sum(1)
        new = _sigmoid(logit)
        if k > 4 and np.abs(new - post).max() < 1e-4:
            return new
        post = new
    return post


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def without_copies(rows: list[tuple[int, list[str], int]]) -> list[tuple[int, list[str], int]]:
    """One of each group of near copies, by min-hashes of the words: copies would make any of their words telling."""
    kept, seen = [], set()
    for row in rows:
        h = np.array([zlib.crc32(w.encode()) for w in row[1]] or [0], np.uint64)
        least = [int(mix(h + np.uint64(k << 33)).min()) for k in range(12)]
        bands = {(k, *least[k : k + 3]) for k in range(0, 12, 3)}
        if not bands & seen:
            kept.append(row)
        seen |= bands
    return kept


class _Terms:
    """Which rows have which terms, as pairs: term, row, and the terms' names."""

    def __init__(self, rows: list[tuple[int, list[str], int]]) -> None:
        number: dict[str, int] = {}
        of_word: dict[str, np.ndarray] = {}
        parts = []
        for _, words, _ in rows:
            for w in words:
                if w not in of_word:
                    of_word[w] = np.array([number.setdefault(t, len(number)) for t in terms_of(w)], np.int32)
            parts.append(np.unique(np.concatenate([of_word[w] for w in words])) if words else np.zeros(0, np.int32))
        self.names = list(number)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(p) for p in parts])
        self.term = np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def split(self, y: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each term over these rows (a mask): how many have it, how surprising its split by y is in nats (below 0: fewer toxic), its odds."""
        pairs = rows[self.row]
        many = np.bincount(self.term[pairs], minlength=len(self.names)).astype(float)
        a = np.bincount(self.term[pairs], y[self.row[pairs]], len(self.names))
        prior = float(np.clip(y[rows].mean(), 1e-6, 1 - 1e-6))
        q = np.clip(a / np.maximum(many, 1), 1e-12, 1 - 1e-12)
        far = many * (q * np.log(q / prior) + (1 - q) * np.log((1 - q) / (1 - prior)))
        return many, np.where(q > prior, far, -far), np.log((a + 0.5) / (many - a + 0.5))


def cross_votes(terms: _Terms, y: np.ndarray, hits: np.ndarray, fold_of: np.ndarray) -> np.ndarray:
    """Votes on each fold's rows of voters made from the others: 2 * LEXICONS of words and of stems, and the patterns."""
    votes = np.full((len(y), 2 * LEXICONS + len(PATTERNS)), -1, np.int8)
    stem = np.array([t.endswith("*") for t in terms.names], bool)
    for f in range(CROSS):
        others = fold_of != f
        if not 0 < y[others].sum() < others.sum():
            continue
        many, far, odds = terms.split(y, others)
        own = ~others[terms.row]
        # clean lexicons first, so that toxic terms have the last word
        for say, chosen in ((0, (many >= 3) & (far < -TELLING[0])), (1, (many >= 3) & (far > TELLING[1]) & (odds > 1))):
            telling = np.flatnonzero(chosen)
            telling = telling[np.lexsort((telling, -np.abs(far[telling])))][: MAX_TERMS // 2]
            voter = np.full(len(terms.names), -1)
            voter[telling] = np.arange(len(telling)) % LEXICONS + LEXICONS * stem[telling]
            pairs = own & (voter[terms.term] >= 0)
            votes[terms.row[pairs], voter[terms.term[pairs]]] = say
        for k in range(len(PATTERNS)):
            hit = hits >> k & 1 > 0
            rate = (y[hit & others].sum() + 0.5) / ((hit & others).sum() + 1) / y[others].mean()
            votes[hit & ~others, 2 * LEXICONS + k] = 1 if rate > 2 else 0 if rate < 0.5 else -1
    return votes


def train(rows: list[tuple[int, list[str], int]]) -> tuple[dict[str, float], float]:
    """Weights by term and the bias. Without rows of both classes: no weights, a bias of the share of toxic rows."""
    rows = without_copies(rows)
    y = np.array([r[0] for r in rows], float)
    positives = int(y.sum())
    prior = (positives + 0.5) / (len(y) + 10)
    if not 0 < positives < len(y):
        return {}, float(np.log(prior / (1 - prior)))
    terms = _Terms(rows)
    # rows are in the order of label and words: every fold gets its share of both labels
    votes = cross_votes(terms, y, np.array([r[2] for r in rows]), np.arange(len(y)) % CROSS)
    post = label_model(np.column_stack((votes, y.astype(np.int8))), prior)
    # the classifier: the terms that split the posteriors most unevenly, either way
    many, far, _ = terms.split(post, np.ones(len(y), bool))
    chosen = np.flatnonzero((many >= 3) & (np.abs(far) > TELLING[2]))
    chosen = chosen[np.lexsort((chosen, -np.abs(far[chosen])))][:MAX_TERMS]
    place = np.full(len(terms.names), -1)
    place[chosen] = np.arange(len(chosen))
    pairs = place[terms.term] >= 0
    row, col = terms.row[pairs], place[terms.term[pairs]]
    w, b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, 401):
        err = (_sigmoid(b + np.bincount(row, w[col], len(y))) - post) / len(y)
        g = np.bincount(col, err[row], len(w)) + 2e-6 * w
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        b -= 0.05 * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-9)
    return {terms.names[t]: float(x) for t, x in zip(chosen, w, strict=True) if abs(x) > 0.02}, float(b)


class Scores(dict):
    """Weight of a word, its stems included."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        self[word] = s = sum(self.weights.get(t, 0.0) for t in terms_of(word))
        return s


def text_score(text: str, words: Scores, bias: float) -> float:
    # each stem counts once, as in training
    logit = bias
    stems: set[str] = set()
    for w in set(WORDS.findall(text.lower())):
        if words[w]:
            stems.update(terms_of(w))
    logit += sum(words.weights.get(t, 0.0) for t in sorted(stems))
    return 1 / (1 + float(np.exp(-np.clip(logit, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    found = training_rows(docs, labels, sample).mapInArrow(_terms, "toxic long, words string, hits long")
    rows = sorted(tuple(r) for r in found.toLocalIterator())  # SAMPLE rows of ROW_WORDS words at most
    same: dict[str, str] = {}  # a word is held once
    return train([(toxic, [same.setdefault(w, w) for w in words.split()], hits) for toxic, words, hits in rows])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Null and empty texts get the bias alone. A null doc_id is not held out and never learnt from. Repeated rows score
    alike. Without labels of both classes all scores are the share of toxic rows. An empty table gives no rows.
    """
    weights, bias = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Scores(weights)
        for batch in batches:
            scores = [text_score(t, words, bias) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], schema=RESULT)

    rows = keyed(docs.withColumn("held_out", held_out()), "held_out").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return rows.select(real_id(), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that aren't predicted toxic, unchanged.

    Null and empty texts are judged by the bias alone, repeated rows alike; doc_ids play no part but in learning. An empty table
    gives no rows.
    """
    weights, bias = fit(docs, labels, sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Scores(weights)
        for batch in batches:
            yield batch.filter(pa.array([text_score(t or "", words, bias) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
