"""Toxicity: a counterfactually regularised classifier.

A document is its distinct lower-case words; a word stands for itself and for its prefixes of 4 to 6 letters,
hashed. A logistic model over the features that differ between the classes is trained with two losses: the usual
one, and the squared change of the score when every identity term of a labelled sentence is swapped, once for another
term of its group and once for a word that says nothing. Neutral mentions of a group thereby stop moving the score.

Every labelled text has a counterpart, whatever the corpus: a text without identity terms gets one of them (by a hash
of its words), and its counterpart another of the same group. Neutral sentences made from ``TEMPLATES`` with every term
are clean rows of their own, which weigh ``TEMPLATE_SHARE`` of the labelled rows together.

The model is fitted on at most ``MAX_ROWS`` labelled rows, those with the least hash of their id, so training
size does not follow the table; scoring reads every whole text.

Defined results: an empty table gives no rows; a null or empty text has the score of the bias alone; a very long text
is the set of all its words; labels whose document is missing or whose value is null are left out; ties in the hash of
the id go by id and label; without labelled rows of both classes every score is the share of toxic rows, or 0; scores of
the threshold itself are toxic; rows are judged one by one, so that null ids, repeated ids and repeated rows change
nothing; extra columns, whatever their names, are ignored, and kept by :func:`without_toxic`.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, id_and_text, labels, record_batch, release, sliced

#: Labelled rows that the classifier is fitted on, at most.
MAX_ROWS = 12_000
BITS = 22
MIN_DOCS = 3
SWAP_WEIGHT = 1.0
THRESHOLD = 0.3
WORDS = regex.compile(r"\p{L}+")
PREFIXES = (4, 5, 6)
#: Groups of identity terms: a term may stand for any other of its group in a neutral sentence.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("frauen", "männer", "mujeres", "hombres", "femmes", "hommes"),
)
NEXT_TERM = {term: group[(i + 1) % len(group)] for group in IDENTITY_GROUPS for i, term in enumerate(group)}
TERMS = tuple(NEXT_TERM)
TEMPLATES = ("the {} went to the market in the morning", "many {} live in this town", "she met {} at the library and they talked about music", "some {} work here")
TEMPLATE_SHARE = 0.02
#: Words whose weight a worker keeps; a full cache is emptied, which changes no result.
CACHE = 500_000


def feature_ids(word: str) -> list[int]:
    names = [f"={word}", *(f"{k}{word[:k]}" for k in PREFIXES if len(word) >= k)]
    return [zlib.crc32(n.encode()) >> (32 - BITS) for n in names]


def words_of(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def swapped(words: set[str]) -> set[str] | None:
    """The words with every identity term swapped; None where there is none."""
    if not any(w in NEXT_TERM for w in words):
        return None
    return {NEXT_TERM.get(w, w) for w in words}


def counterfactual(words: set[str]) -> tuple[set[str], set[str], set[str]]:
    """The words, holding an identity term; with every such term swapped for another; and without them."""
    if (other := swapped(words)) is not None:
        return words, other, {w for w in words if w not in NEXT_TERM}
    term = TERMS[zlib.crc32(" ".join(sorted(words)).encode()) % len(TERMS)]
    return words | {term}, words | {NEXT_TERM[term]}, words


def features_of(words: set[str]) -> list[int]:
    """Ids of the features in order, each as often as it is there: most are there once, so that counts would be half of what is sent."""
    return sorted(f for w in words for f in feature_ids(w))


def change(own: set[str], other: set[str]) -> tuple[list[int], list[int]]:
    """Features whose counts a swap changes, and by how much."""
    found: dict[int, int] = {}
    for words, sign in ((other - own, 1), (own - other, -1)):
        for f in (f for w in words for f in feature_ids(w)):
            found[f] = found.get(f, 0) + sign
    kept = sorted(f for f, n in found.items() if n)
    return kept, [found[f] for f in kept]


def training_row(y: int, words: set[str]) -> tuple:
    """y, ids of the features, and the changes of both swaps."""
    own, *others = counterfactual(words)
    return y, features_of(own), *[x for other in others for x in change(own, other)]


def labelled_sample(docs: DataFrame, truth: DataFrame, label: str, allowed: Column, limit: int) -> DataFrame:
    """doc_id, y, text of the allowed labelled rows with the least hash of their id, ``limit`` at most."""
    known = truth.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = known.where(allowed).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(limit)
    # at most ``limit`` rows of two numbers
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")


class Classifier:
    """Weights of hashed features, and the words' summed weights as they are met."""

    def __init__(self, bias: float, ids: np.ndarray, weights: np.ndarray):
        self.bias = bias
        self.weights = dict(zip(ids.tolist(), weights.tolist(), strict=True))
        self.words: dict[str, float] = {}

    def score(self, text: str) -> float:
        known, total = self.words, self.bias
        if len(known) > CACHE:
            known.clear()
        for w in words_of(text):
            v = known.get(w)
            if v is None:
                v = known[w] = sum(self.weights.get(f, 0.0) for f in feature_ids(w))
            total += v
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -30.0, 30.0))))


def fit(rows: list[tuple], epochs: int = 40, rate: float = 0.3, ridge: float = 1e-4, swap_weight: float = SWAP_WEIGHT) -> Classifier:
    """rows: :func:`training_row` of every labelled text; the neutral sentences are added here."""
    y = np.array([r[0] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Classifier(float(np.log((share + 1e-12) / (1 - share + 1e-12))), np.zeros(0, np.int32), np.zeros(0))
    there = np.zeros((2, 1 << BITS), np.int32)
    for label, ids, *_ in rows:
        there[int(label), np.unique(np.asarray(ids, np.int64))] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()], np.float64)
    # figures only of the features that enough rows have: arrays over all slots would be most of the driver's memory
    often = np.flatnonzero(there[0] + there[1] >= MIN_DOCS)
    seen = there[:, often]
    del there
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    z = odds / np.sqrt(1.0 / (seen[1] + 0.5) + 1.0 / (seen[0] + 0.5))
    # identity terms are features in any case, so that their influence is seen and regularised
    useful = np.union1d(often[(np.abs(z) >= 2.5) & (np.abs(odds) >= 0.7)], [f for term in TERMS for f in feature_ids(term)])
    column = np.full(1 << BITS, -1, np.int32)
    column[useful] = np.arange(len(useful))
    neutral = [training_row(0, words_of(t.format(term))) for t in TEMPLATES for term in TERMS]
    weight = np.concatenate([np.full(len(rows), 1.0), np.full(len(neutral), TEMPLATE_SHARE * len(rows) / len(neutral))])
    weight /= weight.sum()
    rows = [*rows, *neutral]
    y = np.concatenate([y, np.zeros(len(neutral))])

    def sparse(which: int, counts: bool = False):
        row, col, val = [], [], []
        for k, r in enumerate(rows):
            c = column[np.asarray(r[which], np.int64)]
            keep = c >= 0
            c, v = np.unique(c[keep], return_counts=True) if counts else (c[keep], np.asarray(r[which + 1])[keep])
            row.append(np.full(len(c), k))
            col.append(c)
            val.append(v.astype(np.float64))
        return np.concatenate(row), np.concatenate(col), np.concatenate(val)

    r0, c0, v0 = sparse(1, counts=True)
    changes = [sparse(2), sparse(4)]  # x' - x
    del column
    w, b = np.zeros(len(useful)), float(np.log(n[1] / n[0]))
    m, s, mb, sb = np.zeros(len(useful)), np.zeros(len(useful)), 0.0, 0.0
    for t in range(1, epochs * 10 + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(r0, v0 * w[c0], len(y)), -30, 30)))
        g = (p - y) * weight
        grad = np.bincount(c0, v0 * g[r0], len(useful)) + ridge * w
        for rd, cd, vd in changes:
            moved = np.bincount(rd, vd * w[cd], len(y)) * weight
            grad += 2 * swap_weight * np.bincount(cd, vd * moved[rd], len(useful))
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        mb, sb = 0.9 * mb + 0.1 * g.sum(), 0.999 * sb + 0.001 * g.sum() ** 2
        step = rate * 0.2 / (1 + t / 100)
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.999**t)) + 1e-8)
    return Classifier(float(b), useful, w)


def train(docs: DataFrame, truth: DataFrame, allowed: Column, limit: int = MAX_ROWS, swap_weight: float = SWAP_WEIGHT) -> Classifier:
    """A classifier from the allowed labelled rows; features are made where the texts are, and only they are collected."""

    def features(batches):
        schema = pa.schema([("y", pa.int32()), *[(name, pa.list_(pa.int32())) for name in names]])
        for batch in sliced(batches, size_column="text"):
            out = [training_row(y, words_of(text)) for y, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield record_batch(schema, [list(c) for c in zip(*out, strict=True)] if out else [[]] * (1 + len(names)))

    names = ("a", "swapped_a", "swapped_n", "without_a", "without_n")
    sample = labelled_sample(docs, truth, "toxic", allowed, limit)
    found = sample.mapInArrow(features, "y int, " + ", ".join(f"{name} array<int>" for name in names)).toArrow()
    columns = [[x.values.to_numpy()[a:b] for chunk in found.column(k).chunks for x, ends in [(chunk, chunk.offsets.to_numpy())] for a, b in zip(ends[:-1], ends[1:], strict=True)] for k in range(1, 1 + len(names))]
    model = fit(list(zip(found.column(0).to_pylist(), *columns, strict=True)), swap_weight=swap_weight)
    del found, columns
    release()
    return model


def scored(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        own = shared.value
        for batch in sliced(batches):
            yield record_batch(schema, [batch.column(0), [own.score(t) for t in batch.column(1).to_pylist()]])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, truth: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    own = train(docs, truth, fold(F.col("doc_id"), 4) != 2)
    shared = docs.sparkSession.sparkContext.broadcast(own)
    at = docs.columns.index("text")

    def run(batches):
        for batch in sliced(batches):
            keep = [shared.value.score(t or "") < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    own = train(docs, labels(spark, sf_dir), fold(F.col("doc_id"), 4) != 2)
    return scored(docs, own).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
