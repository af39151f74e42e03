"""Language identification by word-first backoff.

Known words are scored by the logarithm of their frequency in each language. A word that is not known falls
back to its character n-grams, from ``ORDERS[0]`` characters down: the longest order of which any n-gram is
known decides, by the mean over the known ones. A document's score is the softmax of its words' summed logs.

Counts cover all training documents, are summed by Spark, and stay there whole. A table of ``CELLS`` numbers, with the
most frequent words and their counts in all languages, is broadcast; how frequent they must be to fit is read off a
histogram. All other words of the texts meet the whole word table in a join. The n-grams are broadcast if there are
``MAX_GRAMS`` of them at most, and are joined beyond that, so that no count is cut and no table outgrows its bound.

Defined results: an empty table gives no rows; a null text or one without a letter is ``und`` with score 0, as is every
text if nothing can be learned; ties go to the language that comes first by code point; very long texts are read whole
and count each of their words; rows are judged one by one, so that null ids, repeated ids and repeated rows change
nothing; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, fold, record_batch, sliced

LETTERS = regex.compile(r"\p{L}+")
ORDERS = (5, 4, 3, 2, 1)
#: Numbers (words x languages) of the table of frequent words, and counts of n-grams, that are broadcast at most.
CELLS = 1 << 21
MAX_GRAMS = 1_000_000
#: Bins of the histogram of word counts for each doubling.
BINS = 16
SMOOTH = 0.5
#: Distinct (language, word) pairs a task counts before it passes its counts on.
FLUSH = 400_000
#: Scored words kept by a worker; a full cache is emptied, which changes no result.
CACHE = 300_000
UNKNOWN = "und"


def grams(word: str, order: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over all rows of (lang, text)."""

    def run(batches):
        schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
        held: dict[str, Counter] = {}

        def flush():
            for lang, found in held.items():
                words, counts = list(found), list(found.values())
                for k in range(0, len(words), 100_000):
                    part = words[k : k + 100_000]
                    yield record_batch(schema, [[lang] * len(part), part, counts[k : k + 100_000]])
            held.clear()

        for batch in sliced(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            if sum(map(len, held.values())) > FLUSH:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_at(padded: Column, size: Column, i: Column) -> Column:
    return F.struct(size.alias("size"), F.substr(padded, i, size).alias("gram"))


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, size, gram, n from counted words."""
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    each = []
    for k in ORDERS:
        last, size = F.length(padded) - k + 1, F.lit(k)
        cut = F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), partial(gram_at, padded, size)))
        each.append(F.coalesce(cut, F.array().cast("array<struct<size:int,gram:string>>")))
    rows = words.select("lang", "n", F.explode(F.concat(*each)).alias("x"))
    return rows.groupBy("lang", "x.size", "x.gram").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies of words and n-grams: a row of one number for each language, and each entry's row."""

    def __init__(self, langs: list[str], words: pa.Table, word_norm: list[float], grams: pa.Table | None, gram_norms: dict[int, list[float]]):
        self.langs = langs
        self.words, self.word_rows = self.table(words, "word", word_norm)
        #: An n-gram's length tells its order, so that one table holds all orders; None: they are not here.
        self.grams: dict[str, int] | None = None
        if grams is not None:
            orders = [self.table(grams.filter(pc.equal(grams["size"], k)), "gram", gram_norms[k]) for k in ORDERS]
            names = [g for index, _ in orders for g in index]
            self.grams = dict(zip(names, range(len(names)), strict=True))
            self.gram_rows = np.concatenate([rows for _, rows in orders])
        self.index: dict[str, int] | None = None  # filled where texts are scored

    def table(self, found: pa.Table, key: str, norm: list[float]) -> tuple[dict[str, int], np.ndarray]:
        entries = found[key].combine_chunks().dictionary_encode()
        at = {lang: i for i, lang in enumerate(self.langs)}
        lang = np.array([at[x] for x in found["lang"].to_pylist()], np.int64)
        names = entries.dictionary.to_pylist()
        counts = np.zeros((len(names), len(self.langs)))
        counts[entries.indices.to_numpy(), lang] = found["n"].to_numpy()
        return dict(zip(names, range(len(names)), strict=True)), (np.log(counts + SMOOTH) - np.array(norm)).astype(np.float32)

    def reset(self) -> None:
        """Forget the words met beside the model's."""
        self.index, self.rows, self.used = dict(self.words), self.word_rows, len(self.words)

    def met(self, words: list[str]) -> np.ndarray:
        """Scores of words that are not in the table, by the longest order of which any n-gram is known; 0 without one."""
        grams_of, ends, known = [], [0], self.grams
        for word in words:
            for order in ORDERS:
                found = [known[g] for g in grams(word, order) if g in known]
                if found:
                    grams_of += found
                    break
            ends.append(len(grams_of))
        counts = np.diff(ends)
        scores = np.zeros((len(words), len(self.langs)), np.float32)
        if grams_of:
            some = counts > 0
            sums = np.add.reduceat(self.gram_rows[np.array(grams_of)], np.array(ends[:-1])[some], axis=0)
            scores[some] = sums / counts[some, None]
        return scores

    def meet(self, words: list[str]) -> None:
        """Keep the scores of words that are not in the table."""
        scores = self.met(words)
        if self.used + len(words) > len(self.rows):
            grown = np.zeros((2 * (self.used + len(words)), len(self.langs)), np.float32)
            grown[: self.used] = self.rows[: self.used]
            self.rows = grown
        self.rows[self.used : self.used + len(words)] = scores
        self.index.update(zip(words, range(self.used, self.used + len(words)), strict=True))
        self.used += len(words)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        if self.index is None or self.used > len(self.words) + CACHE:
            self.reset()
        new = {w for words in found for w in words if w not in self.index}
        if new:
            self.meet(sorted(new))
        out, index = [], self.index
        for words in found:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.rows[np.array([index[w] for w in words])].sum(axis=0, dtype=np.float64)
            best = int(np.argmax(total))
            out.append((self.langs[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out


@dataclass
class Learned:
    """The model that is broadcast, and the whole counts."""

    head: Model
    whole: bool  # all words and n-grams are in the head
    words: DataFrame  # lang, word, n
    grams: DataFrame  # lang, size, gram, n
    word_norm: list[float]
    gram_norms: dict[int, list[float]]


def norms(langs: list[str], totals: dict[str, int], entries: int) -> list[float]:
    return [math.log(totals.get(lang, 0) + SMOOTH * (entries + 1)) for lang in langs]


def count_bin(n: Column) -> Column:
    return F.floor(F.log2(n) * BINS).cast("int")


def learn(docs: DataFrame) -> Learned:
    """A model of all rows of ``docs`` that have a text and a lang."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    words = checkpointed(word_counts(rows))
    counted = checkpointed(gram_counts(words))
    # a row for each language, and for each of them and n-gram length
    totals = {r[0]: r[1] for r in words.groupBy("lang").agg(F.sum("n")).collect()}
    sizes = {(r[0], r[1]): (r[2], r[3]) for r in counted.groupBy("size", "lang").agg(F.sum("n"), F.count(F.lit(1))).collect()}
    distinct = {r[0]: r[1] for r in counted.groupBy("size", "gram").agg(F.lit(1)).groupBy("size").count().collect()}
    langs = sorted(totals)
    by_word = words.groupBy("word").agg(count_bin(F.sum("n")).alias("bin"))
    histogram = sorted(((r[0], r[1]) for r in by_word.groupBy("bin").count().collect()), reverse=True)
    room, least = CELLS // max(1, len(langs)), None
    for place, n in histogram:
        room -= n
        if room < 0:
            break
        least = place
    entries = sum(n for _, n in histogram)
    word_norm = norms(langs, totals, entries)
    gram_norms = {k: norms(langs, {lang: sizes.get((k, lang), (0, 0))[0] for lang in langs}, distinct.get(k, 0)) for k in ORDERS}
    frequent = by_word.where(F.col("bin") >= F.lit(least)).select("word")
    head = words.join(frequent, "word", "left_semi").select("lang", "word", "n").toArrow()
    few_grams = sum(n for _, n in sizes.values()) <= MAX_GRAMS
    grams = counted.select("lang", "size", "gram", "n").toArrow() if few_grams else None
    return Learned(Model(langs, head, word_norm, grams, gram_norms), room >= 0 and few_grams, words, counted, word_norm, gram_norms)


def vectors(counts: DataFrame, key: str, langs: list[str], norm: list[float]) -> DataFrame:
    """key, scores (one for each language) from rows (lang, key, n)."""
    of = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
    held = counts.groupBy(key).agg(of.alias("of"))
    return held.select(key, F.array(*[F.log(F.coalesce(F.col("of")[lang], F.lit(0)) + SMOOTH) - v for lang, v in zip(langs, norm, strict=True)]).alias("scores"))


def backed_off(words: DataFrame, model: Learned, shared) -> DataFrame:
    """word and scores of unseen words (distinct), by their n-grams; words without a known one are left out."""
    langs = model.head.langs
    if model.head.grams is not None:

        def run(batches):
            schema = pa.schema([("word", pa.string()), ("scores", pa.list_(pa.float64()))])
            for batch in batches:
                found = batch.column(0).to_pylist()
                own = shared.value.met(found)
                yield record_batch(schema, [found, own.astype(np.float64).tolist()])

        return words.mapInArrow(run, "word string, scores array<double>")
    rest, scores = checkpointed(words), None
    for k in ORDERS:
        padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
        last = F.length(padded) - k + 1
        cut = rest.where(last >= 1).select("word", F.explode(F.transform(F.sequence(F.lit(1), last), partial(gram_at, padded, F.lit(k)))).alias("x")).select("word", "x.gram")
        table = vectors(model.grams.where(F.col("size") == k).select("lang", "gram", "n"), "gram", langs, model.gram_norms[k])
        met = checkpointed(cut.join(table, "gram").groupBy("word").agg(F.array(*[F.avg(F.col("scores")[i]) for i in range(len(langs))]).alias("scores")))
        scores = met if scores is None else scores.unionByName(met)
        rest = checkpointed(rest.join(met.select("word"), "word", "left_anti"))
    return scores


def predict_joined(docs: DataFrame, model: Learned) -> DataFrame:
    """doc_id, lang_pred, score, by joins of the words outside the head with the whole tables."""
    shared, langs = docs.sparkSession.sparkContext.broadcast(model.head), model.head.langs
    pair = pa.struct([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        own, row = shared.value, TaskContext.get().partitionId() << 40
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("total", pa.list_(pa.float64())), ("rare", pa.list_(pair))])
        known = own.words
        for batch in sliced(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                found = LETTERS.findall(text.lower()) if text else []
                at = [known.get(w, -1) for w in found]
                rare = Counter([w for w, k in zip(found, at, strict=True) if k < 0])
                at = np.array(at, np.int64)
                rows.append((row, len(found), own.word_rows[at[at >= 0]].sum(axis=0, dtype=np.float64), [{"word": w, "n": n} for w, n in rare.items()]))
                row += 1
            if rows:
                ids, sizes, total, rare = (list(c) for c in zip(*rows, strict=True))
                yield record_batch(schema, [ids, batch.column(0), sizes, total, rare])

    def summed(rows: DataFrame) -> list[Column]:
        return [F.sum(F.col("scores")[i] * F.col("n")).alias(f"s{i}") for i in range(len(langs))]

    kinds = "row long, doc_id long, n_words long, total array<double>, rare array<struct<word:string,n:long>>"
    base = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds))
    rare = base.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n")
    known = vectors(model.words, "word", langs, model.word_norm)
    both = rare.join(known, "word", "left")
    unseen = F.collect_list(F.when(F.col("scores").isNull(), F.struct("word", "n")))
    sums = checkpointed(both.groupBy("row").agg(*summed(both), unseen.alias("unseen")))
    open_ = sums.select("row", F.explode("unseen").alias("x")).select("row", "x.word", "x.n")
    more = open_.join(backed_off(open_.select("word").distinct(), model, shared), "word")
    more = more.groupBy("row").agg(*summed(more))
    parts = [base.select("row", *[F.col("total")[i].alias(f"s{i}") for i in range(len(langs))]), sums.drop("unseen"), more]
    scores = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.array(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(len(langs))]).alias("t"))
    best = F.array_max("t")
    lang = F.element_at(F.array(*map(F.lit, langs)), F.array_position("t", best).cast("int"))
    score = 1.0 / F.aggregate("t", F.lit(0.0), lambda s, x: s + F.exp(x - best))
    some = F.col("n_words") > 0
    judged = base.select("row", "doc_id", "n_words").join(scores, "row")
    return judged.select("doc_id", F.when(some, lang).otherwise(UNKNOWN).alias("lang_pred"), F.when(some, score).otherwise(0.0).alias("score"))


def predict(docs: DataFrame, model: Learned) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    if not model.whole:
        return predict_joined(docs, model)
    shared = docs.sparkSession.sparkContext.broadcast(model.head)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
        own = shared.value
        for batch in sliced(batches):
            found = own.predict(batch.column(1).to_pylist())
            yield record_batch(schema, [batch.column(0), [f[0] for f in found], [f[1] for f in found]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs.where(fold(F.col("doc_id"), 4) != 2))
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
