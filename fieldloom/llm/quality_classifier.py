"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks of ``2 * HALF`` bytes, one every ``HALF`` bytes. Learned
filters of ``WIDTH`` bytes, one every ``STRIDE`` bytes, are rectified and averaged over a chunk. A learned rectified
layer reads these channels in every chunk, its units are max-pooled over all chunks of the document, and a logistic
unit gives the probability.

A filter's response to a byte at an offset is a table entry, so that a response is a sum of ``WIDTH`` lookups.
Training follows the maxima back to the chunks they came from (Adam, log loss). It uses at most ``MAX_ROWS``
labelled rows, those with the least hash of their id, whole and of any length, as long as they hold ``MAX_TRAIN_BYTES``
together: a row that does not fit any more is passed over. Scoring reads whole texts.

Defined results: an empty table gives no rows; a null or empty text is one chunk of padding; a very long text is all its
chunks; ties in the hash of the id go by id and label; a score of the threshold itself is good; without labelled rows of
both classes every score is the share of good rows, or 0.5 without labelled rows; rows are judged one by one, so that
null ids, repeated ids and repeated rows change nothing; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, fold, id_and_text, labels, record_batch, sliced
from .toxicity import labelled_sample

#: Labelled rows that the network is fitted on, and their bytes, at most.
MAX_ROWS = 3_000
MAX_TRAIN_BYTES = 24 << 20
HALF = 64
WIDTH = 6
STRIDE = 2
FILTERS = 16
UNITS = 16
THRESHOLD = 0.5
SCAN = 1 << 19


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each behind HALF zeros and filled up to two or more halves; and each text's number of halves."""
    halves = np.array([max(2, -(-len(t) // HALF)) for t in texts], np.int64)
    data = b"".join(part for t, k in zip(texts, halves.tolist(), strict=True) for part in (bytes(HALF), t, bytes(k * HALF - len(t))))
    return np.frombuffer(data + bytes(HALF), np.uint8), halves


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "table": rng.normal(0, 0.4, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "units": rng.normal(0, 0.5, (FILTERS, UNITS)).astype(np.float32),
            "unit_bias": np.zeros(UNITS, np.float32),
            "out": rng.normal(0, 0.3, UNITS).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def responses(self, data: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
        """Rectified filters at every STRIDE-th byte (the last half apart), or at given places."""
        if places is None:
            n = (len(data) - HALF) // STRIDE
            out = np.take(self.p["table"][0], data[0 : n * STRIDE : STRIDE], axis=0)
            for k in range(1, WIDTH):
                out += np.take(self.p["table"][k], data[k : k + n * STRIDE : STRIDE], axis=0)
        else:
            out = sum(self.p["table"][k][data[places + k]] for k in range(WIDTH))
        out += self.p["bias"]
        return np.maximum(out, 0, out=out)

    def channels(self, data: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Channels of every chunk, the text of every chunk, and the chunk's first half."""
        per_half = self.responses(data).reshape(-1, HALF // STRIDE, FILTERS).mean(axis=1)
        first = np.cumsum(halves + 1) - halves  # behind the zeros
        text = np.repeat(np.arange(len(halves)), halves - 1)
        offset = np.arange(len(text)) - np.repeat(np.cumsum(halves - 1) - (halves - 1), halves - 1)
        at = first[text] + offset
        return (per_half[at] + per_half[at + 1]) / 2, text, at

    def forward(self, data: np.ndarray, halves: np.ndarray):
        channels, text, at = self.channels(data, halves)
        units = np.maximum(channels @ self.p["units"] + self.p["unit_bias"], 0)
        starts = np.cumsum(halves - 1) - (halves - 1)
        pooled = np.maximum.reduceat(units, starts, axis=0)
        logit = pooled @ self.p["out"] + self.p["out_bias"][0]
        return logit, pooled, units, channels, at, starts

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        logit = self.forward(*laid_out(texts))[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def gradients(self, texts: list[bytes], y: np.ndarray, ridge: float) -> dict[str, np.ndarray]:
        data, halves = laid_out(texts)
        logit, pooled, units, channels, at, starts = self.forward(data, halves)
        g = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)).astype(np.float32)
        grad = {"out": pooled.T @ g + ridge * self.p["out"], "out_bias": np.array([g.sum()], np.float32)}
        d_pool = g[:, None] * self.p["out"] * (pooled > 0)
        ends = np.append(starts[1:], len(units))
        top = np.stack([units[a:b].argmax(axis=0) + a for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        chunk, back = np.unique(top.ravel(), return_inverse=True)
        d_unit = np.zeros((len(chunk), UNITS), np.float32)
        np.add.at(d_unit, (back, np.tile(np.arange(UNITS), len(texts))), d_pool.ravel())
        grad["units"] = channels[chunk].T @ d_unit + ridge * self.p["units"]
        grad["unit_bias"] = d_unit.sum(axis=0)
        d_channel = d_unit @ self.p["units"].T / (2 * HALF // STRIDE)
        places = (at[chunk][:, None] * HALF + np.arange(0, 2 * HALF, STRIDE)[None, :]).ravel()
        d_place = np.repeat(d_channel, 2 * HALF // STRIDE, axis=0) * (self.responses(data, places) > 0)
        table = np.zeros_like(self.p["table"])
        for k in range(WIDTH):
            flat = (data[places + k].astype(np.int64)[:, None] * FILTERS + np.arange(FILTERS)).ravel()
            table[k] = np.bincount(flat, d_place.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        grad["table"] = table + ridge * self.p["table"]
        grad["bias"] = d_place.sum(axis=0)
        return grad

    def fit(self, texts: list[bytes], labels_: list[int], epochs: int = 10, batch: int = 32, rate: float = 0.01, ridge: float = 1e-5, seed: int = 11) -> Network:
        y = np.array(labels_, np.float32)
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.p["out_bias"][:] = np.log(y.mean() / (1 - y.mean()))
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps = max(epochs * -(-len(y) // batch), 300)
        t = 0
        while t < steps:
            for part in np.array_split(rng.permutation(len(y)), -(-len(y) // batch)):
                t += 1
                for k, g in self.gradients([texts[i] for i in part], y[part], ridge).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    now = rate * (0.1 + 0.9 * (1 - min(1.0, t / steps)))
                    self.p[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
        return self


def train(docs: DataFrame, truth: DataFrame, allowed: Column, limit: int = MAX_ROWS) -> Network:
    sample = checkpointed(labelled_sample(docs, truth, "quality", allowed, limit))
    # one row of numbers for each of the sampled rows
    sizes = sample.select(F.xxhash64("doc_id").alias("h"), "doc_id", "y", F.xxhash64("text").alias("t"), F.octet_length("text").alias("size")).orderBy("h", "doc_id", "y", "t").collect()
    left, chosen = MAX_TRAIN_BYTES, []
    for r in sizes:
        if r["size"] <= left:
            left -= r["size"]
            chosen.append(r["doc_id"])
    rows = sample.where(F.col("doc_id").isin(chosen)).select("doc_id", "y", "text").orderBy("doc_id", "y", "text").toArrow()
    return Network().fit([t.encode() for t in rows.column("text").to_pylist()], rows.column("y").to_pylist())


def scored(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for batch in sliced(batches, SCAN):
            yield record_batch(schema, [batch.column(0), shared.value.scores([t.encode() for t in batch.column(1).to_pylist()])])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    network = train(docs, labels(spark, sf_dir), fold(F.col("doc_id"), 3) != 1)
    return scored(docs, network).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
