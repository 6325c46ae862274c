"""A linear quality classifier over hashed word n-grams.

Features are hashes of words, word pairs, word shapes and shape pairs. A word's shape is which classes of
characters (letters of either case, digits, each other sign) follow one another in it, so that it also says
something of words never seen. A feature's value is its share of its kind's n-grams. The model is a logistic
regression trained in one pass by follow-the-regularised-leader updates, and a score is the sigmoid of a
sparse dot product.

The training sample is bounded: SAMPLE labelled rows at most, those whose ids hash lowest. Scoring covers
every row and whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm import batch

#: Labelled rows that the model is fitted on, at most; so many ids are broadcast.
SAMPLE = 8192
BITS = 18
#: What a kind's values add up to: n-grams' shares are small numbers.
SCALE = 20.0
KINDS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-5, 1e-4
HOLD_OUT = 5
THRESHOLD = 0.3

_U = np.uint64
_CLASS = np.arange(256, dtype=np.int64) + 3
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 0
_STEP = batch.random_values(260 * 260, 11)


def _shape_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of each word's first class and changes of class, in whatever order they come."""
    kind = _CLASS[data]
    change = np.zeros(len(data), _U)
    if len(data) > 1:
        moved = kind[1:] != kind[:-1]
        change[1:][moved] = _STEP[kind[:-1][moved] * 260 + kind[1:][moved]]
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(change)))
    return batch.mix(sums[end] - sums[np.minimum(start + 1, len(data))] + _STEP[kind[start]])


def features(chunk: batch.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: feature numbers, values, and each one's row, in no order; a feature may come repeatedly."""
    words = batch.words_of(chunk, lower=True)
    shape = _shape_hash(chunk.data, words.start, words.end)
    out = []
    share = SCALE / np.maximum(words.counts, 1)
    pair_share = SCALE / np.maximum(words.counts - 1, 1)
    together = words.row[1:] == words.row[:-1]
    for kind, values in enumerate((words.hash, shape)):
        single = batch.mix(values + _U(kind + 1))
        pair = batch.mix(values[:-1] * _U(0xA0761D6478BD642F) + values[1:] + _U(kind + 11))[together]
        out.append((single, share[words.row], words.row))
        out.append((pair, pair_share[words.row[1:][together]], words.row[1:][together]))
    number = np.concatenate([x[0] for x in out]) >> _U(64 - BITS)
    return number.astype(np.int64), np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out])


class Ftrl:
    """Logistic regression by FTRL-proximal updates, one example at a time; the last weight is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _train(batches):
    """One task: the sample in its order, once. Yields the weights."""
    model = Ftrl(1 << BITS)
    for b in batches:
        quality = b.column("quality").to_pylist()
        for chunk in batch.chunks(b.column("text")):
            number, value, row = features(chunk)
            order = np.argsort(row, kind="stable")
            number, value = number[order], value[order]
            bounds = np.searchsorted(row[order], np.arange(chunk.rows + 1))
            for i in range(chunk.rows):
                part = slice(bounds[i], bounds[i + 1])
                at, inverse = np.unique(number[part], return_inverse=True)
                x = np.bincount(inverse, value[part], len(at))
                model.learn(np.append(at, 1 << BITS), np.append(x, 1.0), float(quality[chunk.first + i]))
    yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f8").tobytes()], pa.binary())], ["weights"])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels the model never sees. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % HOLD_OUT == 0


def training_sample(documents: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(text, quality, at): labelled rows outside the hold-out, at most `size` labelled ids and a row of each.

    An id's conflicting labels count as the higher one; null ids and labels are left out. Of rows that repeat an id the
    one whose text hashes least counts."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.select("doc_id", "quality", F.xxhash64("doc_id").alias("at")).orderBy("at", "doc_id").limit(size)
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality", "at").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "quality", "at")


def fit(documents: DataFrame, labels: DataFrame, size: int = SAMPLE) -> np.ndarray:
    """Weights, 2**BITS of them and a bias. Without any labelled row all are zero and every score is 0.5."""
    sample = training_sample(documents, labels, size).repartition(1).sortWithinPartitions("at", "text")
    rows = sample.select("text", "quality").mapInArrow(_train, "weights binary").collect()
    return np.frombuffer(rows[0][0], "<f8") if rows else np.zeros((1 << BITS) + 1)


def score(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, score), a row for each row. Null and empty texts get the bias's.

    The weights (2 MB) are broadcast; nothing shuffles."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for b in batches:
            for chunk in batch.chunks(b.column("text")):
                number, value, row = features(chunk)
                total = np.bincount(row, w[number] * value, chunk.rows) + w[-1]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(chunk.first, chunk.rows), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(documents: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """documents -> (doc_id, held_out, score, predicted)."""
    scored = score(documents, fit(documents, labels, size))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The rows of documents that the classifier does not reject, whole. Rows are scored where they are
    read; nothing shuffles."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, size))

    def run(batches):
        w = shared.value
        for b in batches:
            text = b.column("text").cast(pa.string())
            for chunk in batch.chunks(text):
                number, value, row = features(chunk)
                total = np.bincount(row, w[number] * value, chunk.rows) + w[-1]
                good = 1 / (1 + np.exp(-np.clip(total, -35, 35))) >= THRESHOLD
                yield b.slice(chunk.first, chunk.rows).filter(pa.array(good))

    return documents.mapInArrow(run, documents.schema)
