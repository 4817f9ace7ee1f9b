"""Quality classifier: a factorisation machine.

Features of a text: hashed words (relative frequency, root-scaled), structure
statistics and length bins. The score is the logistic of
w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
the low-rank pairwise part in time linear in the features.

Scale: labels choose at most ``max_train`` training rows (smallest hash of
doc_id; a bounded sample of labelled rows; of rows that repeat a doc_id the
smallest text), whose features are made on the executors; the model (BUCKETS x RANK floats) is fixed in size. Scoring is one
scan without a shuffle, on Arrow batches.

Defined results: null text counts as empty and gets the score of no features;
texts of any length are read whole; a corpus without usable labels of both
classes scores 0.5 for every document; rows are scored one by one, so
repeated rows agree; other columns are ignored or carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from playloom.llm.columns import fresh
from playloom.llm.words import _SPACE, chunks, hashed_words, release

BUCKETS = 4096
RANK = 8
STATS = 20
MAX_TRAIN = 6000


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


_UPPER, _LOWERCASE, _DIGIT, _HIGH, _MARK, _STOP, _LINE = (np.zeros(256, bool) for _ in range(7))
_UPPER[65:91] = True
_LOWERCASE[97:123] = True
_DIGIT[48:58] = True
_HIGH[128:] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_STOP[[ord(c) for c in ".,;:?"]] = True
_LINE[10] = True
_BYTE_KINDS = (_UPPER, _LOWERCASE, _DIGIT, _HIGH, _MARK, _STOP, _LINE)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of BUCKETS + STATS floats for each text."""
    n = len(offsets) - 1
    hashes, first = hashed_words(data, offsets)
    counts = np.diff(first)
    owner = np.repeat(np.arange(n), counts)
    slot = (hashes >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)
    words = np.bincount(owner * BUCKETS + slot, minlength=n * BUCKETS).reshape(n, BUCKETS)
    total = np.maximum(counts, 1)[:, None]
    out = np.zeros((n, BUCKETS + STATS), np.float32)
    np.sqrt(words / total, out=out[:, :BUCKETS], casting="unsafe")
    size = np.diff(offsets)
    chars = np.maximum(size - 0, 1)
    edges = np.append(offsets[:-1], len(data))

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[edges[1:]] - sums[edges[:-1]]

    kinds = [per_text(k[data]) for k in _BYTE_KINDS]
    mark = _MARK[data]
    doubled = mark.copy()
    doubled[1:] &= data[1:] == data[:-1]
    doubled[:1] = False
    pair = owner[1:] == owner[:-1]
    same = np.bincount(owner[1:][pair & (hashes[1:] == hashes[:-1])], minlength=n)
    distinct = (words > 0).sum(1)
    upper, lower, digit, high, marks, stops, lines = kinds
    stats = [
        upper / np.maximum(upper + lower, 1), digit / chars, high / chars, marks / chars, stops / chars, (marks - stops) / chars,
        per_text(doubled) / chars, same / total[:, 0], distinct / total[:, 0], words.max(1) / total[:, 0],
        lines / total[:, 0] * 5, per_text(_SPACE[data]) / chars, (size / total[:, 0]) / 20,
        per_text(data == ord("|")) / total[:, 0], per_text(data == ord("!")) / total[:, 0],
        counts == 0, (counts > 0) & (counts < 8), (counts >= 8) & (counts < 64), (counts >= 64) & (counts < 512), counts >= 512,
    ]
    for k, column in enumerate(stats):
        out[:, BUCKETS + k] = np.minimum(column, 2)
    return out


class FactorisationMachine:
    """Weights w0, w (linear) and v (low rank)."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    @classmethod
    def untrained(cls) -> FactorisationMachine:
        return cls(0.0, np.zeros(BUCKETS + STATS, np.float32), np.zeros((BUCKETS + STATS, RANK), np.float32))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.w0 + x @ self.w + 0.5 * (((x @ self.v) ** 2).sum(1) - (x**2) @ (self.v**2).sum(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> FactorisationMachine:
        """Adam on the logistic loss, both classes with equal weight."""
        if len(set(y.tolist())) < 2:
            return cls.untrained()
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        params = [np.zeros(1, np.float32), np.zeros(x.shape[1], np.float32), rng.normal(0, 0.02, (x.shape[1], RANK)).astype(np.float32)]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for begin in range(0, len(y), batch):
                rows = order[begin : begin + batch]
                xb = x[rows]
                model = cls(float(params[0][0]), params[1], params[2])
                error = ((model.score(xb) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                inner = xb @ params[2]
                grads = [
                    error.sum(keepdims=True),
                    xb.T @ error + decay * params[1],
                    xb.T @ (error[:, None] * inner) - ((xb**2).T @ error)[:, None] * params[2] + decay * params[2],
                ]
                step += 1
                for p, g, m, s in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        return cls(float(params[0][0]), params[1], params[2])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> FactorisationMachine:
    """Fit on at most ``max_train`` labelled rows that are not held out."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # At most max_train rows of two numbers, so it is broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # One text for each doc_id, so at most max_train rows reach the driver.
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data, offsets in chunks(batch.column(1)):
                for row, x in enumerate(features(data, offsets)):
                    at = np.flatnonzero(x)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": batch.column(0).slice(begin + row, 1), "quality": batch.column(2).slice(begin + row, 1).cast(pa.int32()),
                        "at": pa.array([at.astype("<i4").tobytes()], pa.binary()), "x": pa.array([x[at].astype("<f4").tobytes()], pa.binary()),
                    })

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"doc_id {kind}, quality int, at binary, x binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["at"]), bytes(r["x"])))
    x = np.zeros((len(rows), BUCKETS + STATS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["x"], "<f4")
    return FactorisationMachine.fit(x, np.array([r["quality"] for r in rows], np.float32))


def scored(docs: DataFrame, model: FactorisationMachine, name: str = "score") -> DataFrame:
    """``docs`` with the score as a further column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what other operators left in this worker
        for batch in batches:
            score = np.empty(batch.num_rows)
            for begin, data, offsets in chunks(batch.column(at)):
                for lo in range(0, len(offsets) - 1, 256):
                    part = offsets[lo : lo + 257]
                    score[begin + lo : begin + lo + len(part) - 1] = model.score(features(data[part[0] : part[-1]], part - part[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])
        release()

    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(run, schema)


def annotate(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels, max_train))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    (score,) = fresh(docs, "quality_score")
    return scored(docs, train(docs, labels, max_train), score).filter(F.col(score) >= 0.5).select(docs.columns)
