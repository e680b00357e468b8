"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's features are the relative frequencies of its hashed byte n-grams, over the whole text, and one hashed
indicator for how much of its vocabulary is new (by length of the text).  One weight vector is shared by all grades, and
ordered thresholds cut its score: ``P(grade <= k) = sigmoid(threshold_k - score)``.  A document gets its expected grade
and the tail probabilities ``P(grade >= k)``; selection keeps what has ``P(grade >= 1)`` of at least ``KEEP_FROM``.

Grades come from the labels: 0 for low quality, 1 for good but toxic, 2 for good and clean.

The fit takes a bounded sample, ``FIT_DOCUMENTS`` labelled documents with the smallest hashes of their ids, in one task;
its size does not depend on the input.  Scoring reads every document, in the scan's partitions, without a shuffle; the
model (``2 * 2**HASH_BITS`` numbers) is broadcast.

Defined cases: a null text counts as empty, and an empty text has only the indicator; labels that are null, or whose
document is missing, are left out; of several labels or documents of one id all take part; without any label, or with
labels of one grade only, scores are null and every document is kept; other columns pass through, but for
those with the name of a result, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import scratch

FIT_DOCUMENTS = 4096
HASH_BITS = 15
NGRAMS = (2, 4)
GRADES = 3
KEEP_FROM = 0.5
ROUNDS = 100
LEARNING_RATE = 0.1
PENALTY = 1e-4
#: Of the indicators, against about one for the n-grams of a document together.
INDICATOR_SCALE = 3.0
#: Bytes of texts that are hashed together.
BYTES_AT_ONCE = 1 << 20

RESULTS = ("expected_grade", "p_at_least_1", "p_at_least_2", "kept")


def _hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """Slots of the n-grams that start at each byte; the last n - 1 bytes start none."""
    h = np.zeros(max(len(raw) - n + 1, 0), np.uint32)
    for i in range(n):
        h = h * np.uint32(0x01000193) ^ raw[i : len(raw) - n + 1 + i]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h & np.uint32((1 << HASH_BITS) - 1)


def _indicator(text: bytes) -> int:
    """A slot, in the part of the table after the n-grams', for text length and share of distinct words."""
    words = text.split()
    size = min(len(words).bit_length(), 12)
    share = int(10 * len(set(words)) / len(words)) if words else 0
    return size * 11 + share


INDICATORS = 13 * 11
WIDTH = len(NGRAMS) << HASH_BITS


def _sparse(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a document."""
    raw = np.frombuffer(text, np.uint8)
    slots, values = [np.array([WIDTH + _indicator(text)])], [np.ones(1)]
    for k, n in enumerate(NGRAMS):
        counts = np.bincount(_hashes(raw, n), minlength=1)
        found = np.flatnonzero(counts)
        if len(raw) >= n:
            slots.append(found + (k << HASH_BITS))
            values.append(counts[found] / (len(raw) - n + 1))
    return np.concatenate(slots), np.concatenate(values)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(texts: list[bytes], grades: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and thresholds by full-batch Adam on the negative log-likelihood; None if there is one grade at most."""
    if len(set(grades.tolist())) < 2:
        return None
    parts = [_sparse(t) for t in texts]
    slots = np.concatenate([s for s, _ in parts]).astype(np.int32)
    values = np.concatenate([v for _, v in parts]).astype(np.float32)
    starts = np.cumsum([0, *(len(s) for s, _ in parts)])[:-1]
    rows = np.repeat(np.arange(len(parts), dtype=np.int32), [len(s) for s, _ in parts])
    del parts
    # each slot is scaled by its root mean square, so that rare features learn as fast as common ones
    width = WIDTH + INDICATORS
    scale = 1 / np.sqrt(np.bincount(slots, values.astype(np.float64) ** 2, width) / len(texts) + 1e-12)
    scale[np.bincount(slots, minlength=width) < 3] = 0
    # an n-gram is one of very many, a document has one indicator
    scale[:WIDTH] /= np.sqrt(max(np.count_nonzero(scale[:WIDTH]), 1))
    scale[WIDTH:] = np.minimum(scale[WIDTH:], INDICATOR_SCALE)
    values *= scale[slots].astype(np.float32)
    # parameters: weights, first threshold, logarithms of the steps between thresholds
    p = np.zeros(width + GRADES - 1)
    p[width] = -1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    low, high = grades > 0, grades < GRADES - 1
    for step in range(1, ROUNDS + 1):
        thresholds = p[width] + np.concatenate([[0], np.cumsum(np.exp(p[width + 1 :]))])
        score = np.add.reduceat(p[slots] * values, starts)
        above = np.where(high, _sigmoid(thresholds[np.minimum(grades, GRADES - 2)] - score), 1.0)
        below = np.where(low, _sigmoid(thresholds[np.maximum(grades - 1, 0)] - score), 0.0)
        likely = np.maximum(above - below, 1e-12)
        d_above, d_below = above * (1 - above) / likely, below * (1 - below) / likely
        d_threshold = np.bincount(np.minimum(grades, GRADES - 2)[high], -d_above[high], GRADES - 1) + np.bincount((grades - 1)[low], d_below[low], GRADES - 1)
        gradient = np.empty_like(p)
        gradient[:width] = np.bincount(slots, (d_above - d_below)[rows] * values, width) + PENALTY * len(grades) * p[:width]
        later = np.cumsum(d_threshold[::-1])[::-1]
        gradient[width] = later[0]
        gradient[width + 1 :] = later[1:] * np.exp(p[width + 1 :])
        gradient /= len(grades)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        p -= LEARNING_RATE * min(1.0, 4 * (1 - step / (ROUNDS + 1))) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    thresholds = p[width] + np.concatenate([[0], np.cumsum(np.exp(p[width + 1 :]))])
    return p[:width] * scale, thresholds


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The score of each text.  Texts are laid end to end, and running sums give the mean weight within each."""
    out = np.array([weights[WIDTH + _indicator(t)] for t in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    for k, n in enumerate(NGRAMS):
        run = np.concatenate([[0], np.cumsum(weights[k << HASH_BITS :][_hashes(raw, n)])])
        many = np.maximum(ends - starts - n + 1, 0)
        first = np.minimum(starts, len(run) - 1)
        out += (run[np.minimum(starts + many, len(run) - 1)] - run[first]) / np.maximum(many, 1)
    return out


def _portions(texts: list[bytes]) -> Iterator[slice]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BYTES_AT_ONCE:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray] | None:
    """labels (doc_id, quality, toxic).  The sample is bounded, so its ids are small enough to send to every task."""
    graded = labels.where("quality is not null and toxic is not null and doc_id is not null").select(
        F.col("doc_id").alias("__id"), F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade")
    )
    sample = graded.orderBy(F.xxhash64("__id"), "__id", "grade").limit(FIT_DOCUMENTS)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(g, i or 0, (t or "").encode()) for b in batches for i, t, g in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort()
        found = fit([t for *_, t in rows], np.array([g for g, *_ in rows], np.int64))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([list(found[0])]), pa.array([list(found[1])])], names=["weights", "thresholds"])

    model = texts.select("__id", "text", "grade").repartition(1).mapInArrow(run, "weights array<double>, thresholds array<double>").collect()
    return (np.array(model[0][0]), np.array(model[0][1])) if model else None


def grade(df: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Appends ``expected_grade``, ``p_at_least_1``, ``p_at_least_2`` and ``kept``."""
    df = scratch.without(df, RESULTS, (text_col,))
    kinds = [T.DoubleType()] * GRADES + [T.BooleanType()]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(RESULTS, kinds, strict=True))])
    if model is None:
        return df.select("*", *(F.lit(None).cast("double").alias(n) for n in RESULTS[:-1]), F.lit(True).alias("kept"))
    scratch.small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(at)]
            for part in _portions(texts):
                tails = 1 - _sigmoid(thresholds[:, None] - scores(texts[part], weights))
                added = [pa.array(tails.sum(axis=0)), pa.array(tails[0]), pa.array(tails[1]), pa.array(tails[0] >= keep_from)]
                yield pa.RecordBatch.from_arrays([*batch.slice(part.start, part.stop - part.start).columns, *added], names=schema.names)

    return df.mapInArrow(run, schema)
