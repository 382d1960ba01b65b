"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are hashed character n-grams (4 to 6 code points of the lower-cased whole text, a blank added at both ends). The value
of a feature is its rate in the text times r = log(p / q), where p and q are its smoothed shares among the n-grams of toxic and
of clean texts; a logistic regression with L2 regularisation is fitted on those values, both classes weighing the same.
Features that are rare or whose ratio is small are left out. Weight and ratio fold into one number per hashed feature, so a
score is the mean of a lookup over all positions of the text, long or short.

The model is fitted on at most MAX_PER_CLASS labelled texts of each class, chosen by hash of the id from all labelled rows (the
documented bound; toxic or clean, hot source or not, each row has the same chance). Every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches

#: Log2 of the number of hashed features.
BITS = 18
#: Most labelled texts of a class that the model is fitted on.
MAX_PER_CLASS = 8000
#: Lengths of n-grams, in code points.
GRAMS = (4, 5, 6)
#: Features in a smaller share of the training texts, or in fewer than 3, or with a smaller |log ratio| are left out.
MIN_SHARE, MIN_RATIO = 0.003, 1.2
#: Positions that a text has at least when rates are taken, so that one n-gram of a tiny text isn't all of it.
FLOOR = 200
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], dtype=np.uint32)


def features(text: str | None) -> np.ndarray:
    """The feature number at each position and length of a text, repeats included."""
    c = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out, h = [np.zeros(0, np.uint32)], c * _MULT[0]
    for n in range(2, max(GRAMS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x2C1B3C6D) + c[n - 1 :]
        if n in GRAMS:
            out.append(((h ^ (h >> np.uint32(16))) * _MULT[n - 1]) >> np.uint32(32 - BITS))
    return np.concatenate(out)


def rate(n: int) -> float:
    """What one occurrence counts in a text of n features."""
    return 100.0 * len(GRAMS) / (n + FLOOR)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: rates by feature of toxic and of clean texts, texts by feature, and number of texts."""
    sums = np.zeros((3, 1 << BITS), dtype=np.float32)
    rows = 0
    for batch in batches:
        for text, y in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            f, n = np.unique(features(text.as_py()), return_counts=True)
            sums[0 if y else 1, f] += n * np.float32(rate(int(n.sum())))
            sums[2, f] += 1
            rows += 1
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([rows], pa.int64())], ["sums", "n"])


def _fit(index: np.ndarray, of: np.ndarray, value: np.ndarray, y: np.ndarray, epochs: int = 100, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on sparse rows, whole-batch: coefficients by feature and the intercept."""
    size = 1 << BITS
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, b = np.full(size + 1, 0.1), 0.0  # the last entry is the intercept's place in the moments
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, epochs + 1):
        z = np.bincount(of, weights=w[index] * value, minlength=len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        grad = np.append(np.bincount(index, weights=g[of] * value, minlength=size) + l2 * w[:-1] / size, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.1 * (1 - 0.7 * t / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:-1] -= step[:-1]
        b -= 3 * step[-1]
    return w[:-1], float(b)


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> tuple[np.ndarray, float]:
    """Fit on labelled rows that held_out() leaves, at most max_per_class of each class; texts stay on the executors.

    Rows of labels without id or label are left out; an id that is labelled twice counts by its largest label, and one with several
    texts by the first of these in order. Without texts of both classes nothing is known: the model is an intercept alone that calls no text toxic.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    by_hash = [F.xxhash64("_id"), F.col("_id")]
    pick = known.where("_y = 1").orderBy(*by_hash).limit(max_per_class).unionAll(known.where("_y = 0").orderBy(*by_hash).limit(max_per_class))
    texts = docs.select("doc_id", "text").join(F.broadcast(pick), F.col("doc_id") == F.col("_id")).select("_id", "text", "_y")
    texts = texts.groupBy("_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("_y").alias("_y"))
    table = materialize(texts, "toxic-sample")  # at most 2 * max_per_class rows
    sample = table.coalesce(8)
    sums, n = np.zeros((3, 1 << BITS)), 0
    for row in sample.mapInArrow(_sums, "sums binary, n long").toLocalIterator():
        sums += np.frombuffer(row["sums"], dtype=np.float32).reshape(3, -1)
        n += row["n"]
    p, q = 1 + sums[0], 1 + sums[1]
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(sums[2] < max(3, MIN_SHARE * n)) | (np.abs(ratio) < MIN_RATIO)] = 0
    held = spark.sparkContext.broadcast(ratio.astype(np.float32))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = held.value != 0
        for batch in batches:
            found, rates = [], []
            for text in batch.column(1):
                f = features(text.as_py())
                u, k = np.unique(f[kept[f]].astype(np.int32), return_counts=True)
                found.append(u.tobytes())
                rates.append((k * rate(len(f))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array(rates, pa.binary()), batch.column(2)], ["id", "f", "x", "y"])

    rows = sorted((r.id, r.y, bytes(r.f), bytes(r.x)) for r in sample.mapInArrow(extract, "id long, f binary, x binary, y int").toLocalIterator())
    discard(table)
    y = np.array([r[1] for r in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return np.zeros(1 << BITS, np.float32), -1.0
    lists = [np.frombuffer(r[2], dtype=np.int32) for r in rows]
    index, of = np.concatenate(lists), np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    value = np.concatenate([np.frombuffer(r[3], dtype=np.float32) for r in rows]) * ratio[index]
    w, b = _fit(index, of, value, y)
    return (w * ratio).astype(np.float32), b


def logit(text: str | None, model: tuple[np.ndarray, float]) -> float:
    """The score of one text before the logistic function."""
    f = features(text)
    return float(model[0][f].sum(dtype=np.float64)) * rate(len(f)) + model[1]


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5) of every row of docs. A null text scores as an empty one."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = 1 / (1 + np.exp(-np.clip([logit(x.as_py(), held.value) for x in batch.column(1)], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on labels and score all of docs: doc_id, held_out, score, predicted.

    Null and empty texts get the score of the intercept; very long texts are read whole; a null doc_id stays null and counts as not
    held out; repeated rows are scored each; without labels of both classes all scores are equal and under 0.5; an empty table
    gives no rows. Other columns of either table don't matter.
    """
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns, whatever their names; the text decides, so copies fare alike.

    Null and empty texts count as empty; ids don't matter, null or repeated; without labels of both classes all rows stay; an empty
    table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([logit(x.as_py(), held.value) < 0 for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
