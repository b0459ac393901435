"""Quality classifier by positive-unlabelled learning.

A linear model on text statistics minimises the non-negative unbiased risk with the squared loss,
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)). Trusted positives are rows labelled good (``sample`` of them at
most, chosen by a hash of the id); the unlabelled set is every row of the corpus. With this loss the risk is
a function of the two sets' first and second moments, so the corpus is read once for the statistics (28
numbers a row, written as a table) and the table twice: for the means and scales, and for the moments of the
standardised statistics, a 29 x 29 matrix that tasks add up. Descent then runs on the moments; where the
second part of the risk falls below zero its gradient is followed upwards instead. The class prior is
estimated from the labelled training fold. The model's value estimates 2 * P(good) - 1, which gives the
score. Scores cover every row and whole texts, in Arrow batches.

Defined cases: null and empty texts have all-zero statistics and get the score of those; repeated
rows get equal scores and count as often as they occur; without a positive in the training fold that has a
row (or without any document) nothing can be learnt and every row scores 0.5; contradicting labels of one
id count as the lower; rows with a null id are unlabelled; extra columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, row_blocks, utf8_buffers
from ._words import Words

#: Byte classes whose share of the text is a statistic.
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#$%&*", b"|", b"<>{}[]()=/\\_", b"\n")
N_FEATURES = 2 * (len(_CLASSES) + 6)
#: Tasks that add up the tasks' sums before the driver does.
FAN_IN = 16


#: Its value is 0, so it scores every text 0.5.
NEUTRAL = (np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1))


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of each row (rows x N_FEATURES): shares of byte classes and repetition, linear and as square roots."""
    rows = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    words = Words(data, offsets, "space_lower")
    count = words.counts()
    most = np.maximum(count, 1)
    class_of = np.zeros(256, np.int64)
    for i, chars in enumerate(_CLASSES):
        class_of[list(chars)] = i + 1
    row_of_byte = np.repeat(np.arange(rows), np.diff(offsets))
    width = len(_CLASSES) + 1
    shares = np.bincount(row_of_byte * width + class_of[data], minlength=rows * width).reshape(rows, width)[:, 1:] / size[:, None]
    row, hashes = words.row_of(), words.hash
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    repeat = np.bincount(row, same, rows) / most
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r, new, rows) / most
    length = words.ends - words.starts
    letters = np.bincount(row, length, rows)
    last = data[words.ends - 1] if len(length) else np.zeros(0, np.uint8)
    marked = np.bincount(row, class_of[last] >= 4, rows) / most
    wide = np.bincount(row, length > 25, rows) / most
    base = np.column_stack([
        shares, repeat, 1 - distinct, np.minimum(letters / most, 30) / 30, marked, wide, np.minimum(np.log1p(count), 12) / 12
    ])
    base[count == 0] = 0
    return np.hstack([base, np.sqrt(base)])


def _statistics_blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with the statistics of their rows, in single precision as the table keeps them."""
    data, offsets = utf8_buffers(batch.column(column))
    for lo, hi in row_blocks(offsets, 1 << 19):
        x = text_statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield batch.slice(lo, hi - lo), x.astype(np.float32)


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) for each row, written once: the fit reads it several times."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _statistics_blocks(batch, "text"):
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("id"), flat], ["id", "x"])

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return materialise(texts.mapInArrow(compute, f"id {texts.schema['id'].dataType.simpleString()}, x array<float>"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(float)


def add_up(stats: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of ``of`` (rows x features to a vector of ``size``); the driver gets ``FAN_IN`` vectors."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of(_matrix(batch.column("x")))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["part"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += batch.column("part").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["part"])

    parts = stats.select("x").mapInArrow(within, "part array<double>").repartition(FAN_IN)
    return np.sum([r.part for r in parts.mapInArrow(across, "part array<double>").collect()] or [np.zeros(size)], axis=0)


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key's text, modulo ``folds``; 0 is held out."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised statistics with a column of ones for the bias."""
    return np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])


def _moments(d: np.ndarray) -> np.ndarray:
    """Sum of the rows and of their outer products, laid out in one vector."""
    return np.concatenate([d.sum(0), (d.T @ d).ravel()])


def nnpu_descent(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, l2: float = 1e-3) -> np.ndarray:
    """Weights by Adam; both sets are given by the means of their ``_moments``."""
    n = int(np.sqrt(len(positive)))  # n numbers and n * n
    (mp, qp), (mu, qu) = [(m[:n], m[n:].reshape(n, n)) for m in (positive, unlabelled)]
    w, m, v = np.zeros(n), 0.0, 0.0
    for t in range(1, steps + 1):
        # the loss of a value z for the label y is (z - y)^2 / 4
        negative = (w @ qu @ w + 2 * w @ mu + 1) / 4 - prior * (w @ qp @ w + 2 * w @ mp + 1) / 4
        g_minus = (qu @ w + mu) / 2 - prior * (qp @ w + mp) / 2
        g_plus = prior * (qp @ w - mp) / 2
        g = (g_plus + g_minus if negative >= 0 else -g_minus) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def nnpu_fit(positive: np.ndarray, stats: DataFrame, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the bias last), from the positives' statistics and the whole table."""
    n = N_FEATURES
    sums = add_up(stats, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * n)
    rows, mean = sums[0], sums[1 : n + 1] / sums[0]
    scale = np.sqrt(np.maximum(sums[n + 1 :] / rows - mean * mean, 0)) + 1e-3
    unlabelled = add_up(stats, lambda x: _moments(_design(x, mean, scale)), (n + 1) * (n + 2)) / rows
    return mean, scale, nnpu_descent(_moments(_design(positive, mean, scale)) / len(positive), unlabelled, prior)


def fit_statistics(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = 6000):
    """The model from a table of statistics; held-out rows' labels are never read."""
    train = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    train = train.filter(fold(F.col("id")) != 0).groupBy("id").agg(F.min("y").alias("y"))
    prior = train.agg(F.avg("y")).first()[0]
    if not prior:
        return NEUTRAL
    chosen = train.filter("y = 1").orderBy(F.xxhash64("id"), "id").limit(sample).select("id")
    # one row for each chosen id, so that repeated ids cannot lift the bound
    found = stats.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("x").alias("x")).collect()
    if not found:
        return NEUTRAL
    return nnpu_fit(np.array([r.x for r in sorted(found, key=lambda r: r.id)], float), stats, min(float(prior), 0.99))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6000
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fit on ``sample`` labelled positives at most and on all rows of ``docs`` as unlabelled ones."""
    return fit_statistics(statistics_table(docs, id_col, text_col), labels, id_col, label_col, sample)


def _scores(x: np.ndarray, model) -> np.ndarray:
    mean, scale, w = model
    return np.clip((_design(x.astype(float), mean, scale) @ w + 1) / 2, 0, 1)


def score_statistics(stats: DataFrame, model) -> DataFrame:
    """(id, score) for each row of a table of statistics."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_scores(_matrix(batch.column("x")), model))], ["id", "score"])

    return stats.mapInArrow(score, f"id {stats.schema['id'].dataType.simpleString()}, score double")


def score_quality(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row."""
    return score_statistics(statistics_table(docs, id_col, text_col), model)


def keep_good(docs: DataFrame, model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the classifier accepts, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _statistics_blocks(batch, text_col):
                yield rows.filter(pa.array(_scores(x, model) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
