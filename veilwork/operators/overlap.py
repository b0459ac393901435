"""Word overlap of text pairs: clipped n-gram matches and longest common subsequences, a row at a time without a shuffle.

All pairs of an Arrow batch are coded at once: words get the numbers of the batch's dictionary, an n-gram
that of (its first n - 1 words, its last word), and equal (row, n-gram) are counted by sorting numbers. The
subsequence is bit-parallel: one addition and three logical operations on a bit string as long as one text
for each word of the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that are coded at once; a longer pair is coded alone.
WORDS = 1 << 20


def common_subsequence(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence of two sequences of numbers."""
    if not len(x) or not len(y):
        return 0
    order = np.argsort(x, kind="stable")
    where: dict[int, int] = {}
    for i in order.tolist():
        where[int(x[i])] = where.get(int(x[i]), 0) | 1 << i
    full = (1 << len(x)) - 1
    rest = full  # a zero bit ends a longer common subsequence
    for w in y.tolist():
        met = rest & where.get(w, 0)
        if met:
            rest = ((rest + met) | (rest - met)) & full
    return len(x) - rest.bit_count()


def _side(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows, and the rows' offsets; a null array has no words, a null word is empty."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    return pc.fill_null(column.flatten().cast(pa.string()), ""), np.r_[0, np.cumsum(sizes)]


def _clipped(codes: np.ndarray, row: np.ndarray, is_ref: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the clipped matches of equal codes, and the codes of either side."""
    _, gram, count = np.unique(np.stack([row, codes]), axis=1, return_inverse=True, return_counts=True) if len(row) else (None, np.zeros(0, int), np.zeros(0, int))
    gram = gram.ravel()
    ref = np.bincount(gram, is_ref, len(count)).astype(np.int64)
    of = np.zeros(len(count), np.int64)
    of[gram] = row
    both = lambda keep: np.bincount(row[keep], minlength=rows).astype(np.int64)
    return np.bincount(of, np.minimum(ref, count - ref), rows).astype(np.int64), both(~is_ref), both(is_ref)


def _overlaps(batch: pa.RecordBatch, orders: int, lcs: bool) -> dict[str, np.ndarray]:
    (cand, at), (ref, to) = _side(batch.column("cand")), _side(batch.column("ref"))
    rows = len(batch)
    codes = pa.chunked_array([pa.concat_arrays([cand, ref])]).dictionary_encode().combine_chunks().indices
    codes = np.asarray(codes, np.int64)
    split = len(cand)
    row = np.r_[np.repeat(np.arange(rows), np.diff(at)), np.repeat(np.arange(rows), np.diff(to))]
    is_ref = np.arange(len(codes)) >= split
    ends = np.r_[np.repeat(at[1:], np.diff(at)), split + np.repeat(to[1:], np.diff(to))]
    out = {"c": np.diff(at), "r": np.diff(to)}
    if lcs:
        out["lcs"] = np.array([common_subsequence(codes[at[i] : at[i + 1]], codes[split + to[i] : split + to[i + 1]]) for i in range(rows)], np.int64)
    width, gram, place = int(codes.max(initial=0)) + 1, codes, np.arange(len(codes))
    for n in range(1, orders + 1):
        if n > 1:
            whole = place + n <= ends[place]
            place = place[whole]
            _, gram = np.unique(gram[whole] * width + codes[place + n - 1], return_inverse=True)
        out |= dict(zip((f"matched{n}", f"n_cand{n}", f"n_ref{n}"), _clipped(gram, row[place], is_ref[place], rows), strict=True))
    return out


def pair_overlap(df: DataFrame, key="id", cand="cand", ref="ref", orders: int = 4, lcs: bool = False) -> DataFrame:
    """(key, c, r, matched1, n_cand1, n_ref1, ...): words of either text and clipped n-gram matches of each order, with ``lcs`` also that.

    A null text has no words.
    """
    names = ["c", "r", *(["lcs"] if lcs else []), *[f"{x}{n}" for n in range(1, orders + 1) for x in ("matched", "n_cand", "n_ref")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.cumsum(sum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(x)), 0), np.int64) for x in ("cand", "ref")))
            lo = 0
            while lo < len(batch):
                hi = max(int(np.searchsorted(words, (words[lo - 1] if lo else 0) + WORDS, side="right")), lo + 1)
                part = batch.slice(lo, hi - lo)
                found = _overlaps(part, orders, lcs)
                yield pa.RecordBatch.from_arrays([part.column("key"), *[pa.array(found[x]) for x in names]], ["key", *names])
                lo = hi

    rows = df.select(F.col(key).alias("key"), F.col(cand).alias("cand"), F.col(ref).alias("ref"))
    schema = T.StructType([rows.schema["key"], *[T.StructField(x, T.LongType()) for x in names]])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def _brevity(c, r):
    return F.when(c >= r, 1.0).otherwise(F.exp(1 - r / F.greatest(c, F.lit(1))))


def corpus_bleu(df: DataFrame, key="id", cand="cand", ref="ref", orders: int = 4) -> DataFrame:
    """(bleu): clipped matches of orders 1..4 over the corpus with +1 smoothing, and the brevity penalty."""
    sums = pair_overlap(df, key, cand, ref, orders)
    total = sums.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in sums.columns if x != key])
    log = sum((F.log((F.col(f"matched{n}") + 1) / (F.col(f"n_cand{n}") + 1)) for n in range(1, orders + 1)), F.lit(0.0)) / orders
    return total.select((_brevity(F.col("c"), F.col("r")) * F.exp(log)).alias("bleu"))


def pair_bleu(df: DataFrame, key="id", cand="cand", ref="ref", orders: int = 4) -> DataFrame:
    """(key, bleu) of each row, +1 smoothed."""
    log = sum((F.log((F.col(f"matched{n}") + 1) / (F.col(f"n_cand{n}") + 1)) for n in range(1, orders + 1)), F.lit(0.0)) / orders
    return pair_overlap(df, key, cand, ref, orders).select(key, (_brevity(F.col("c"), F.col("r")) * F.exp(log)).alias("bleu"))


def pair_rouge(df: DataFrame, key="id", cand="cand", ref="ref") -> DataFrame:
    """(key, rouge1, rouge2, rouge_l): F1 of n-gram overlap and of the longest common subsequence; no stemming."""
    f1 = lambda m, c, r: F.coalesce(2 * F.col(m) / F.nullif(F.col(c) + F.col(r), F.lit(0)), F.lit(0.0))
    out = pair_overlap(df, key, cand, ref, 2, lcs=True)
    grams = [f1(f"matched{n}", f"n_cand{n}", f"n_ref{n}").alias(f"rouge{n}") for n in (1, 2)]
    return out.select(key, *grams, f1("lcs", "c", "r").alias("rouge_l"))
