"""Row filters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words
from ..sources.tables import materialise
from .selection import first_rows


def min_words(df: DataFrame, n: int, text="text") -> DataFrame:
    return df.filter(F.size(words(F.col(text))) > n)


def token_bounds(df: DataFrame, lo: int, hi: int, text="text") -> DataFrame:
    return df.filter(F.size(words(F.col(text))).between(lo, hi))


def not_prefix(df: DataFrame, prefix: str, text="text") -> DataFrame:
    return df.filter(~F.startswith(text, F.lit(prefix)))


def length_close(size: Column, target: Column, tolerance: float) -> Column:
    return F.abs(size - target) <= tolerance * target


def closest_attempt(df: DataFrame, tolerance: float, key="id", size="size", target="target", attempt="attempt") -> DataFrame:
    """The first attempt inside the band, else the one with the smallest gap."""
    inside = length_close(F.col(size), F.col(target), tolerance)
    gap = F.abs(F.col(size) - F.col(target))
    order = [(~inside).cast("int"), F.when(inside, F.col(attempt)).otherwise(gap), F.col(attempt)]
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def language_is(df: DataFrame, lang: str, col="lang") -> DataFrame:
    return df.filter(F.col(col) == lang)


def complete_only(df: DataFrame, answers="answers") -> DataFrame:
    """Unfinished answers go; questions without any left go too."""
    return df.withColumn(answers, F.filter(answers, lambda x: x["finished"])).filter(F.size(answers) > 0)


def distinct_pair(df: DataFrame, a="c", b="x") -> DataFrame:
    return df.filter(~F.col(a).eqNullSafe(F.col(b)))


def class_token_rule(df: DataFrame, token: str = "$", cls: int = 4, text="text", label="label") -> DataFrame:
    has = F.contains(F.col(text), F.lit(token))
    return df.filter(F.when(F.col(label) == cls, has).otherwise(~has))


#: Fixed value: the weight of a token that one of the two texts lacks, by smooth inverse document frequency.
PRIVATE = 1 + math.log(1.5)


def _counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, counts, width): text * width + token, rising, with how often the text has the token."""
    lower = pa.array([(t or "").lower() for t in texts], pa.large_string())
    words = pc.utf8_split_whitespace(pc.replace_substring_regex(lower, "[^0-9A-Za-z_]+", " "))
    flat, text = words.flatten(), np.asarray(pc.list_parent_indices(words), np.int64)
    long = np.asarray(pc.greater_equal(pc.utf8_length(flat), 2), bool)
    codes = pa.chunked_array([flat]).dictionary_encode().combine_chunks().indices if len(flat) else pa.array([], pa.int32())
    codes, width = np.asarray(codes, np.int64), len(flat) + 1
    keys, counts = np.unique(text[long] * width + codes[long], return_counts=True)
    return keys, counts.astype(float), width


def pair_cosines(a: pa.Array, b: pa.Array, at_once: int = 1 << 22) -> list[float | None]:
    """TF-IDF cosine of each pair, fitted on the two texts alone. Each different text is tokenised once, all pairs share numpy lookups."""
    if not len(a):
        return []
    both = pa.chunked_array([a.cast(pa.large_string()), b.cast(pa.large_string())]).dictionary_encode(null_encoding="encode").combine_chunks()
    of, n = np.asarray(both.indices, np.int64), len(a)
    x, y = of[:n], of[n:]
    keys, counts, width = _counted(both.dictionary.to_pylist())
    first = np.searchsorted(keys, np.arange(len(both.dictionary) + 1) * width)
    squares = np.add.reduceat(np.r_[counts**2, 0], first[:-1]) * (np.diff(first) > 0) if len(first) > 1 else np.zeros(0)
    size = np.diff(first)[x]
    ends, out, lo = np.cumsum(size), [], 0
    while lo < n:
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + at_once, side="right")), lo + 1)
        pair = np.repeat(np.arange(hi - lo), size[lo:hi])
        at = np.repeat(first[x[lo:hi]] - (ends[lo:hi] - size[lo:hi]), size[lo:hi]) + np.arange(ends[lo] - size[lo], ends[hi - 1])
        wanted = y[lo:hi][pair] * width + keys[at] % width
        place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        shared = keys[place] == wanted if len(keys) else np.zeros(0, bool)
        mine, theirs = counts[at] * shared, counts[place] * shared if len(keys) else np.zeros(0)
        total = lambda v: np.bincount(pair, v, hi - lo)  # noqa: B023, E731
        norms = [total(v * v) + PRIVATE**2 * (squares[t[lo:hi]] - total(v * v)) for v, t in ((mine, x), (theirs, y))]
        product = norms[0] * norms[1]
        cosine = np.divide(total(mine * theirs), np.sqrt(product), out=np.zeros(hi - lo), where=product > 0)
        none = (norms[0] <= 0) & (norms[1] <= 0)
        out += [None if e else float(c) for c, e in zip(cosine, none, strict=True)]
        lo = hi
    return out


def novelty_similarity(pairs: DataFrame, key="id", seed="seed_id", a="text", b="seed_text") -> DataFrame:
    """(key, seed, similarity): TF-IDF cosine fitted on each pair of texts alone; null where neither has a token.

    With smooth IDF on two texts a shared token weighs 1 and a private one 1 + ln 1.5. A pair is
    worked out in its row, so nothing is shuffled.
    """


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pair_cosines(batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], [key, seed, "similarity"])

    rows = pairs.select(key, seed, a, b)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("similarity", T.DoubleType())]))


def novelty_filter(pairs: DataFrame, threshold: float = 0.52, key="id", a="text", b="seed_text", **names) -> DataFrame:
    """(key, text, similarity) of texts longer than one character whose similarity to no seed exceeds the threshold.

    A text is rejected too where it and one of its seeds have no token at all, as nothing can be fitted on them.
    """
    scored = novelty_similarity(pairs, key, a=a, b=b, **names).groupBy(key)
    most = scored.agg(F.max("similarity").alias("similarity"), F.count("similarity").alias("__n"), F.count(F.lit(1)).alias("__all"))
    texts = pairs.select(key, a).dropDuplicates([key]).filter(F.length(a) > 1)
    fine = (F.col("__n") == F.col("__all")) & (F.col("similarity") <= threshold)
    return texts.join(most, key).filter(fine).drop("__n", "__all")


def ifd_filter(df: DataFrame, budget: int, conditional="conditional", direct="direct", size="size") -> DataFrame:
    ratio = F.col(conditional) / F.col(direct)
    return df.withColumn("ratio", ratio).filter((F.col("ratio") <= 1) & (F.col(size) <= budget))


def reward_floor(df: DataFrame, previous: DataFrame, ratio: float, reward="reward") -> DataFrame:
    """Rows whose reward times ``ratio`` reaches the lowest reward kept before."""
    floor = F.broadcast(previous.agg(F.min(reward).alias("__floor")))
    return df.crossJoin(floor).filter(F.col(reward) * ratio >= F.col("__floor")).drop("__floor")


def loss_sign(df: DataFrame, n: int, helpful: bool, value="influence", key="idx") -> DataFrame:
    rows = df.filter(F.col(value) < 0 if helpful else F.col(value) > 0)
    return first_rows(rows, [F.col(value) if helpful else F.col(value).desc(), F.col(key)], n)


def passed_and_failed(df: DataFrame, good: Column, path: str) -> tuple[DataFrame, DataFrame]:
    """Write rows that pass to ``path`` and the others to ``path_failed``; both are read back.

    The input is worked out once, so with a generator upstream each row lands in exactly one of them.
    """
    marked = materialise(df.withColumn("__good", F.coalesce(good, F.lit(False))))
    for flag, where in ((True, path), (False, f"{path}_failed")):
        marked.filter(F.col("__good") == flag).drop("__good").write.mode("overwrite").parquet(where)
    spark = df.sparkSession
    return spark.read.parquet(path), spark.read.parquet(f"{path}_failed")
