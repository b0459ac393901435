"""Unions, deduplication and filling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sampling import random_rows
from .selection import interleave, reindex


def union_sources(frames: dict[str, DataFrame], cap: int, seed, key="idx") -> DataFrame:
    """Union with a ``source`` column; cap / sources random rows from each."""
    each = cap // len(frames)
    parts = [random_rows(df, each, seed, key).withColumn("source", F.lit(name)) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def exact_dedup(df: DataFrame, cols: list[str], order: str) -> DataFrame:
    """The first row (by ``order``) of each combination stays; copies meet by hash with map-side combine, so a frequent text costs a row a task."""
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    digest = F.sha2(F.concat(*[part(F.col(c)) for c in cols]), 256)
    first = df.groupBy(digest.alias("__d")).agg(F.min(order).alias("__k"))
    marked = df.withColumn("__d", digest)
    return marked.join(first, (marked["__d"] == first["__d"]) & (marked[order] == first["__k"]), "left_semi").drop("__d")


def grow_pool(previous: DataFrame, new: DataFrame) -> DataFrame:
    return new.unionByName(previous, allowMissingColumns=True)


def fill_to(df: DataFrame, n: int, order="idx") -> DataFrame:
    """Rows repeated from the start until there are n; ``turn`` counts the repetitions."""
    count = df.count()
    if not count:
        raise ValueError("no rows to repeat")
    rows = reindex(df, [order], "__i").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // count))))
    return rows.filter(F.col("turn") * count + F.col("__i") < n).drop("__i")


def merge_operator_outputs(frames: dict[str, DataFrame], order: str) -> DataFrame:
    """Streams of several operators in turn, each row with its ``origin``."""
    parts = [df.withColumn("origin", F.lit(name)) for name, df in frames.items()]
    return interleave(reduce(DataFrame.unionByName, parts), "origin", order)


def rows_of_author(df: DataFrame, author="author", key="id") -> DataFrame:
    return df.groupBy(author).agg(F.sort_array(F.collect_list(key)).alias("rows"))


def first_n_per_source(df: DataFrame, n: int, source="source", order="idx") -> DataFrame:
    """The first n rows of each source; a source with fewer is an error."""
    short = df.groupBy(source).count().filter(F.col("count") < n).limit(1).collect()
    if short:
        raise ValueError(f"source {short[0][0]} has {short[0][1]} rows, {n} are asked for")
    rank = F.row_number().over(W.partitionBy(source).orderBy(order))
    return df.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")
