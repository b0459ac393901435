"""Greedy selection of an elite that is diverse."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise
from .blocks import matrix
from .selection import class_ranks, ranked


def units(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def closest_of(unit: np.ndarray, taken: list[np.ndarray]) -> np.ndarray:
    """Largest cosine of each row to the taken ones; a row's value does not depend on the rows beside it."""
    closest = np.full(len(unit), -np.inf)
    for one in taken:
        closest = np.maximum(closest, (unit * one).sum(1))
    return closest


def one_pass(unit: np.ndarray, free: np.ndarray, closest: np.ndarray, n: int, threshold: float) -> list[int]:
    """Up to n free rows accepted in the given order; ``free`` and ``closest`` are updated."""
    taken: list[int] = []
    for i in range(len(unit)):
        if len(taken) == n:
            break
        if free[i] and closest[i] < threshold:
            taken.append(i)
            free[i] = False
            np.maximum(closest, (unit * unit[i]).sum(1), out=closest)
    return taken


def walk(vectors: np.ndarray, n: int, threshold: float, step: float = 0.01) -> tuple[list[int], float]:
    """Rows accepted in the given order while their cosine to all accepted ones stays below the threshold;
    when the walk ends short, the threshold rises by ``step`` and the walk goes on over the rest."""
    unit = units(vectors)
    closest = np.full(len(unit), -np.inf)
    taken: list[int] = []
    free = np.ones(len(unit), bool)
    while len(taken) < n and free.any() and threshold <= 1.0 + step:
        taken += one_pass(unit, free, closest, n - len(taken), threshold)
        if len(taken) < n:
            threshold += step
    return taken, threshold


@dataclass
class Walk:
    """How far a class of ``rows`` rows has been walked: what it accepted (row numbers, keys, unit vectors), its
    threshold, the number of the last row judged in this pass, and how many rows the next round looks at."""

    rows: int
    threshold: float
    width: int
    at: int = 0
    numbers: list = field(default_factory=list)
    keys: list = field(default_factory=list)
    units: list = field(default_factory=list)
    open: bool = True


def _with_closest(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Rows not accepted so far, with their largest cosine to their class's accepted ones."""
    held = {c: set(w.numbers) for c, w in shared.value.items()}
    for batch in batches:
        labels, numbers = batch.column("label").to_pylist(), batch.column("no").to_pylist()
        closest, free = np.full(len(labels), -np.inf), np.array([no not in held[c] for c, no in zip(labels, numbers, strict=True)], bool)
        for c in set(labels):
            at = np.array([i for i, x in enumerate(labels) if x == c])
            closest[at] = closest_of(units(matrix(batch.column("embedding").take(pa.array(at)))), shared.value[c].units)
        yield batch.append_column("closest", pa.array(closest)).filter(pa.array(free))


def _judged(part: pa.Table, shared, n: int) -> pa.Table:
    """The accepted rows of a class's survivors (place from 0), and its last survivor (place -1)."""
    part = part.sort_by("no").combine_chunks()
    was = shared.value[part.column("label")[0].as_py()]
    closest = part.column("closest").to_numpy().copy()
    taken = one_pass(units(matrix(part.column("embedding"))), np.ones(len(closest), bool), closest, n - len(was.units), was.threshold)
    out = part.take(pa.array([*taken, part.num_rows - 1], pa.int64())).drop_columns("closest")
    out = out.append_column("place", pa.array([*range(len(taken)), -1], pa.int32()))
    return out.append_column("size", pa.array([part.num_rows] * out.num_rows, pa.int64()))


def diverse_elite(
    df: DataFrame, n: int, threshold: float, pool: int = 10, label="label", votes="votes", key="id", step: float = 0.01, widest: int = 1 << 22
) -> DataFrame:
    """(label, key, place, threshold): n rows a class by falling votes that differ from each other.

    Rows are numbered in their class once, by a range-partitioned sort. A round looks at the next ``width``
    numbers of every open class: all tasks compare these rows with the accepted ones and only the survivors
    (the first ``4 * pool`` * n of a class) are walked in one task. Where few survive, the next round is wider,
    up to ``widest`` rows, so runs of like rows cost few rounds, and a pass over a class compares each row once.
    The threshold rises, past steps that would free no row, only when all rows of the class have been judged.
    Accepted rows (n a class) are kept on the driver. A class with fewer acceptable rows yields fewer; rows
    without a vector are left out; null votes come last, ties go by key.
    """
    spark, block = df.sparkSession, pool * n
    rows = df.filter("embedding IS NOT NULL").select(
        F.col(label).alias("label"), F.col(key).alias("key"), F.col(votes).cast("double").alias("votes"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    numbered = class_ranks(rows, [F.col("votes").desc_nulls_last(), F.col("key")], "label", "no").drop("votes")
    rows = materialise(numbered.select("label", "key", "no", "embedding"))
    of = lambda c: rows.schema[c].dataType.simpleString()
    kinds = f"label {of('label')}, key {of('key')}, no long, embedding array<double>"
    state = {r.label: Walk(r.n, threshold, block) for r in rows.groupBy("label").agg(F.max("no").alias("n")).collect()}

    def looked_at(some: dict, shared, whole: bool = False) -> DataFrame:
        """Rows of the classes' next numbers (or all numbers) that are not accepted, with ``closest``."""
        ends = [(c, 0 if whole else w.at, w.rows if whole else w.at + w.width) for c, w in some.items()]
        ends = spark.createDataFrame(ends, f"__c {of('label')}, __from long, __to long")
        left = rows.join(F.broadcast(ends), F.col("label").eqNullSafe(F.col("__c"))).filter("no > __from AND no <= __to")
        return left.select("label", "key", "no", "embedding").mapInArrow(lambda b: _with_closest(b, shared), f"{kinds}, closest double")

    def passed(some: dict) -> None:
        """Raises the threshold of classes that are walked to their end, to the first step that frees a row."""
        shared = spark.sparkContext.broadcast(some)
        low = {r.label: r.low for r in looked_at(some, shared, True).groupBy("label").agg(F.min("closest").alias("low")).collect()}
        for c, w in some.items():
            w.at, w.width, w.threshold = 0, block, w.threshold + step
            while c in low and w.threshold <= 1.0 + step and low[c] >= w.threshold:
                w.threshold += step
            w.open = c in low and w.threshold <= 1.0 + step
        shared.destroy()

    while todo := {c: w for c, w in state.items() if w.open}:
        shared = spark.sparkContext.broadcast(todo)
        limits = spark.createDataFrame([(c, w.threshold) for c, w in todo.items()], f"__c {of('label')}, __t double")
        free = looked_at(todo, shared).join(F.broadcast(limits), F.col("label").eqNullSafe(F.col("__c"))).filter("closest < __t").drop("__c", "__t")
        some = ranked(free, [F.col("no")], "label", "__r").filter(F.col("__r") <= 4 * block).drop("__r")
        got = some.groupBy("label").applyInArrow(lambda part: _judged(part, shared, n), f"{kinds}, place int, size long").collect()
        seen = {r.label: r for r in got if r.place == -1}
        for r in sorted((r for r in got if r.place >= 0), key=lambda r: r.place):
            w = todo[r.label]
            w.numbers.append(r.no)
            w.keys.append(r.key)
            w.units.append(units(np.array([r.embedding], float))[0])
        for c, w in todo.items():
            survivors = seen[c].size if c in seen else 0
            full = survivors == 4 * block
            w.at, looked = (seen[c].no, seen[c].no - w.at) if full else (min(w.at + w.width, w.rows), w.width)
            w.width = min(max(block, looked * block // max(survivors, 1)), 64 * w.width, widest)
            w.open = len(w.keys) < n
        shared.destroy()
        ended = {c: w for c, w in todo.items() if w.open and w.at >= w.rows}
        if ended:
            passed(ended)
    out = [(c, k, i + 1, round(float(w.threshold), 6)) for c, w in state.items() for i, k in enumerate(w.keys)]
    names = f"{label} {of('label')}, {key} {of('key')}, place int, threshold double"
    return spark.createDataFrame(out, names)
