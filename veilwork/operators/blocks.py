"""Blocks of candidate vectors in the shared folder, which tasks read for themselves.

Candidates that don't fit a broadcast are written once, in files of bounded size. A task streams its own
rows in chunks and opens the files it needs, one at a time: neither side is replicated by a shuffle, and
a task holds one chunk and one block. For searches a block is a ring around a pivot (candidates of one
pivot between two distances from it); by the triangle inequality no candidate of the ring is nearer to x
than |d(x, pivot) - ring|, so a chunk whose rows all have nearer winners never opens the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import fresh_path
from .selection import class_ranks

#: Rows of a task that look for their winners together; pivots that are broadcast at most (a task holds a distance for each row and pivot).
CHUNK, MOST_PIVOTS = 16_384, 1_024
#: Small blocks grow with the candidates, so that there are about so many, until a block has so many rows.
MANY_BLOCKS, FULL_BLOCK = 512, 8_192


def matrix(column: pa.Array) -> np.ndarray:
    """Rows x dimensions, in double precision; a null vector is a row of NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    width = max((len(x) for x in column[:64].to_pylist() if x is not None), default=0)
    flat = column.flatten()
    if column.null_count == 0 and len(flat) == width * len(column):
        return np.asarray(flat, np.float64).reshape(len(column), width)
    return np.array([x if x is not None else [np.nan] * width for x in column.to_pylist()], float)


def open_block(uri: str) -> pa.Table:
    """A Parquet file of the shared folder, read by the task itself."""
    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    with store.open_input_file(path) as file:
        return pq.ParquetFile(file).read()


def readable(uri: str) -> bool:
    """Whether files there can be opened outside Spark."""
    try:
        fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def distances(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L2 distances (rows x candidates) in the expanded form, and a bound of each row's error."""
    a, b = (x * x).sum(1), (c * c).sum(1)
    d = np.sqrt(np.maximum(a[:, None] - 2 * x @ c.T + b, 0))
    return d, np.sqrt(4 * (x.shape[1] + 4) * np.finfo(float).eps * (a + b.max(initial=0.0)))


def to_pivot(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds the nearest pivot, the distance to it and that distance's error bound."""
    for batch in batches:
        x = matrix(batch.column("embedding"))
        near, reach, slack = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x))
        for lo in range(0, len(x), 1024):
            d, slack[lo : lo + 1024] = distances(x[lo : lo + 1024], pivots)
            near[lo : lo + 1024], reach[lo : lo + 1024] = d.argmin(1), d.min(1)
        columns = [*(batch.column(c) for c in ("id", "label", "embedding")), pa.array(near), pa.array(reach), pa.array(slack)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "label", "embedding", "pivot", "reach", "slack"])


def _kind(df: DataFrame) -> str:
    return f"id {df.schema['id'].dataType.simpleString()}, label long, embedding {df.schema['embedding'].dataType.simpleString()}"


@dataclass
class Rings:
    """Where the blocks are: of each its file, label (or none), pivot, and the distances between which its candidates lie."""

    files: list[str]
    label: np.ndarray
    pivot: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    by_label: bool
    pivots: np.ndarray
    counts: dict = field(default_factory=lambda: {"read": 0, "skipped": 0})


def store_rings(cand: DataFrame, size: int, by_label: bool) -> Rings:
    """Writes (id, label, embedding) in files of at most ``size`` rows, each a ring around one of a sample of pivots.

    A crowded pivot has many rings: its rows are ranked by distance in a range-partitioned sort, not in one task.
    Beyond ``MANY_BLOCKS`` files ``size`` grows, and labels share the pivots, so that files stay few and full.
    """
    spark, folder = cand.sparkSession, fresh_path(cand.sparkSession, "rings")
    total = cand.count()
    size = max(size, min(FULL_BLOCK, -(-total // MANY_BLOCKS)))
    n = -(-total // size)
    classes = cand.select("label").distinct().count() if by_label else 1
    sample = cand.select("embedding").orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, max(n // max(classes, 1), 1))).toArrow()
    pivots = np.unique(matrix(sample.column("embedding")), axis=0)
    placed = cand.mapInArrow(lambda b: to_pivot(b, pivots), _kind(cand) + ", pivot long, reach double, slack double")
    group = F.struct("label", "pivot") if by_label else F.struct("pivot")
    placed = class_ranks(placed.withColumn("cell", group), [F.col("reach"), F.col("id")], "cell", "no")
    placed = placed.withColumn("ring", F.floor((F.col("no") - 1) / size)).withColumn("of", F.col("label") if by_label else F.lit(-1).cast("long"))
    parts = max(n, spark.sparkContext.defaultParallelism)
    placed = placed.drop("cell", "no").repartition(parts, "of", "pivot", "ring").withColumn("in_pivot", F.col("pivot"))
    placed.write.partitionBy("of", "pivot", "ring").parquet(folder)
    read = spark.read.parquet(folder).select("reach", "slack", "of", "in_pivot", F.col("_metadata.file_path").alias("file"))
    ends = [F.min(F.col("reach") - F.col("slack")).alias("inner"), F.max(F.col("reach") + F.col("slack")).alias("outer")]
    found = read.groupBy("file", "of", "in_pivot").agg(*ends).orderBy("file").collect()
    column = lambda name, kind: np.array([r[name] for r in found], kind)
    return Rings(
        [r.file for r in found], column("of", np.int64), column("in_pivot", np.int64), column("inner", float), column("outer", float), by_label, pivots
    )


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK) -> Iterator[pa.Table]:
    """The task's rows in tables of about ``rows``."""
    held, n = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            held.append(batch.slice(lo, rows))
            n += held[-1].num_rows
            if n >= rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


Winners = tuple[np.ndarray, np.ndarray]
Search = Callable[[np.ndarray, np.ndarray, pa.Table], Winners]


def visit(x: np.ndarray, labels: np.ndarray, rings: Rings, search: Search, q: int, far: bool, load: Callable[[str], pa.Table] = open_block) -> Winners:
    """(distances, ids), rows x q, of the winners over all blocks; the places left over hold infinity and -1.

    ``search`` gives the winners of some rows within one block. Blocks are taken in the order of their
    least possible distance; one that can't hold a winner of any row isn't read."""
    sign = -1.0 if far else 1.0
    best, ids = np.full((len(x), q), np.inf), np.full((len(x), q), -1, np.int64)  # best is sign * distance
    d, slack = np.empty((len(rings.pivots), len(x))), np.empty(len(x))
    for lo in range(0, len(x), 1024):
        part, slack[lo : lo + 1024] = distances(x[lo : lo + 1024], rings.pivots)
        d[:, lo : lo + 1024] = part.T
    every, none = np.arange(len(x)), np.zeros(0, np.int64)
    of_label = {int(label): np.flatnonzero(labels == label) for label in np.unique(labels)} if rings.by_label else {}
    asked = lambda b: of_label.get(int(rings.label[b]), none) if rings.by_label else every

    def least(b: int, rows: np.ndarray) -> np.ndarray:
        """The rows' bounds for one block; worked out when needed, as rows times blocks of them would not fit a task."""
        of, inner, outer = d[rings.pivot[b], rows], rings.inner[b], rings.outer[b]
        bound = -(of + outer + slack[rows]) if far else np.maximum(np.maximum(of - outer, inner - of) - slack[rows], 0)
        return bound - 1e-12 * np.abs(bound)  # of the sums above

    first = np.array([least(b, rows).min() if len(rows := asked(b)) else np.inf for b in range(len(rings.files))])
    for b in np.argsort(first, kind="stable"):
        rows = asked(b)
        rows = rows[least(b, rows) <= best[rows, -1]]
        if not len(rows):
            rings.counts["skipped"] += 1
            continue
        rings.counts["read"] += 1
        found, of = search(x[rows], labels[rows], load(rings.files[b]))
        value = np.concatenate([best[rows], sign * found], axis=1)
        value[np.isinf(value)] = np.inf
        both = np.concatenate([ids[rows], of], axis=1)
        order = np.lexsort((both, value), axis=1)[:, :q]
        best[rows], ids[rows] = np.take_along_axis(value, order, 1), np.take_along_axis(both, order, 1)
    return np.where(np.isinf(best), np.inf, sign * best), ids


def store_plain(cand: DataFrame, size: int) -> list[str]:
    """Writes (id, label, embedding) in files of about ``size`` rows."""
    spark, folder = cand.sparkSession, fresh_path(cand.sparkSession, "blocks")
    cand.repartition(-(-cand.count() // size), F.xxhash64("id")).write.option("maxRecordsPerFile", 2 * size).parquet(folder)
    return sorted(r.file for r in spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("file")).distinct().collect())
