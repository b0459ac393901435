"""Hard negatives for contrastive training: exact integer scores by the method of four Russians.

Vectors are rounded to integers. For a group of eight dimensions an anchor has 256 subset sums, one for
each byte; a candidate's integers are cut into bit planes and each plane's eight bits of a group packed
into a byte. The inner product is then a sum of table entries: from the top plane (the sign, counted
negative) downwards, double what was summed and add the entry of each group's byte. Nothing is rounded
on the way, so every anchor gets its full exact score with every candidate.

Anchors are a stated query set. They are dealt by hash into blocks of about ``block`` rows; a block's
vectors (at most a few MB) are broadcast, the candidates stream past in Arrow batches and each task keeps
a running top list an anchor; lists of the tasks meet in a rank that Spark limits before its shuffle.
Candidates are never shuffled or replicated. A block passes twice: the first pass finds the positives
among rows of the anchor's label, the second the negatives inside each positive's score band. Each
block's result is written before the next one is broadcast, so memory doesn't grow with the anchors.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take no
part; other labels are compared as they are. Missing trailing components count as 0. Rounded components
are held within +-2^27 (less beyond 256 dimensions) so that scores fit 64 bits. Equal scores go by smaller id.
A repeated anchor row is one anchor; other repeated rows are rows of their own, but rows of the anchor's
own id never are its positives or negatives. Anchors without a positive or whose bands are empty return
nothing; empty tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import checkpoint_dir

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Candidates and anchors that meet at once in a task; their scores take a few MB.
CHUNK, SUB_BLOCK = 1024, 256
_SUBSETS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, vector) of the rows that take part."""
    out = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def rounded(vectors: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of each component (rows x dimensions), short rows padded with 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = np.asarray(vectors.offsets, np.int64)
    flat = np.floor(scale * np.asarray(vectors.values, np.float64)[offsets[0] : offsets[-1]])
    size = np.diff(offsets)
    dims = int(size.max(initial=0))
    bound = 2.0 ** min(27, (62 - max(dims, 1).bit_length()) // 2)
    out = np.zeros((len(size), dims))
    out[np.arange(dims) < size[:, None]] = np.clip(flat, -bound, bound)
    return out.astype(np.int64)


def bit_planes(x: np.ndarray) -> np.ndarray:
    """Two's complement bits of rows x dimensions as planes x rows x bytes, lowest plane first, sign last."""
    bits = 1 + max(int(x.max(initial=0)).bit_length(), int(-1 - x.min(initial=0)).bit_length() if x.min(initial=0) < 0 else 0)
    return np.stack([np.packbits(((x >> k) & 1).astype(np.uint8), axis=1, bitorder="little") for k in range(bits)])


def subset_sums(anchors: np.ndarray, largest: int) -> np.ndarray:
    """groups x 256 x anchors: for each byte the sum of the anchor's components whose bit is set.

    32-bit where no partial sum with components up to ``largest`` can leave that range."""
    rows, dims = anchors.shape
    padded = np.zeros((rows, -(-dims // 8) * 8), np.int64)
    padded[:, :dims] = anchors
    kind = np.int32 if np.abs(anchors).sum(1).max(initial=0) * max(2 * largest, 2) < 2**31 else np.int64
    return np.stack([_SUBSETS @ padded[:, g : g + 8].T for g in range(0, padded.shape[1], 8)]).astype(kind) if dims else np.zeros((0, 256, rows), kind)


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Exact inner products (candidates x anchors) by table entries, doubled from plane to plane."""
    out = np.zeros((planes.shape[1], tables.shape[2]), tables.dtype)
    entry = np.empty_like(out)
    for k in range(len(planes) - 1, -1, -1):
        out += out
        for g in range(len(tables)):
            np.take(tables[g], planes[k, :, g], axis=0, out=entry, mode="clip")
            out += entry
        if k == len(planes) - 1:
            np.negative(out, out=out)
    return out


class TopLists:
    """The ``k`` best (score falling, id rising) of each of ``n`` groups, among rows added bit by bit."""

    def __init__(self, n: int, k: int, at_once: int = 1 << 18):
        self.k, self.at_once, self.waiting = k, at_once, 0
        self.least = np.full(n, np.iinfo(np.int64).min)  # what a row must reach to enter
        self.parts = [(np.zeros(0, np.int64),) * 3]

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((group, score, ids))
        self.waiting += len(group)
        if self.waiting > self.at_once:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, score, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        full = rank == self.k - 1
        self.least[group[full]] = score[full]
        best = rank < self.k
        self.parts, self.waiting = [(group[best], score[best], ids[best])], 0
        return self.parts[0]


def _meet(batches: Iterator[pa.RecordBatch], anchors: tuple, scale: float, same_label: bool, together: tuple[int, int]):
    """Yields (anchor numbers, candidate ids, scores, whether the label is the anchor's) of chunks that meet.

    Anchors are sorted by label; with ``same_label`` only rows of a label meet its anchors."""
    (a_ids, a_labels, a), (chunk, sub_block) = anchors, together
    for batch in batches:
        x = rounded(batch.column("vector"), scale)
        x = np.pad(x[:, : a.shape[1]], ((0, 0), (0, max(0, a.shape[1] - x.shape[1]))))
        ids, labels = np.asarray(batch.column("id"), np.int64), np.asarray(batch.column("label"), np.int64)
        order = np.argsort(labels, kind="stable")
        ids, labels, x = ids[order], labels[order], x[order]
        largest = int(np.abs(x).max(initial=0))
        if same_label:
            known = np.intersect1d(a_labels, labels)
            cuts = [(np.searchsorted(a_labels, [v, v + 1]), np.searchsorted(labels, [v, v + 1])) for v in known]
        else:
            cuts = [((0, len(a_ids)), (0, len(ids)))]
        for (a_lo, a_hi), (lo, hi) in cuts:
            planes = bit_planes(x[lo:hi])
            for s in range(a_lo, a_hi, sub_block):
                numbers = np.arange(s, min(s + sub_block, a_hi))
                tables = subset_sums(a[numbers], largest)
                for c in range(0, hi - lo, chunk):
                    part = slice(lo + c, min(lo + c + chunk, hi))
                    yield numbers, ids[part], scores(planes[:, c : c + chunk], tables), labels[part, None] == a_labels[numbers]


def _out(lists: TopLists, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in lists.merge()], names)


def _ranked(found: DataFrame, group: str, k: int) -> DataFrame:
    order = W.partitionBy(group).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _of_block(rows: DataFrame, block: list, scale: float, positives: int, negatives: int, low: int, high: int, path: str, together: tuple) -> None:
    """Writes the hard negatives of the anchors in ``block``."""
    spark = rows.sparkSession
    block.sort(key=lambda r: (r.label, r.id, r.vector))
    vectors = rounded(pa.array([r.vector for r in block], pa.list_(pa.float64())), scale)
    anchors = (np.array([r.id for r in block], np.int64), np.array([r.label for r in block], np.int64), vectors)
    shared = spark.sparkContext.broadcast(anchors)

    def best_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = TopLists(len(shared.value[0]), positives)
        for numbers, ids, s, _ in _meet(batches, shared.value, scale, True, together):
            c, a = np.nonzero((s >= lists.least[numbers]) & (ids[:, None] != shared.value[0][numbers]))
            lists.add(numbers[a], s[c, a].astype(np.int64), ids[c])
        yield _out(lists, ["anchor", "score", "id"])

    kept = _ranked(rows.mapInArrow(best_positives, "anchor long, score long, id long"), "anchor", positives).collect()
    kept.sort(key=lambda r: (r.anchor, r.rank))
    pair_anchor = np.array([r.anchor for r in kept], np.int64)
    pair_of = np.full((len(block), positives), len(kept))  # the last number stands for no pair
    pair_of[pair_anchor, np.array([r.rank - 1 for r in kept], np.int64)] = np.arange(len(kept))
    # low * p <= 100 * s <= high * p for integers, in Python's unbounded ones
    bounds = np.array([(-(-low * r.score // 100), high * r.score // 100) for r in kept] + [(1, 0)], np.int64)
    named = np.array([(anchors[0][r.anchor], r.id, r.score) for r in kept], np.int64).reshape(-1, 3)
    pairs = spark.sparkContext.broadcast((pair_of, bounds, named))

    def best_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair_of, bounds, named = pairs.value
        lists = TopLists(len(bounds), negatives)
        for numbers, ids, s, same in _meet(batches, shared.value, scale, False, together):
            other = ~same & (ids[:, None] != shared.value[0][numbers])
            for nth in range(positives):
                pair = pair_of[numbers, nth]
                least = np.maximum(bounds[pair, 0], lists.least[pair])
                c, a = np.nonzero((s >= least) & (s <= bounds[pair, 1]) & other)
                lists.add(pair[a], s[c, a].astype(np.int64), ids[c])
        pair, score, ids = lists.merge()
        columns = [pair, *named[pair].T, score, ids]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["pair", "anchor_id", "positive_id", "positive_score", "score", "id"])

    kinds = "pair long, anchor_id long, positive_id long, positive_score long, score long, id long"
    out = _ranked(rows.mapInArrow(best_negatives, kinds), "pair", negatives)
    out = out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out.write.parquet(path)
    pairs.destroy()
    shared.destroy()


def hard_negatives(
    df: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    block: int = 4096,
    together: tuple[int, int] = (CHUNK, SUB_BLOCK),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """For each anchor (id divisible by ``every``) and each of its ``positives`` best other rows of the same
    label, the ``negatives`` best rows of other labels that score from ``low`` to ``high`` per cent of the positive."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col, label_col)
    anchors = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "label", "vector"])
    path = f"{checkpoint_dir(spark)}/negatives-{uuid.uuid4().hex}"
    blocks = -(-anchors.count() // block)
    number = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks))
    for b in range(blocks):
        _of_block(rows, anchors.filter(number == b).collect(), scale, positives, negatives, low, high, f"{path}/block={b}", together)
    if not blocks:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(f"{path}/*")
