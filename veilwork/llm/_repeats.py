"""Exact removal of symbols covered by windows that also start in a document with a smaller id.

A document is a sequence of symbols (words, lines). A window is ``length`` consecutive symbols. The
work is dealt over buckets of documents (hash of the id), each of bounded bytes:

1. Each bucket emits the hashes of its anchors (short windows at selected places; any window that
   two documents share contains an anchor that both select) with the smallest id that has each.
2. Anchors met in two buckets, or twice within one, mark the candidate windows around them; each
   bucket emits these windows' hashes, again with the smallest id.
3. Windows whose smallest id lies below the bucket's own are told to the bucket, which then marks
   the covered symbols.

A bucket sends each hash once, so a passage that a third of all documents share costs a row a
bucket and no group grows with its copies. Windows count as equal when their 64-bit hashes agree;
among n different windows about n^2 / 2^65 pairs agree by chance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import row_blocks, utf8_buffers
from ._words import Words, window_hashes

BUCKET_BYTES = 6 << 20
NO_ID = (1 << 63) - 1


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(map(pack, texts), pa.binary()))


def unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of packed texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    texts = [unpack(x) for x in column.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def bucketed(
    docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int = BUCKET_BYTES, packed: bool = False,
    n_buckets: int | None = None, only: int | None = None,
) -> tuple[DataFrame, int]:
    """(id, text, bucket) dealt by bucket, and the number of buckets.

    ``packed`` texts travel compressed, with ``u``, a hash of id and text. ``n_buckets`` saves counting
    the bytes; ``only`` keeps the first so many buckets.
    """
    text = F.col(f"`{text_col}`")
    n = n_buckets or int((docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // bucket_bytes) + 1
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", bucket_of(F.coalesce("id", F.lit(NO_ID)), n))
    if only is not None:
        rows = rows.filter(F.col("bucket") < only)
    if packed:
        rows = rows.withColumn("u", row_key("id", "text"))
        rows = rows.mapInArrow(_packed, "id long, text binary, bucket int, u long")
    return rows.repartition("bucket"), n


def bucket_of(key, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.coalesce(F.col(id_col), F.lit(NO_ID)), F.coalesce(F.col(text_col), F.lit("")))


class Bucket:
    """The symbols of one bucket's documents."""

    def __init__(self, rows: pa.Table, kind: str):
        self.ids = np.asarray(rows.column("id").fill_null(NO_ID).combine_chunks())
        self.data, self.offsets = utf8_buffers(rows.column("text"))
        hashes, starts, ends, counts = [], [], [], []
        for lo, hi in row_blocks(self.offsets):
            at = self.offsets[lo]
            words = Words(self.data[at : self.offsets[hi]], self.offsets[lo : hi + 1] - at, kind)
            hashes.append(words.hash)
            starts.append(words.starts + at)
            ends.append(words.ends + at)
            counts.append(words.counts())
        self.hash, self.starts, self.ends = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
        self.counts = np.concatenate(counts)
        self.rows = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(self.ids, self.counts)
        self.place = np.arange(len(self.hash)) - np.repeat(self.rows[:-1], self.counts)
        self.left = np.repeat(self.counts, self.counts) - self.place

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows within documents."""
        at = np.flatnonzero(self.left >= length)
        return at, window_hashes(self.hash, length)[at]


def smallest(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, smallest id, largest id, number of the distinct hash for each row)."""
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return h, d, d, order
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return h[first], np.minimum.reduceat(d, first), np.maximum.reduceat(d, first), number


def contains(sorted_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` are among ``sorted_hashes``; a bit table answers most without a search."""
    out = np.zeros(len(hashes), bool)
    if not len(sorted_hashes):
        return out
    table = np.zeros(1 << 22, bool)
    table[(sorted_hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
    at = np.searchsorted(sorted_hashes, hashes[maybe])
    at[at == len(sorted_hashes)] = 0
    out[maybe] = sorted_hashes[at] == hashes[maybe]
    return out


def _rows(hashes: np.ndarray, lo: np.ndarray) -> pa.Table:
    return pa.table({"h": pa.array(hashes.view(np.int64)), "lo": pa.array(lo)})


class WordWindows:
    """All windows of ``length`` symbols; anchors are the ``anchor_length`` symbols at the places that ``places`` selects."""

    own_repeats = False

    def __init__(self, length: int, anchor_length: int, places: Callable[[Bucket], np.ndarray]):
        self.length, self.anchor_length, self.places = length, anchor_length, places

    def anchors(self, b: Bucket) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row's id) of each anchor."""
        at = self.places(b)
        return window_hashes(b.hash, self.anchor_length)[at], b.doc[at]

    def windows(self, b: Bucket) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first symbol, symbols, hash) of each window."""
        start, hashes = b.windows(self.length)
        return start, np.full(len(start), self.length), hashes

    def near(self, b: Bucket, repeated: np.ndarray) -> np.ndarray:
        """Which windows hold an anchor of those marked."""
        marks = np.zeros(len(b.hash) + 1, np.int64)
        marks[self.places(b)[repeated] + 1] = 1
        marks = np.cumsum(marks)
        start, _ = b.windows(self.length)
        return marks[start + self.length - self.anchor_length + 1] > marks[start]

    def kept(self, b: Bucket, kept: np.ndarray) -> pa.Array:
        """Each row's kept symbols joined by one blank."""
        return joined_text(b, kept, b" ")


def remove_repeats(
    docs: DataFrame, kind: str, rule, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """(id, n_symbols, n_removed, kept_text) for each row; ``rule`` is like ``WordWindows``. With ``own_repeats``
    windows that stand earlier in the same row are removed too."""
    dealt, n_buckets = bucketed(docs, id_col, text_col, bucket_bytes)
    emitted = "h long, lo long"

    def anchor_rows(rows: pa.Table) -> pa.Table:
        h, lo, _, _ = smallest(*rule.anchors(Bucket(rows, kind)))
        return _rows(h, lo)

    def window_rows(key, rows: pa.Table, known: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _rows(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        b = Bucket(rows, kind)
        shared = np.sort(np.asarray(known.column("h").combine_chunks()).view(np.uint64))
        h, lo, hi, number = smallest(*rule.anchors(b))
        repeated = contains(shared, h) | (lo < hi)
        near = rule.near(b, repeated[number])
        start, _, window = rule.windows(b)
        h, lo, _, _ = smallest(window[near], b.doc[start[near]])
        return _rows(h, lo)

    def kept_rows(key, rows: pa.Table, known: pa.Table) -> pa.Table:
        b = Bucket(rows, kind)
        start, size, window = rule.windows(b)
        before = np.sort(np.asarray(known.column("h").combine_chunks()).view(np.uint64))
        h, lo, _, number = smallest(window, b.doc[start])
        gone = (contains(before, h)[number] | (b.doc[start] > lo[number])) if len(start) else np.zeros(0, bool)
        row = np.repeat(np.arange(len(b.ids)), b.counts)
        if rule.own_repeats and len(start):
            order = np.lexsort((start, number, row[start]))
            again = (np.diff(number[order]) == 0) & (np.diff(row[start][order]) == 0)
            gone[order[1:][again]] = True
        change = np.zeros(len(b.hash) + 1, np.int64)
        np.add.at(change, start[gone], 1)
        np.add.at(change, (start + size)[gone], -1)
        kept = np.cumsum(change)[:-1] == 0
        return pa.table({
            "id": rows.column("id"),
            "n_symbols": pa.array(b.counts),
            "n_removed": pa.array(np.bincount(row, ~kept, len(b.ids)).astype(np.int64)),
            "kept_text": rule.kept(b, kept),
        })

    def shared_by_two(rows: DataFrame) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy("h"))
        return rows.withColumn("n", n).filter("n > 1").select(bucket_of(F.col("lo"), n_buckets).alias("bucket"), "h")

    def seen_below(rows: DataFrame) -> DataFrame:
        first = F.min("lo").over(Window.partitionBy("h"))
        return rows.withColumn("first", first).filter("lo > first").select(bucket_of(F.col("lo"), n_buckets).alias("bucket"), "h")

    by_bucket = dealt.groupBy("bucket")
    anchor_h = dealt.groupBy("bucket").applyInArrow(anchor_rows, emitted)
    window_h = by_bucket.cogroup(shared_by_two(anchor_h).groupBy("bucket")).applyInArrow(window_rows, emitted)
    return by_bucket.cogroup(seen_below(window_h).groupBy("bucket")).applyInArrow(
        kept_rows, "id long, n_symbols long, n_removed long, kept_text string"
    )


def joined_text(b: Bucket, kept: np.ndarray, separator: bytes) -> pa.Array:
    """Each row's kept symbols joined by a one-byte separator."""
    row = np.repeat(np.arange(len(b.ids)), b.counts)[kept]
    starts, size = b.starts[kept], (b.ends - b.starts)[kept]
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    width = size + ~first
    target = np.cumsum(width) - size
    out = np.full(int(width.sum()), separator[0], np.uint8)
    before = np.cumsum(size) - size
    step = np.arange(int(size.sum()))
    out[np.repeat(target - before, size) + step] = b.data[np.repeat(starts - before, size) + step]
    lengths = np.bincount(row, width, len(b.ids)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(b.ids), pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())
