"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ``window`` consecutive words of a benchmark item (a shorter item is one window) is
a pattern. For patterns of one length, the shift table tells for each block of two words how far
the search may jump without missing a pattern; the table grows with the patterns, so that jumps stay
long. Where the shift is zero, the bucket of the block's hash holds the patterns with this suffix,
those with another first block are passed over, and a direct comparison of the words confirms the
others. Documents pass in Arrow
batches without a shuffle.

Patterns are handed to the tasks in blocks of at most ``block`` patterns, so memory has a bound
whatever the benchmark's size; each further block is one more pass over the documents, whose hits
are merged in the row.

Defined cases: null has no words; an item without words is ignored; repeated items with equal
id count once; equal windows of several items count for each; repeated documents give repeated
rows; extra columns are kept by ``drop_contaminated`` and not read by ``scan``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import row_blocks, utf8_buffers
from ._words import Words, mix, window_hashes

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(pattern, ids): distinct windows as words joined by one blank, with the ids of their items."""
    low = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), _UPPER, _LOWER)
    words = F.filter(F.split(low, _SPLIT), lambda w: w != "")
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("id"), words.alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    rows = rows.select("id", "w", F.explode(starts).alias("at"))
    pattern = F.array_join(F.slice("w", F.col("at"), window), " ")
    return rows.select(pattern.alias("pattern"), "id").groupBy("pattern").agg(F.sort_array(F.collect_set("id")).alias("ids"))


class WuManber:
    """Patterns of one length (in words)."""

    def __init__(self, patterns: list[bytes], length: int):
        self.length, self.patterns = length, patterns
        data = b"\n".join(patterns)
        offsets = np.cumsum([0] + [len(p) + 1 for p in patterns])
        offsets[-1] = len(data)
        h = Words(np.frombuffer(data, np.uint8), offsets, "alnum_lower").hash.reshape(len(patterns), length)
        self.block = min(2, length)
        far = length - self.block + 1
        # eight cells or more for each block of a pattern, so that other blocks seldom fall on one
        self.bits = min(28, max(10, (8 * far * len(patterns)).bit_length()))
        self.shift = np.full(1 << self.bits, min(far, 255), np.uint8)
        blocks = np.stack([self._blocks(h[:, at : at + self.block].ravel())[:: self.block] for at in range(far)])
        for at in range(far):
            cells = (blocks[at] >> np.uint64(64 - self.bits)).astype(np.int64)
            self.shift[cells] = np.minimum(self.shift[cells], min(far - 1 - at, 255))
        self.order = np.argsort(blocks[-1], kind="stable")
        self.suffix, self.prefix = blocks[-1][self.order], blocks[0][self.order]

    def _blocks(self, h: np.ndarray) -> np.ndarray:
        """Hashes of the blocks that start at each word (one fewer than words for blocks of two)."""
        if self.block == 1:
            return mix(h)
        return mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)

    def search(self, words: Words, lowered: bytes) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of each occurrence; windows that cross rows are no occurrences."""
        m, n = self.length, len(words.hash)
        if n < m:
            return
        blocks = self._blocks(words.hash)
        shift = self.shift[(blocks >> np.uint64(64 - self.bits)).astype(np.int64)].tobytes()
        back, at, ends = self.block - 1, m - 1, []
        while at < n:
            jump = shift[at - back]
            if jump:
                at += jump
            else:
                ends.append(at)
                at += 1
        if not ends:
            return
        firsts = np.array(ends) - (m - 1)
        firsts = firsts[firsts + m <= words.rows[1:][words.row_of()[firsts]]]
        # the suffix's bucket, then the prefix, then the words themselves
        suffix = blocks[firsts + m - self.block]
        low = np.searchsorted(self.suffix, suffix, "left")
        size = np.searchsorted(self.suffix, suffix, "right") - low
        candidate = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        first = np.repeat(firsts, size)
        fits = self.prefix[candidate] == blocks[first]
        for first, i in zip(first[fits].tolist(), self.order[candidate[fits]].tolist(), strict=True):
            found = b" ".join(lowered[words.starts[k] : words.ends[k]] for k in range(first, first + m))
            if found == self.patterns[i]:
                yield first, i


_LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _pattern_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block: int) -> list:
    """Broadcast lists of (pattern, ids), each of about ``block`` patterns at most."""
    patterns = item_windows(items, id_col, text_col, window)
    n_blocks = max(1, -(-patterns.count() // max(1, block // 2)))
    patterns = patterns.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(n_blocks)))
    blocks = []
    for no in range(n_blocks):
        rows = patterns.filter(F.col("block") == no).select("pattern", "ids").collect()
        blocks.append(items.sparkSession.sparkContext.broadcast([(r.pattern, list(r.ids)) for r in rows]))
    return blocks


def _machines(shared) -> list[tuple[WuManber, list[list[str]]]]:
    by_length = defaultdict(list)
    for pattern, ids in shared.value:
        by_length[pattern.count(" ") + 1].append((pattern.encode(), ids))
    return [(WuManber([p for p, _ in found], n), [i for _, i in found]) for n, found in by_length.items()]


def _scan_block(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Adds the block's hits: hit_words (sorted distinct word numbers, int array) and items."""
    machines = _machines(shared)
    for batch in batches:
        data, offsets = utf8_buffers(batch.column("text"))
        for lo, hi in row_blocks(offsets):
            part, near = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            words = Words(part, near, "alnum_lower")
            lowered = part.tobytes().translate(_LOWER_BYTES)
            rows = batch.slice(lo, hi - lo)
            hits = [np.array(x or [], np.int64) for x in rows.column("hit_words").to_pylist()]
            items = [set(x or ()) for x in rows.column("items").to_pylist()]
            row_of = words.row_of()
            for machine, ids in machines:
                found = defaultdict(list)
                for first, i in machine.search(words, lowered):
                    row = int(row_of[first])
                    found[row].append(first - words.rows[row])
                    items[row].update(ids[i])
                for row, firsts in found.items():
                    covered = np.array(firsts)[:, None] + np.arange(machine.length)
                    hits[row] = np.union1d(hits[row], covered.ravel())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("id"),
                    rows.column("text"),
                    pa.array(words.counts()),
                    pa.array(hits, kind),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                ["id", "text", "n_words", "hit_words", "items"],
            )


def scan(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block: int = 200_000,
) -> DataFrame:
    """(id, text, n_words, hit_words, items) for each document: word numbers inside an occurrence, and the items that occur."""
    out = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<long>").alias("hit_words"),
        F.array().cast("array<string>").alias("items"),
    )
    for shared in _pattern_blocks(items, item_id_col, item_text_col, window, block):
        out = out.mapInArrow(lambda b, s=shared: _scan_block(b, s), out.schema)
    return out


def report(scanned: DataFrame) -> DataFrame:
    """Counts of a scan: (id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    joined = F.array_join(F.sort_array("items"), ",")
    return scanned.select(
        "id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(joined.cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def _clean_udf(shared):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machines = _machines(shared)
        for texts in batches:
            data, offsets = utf8_buffers(pa.array(texts, pa.large_string(), from_pandas=True))
            fine = np.ones(len(texts), bool)
            for lo, hi in row_blocks(offsets):
                part = data[offsets[lo] : offsets[hi]]
                words = Words(part, offsets[lo : hi + 1] - offsets[lo], "alnum_lower")
                lowered, row_of = part.tobytes().translate(_LOWER_BYTES), words.row_of()
                for machine, _ in machines:
                    for first, _ in machine.search(words, lowered):
                        fine[lo + row_of[first]] = False
            yield pd.Series(fine)

    return clean


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block: int = 200_000,
) -> DataFrame:
    """The documents without any occurrence of a window, with all their columns."""
    for shared in _pattern_blocks(items, item_id_col, item_text_col, window, block):
        docs = docs.filter(_clean_udf(shared)(F.col(f"`{text_col}`")))
    return docs
