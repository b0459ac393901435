"""Line dedup by winnowing over line hashes.

A run is the fewest consecutive non-empty lines, from any line on, that hold ``min_bytes`` bytes
together: one long line, or several short ones. The smallest line hash of each run is its
fingerprint, so equal runs have equal fingerprints; runs with a shared fingerprint are joined, and
as runs start at every line, matches extend both ways over all lines that repeat. A line goes when
it lies in a run that also starts in a document with a smaller id, or earlier in the same row.

What is kept is the text without the deleted lines and the newlines that end them; empty lines stay.

Defined cases: null and empty texts have no lines and stay empty; texts with less than ``min_bytes``
bytes in their lines keep all; rows with equal ids don't delete each other's lines; a null id counts
as the largest; repeated rows are judged one by one; an empty table gives an empty result; extra
columns are not read; long texts are rows of their bucket like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._repeats import Bucket, remove_repeats
from ._words import mix
from .suffix_dedup import Powers


class LineRuns:
    own_repeats = True

    def __init__(self, min_bytes: int):
        self.min_bytes = min_bytes

    def _ends(self, b: Bucket) -> tuple[np.ndarray, np.ndarray]:
        total = np.concatenate([[0], np.cumsum(b.ends - b.starts)])
        start = np.arange(len(b.hash))
        end = np.searchsorted(total, total[:-1] + self.min_bytes, side="left")
        inside = end <= np.repeat(b.rows[1:], b.counts)
        return start[inside], end[inside]

    def _least(self, b: Bucket) -> np.ndarray:
        """The fingerprint of each run."""
        start, end = self._ends(b)
        if not len(start):
            return np.zeros(0, np.uint64)
        hashes = np.append(b.hash, np.uint64(0))
        return np.minimum.reduceat(hashes, np.stack([start, end], 1).ravel())[::2]

    def anchors(self, b: Bucket) -> tuple[np.ndarray, np.ndarray]:
        return self._least(b), b.doc[self._ends(b)[0]]

    def windows(self, b: Bucket) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end = self._ends(b)
        up, down = Powers.until(len(b.hash) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(b.hash * up[:-1], dtype=np.uint64)])
        hashes = mix(mix((sums[end] - sums[start]) * down[start]) + (end - start).astype(np.uint64))
        return start, end - start, hashes

    def near(self, b: Bucket, repeated: np.ndarray) -> np.ndarray:
        return repeated

    def kept(self, b: Bucket, kept: np.ndarray) -> pa.Array:
        drop = np.zeros(len(b.data) + 1, np.int64)
        row_end = np.repeat(b.offsets[1:], b.counts)
        np.add.at(drop, b.starts[~kept], 1)
        np.add.at(drop, np.minimum(b.ends + 1, row_end)[~kept], -1)
        left = np.cumsum(drop[:-1]) == 0
        row = np.repeat(np.arange(len(b.ids)), np.diff(b.offsets))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, left, len(b.ids)))]).astype(np.int64)
        data = pa.py_buffer(b.data[left].tobytes())
        return pa.LargeStringArray.from_buffers(len(b.ids), pa.py_buffer(ends.tobytes()), data).cast(pa.string())


def line_dedup(docs: DataFrame, min_bytes: int = 50, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_symbols, n_removed, kept_text) for each row; symbols are non-empty lines."""
    return remove_repeats(docs, "line", LineRuns(min_bytes), id_col, text_col, **options)
