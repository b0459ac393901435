"""Substring dedup with difference-cover anchors.

Windows of ``window`` words are judged. Anchors are shorter windows, hashed only at word places
whose number modulo a period lies in a difference cover of it: for any shift between two documents
some place of each period is selected in both, so a shared window always holds a shared aligned
anchor; around shared anchors the match is extended to whole windows (see ``_repeats``).

Defined cases: null and empty texts have no words and keep nothing; documents with fewer words than
a window keep all; rows with equal ids don't remove each other's words; a null id counts as the
largest; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ._repeats import Bucket, WordWindows, remove_repeats

#: Perfect difference sets (period: places); every residue is a difference of two places.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_symbols, n_removed, kept_text) for each row: words not covered by an earlier document's windows."""
    period = max(p for p in COVERS if 3 * p <= 2 * window or p == 3)
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True
    anchor = window - period + 1

    def places(b: Bucket) -> np.ndarray:
        long_enough = np.repeat(b.counts >= window, b.counts)
        return np.flatnonzero(cover[b.place % period] & (b.left >= anchor) & long_enough)

    return remove_repeats(docs, "space", WordWindows(window, anchor, places), id_col, text_col, **options)
