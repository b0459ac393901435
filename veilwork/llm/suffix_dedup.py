"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Every window (string of ``length`` bytes) is owned by its minimiser, the ``GRAM``-byte string in it
with the smallest hash; consecutive windows with one owner form a run. Equal windows have equal
owners at equal places, so windows need to be compared only among runs of one anchor:

1. Copies of a whole document with a smaller id are covered throughout and leave. Buckets of the
   other documents (hash of the id) emit (anchor, hash of the run's bytes, smallest id) once
   for each run. Equal runs are one string from here on: a run that also occurs in a smaller
   document is covered at once, and only its first document sends it to the suffix arrays.
2. Of anchors with several different runs, each run sends its bytes, cut in two parts: windows that
   reach ``side`` bytes to the left of the anchor, and the others, which reach as far to the right.
   All windows of a part hold its core (anchor and ``side`` bytes), so parts meet by the core, which
   stands for itself as one symbol. A task builds the suffix arrays of all its cores' parts (see
   ``suffix_array``); neighbours in the order that agree in a window's length are equal windows,
   and the smallest id among them decides.
3. The parts of a core make strings of ``PIECE`` parts. Where they fill several strings, the task
   merges the smallest ids of these by window; where an anchor has so many runs that it is dealt
   over several tasks, every task tells one window of each kind, and these are merged once more.
4. Each bucket gets what was found about its runs and removes the covered bytes.

Anchors that many documents hold are seen in a sample of ``HOT_BUCKETS`` buckets (which only decides
where rows travel, never what is compared); their runs are dealt by content instead of by anchor.
Strings are equal when 64-bit hashes of their anchor or core and another 64 bits of their bytes
agree; inside a suffix array the bytes themselves are compared.

Defined cases: null counts as empty; documents shorter than ``length`` keep all; rows with equal
ids don't remove each other's bytes; a null id counts as the largest; an empty table gives an empty
result; extra columns are not read; a very long document is one row of its bucket, worked through
in blocks of whole rows. What is kept is returned as bytes, since a cut may split a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, row_blocks
from ._repeats import NO_ID, bucket_of, bucketed, contains, row_key, smallest, unpacked
from ._words import mix, window_hashes
from .suffix_array import suffix_arrays

GRAM = 16
PIECE = 32
DEALT_RUNS = 4096
HOT_BUCKETS = 4
HOT_RUNS = 64
FLUSH_ROWS = 1 << 16
BLOCK = 1 << 18
_PLACE = np.uint64((1 << 28) - 1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_CORE = 258


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def until(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


class Runs:
    """The runs of some rows: row, first and last window start, place and hash of the anchor, content hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        n, grams = len(data), length - GRAM + 1
        value = _BYTE[data]
        if n < length:
            self.row = self.first = self.last = self.owner = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, np.uint64)
            return
        gram = window_hashes(value, GRAM)
        least, width = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64), 1
        while 2 * width <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < grams:
            least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
        owner = (least & _PLACE).astype(np.int64)
        sizes = np.diff(offsets)
        starts = np.flatnonzero(np.repeat(offsets[1:], sizes)[: n - length + 1] - np.arange(n - length + 1) >= length)
        owner = owner[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        self.first = starts[at]
        self.last = starts[np.append(at[1:], len(starts)) - 1] if len(at) else self.first
        self.row = np.searchsorted(offsets, self.first, side="right") - 1
        self.owner = owner[at]
        self.anchor = gram[self.owner]
        up, down = Powers.until(n)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value * up, dtype=np.uint64)])
        size = self.last + length - self.first
        self.content = mix(mix((sums[self.last + length] - sums[self.first]) * down[self.first]) + size.astype(np.uint64))


class _Bucket:
    def __init__(self, rows: pa.Table, length: int, copies: np.ndarray):
        """``copies``: the rows (``u``) that are left out."""
        copied = contains(np.sort(copies), _longs(rows, "u").view(np.uint64))
        self.copies, rows = rows.filter(pa.array(copied)), rows.filter(pa.array(~copied))
        self.rows = rows
        self.ids = np.asarray(rows.column("id").fill_null(NO_ID).combine_chunks())
        self.data, self.offsets = unpacked(rows.column("text"))
        self.length, self.side = length, (length - GRAM + 1) // 2
        parts = []
        for lo, hi in row_blocks(self.offsets, BLOCK):
            at = self.offsets[lo]
            r = Runs(self.data[at : self.offsets[hi]], self.offsets[lo : hi + 1] - at, length)
            parts.append((r.row + lo, r.first + at, r.last + at, r.owner + at, r.anchor, r.content))
        none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
        self.row, self.first, self.last, self.owner, self.anchor, self.content = (np.concatenate(p) for p in zip(none, *parts, strict=True))
        self.doc = self.ids[self.row]
        self.distinct, self.least, _, self.number = smallest(self.content, self.doc)

    def part(self, runs: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(runs with such a part, its first and last window start, its core's start)."""
        turn = self.owner[runs] - self.side
        first = np.maximum(self.first[runs], turn + 1) if right else self.first[runs]
        last = self.last[runs] if right else np.minimum(self.last[runs], turn)
        has = first <= last
        core = self.owner[runs] if right else turn
        return runs[has], first[has], last[has], core[has]


def _hashes_at(values: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    for k in range(length):
        out = out * np.uint64(_BASE) + values[start + k]
    return mix(out)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _longs(table, name: str) -> np.ndarray:
    """A column of whole numbers, 0 for null."""
    column = table.column(name).fill_null(0)
    return np.asarray(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
    return whole.cast(pa.binary())


def _buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_SENT = "key long, salt int, salts int, s long, lo long, part int, text binary"
_FOUND = "key long, w long, lo long, s long, part int, place int, mask binary"


def _found(lo, s, part, key=None, w=None, place=None, masks=None) -> pa.RecordBatch:
    nulls = [None] * len(lo)
    return pa.RecordBatch.from_arrays(
        [pa.array(s if key is None else key), pa.array(nulls if w is None else w.view(np.int64), pa.int64()), pa.array(lo), pa.array(s),
         pa.array(part, pa.int32()), pa.array(nulls if place is None else place, pa.int32()), pa.array(nulls, pa.binary()) if masks is None else masks],
        [c.split()[0] for c in _FOUND.split(", ")],
    )


def _compare(symbols: int):
    """Parts sorted by (key, salt) -> masks of windows that a smaller document of the same string has, and for
    cores of several strings one window of each kind. ``part`` is 2 * (bytes before the core) + (right part)."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, salt, salts = _longs(rows, "key"), _longs(rows, "salt"), _longs(rows, "salts")
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        split = np.repeat(size > PIECE, size) | (salts > 1)
        within = np.arange(len(key)) - np.repeat(start, size)
        piece = np.cumsum(new | (within % PIECE == 0)) - 1
        keep = np.flatnonzero(split | np.repeat(size > 1, size))
        if not len(keep):
            return
        s, lo, part = (_longs(rows, c)[keep] for c in ("s", "lo", "part"))
        data, offsets = _buffers(rows.column("text"))
        width = np.diff(offsets)[keep]
        group, split, key, salts, first = piece[keep], split[keep], key[keep], salts[keep], offsets[keep]
        end = np.cumsum(width + 2)  # with the core and an end mark
        begin = end - width - 2
        gone = np.zeros(int(end[-1]), bool)  # window starts that a smaller document has
        told = []
        weight = np.bincount(group, width + 2)[group]
        level = np.ceil(np.log2(weight)).astype(int)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            r, place, later, w = equal_windows(group[own], split[own], lo[own], part[own], data, first[own], width[own])
            r = own[r]
            gone[(begin[r] + place)[later]] = True
            told.append((r[~later], place[~later], w))
        r, place, w = (np.concatenate(x) for x in zip(*told, strict=True))
        # the strings of one core meet here, and those of other tasks later
        order = np.lexsort((lo[r], w, key[r]))
        r, place, w = r[order], place[order], w[order]
        same = np.zeros(len(r), bool)
        same[1:] = (w[1:] == w[:-1]) & (key[r[1:]] == key[r[:-1]])
        heads = np.flatnonzero(~same)
        least = np.repeat(lo[r[heads]], np.diff(np.append(heads, len(r))))
        later = lo[r] > least
        gone[(begin[r] + place)[later]] = True
        out = np.flatnonzero(~later & (salts[r] > 1))
        if len(out):
            r, place, w = r[out], place[out], w[out]
            yield _found(lo[r], s[r], part[r], key[r], w, place)
        hit = np.flatnonzero(np.add.reduceat(gone, begin) > 0)
        if len(hit):
            windows = width[hit] + 2 - symbols
            padded = -(-windows // 8) * 8
            bits = np.zeros(int(padded.sum()), bool)
            bits[_ranges(np.cumsum(padded) - padded, windows)] = gone[_ranges(begin[hit], windows)]
            yield _found(lo[hit], s[hit], part[hit], masks=_binary(np.packbits(bits), padded // 8))

    def equal_windows(group, split, lo, part, data, first, width) -> tuple[np.ndarray, ...]:
        """(part's number, window's place, whether the string has it with a smaller id) of windows; of those without
        a smaller id only where the core has several strings, and then with a hash."""
        size = width + 2
        end = np.cumsum(size)
        begin = end - size
        text = np.ones(int(end[-1]), np.int64)
        plain = np.ones(len(text), bool)
        text[begin + part // 2] = _CORE
        plain[begin + part // 2] = False
        plain[end - 1] = False
        text[plain] = data[_ranges(first, width)].astype(np.int64) + 2
        last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
        text[end[last] - 1] = 0
        order = suffix_arrays(text, np.concatenate([[0], end[last]]))
        run = np.repeat(np.arange(len(size)), size)
        left = np.repeat(end - 1, size) - np.arange(len(text))
        order = order[left[order] >= symbols]
        views = np.lib.stride_tricks.sliding_window_view(text.astype(np.int16), symbols)
        same = np.zeros(len(order), bool)
        for at in range(1, len(order), 1 << 16):
            to = min(at + (1 << 16), len(order))
            same[at:to] = (views[order[at:to]] == views[order[at - 1 : to - 1]]).all(1)
        at_run = run[order]
        same[1:] &= group[at_run[1:]] == group[at_run[:-1]]
        heads = np.flatnonzero(~same)
        ids = lo[at_run]
        least = np.repeat(np.minimum.reduceat(ids, heads), np.diff(np.append(heads, len(order)))) if len(heads) else ids
        later = ids > least
        used = np.flatnonzero(later | split[at_run])
        order, at_run, later = order[used], at_run[used], later[used]
        values = mix(np.arange(_CORE + 1, dtype=np.uint64) + np.uint64(1))[text]
        return at_run, order - begin[at_run], later, _hashes_at(values, order[~later], symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= FLUSH_ROWS:
                rows = pa.Table.from_batches(held)
                key, salt = _longs(rows, "key"), _longs(rows, "salt")
                edge = np.flatnonzero((key != key[-1]) | (salt != salt[-1]))
                cut = int(edge[-1]) + 1 if len(edge) else 0
                if cut:
                    yield from solve(rows.slice(0, cut))
                held, n = rows.slice(cut).to_batches(), len(key) - cut
        if n:
            yield from solve(pa.Table.from_batches(held))

    return run


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for each row; ``kept`` is binary."""
    dealt, n_buckets = bucketed(docs, id_col, text_col, packed=True, **options)

    def run_rows(key, rows: pa.Table, known: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "s", "lo")})
        b = _Bucket(rows, length, _longs(known, "s").view(np.uint64))
        anchor = np.zeros(len(b.distinct), np.uint64)
        anchor[b.number] = b.anchor
        order = np.argsort(b.least, kind="stable")
        return pa.table({
            "a": pa.array(anchor[order].view(np.int64)), "s": pa.array(b.distinct[order].view(np.int64)), "lo": pa.array(b.least[order]),
        })

    def sent_rows(key, rows: pa.Table, known: pa.Table) -> pa.Table:
        parts = [_empty_sent()]
        kind, s = _longs(known, "kind"), _longs(known, "s").view(np.uint64)
        if rows.num_rows and (kind == 1).any():
            b = _Bucket(rows, length, s[kind == COPY])
            wanted, salts = s[kind == 1], _longs(known, "salts")[kind == 1]
            order = np.argsort(wanted)
            wanted, salts = wanted[order], salts[order]
            own = np.full(len(b.distinct), -1)
            theirs = np.flatnonzero(b.doc == b.least[b.number])
            own[b.number[theirs[::-1]]] = theirs[::-1]
            chosen = np.sort(own[contains(wanted, b.distinct)])
            values = _BYTE[b.data]
            for right in (False, True):
                runs, first, last, core = b.part(chosen, right)
                n_left, to = core - first, core + GRAM + b.side
                n_right = last + length - to
                place = np.stack([first, to], 1).ravel()
                text = b.data[_ranges(place, np.stack([n_left, n_right], 1).ravel())]
                many = salts[np.searchsorted(wanted, b.content[runs])]
                content = b.content[runs].view(np.int64)
                core_key = _hashes_at(values, core, GRAM + b.side) ^ np.uint64(right)
                parts.append(pa.table({
                    "key": pa.array(core_key.view(np.int64)), "salt": pa.array((content % many).astype(np.int32)),
                    "salts": pa.array(many.astype(np.int32)), "s": pa.array(content), "lo": pa.array(b.doc[runs]),
                    "part": pa.array((2 * n_left + right).astype(np.int32)), "text": _binary(text, n_left + n_right),
                }))
        return pa.concat_tables(parts)

    def kept_rows(key, rows: pa.Table, known: pa.Table) -> pa.Table:
        kind, s = _longs(known, "kind"), _longs(known, "s").view(np.uint64)
        b = _Bucket(rows, length, s[kind == COPY])
        covered = contains(np.sort(s[kind == 0]), b.distinct)[b.number] | (b.doc > b.least[b.number])
        gone = [_ranges(b.first[covered], b.last[covered] - b.first[covered] + 1)]
        found = np.flatnonzero(kind > 0)
        if len(found):
            open_runs = np.flatnonzero(~covered & contains(np.sort(s[found]), b.content))
            open_runs = open_runs[np.argsort(b.content[open_runs])]
            found = found[np.argsort(s[found], kind="stable")]
            lo = np.searchsorted(b.content[open_runs], s[found], "left")
            n = np.searchsorted(b.content[open_runs], s[found], "right") - lo
            runs, told = open_runs[_ranges(lo, n)], np.repeat(found, n)
            part = _longs(known, "part")[told]
            begin = np.where(part % 2 == 1, np.maximum(b.first[runs], b.owner[runs] - b.side + 1), b.first[runs])
            one = kind[told] == 2
            gone.append(begin[one] + _longs(known, "place")[told[one]])
            data, offsets = _buffers(known.column("mask").fill_null(b""))
            told, begin = told[~one], begin[~one]
            bits = np.unpackbits(data[_ranges(offsets[told], offsets[told + 1] - offsets[told])]).astype(bool)
            gone.append(_ranges(begin, 8 * (offsets[told + 1] - offsets[told]))[bits])
        gone = np.concatenate(gone)
        change = np.bincount(gone, minlength=len(b.data) + 1) - np.bincount(gone + length, minlength=len(b.data) + 1)
        removed = np.cumsum(change[:-1]) > 0
        size = np.diff(b.offsets)
        row = np.repeat(np.arange(len(b.ids)), size)
        spans = removed.copy()
        spans[1:] &= ~removed[:-1]
        begins = b.offsets[:-1][size > 0]
        spans[begins] = removed[begins]
        n_removed = np.bincount(row, removed, len(b.ids)).astype(np.int64)
        whole = np.array([zstandard.frame_content_size(x) for x in b.copies.column("text").to_pylist()], np.int64)
        none = pa.array([b""] * len(whole), pa.binary())
        return pa.concat_tables([
            pa.table({"id": b.rows.column("id"), "n_bytes": pa.array(size), "n_removed": pa.array(n_removed),
                      "n_spans": pa.array(np.bincount(row, spans, len(b.ids)).astype(np.int64)), "kept": _binary(b.data[~removed], size - n_removed)}),
            pa.table({"id": b.copies.column("id"), "n_bytes": pa.array(whole), "n_removed": pa.array(whole), "n_spans": pa.array(whole * 0 + 1), "kept": none}),
        ])

    bucket = bucket_of(F.col("lo"), n_buckets).alias("bucket")
    copies = materialise(_later_copies(docs, length, id_col, text_col).select(bucket_of(F.col("id"), n_buckets).alias("bucket"), F.col("u").alias("s")))
    groups, schema = dealt.groupBy("bucket"), "a long, s long, lo long"
    runs = groups.cogroup(copies.groupBy("bucket")).applyInArrow(run_rows, schema)
    # anchors with many different runs already in a few buckets: at most HOT_BUCKETS * (runs of a bucket) / HOT_RUNS of them
    sample, _ = bucketed(docs, id_col, text_col, packed=True, n_buckets=n_buckets, only=HOT_BUCKETS, **options)
    sample = sample.groupBy("bucket").cogroup(copies.groupBy("bucket")).applyInArrow(run_rows, schema)
    hot = sample.groupBy("a").agg(F.countDistinct("s").alias("seen")).filter(F.col("seen") >= HOT_RUNS)
    share = F.lit(n_buckets / min(HOT_BUCKETS, n_buckets))
    hot = materialise(hot.select("a", F.ceil(F.col("seen") * share / DEALT_RUNS).cast("int").alias("salts")))
    runs = runs.join(F.broadcast(hot), "a", "left")
    runs = runs.select("salts", "lo", F.when(F.col("salts").isNull(), F.col("a")).otherwise(F.xxhash64("a", "s")).alias("a"), "s").repartition("a")
    runs = runs.withColumn("first", F.min("lo").over(Window.partitionBy("a", "s")))
    own = F.sum((F.col("lo") == F.col("first")).cast("long")).over(Window.partitionBy("a"))
    kind = F.when(F.col("lo") > F.col("first"), 0).when(F.col("salts").isNotNull() | (own > 1), 1)
    salts = F.coalesce("salts", F.floor(own / DEALT_RUNS).cast("int") + 1)
    told = runs.select(bucket, "s", kind.alias("kind"), salts.alias("salts")).filter("kind IS NOT NULL")
    same = copies.select("bucket", "s", F.lit(COPY).alias("kind"))
    sent = told.filter("kind = 1").unionByName(same.withColumn("salts", F.lit(1)))
    sent = groups.cogroup(sent.groupBy("bucket")).applyInArrow(sent_rows, _SENT)
    ordered = sent.repartition("key", "salt").sortWithinPartitions("key", "salt")
    found = ordered.mapInArrow(_compare(length - GRAM - (length - GRAM + 1) // 2 + 1), _FOUND)
    least = F.min("lo").over(Window.partitionBy("key", "w"))
    found = found.withColumn("least", least).filter("mask IS NOT NULL OR lo > least")
    found = found.select(bucket, "s", F.when(F.col("mask").isNull(), 2).otherwise(1).alias("kind"), *_EXTRA)
    told = told.filter("kind = 0").select("bucket", "s", "kind").unionByName(same)
    told = told.select("*", *(F.lit(None).cast(t).alias(c) for c, t in _EXTRA.items())).unionByName(found)
    return groups.cogroup(told.groupBy("bucket")).applyInArrow(kept_rows, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


COPY = -1
_EXTRA = {"part": "int", "place": "int", "mask": "binary"}


def _later_copies(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """(id, u) of rows whose whole text, of ``length`` bytes at least, also stands in a row with a smaller id."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    rows = rows.filter(F.octet_length("text") >= length)
    rows = rows.select("id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), row_key("id", "text").alias("u"))
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("last > first").select("digest", "first")
    return rows.join(first, "digest").filter("id > first").select("id", "u")


def _empty_sent() -> pa.Table:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.table({c.split()[0]: pa.array([], types[c.split()[1]]) for c in _SENT.split(", ")})
