"""Trie of conversation prefixes, screened by a count-min sketch.

A prefix is named by 128 bits: the sum, over its turns, of a hash of the turn's depth and of the SHA-256
of its role and text. Texts stay where they are read; what is shuffled is a row of numbers for each turn.

Screening: every prefix of every conversation is counted in a count-min sketch of two rows, whose cells
are taken from the two halves of the name. Tasks send their non-empty cells, slice by slice, one task
merges a slice, and only "held once" or "held more often" is kept, one bit a cell (``max_bits`` cells a
row at most, so at most 2 * max_bits / 8 bytes are broadcast). A count-min estimate is never too low, so
an estimate of one proves that one conversation alone has the prefix: its node, with one member, one leaf
below and nothing saved, is written where it is found. Only other prefixes are shuffled and grouped
exactly. With more prefixes than ``max_bits`` / 8 the estimates grow and more prefixes take the exact
way; results stay the same.

Sums over subtrees need no walk over levels. Each node is owned by its smallest member; the nodes that a
conversation owns are the end of its path. A node's sum over its subtree is therefore the sum, over its
members, of what each owns at or below the node's depth: one running sum along each conversation and one
combinable aggregation by node. The hash of the conversations that end at a node is sequential by its
definition: ids are sorted by range, packed into long strings within their partitions, and only these
meet, in order, in the task of their node, which reads them as a stream.

Groups are only ever combined by sums, minima and counts; a join by parent may be split by the adaptive
planner. A conversation is the unit of the windows (which spill): its turns are numbered in one task.

Defined cases: rows with a null conv_id take no part; null turns come first, null role and text are
empty; turns of equal number are ordered by the hash of role and text, repeated rows are turns of their
own; conversations rebuilt without turns are members of the root only; an empty table has no root and
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialise

RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOBODY = hashlib.sha256(b"").hexdigest()
SLICE = 1 << 16  # cells of a sketch row that one task merges; offsets within it have 16 bits
_LOW = (1 << 32) - 1


def shared_turns(conv_id: Column, most: int = 9) -> Column:
    """How many first turns a conversation takes over: unsigned crc32 of its decimal id, modulo ``most``."""
    return F.crc32(conv_id.cast("string").cast("binary")) % most


def _packed(low: Column, high: Column) -> Column:
    return low.bitwiseAND(_LOW).bitwiseOR(F.shiftleft(high.bitwiseAND(_LOW), 32))


def rebuilt_paths(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """(c, d, hi, lo, parent_hi, parent_lo, bytes, last): each rebuilt conversation's prefixes, and its root (d = 0).

    Conversation c takes the first turns (see ``shared_turns``) of conversation c - c % family, then its own after these."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        (F.col("conv_id") - F.col("conv_id") % family).cast("long").alias("f"),
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(framed.cast("binary"), 256)).alias("name"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    turns = turns.withColumn("name", F.substring("name", 1, 16))
    own = W.partitionBy("f", "c")
    pos = F.row_number().over(own.orderBy(F.col("turn").asc_nulls_first(), "name")).cast("long") - 1
    turns = turns.withColumn("own", F.count(F.lit(1)).over(own)).withColumn("pos", pos)
    first = F.when(F.col("pos") == 0, F.struct("c", "own", shared_turns(F.col("c"), most).alias("h")))
    turns = turns.withColumn("members", F.collect_list(first).over(W.partitionBy("f")))
    of_base = lambda x: F.coalesce(F.get(F.filter("members", lambda m: m["c"] == F.col("f")), F.lit(0))["own"], F.lit(0))
    taken = lambda m: F.least(m["h"], of_base(m))
    length = lambda m: taken(m) + F.greatest(m["own"] - m["h"], F.lit(0))
    me = F.struct(F.col("c"), F.col("own"), shared_turns(F.col("c"), most).alias("h"))
    place = lambda m, at: F.struct(m["c"].alias("c"), at.cast("long").alias("at"), length(m).cast("long").alias("n"))
    none = F.array().cast("array<struct<c:bigint,at:bigint,n:bigint>>")
    root = F.when(F.col("pos") == 0, F.array(place(me, F.lit(-1)))).otherwise(none)
    kept = F.when(F.col("pos") >= me["h"], F.array(place(me, F.col("pos") - me["h"] + taken(me)))).otherwise(none)
    lent = F.when(
        (F.col("c") == F.col("f")) & (F.col("pos") < most), F.transform(F.filter("members", lambda m: m["h"] > F.col("pos")), lambda m: place(m, F.col("pos")))
    ).otherwise(none)
    rows = turns.select("f", "name", "bytes", F.explode(F.concat(root, kept, lent)).alias("p"))
    rows = rows.select("f", F.col("p.c").alias("c"), (F.col("p.at") + 1).alias("d"), F.col("p.n").alias("n"), "name", "bytes")
    one, two = F.xxhash64("d", "name"), F.xxhash64(F.lit(1), "name", "d")
    lanes = [one.bitwiseAND(_LOW), F.shiftrightunsigned(one, 32), two.bitwiseAND(_LOW), F.shiftrightunsigned(two, 32)]
    rows = rows.select("*", *[F.when(F.col("d") > 0, x).otherwise(F.lit(0)).alias(f"l{i}") for i, x in enumerate(lanes)])
    path = W.partitionBy("f", "c").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("c", "d", "n", "bytes", *[f"l{i}" for i in range(4)], *[F.sum(f"l{i}").over(path).alias(f"s{i}") for i in range(4)])
    now, before = [F.col(f"s{i}") for i in range(4)], [F.col(f"s{i}") - F.col(f"l{i}") for i in range(4)]
    return rows.select(
        "c", "d", _packed(now[0], now[1]).alias("hi"), _packed(now[2], now[3]).alias("lo"),
        _packed(before[0], before[1]).alias("parent_hi"), _packed(before[2], before[3]).alias("parent_lo"),
        F.when(F.col("d") > 0, F.col("bytes")).otherwise(F.lit(0)).alias("bytes"), (F.col("d") == F.col("n")).alias("last"),
    )


def _cells(batch: pa.RecordBatch, prefix: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.asarray(batch.column(prefix + x), np.int64) & (bits - 1) for x in ("hi", "lo"))


def _sliced(cells: np.ndarray, counts: np.ndarray, row: int, width: int) -> Iterator[tuple]:
    """(row, slice, cells held once, cells held more often) as 16-bit offsets within the slice."""
    starts = np.flatnonzero(np.r_[True, np.diff(cells // width) > 0])
    for a, b in zip(starts, np.r_[starts[1:], len(cells)], strict=True):
        inside, many = (cells[a:b] % width).astype(np.uint16), counts[a:b] > 1
        yield row, int(cells[a] // width), inside[~many].tobytes(), inside[many].tobytes()


def count_cells(batches: Iterator[pa.RecordBatch], bits: int, width: int, at_once: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The task's sketch, sent in slices whenever ``at_once`` prefixes have been counted."""

    def sent() -> pa.RecordBatch:
        rows = []
        for row in range(2):
            cells, counts = np.unique(np.concatenate([h[row] for h in held]), return_counts=True)
            rows += _sliced(cells, counts, row, width) if len(cells) else []
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["row", "slice", "once", "more"])

    held: list = []
    for batch in batches:
        held.append(_cells(batch, "", bits))
        if sum(len(h[0]) for h in held) >= at_once:
            yield sent()
            held = []
    if sum(len(h[0]) for h in held):
        yield sent()


def merge_slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(row, slice, bits): the cells that are held more than once; slices arrive sorted and are summed as a stream."""
    key, cells = None, np.zeros(width, np.uint8)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([np.packbits(cells > 1).tobytes()])], ["row", "slice", "bits"])

    for batch in batches:
        for row, number, once, more in zip(*(batch.column(x).to_pylist() for x in ("row", "slice", "once", "more")), strict=True):
            if (row, number) != key:
                if key is not None:
                    yield done()
                key, cells = (row, number), np.zeros(width, np.uint8)
            at = np.frombuffer(once, np.uint16)
            cells[at] = np.minimum(cells[at] + 1, 2)
            cells[np.frombuffer(more, np.uint16)] = 2
    if key is not None:
        yield done()


def sketch(paths: DataFrame, max_bits: int, width: int = SLICE) -> np.ndarray:
    """2 x cells / 8 bytes: a bit for each cell that is held more than once."""
    n = paths.count()
    bits = 1 << min(max(8 * n, width).bit_length(), max_bits.bit_length() - 1)
    slices = paths.select("hi", "lo").mapInArrow(lambda b: count_cells(b, bits, width), "row long, slice long, once binary, more binary")
    slices = slices.repartition("row", "slice").sortWithinPartitions("row", "slice")
    out = np.zeros((2, bits // width, width // 8), np.uint8)
    for r in slices.mapInArrow(lambda b: merge_slices(b, width), "row long, slice long, bits binary").toLocalIterator():
        out[r.row, r.slice] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(2, -1)


def screen(paths: DataFrame, max_bits: int, width: int = SLICE) -> DataFrame:
    """``paths`` with single (the sketch proves that one conversation has the prefix) and parent_single."""
    shared = paths.sparkSession.sparkContext.broadcast(sketch(paths.filter("d > 0"), max_bits, width))

    def alone(batch: pa.RecordBatch, prefix: str) -> np.ndarray:
        held, single = shared.value, np.zeros(len(batch), bool)
        for row, cells in enumerate(_cells(batch, prefix, held.shape[1] * 8)):
            single |= (held[row, cells >> 3] >> (7 - (cells & 7)) & 1) == 0
        return single

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.asarray(batch.column("d"), np.int64)
            single, above = (d > 0) & alone(batch, ""), (d > 1) & alone(batch, "parent_")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single), pa.array(above)], [*batch.schema.names, "single", "parent_single"])

    return paths.mapInArrow(marked, T.StructType([*paths.schema.fields, *[T.StructField(x, T.BooleanType()) for x in ("single", "parent_single")]]))


def packed_ids(batches: Iterator[pa.RecordBatch], at_most: int = 4096) -> Iterator[pa.RecordBatch]:
    """(hi, lo, first, ids): runs of at most ``at_most`` ids of one node, from rows sorted by node and id."""
    for batch in batches:
        hi, lo, c = (np.asarray(batch.column(x), np.int64) for x in ("hi", "lo", "c"))
        if not len(c):
            continue
        new = np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]
        start = np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
        at = np.flatnonzero(new | ((np.arange(len(c)) - start) % at_most == 0))
        ids = [",".join(map(str, x.tolist())) for x in np.split(c, at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hi[at], lo[at], c[at], ids)], ["hi", "lo", "first", "ids"])


def hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo, ends_sha256) of nodes whose packed ids arrive in order."""
    key, state = None, None
    for batch in batches:
        done = []
        for *node, ids in zip(*(batch.column(x).to_pylist() for x in ("hi", "lo", "ids")), strict=True):
            if node != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _hashes(done)
    if key is not None:
        yield _hashes([(*key, state.hexdigest())])


def _hashes(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["hi", "lo", "ends_sha256"])


def _ends(ending: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256): SHA-256 of the comma-joined ids, numerically rising, of the conversations that end at a node."""
    ranged = ending.select("hi", "lo", "c").repartitionByRange("c").sortWithinPartitions("hi", "lo", "c")
    packed = ranged.mapInArrow(packed_ids, "hi long, lo long, first long, ids string")
    return packed.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(hashed_ids, "hi long, lo long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = 5, most: int = 9, max_bits: int = 1 << 27, width: int = SLICE) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    paths = materialise(screen(materialise(rebuilt_paths(conversations, family, most)), max_bits, width))
    roots = paths.filter("d = 0")
    n_convs, smallest = roots.agg(F.count(F.lit(1)), F.min("c")).first()
    if not n_convs:
        return spark.createDataFrame([], RESULT)
    alone, maybe = paths.filter("single"), paths.filter("d > 0 AND NOT single")
    most_of = [F.max(x).alias(x) for x in ("parent_hi", "parent_lo", "bytes", "parent_single")]
    nodes = maybe.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), F.max("d").alias("depth"), *most_of)
    below = nodes.filter("depth > 1 AND NOT parent_single").select("parent_hi", "parent_lo")
    below = below.unionAll(alone.filter("d > 1 AND NOT parent_single").select("parent_hi", "parent_lo"))
    children = below.groupBy(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(nodes.join(children, ["hi", "lo"], "left").fillna(0, "n_children"))

    saved, leaf = (F.col("n_convs") - 1) * F.col("bytes"), (F.col("n_children") == 0).cast("long")
    nobody = [F.lit(None).cast("long").alias(x) for x in ("hi", "lo")]
    zero = F.lit(0).cast("long")
    owned = maybe.select("c", "d", "hi", "lo", zero.alias("saved"), zero.alias("leaf"))
    owned = owned.unionAll(nodes.select("conv_id", "depth", *nobody, saved, leaf)).unionAll(alone.filter("last").select("c", "d", *nobody, zero, zero + 1))
    deeper = W.partitionBy("c").orderBy(F.col("d").desc()).rangeBetween(W.unboundedPreceding, 0)
    owned = owned.select("hi", "lo", F.sum("saved").over(deeper).alias("saved"), F.sum("leaf").over(deeper).alias("leaf")).filter("hi IS NOT NULL")
    subtree = owned.groupBy("hi", "lo").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    of_nodes = nodes.agg(F.count_if(F.col("depth") == 1), F.sum(leaf), F.sum(saved)).first()
    of_alone = alone.agg(F.count_if(F.col("d") == 1), F.count_if("last")).first()
    leaves = (of_nodes[1] or 0) + of_alone[1]
    top = (0, 0, None, None, False, smallest, 0, n_convs, of_nodes[0] + of_alone[0], max(leaves, 1), of_nodes[2] or 0)
    kinds = "hi long, lo long, parent_hi long, parent_lo long, parent_single boolean, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    many = nodes.join(subtree, ["hi", "lo"]).select(*[x.split()[0] for x in kinds.split(", ")]).unionAll(spark.createDataFrame([top], kinds))
    many = many.join(_ends(paths.filter("last AND NOT single")), ["hi", "lo"], "left").fillna(NOBODY, "ends_sha256").drop("hi", "lo")
    own_end = F.when(F.col("last"), F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(F.lit(NOBODY))
    single = alone.select(
        "parent_hi", "parent_lo", "parent_single", F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"),
        own_end.alias("ends_sha256"),
    )
    every = many.unionAll(single)
    known = every.filter("depth <= 1 OR parent_single").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, F.lit(smallest)).when(F.col("depth") > 1, F.col("conv_id"))
    )
    parents = nodes.select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv_id").alias("parent_conv_id"))
    asked = every.filter("depth > 1 AND NOT parent_single").join(parents, ["parent_hi", "parent_lo"])
    names = [x.split()[0] for x in RESULT.split(", ")]
    return known.select(*names).unionAll(asked.select(*names))
