"""N-gram Jaccard join by partitioning the universe of shingles (pigeonhole principle).

Two sets of sizes a and b with Jaccard similarity of at least t differ in at most
H = (a + b) * (1 - t) / (1 + t) elements. Sizes are cut into bands; within a band a hash deals the
universe into m segments. A set indexes the sum of its hashes in each segment, and in the first x
segments also the sums that miss one element (the one-deletion neighbourhood). A whole segment
counts as one unit, as a pair whose entries there differ has one difference at least, and one with
deletions as two. So m + x = H + 1 + z units are enough to meet, even when z of them are left out:
a set leaves out segments with fewer than two elements, which collide with unrelated sets, as long
as these weigh no more than z, and indexes all otherwise. For each band the allocation (m, x, z) with
the fewest expected entries is taken among those whose tiny segments rarely weigh more than z;
``COLLISION`` is the price of a tiny segment where none is left out.

Sets are represented by their digest, so copies are one entity. Before anything is indexed, entities
without any possible partner leave: in the order of hashes, the first n - ceil(t * n) + 1 + n / 8
elements of two similar sets have more than k in common, k being an eighth of the smaller set, and
that has ceil(t * n) elements at least. An entity of whose first elements no more than so many stand
among the first elements of others has no partner. Elements met twice among the
texts that a task takes at once (``FIRST_ROWS`` elements) are settled there and travel as two rows. Entities that share an index entry
are first compared with one of them, the one that shares most entries with others (in a group of
near copies that is their common original); what exact verification confirms is merged into
components. Entries whose members then still lie in several components yield the remaining pairs
between these, which are verified too. So no pair is lost, and large groups of near copies cost a
link each and not all pairs. Before texts are fetched, pairs pass an exact bound inside the join:
each set has a sketch of parities (bit i: is the number of elements with hash i modulo 1024 odd),
and two sets differ in at least as many elements as their sketches in bits. Texts of entities that
may have partners travel compressed.

Defined cases: null or blank texts have an empty set and stay alone; texts with fewer words than a
shingle count as one shingle of all their words; a null id counts as the largest; texts of one id,
or without one, are told apart by a 64-bit hash and verified each by its own; repeated rows get equal answers; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, row_blocks, utf8_buffers
from ._repeats import NO_ID, _packed, unpacked
from ._words import Words, mix, window_hashes
from .components import connected_components


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the offsets of each row's set."""
    words = Words(data, offsets, "space_lower")
    counts, row = words.counts(), words.row_of()
    left = words.rows[1:][row] - np.arange(len(row))
    at = np.flatnonzero(left >= size)
    hashes, rows = [window_hashes(words.hash, size)[at]], [row[at]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        hashes.append(mix(window_hashes(words.hash, n)[words.rows[short]] + np.uint64(n)) if len(short) else np.zeros(0, np.uint64))
        rows.append(short)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.argsort(h)
    order = order[np.argsort(r[order], kind="stable")]
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(len(offsets)))


def set_digests(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, 0 for the empty one."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    n = np.diff(at)
    return np.where(n > 0, mix((total[at[1:]] - total[at[:-1]]) ^ n.astype(np.uint64)), np.uint64(0))


SKETCH_WORDS = 16
BLOCK = 1 << 20
FIRST_ROWS = 1 << 18
COLLISION = 32
SMALLEST_MEAN = 4
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def parity_sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows x SKETCH_WORDS of 64 parities each."""
    rows, bits = len(at) - 1, 64 * SKETCH_WORDS
    row = np.repeat(np.arange(rows), np.diff(at))
    place = (mix(h ^ np.uint64(0x9FB21C651E98DF25)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(row * bits + place, minlength=rows * bits).reshape(rows, bits) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64).reshape(rows, SKETCH_WORDS)


class Bands:
    """Size bands for a threshold of percent / 100: lower ends, and per band H, the number of segments, how many of
    these have one-deletion neighbourhoods, and the units that may be skipped."""

    def __init__(self, percent: int, largest: int = 1 << 31):
        self.low = [1]
        while self.low[-1] <= largest:
            self.low.append(max(self.low[-1] + 1, 100 * self.low[-1] // percent + 1))
        self.low = np.array(self.low)
        high = self.low[1:] - 1
        top = 100 * high // percent
        self.differ = ((high + top) * (100 - percent)) // (100 + percent)
        plans = [self._plan(h, n) for h, n in zip(self.differ.tolist(), self.low.tolist(), strict=False)]
        self.segments, self.deletion, self.slack = map(np.array, zip(*plans, strict=True))

    @staticmethod
    def _plan(h: int, n: int) -> tuple[int, int, int]:
        """(segments, those with deletions, slack) of the least cost for differences of h and sizes from n."""
        if not h:
            return 1, 0, 0
        pairs = (h + 2) // 2
        tiny = _tiny(n / np.array([h + 1, pairs])) * [h + 1, pairs]
        costs = {(h + 1, 0, 0): h + 1 + COLLISION * tiny[0], (pairs, pairs, 0): n + pairs + COLLISION * tiny[1]}
        for m in np.unique(np.linspace(pairs, max(pairs, n // SMALLEST_MEAN), 40).astype(int)).tolist():
            x = np.unique(np.linspace(0, m, 200).astype(int))
            lost = (m + x) * _tiny(n / m)
            enough = np.flatnonzero(m + x - h - 1 >= lost + 4 * np.sqrt(lost))
            if len(enough):
                deleted = int(x[enough[0]])
                costs[m, deleted, m + deleted - h - 1] = m + deleted * n / m
        return min(costs, key=lambda plan: (costs[plan], plan))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1


def _tiny(mean):
    """The chance that a segment has fewer than two elements."""
    return np.exp(-mean) * (1 + mean)


def signatures(h: np.ndarray, at: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(index entry, row) of all sets, in the spaces of their own band and the one below."""
    n = np.diff(at)
    value = mix(h ^ np.uint64(0x2545F4914F6CDD1D))
    out, owners = [], []
    for below in (0, 1):
        space = bands.of(n) - below
        rows = np.flatnonzero((n > 0) & (space >= 0))
        rows = rows[bands.differ[space[rows]] > 0]
        if not len(rows):
            continue
        m, s = bands.segments[space[rows]], space[rows]
        base = np.concatenate([[0], np.cumsum(m)])
        element = np.concatenate([np.arange(a, b) for a, b in zip(at[rows], at[rows + 1], strict=True)])
        turn = np.repeat(np.arange(len(rows)), n[rows])
        segment = ((h[element] >> np.uint64(32)) * m[turn].astype(np.uint64)) >> np.uint64(32)
        slot = base[turn] + segment.astype(np.int64)
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, slot, value[element])
        held = np.bincount(slot, minlength=base[-1])
        owner = np.repeat(np.arange(len(rows)), m)
        number = np.arange(base[-1]) - base[owner]
        near = number < bands.deletion[s][owner]
        lost = np.add.reduceat((held < 2) * (1 + near), base[:-1])
        use = (held >= 2) | (lost > bands.slack[s])[owner]
        tag = mix((s[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64))
        out.append(mix(sums + tag)[use])
        owners.append(rows[owner[use]])
        missing = (near & use)[slot]
        at_slot = slot[missing]
        out.append(mix(sums[at_slot] - value[element[missing]] + tag[at_slot]))
        owners.append(rows[turn[missing]])
    return (np.concatenate(out), np.concatenate(owners)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


def _blocks(column: pa.Array):
    """(lo, hi, bytes, offsets) of texts, ``BLOCK`` bytes or one text at a time; packed texts are unpacked by block."""
    if pa.types.is_binary(column.type):
        sizes = [zstandard.frame_content_size(x) for x in column.to_pylist()]
        for lo, hi in row_blocks(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), BLOCK):
            yield lo, hi, *unpacked(column.slice(lo, hi - lo))
        return
    data, offsets = utf8_buffers(column)
    for lo, hi in row_blocks(offsets, BLOCK):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _sets_of(batch: pa.RecordBatch, size: int):
    for lo, hi, data, offsets in _blocks(batch.column("text")):
        yield lo, hi, *shingle_sets(data, offsets, size)


def _set_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, h, at in _sets_of(batch, size):
            sketch = parity_sketches(h, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(lo, hi - lo) for c in ("id", "t")]
                + [pa.array(np.diff(at)), pa.array(set_digests(h, at).view(np.int64))]
                + [pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH_WORDS)],
                ["id", "t", "n", "d", *SKETCH],
            )


def _first_rows(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(token, d, kind, weight). Kind 1: elements among the first ones of set ``d``, weighing 1 unless the batch has
    shown them to be common; kind 0: one row a set, the number of its common elements less the number needed."""

    def told(sets: list) -> pa.RecordBatch:
        token, owner, d, need = (np.concatenate(x) for x in zip(*sets, strict=True))
        order = np.argsort(token)
        token, owner = token[order], owner[order]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        times = np.diff(np.append(start, len(token)))
        common = np.bincount(owner, np.repeat(times > 1, times), len(d)).astype(np.int64)
        at = np.sort(np.concatenate([start, start[times > 1] + 1]))
        weight = np.repeat((times == 1).astype(np.int32), np.minimum(times, 2))
        d = d.view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([token[at].view(np.int64), d])), pa.array(np.concatenate([d[owner[at]], d])),
             pa.array(np.concatenate([np.ones(len(at), np.int32), np.zeros(len(d), np.int32)])),
             pa.array(np.concatenate([weight, (common - need).astype(np.int32)]))],
            ["token", "d", "kind", "weight"],
        )

    for batch in batches:
        sets, base, held, done = [], 0, 0, set()
        for _, _, h, at in _sets_of(batch, size):
            d, n = set_digests(h, at), np.diff(at)
            new = np.array([x != 0 and x not in done and not done.add(x) for x in d.tolist()], bool)
            n, first, d = n[new], at[:-1][new], d[new]
            p = np.minimum(n, n - -(-n * percent // 100) + 1 + n // 8)
            if len(n):
                sets.append((h[_ranges(first, p)], np.repeat(np.arange(len(n)) + base, p), d, -(-n * percent // 100) // 8 + 1))
                base, held = base + len(n), held + int(p.sum())
            if held > FIRST_ROWS:
                yield told(sets)
                sets, base, held, done = [], 0, 0, set()
        if sets:
            yield told(sets)


def _entry_rows(batches: Iterator[pa.RecordBatch], size: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, h, at in _sets_of(batch, size):
            d = np.asarray(batch.column("d").slice(lo, hi - lo))
            entry, row = signatures(h, at, bands)
            yield pa.RecordBatch.from_arrays([pa.array(entry.view(np.int64)), pa.array(d[row])], ["entry", "d"])


def _digest_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Packed texts with the digest of their own set, the first of each digest in a task."""
    done: set[int] = set()
    for batch in batches:
        for lo, hi, h, at in _sets_of(batch, size):
            d = set_digests(h, at).view(np.int64)
            first = pa.array(np.array([x not in done and not done.add(x) for x in d.tolist()], bool))
            yield pa.RecordBatch.from_arrays([pa.array(d).filter(first), batch.column("text").slice(lo, hi - lo).filter(first)], ["d", "text"])


def _verified(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with their packed texts, those that are similar."""
    last, last_set = None, None
    for batch in batches:
        firsts = batch.column("a").to_pylist()
        keep = np.zeros(batch.num_rows, bool)
        for lo, hi, data, offsets in _blocks(batch.column("text_b")):
            h, at = shingle_sets(data, offsets, size)
            for i in range(lo, hi):
                if firsts[i] != last or last_set is None:
                    one, ends = unpacked(batch.column("text_a").slice(i, 1))
                    last, last_set = firsts[i], shingle_sets(one, ends, size)[0]
                other = h[at[i - lo] : at[i - lo + 1]]
                where = np.searchsorted(last_set, other)
                where[where == len(last_set)] = 0
                common = int((last_set[where] == other).sum()) if len(last_set) else 0
                keep[i] = 100 * common >= percent * (len(last_set) + len(other) - common) > 0
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])


def _keyed(id_col: str, text_col: str) -> list:
    """(id, t, text): ``t`` is a hash that tells the texts of one id apart."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("t"), text.alias("text")]


def near_duplicates(
    docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) for each row."""
    light, labels = _components(docs, size, percent, id_col, text_col)
    return light.select("id", "n", "d").join(labels.select("d", "component_id"), "d", "left").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
    )


def drop_near_duplicates(
    docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows of ``docs`` with one text for each component: that of the smallest id, null ids last; among
    texts of one id the smallest digest, then the smallest hash of the text. Rows without shingles and
    repeats of a kept row stay.
    """
    light, labels = _components(docs, size, percent, id_col, text_col)
    kept = (F.col("id") == F.col("keep_id")) & (F.col("t") == F.col("keep_t")) & (F.col("d") == F.col("keep_d"))
    gone = light.filter("n > 0").join(labels, "d").filter(~kept).select(F.col("id").alias("__id"), F.col("t").alias("__t")).distinct()
    row_id, t, _ = _keyed(id_col, text_col)
    rows = docs.withColumns({"__id": row_id, "__t": t})
    return rows.join(gone, ["__id", "__t"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _components(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, t, n, d, ...), and for each digest (d, component_id, keep_id, keep_d, keep_t): the smallest id of
    its component, and the id, digest and text hash of the row that represents it."""
    bands = Bands(percent)
    texts = docs.select(*_keyed(id_col, text_col))
    schema = "id long, t long, n long, d long, " + ", ".join(f"{c} long" for c in SKETCH)
    light = materialise(texts.mapInArrow(lambda b: _set_rows(b, size), schema))
    same = [F.min(c).alias(c) for c in SKETCH]
    entities = light.filter("n > 0").groupBy("d").agg(F.min(F.struct("id", "t")).alias("first"), F.min("n").alias("n"), *same)
    entities = materialise(entities.select("d", F.col("first.id").alias("rep"), F.col("first.t").alias("rep_t"), "n", *SKETCH))

    firsts = texts.select("text").mapInArrow(lambda b: _first_rows(b, size, percent), "token long, d long, kind int, weight int")
    same_token = Window.partitionBy("token", "kind")
    several = F.min("d").over(same_token) != F.max("d").over(same_token)
    score = F.when((F.col("kind") == 0) | several, F.col("weight")).otherwise(0)
    possible_d = firsts.repartition("token").select("d", score.alias("score")).groupBy("d").agg(F.sum("score").alias("score"))
    alive = materialise(entities.join(possible_d.filter("score >= 0"), "d", "left_semi"))
    packed = texts.mapInArrow(_packed, "id long, t long, text binary")
    own = packed.join(alive.select(F.col("rep").alias("id"), F.col("rep_t").alias("t")), ["id", "t"], "left_semi").select("text")
    held = materialise(own.mapInArrow(lambda b: _digest_rows(b, size), "d long, text binary").dropDuplicates(["d"]))

    entries = held.mapInArrow(lambda b: _entry_rows(b, size, bands), "entry long, d long")
    held_by = F.count(F.lit(1)).over(Window.partitionBy("entry"))
    shared = materialise(entries.withColumn("held", held_by).filter("held > 1"))
    degree = shared.groupBy("d").agg(F.sum("held").alias("degree"))
    best = F.max(F.struct("degree", "d")).over(Window.partitionBy("entry"))
    stars = shared.select("entry", "d").join(degree, "d").withColumn("leader", best["d"])
    stars = materialise(stars.filter("d <> leader").select("entry", "leader", "d"))

    def possible(na, nb, a: str, b: str):
        """Whether sizes and sketches leave the similarity possible."""
        differ = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH), F.lit(0))
        sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
        return sizes & (differ * (100 + percent) <= (na + nb) * (100 - percent))

    def sized(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of digests that may be similar."""
        one, two = alive.alias("one"), alive.alias("two")
        both = pairs.join(two, F.col("b") == F.col("two.d"))
        fits = (F.col("a") == F.col("one.d")) & possible(F.col("one.n"), F.col("two.n"), "one", "two")
        return both.join(one, fits).select("a", "b")

    pairs = materialise(sized(stars.select(F.col("leader").alias("a"), F.col("d").alias("b")).distinct()))

    def links(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(held.select(F.col("d").alias("b"), F.col("text").alias("text_b")), "b")
        rows = rows.join(held.select(F.col("d").alias("a"), F.col("text").alias("text_a")), "a")
        return rows.select("a", "b", "text_a", "text_b").mapInArrow(lambda x: _verified(x, size, percent), "a long, b long")

    first = materialise(links(pairs))
    found = connected_components(first.select(F.col("a").alias("u"), F.col("b").alias("v")))

    def labelled(rows: DataFrame, name: str) -> DataFrame:
        own = found.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}"))
        return rows.join(own, name, "left").withColumn(f"c_{name}", F.coalesce(f"c_{name}", name))

    mixed = labelled(labelled(stars, "d"), "leader").filter("c_d <> c_leader").select("entry").distinct()
    rest = stars.join(mixed, "entry", "left_semi")
    rest = rest.select("entry", "d").union(rest.select("entry", F.col("leader").alias("d"))).distinct()
    # entries with the same members give the same pairs, so one of them is enough
    members = rest.groupBy("entry").agg(F.bit_xor(F.xxhash64("d")).alias("x"), F.bit_xor(F.xxhash64("d", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("k"))
    rest = rest.join(members.groupBy("x", "y", "k").agg(F.min("entry").alias("entry")).select("entry"), "entry", "left_semi")
    rest = materialise(labelled(rest, "d").join(alive.select("d", "n", *SKETCH), "d"))
    one, two = rest.alias("one"), rest.alias("two")
    open_pair = (F.col("one.entry") == F.col("two.entry")) & (F.col("one.d") < F.col("two.d"))
    open_pair = open_pair & (F.col("one.c_d") != F.col("two.c_d"))
    more = one.join(two, open_pair & possible(F.col("one.n"), F.col("two.n"), "one", "two"))
    more = more.select(F.col("one.d").alias("a"), F.col("two.d").alias("b")).distinct()
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = more.join(tried, ["a", "b"], "left_anti")
    second = materialise(links(more))

    groups = found
    if not second.isEmpty():
        over = labelled(labelled(second, "a"), "b").select(F.col("c_a").alias("u"), F.col("c_b").alias("v"))
        merged = connected_components(over)
        low = merged.select(F.col("node").alias("component"), F.col("component").alias("low"))
        every = found.unionByName(merged.select("node", F.col("node").alias("component"))).distinct()
        groups = every.join(low, "component", "left").select("node", F.coalesce("low", "component").alias("component"))
        groups = materialise(groups.groupBy("node").agg(F.min("component").alias("component")))
    rep = F.struct(F.col("rep").alias("keep_id"), F.col("d").alias("keep_d"), F.col("rep_t").alias("keep_t"))
    member = entities.select("d", rep.alias("first")).join(groups.withColumnRenamed("node", "d"), "d")
    smallest = member.groupBy("component").agg(F.min("first").alias("low"))
    labels = member.join(smallest, "component").select("d", "low")
    labels = entities.select("d", rep.alias("first")).join(labels, "d", "left").select("d", F.coalesce("low", "first").alias("low"))
    return light, labels.select("d", F.col("low.keep_id").alias("component_id"), "low.*")
