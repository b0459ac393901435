"""Secret scan: three fixed rules, and a character network over every other candidate.

One pass over the texts finds the rules' spans and all candidates: runs of ``A-Za-z0-9+/_=.-`` with 16
characters, or with 8 and a digit. A candidate is kept as windows of bytes with its context before and
after (long runs as several windows, so none is cut short); texts themselves go no further. The network
(``char_cnn``) learns from labelled findings: candidates that a rule covers are positive, the others
negative; those labels can be replaced by a reviewer's (``findings``). Every window of every labelled
candidate of the training folds is learnt from (a candidate's windows share its weight and have its label),
plus copies of positives in a negative's surroundings and with re-lettered values, so that neither a key word
nor an alphabet is all it knows. Equal windows are counted, the rarer class is repeated, and all are dealt by
hash over shards of about ``SHARD`` samples, whose number grows with the table. In each round a task goes once
through its shards, from the same weights; the weights (and Adam's means) after it are averaged by the shards'
samples. The calibration fold is scored as a whole, a candidate by its likeliest window: sums over all of
it calibrate the logits (Platt), and counts of all its positives give the threshold, the highest probability
at which the share ``recall`` of them is still found. Then every candidate of every text is scored.

The rules' spans always stay; the network adds spans of kind ``cnn`` where no rule's span overlaps.

Defined cases: null and empty texts have no spans; repeated rows and null ids are rows of their own;
spans are code points, end exclusive, by start, then kind, then end; without positives or negatives in
the training or the calibration fold, or where negatives get the larger logits, the network adds nothing; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import char_cnn
from ._common import materialise, row_blocks, utf8_buffers
from .char_cnn import AFTER, BATCH, BEFORE, BODY, WINDOW, Detector

#: The base rules in their order, the group that is measured and its least length.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
    ("hex", r"[0-9a-f]+", 0, 0, 32),
)
KINDS = (*(r[0] for r in RULES), "cnn")
_COMPILED = [(i, re.compile(r[1], r[2]), r[3], r[4]) for i, r in enumerate(RULES)]
#: Holds of every text that a rule can match; a linear automaton looks for it in whole columns.
_MAYBE = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")] = True
PIECE = WINDOW + 1  # a window's bytes and the number of its body bytes
#: Samples of a shard, copies included; a task trains on a shard at a time.
SHARD = 6000
#: Where a class weighs less than the other by more than this factor, its windows are repeated; weights do the rest.
RARER = 4
#: Tasks that add up the shards' weights before the driver does.
FAN_IN = 16
EXAMINED = (
    "kind array<int>, start array<long>, end array<long>, run_start array<long>, run_end array<long>, "
    "run_pieces array<long>, run_label array<int>, pieces binary"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rules' findings, sorted."""
    found = [
        (m.start(), kind, m.end()) for kind, rule, group, least in _COMPILED for m in rule.finditer(text) if m.end(group) - m.start(group) >= least
    ]
    return sorted(found)


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end byte) of the candidates; none crosses a row."""
    token = _TOKEN[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens, closes = token.copy(), token.copy()
    opens[1:] &= ~token[:-1]
    closes[:-1] &= ~token[1:]
    opens[edges] |= token[edges]
    closes[edges - 1] |= token[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = end - start >= 8
    start, end = start[long], end[long]
    digits = np.r_[0, np.cumsum((data >= 48) & (data <= 57), dtype=np.int64)]
    fit = (end - start >= 16) | (digits[end] > digits[start])
    start, end = start[fit], end[fit]
    return np.searchsorted(offsets, start, side="right") - 1, start, end


def windows(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of each run, pieces x PIECE bytes): ``BODY`` bytes a piece, with what stands around it in its row."""
    count = -(-(end - start) // BODY)
    of = np.repeat(np.arange(len(start)), count)
    first = start[of] + BODY * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    at = first[:, None] + np.arange(-BEFORE, BODY + AFTER)
    inside = (at >= offsets[row[of], None]) & (at < offsets[row[of] + 1, None])
    out = np.zeros((len(of), PIECE), np.uint8)
    if len(of):
        out[:, :WINDOW] = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0)
        out[:, WINDOW] = np.minimum(end[of] - first, BODY)
    return count, out


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values, kind))


def _examined(ids: pa.Array, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    rows = len(offsets) - 1
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    base = [base_spans(t.as_py()) if maybe else [] for t, maybe in zip(texts, pc.match_substring_regex(texts, _MAYBE).to_pylist(), strict=True)]
    row, start, end = runs(data, offsets)
    count, pieces = windows(data, offsets, row, start, end)
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)]
    before = points[offsets[row]]
    from_, to = points[start] - before, points[end] - before
    label = np.zeros(len(row), np.int32)
    for r in (r for r, spans in enumerate(base) if spans):
        own = slice(*np.searchsorted(row, [r, r + 1]))
        for s, _, e in base[r]:
            label[own] |= (from_[own] < e) & (s < to[own])
    flat = np.array([x for spans in base for x in spans], np.int64).reshape(-1, 3)
    per_row, n_base = np.bincount(row, minlength=rows), np.array([len(s) for s in base], np.int64)
    ends = np.r_[0, np.cumsum(np.bincount(row, count, rows).astype(np.int64) * PIECE)]
    packed = pieces.tobytes()
    columns = [
        ids, _lists(flat[:, 1], n_base, pa.int32()), _lists(flat[:, 0], n_base, pa.int64()), _lists(flat[:, 2], n_base, pa.int64()),
        _lists(from_, per_row, pa.int64()), _lists(to, per_row, pa.int64()), _lists(count, per_row, pa.int64()), _lists(label, per_row, pa.int32()),
        pa.array([packed[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()),
    ]
    names = ["id", "kind", "start", "end", "run_start", "run_end", "run_pieces", "run_label", "pieces"]
    return pa.RecordBatch.from_arrays(columns, names)


def examine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its rule spans (kind number, start, end) and its candidates: span, windows and whether a rule covers them."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_buffers(batch.column("text"))
            for lo, hi in row_blocks(offsets):
                part = slice(lo, hi)
                yield _examined(
                    batch.column("id")[part], batch.column("text")[part], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                )

    schema = T.StructType([texts.schema["id"], *T.DataType.fromDDL(EXAMINED).fields])
    return texts.mapInArrow(blocks, schema)


def with_findings(examined: DataFrame, findings: DataFrame) -> DataFrame:
    """Labels of a reviewer, (id, start, end, label) for whole candidates, in place of the rules'; others are not learnt from (-1)."""
    said = findings.groupBy("id").agg(F.collect_list(F.struct("start", "end", "label")).alias("said"))
    run = F.arrays_zip("run_start", "run_end")
    of = lambda r: F.filter("said", lambda s: (s["start"] == r["run_start"]) & (s["end"] == r["run_end"]))
    label = F.transform(run, lambda r: F.coalesce(F.get(of(r), F.lit(0))["label"].cast("int"), F.lit(-1)))
    joined = examined.join(said, examined["id"].eqNullSafe(said["id"]), "left").drop(said["id"])
    return joined.withColumn("run_label", label).drop("said")


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key's text, modulo ``folds``: 0 is held out, 1 calibrates, the rest trains."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(2))


def labelled_windows(examined: DataFrame, sample: int) -> dict[tuple[str, int], np.ndarray]:
    """(role, label) to at most ``sample`` windows, the first ones of labelled candidates by a hash: to look at, nothing is fitted on them."""
    number = F.array_position(F.transform("run_label", lambda x: F.lit(1)), 1)  # null where there is no candidate
    one = examined.filter(number.isNotNull()).select(
        "id", fold(F.col("id")).alias("fold"), F.posexplode(F.arrays_zip("run_label", "run_pieces", "run_start")).alias("at", "run"), "pieces",
        F.col("run_pieces").alias("counts"),
    )
    skipped = F.aggregate(F.slice("counts", 1, F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x)
    window = F.substring("pieces", (skipped * PIECE + 1).cast("int"), F.lit(PIECE))
    one = one.select("id", "fold", F.col("run.run_label").alias("label"), F.col("run.run_start").alias("start"), window.alias("window"))
    out = {}
    for role, of in (("train", "fold > 1"), ("calibrate", "fold = 1"), ("held_out", "fold = 0")):
        for label in (0, 1):
            rows = one.filter(of).filter(F.col("label") == label).orderBy(F.xxhash64("id", "start"), "id", "start", "window").limit(sample)
            found = [bytes(r.window) for r in rows.select("window").collect()]
            out[role, label] = np.frombuffer(b"".join(found), np.uint8).reshape(-1, PIECE)
    return out


def varied(positive: np.ndarray, negative: np.ndarray, seed: int | list[int] = 0) -> np.ndarray:
    """Copies of positives: values in the surroundings of negatives, and values in other letters."""
    rng = np.random.default_rng(seed)
    moved, size = negative[rng.integers(0, len(negative), len(positive))].copy(), positive[:, WINDOW].astype(int)
    letters = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    other = positive.copy()
    for i, n in enumerate(size):
        after = moved[i, BEFORE + moved[i, WINDOW] : WINDOW].copy()
        moved[i, BEFORE:] = 0
        moved[i, BEFORE : BEFORE + n] = positive[i, BEFORE : BEFORE + n]
        moved[i, BEFORE + n : WINDOW][: len(after)] = after[: AFTER + BODY - n]
        moved[i, WINDOW] = n
        value = other[i, BEFORE : BEFORE + n]
        tail = n - next((k for k, x in enumerate(value[::-1]) if x in b"=:"), n)  # what follows a key within the run keeps the key
        changed = value[tail:]
        changed[np.isin(changed, letters)] = rng.choice(letters, int(np.isin(changed, letters).sum()))
    return np.concatenate([moved, other])


def _candidates(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, number of windows) of a batch's candidates, and all their windows."""
    number = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
    pieces = b"".join(x for x in batch.column("pieces").to_pylist() if x)
    return number("run_label"), number("run_pieces").astype(np.int64), np.frombuffer(pieces, np.uint8).reshape(-1, PIECE)


def counted_windows(examined: DataFrame) -> DataFrame:
    """(label, of, window, n): the different windows of all labelled candidates in the training folds, and how often each occurs.

    ``of`` is the number of windows that the candidate has.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, of, pieces = _candidates(batch)
            label, of = np.repeat(label, of), np.repeat(of, of)
            asked = (label == 0) | (label == 1)
            offsets = pa.py_buffer(np.arange(0, PIECE * int(asked.sum()) + 1, PIECE, dtype=np.int32))
            window = pa.Array.from_buffers(pa.binary(), int(asked.sum()), [None, offsets, pa.py_buffer(pieces[asked].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(label[asked], pa.int32()), pa.array(of[asked], pa.int64()), window], ["label", "of", "window"])

    learnt = examined.filter(fold(F.col("id")) > 1).select("run_label", "run_pieces", "pieces")
    each = learnt.mapInArrow(unpack, "label int, of long, window binary")
    return each.groupBy("label", "of", "window").agg(F.count(F.lit(1)).alias("n"))


def deal(counted: DataFrame, copies: dict[int, int], shards: int) -> DataFrame:
    """(shard, rows): all windows, those of a class ``copies`` times, dealt as evenly as whole numbers allow.

    A window starts at a shard chosen by hash and goes round: one that occurs often is in all shards.
    """
    times = counted.withColumn("n", F.col("n") * F.when(F.col("label") == 1, F.lit(copies[1])).otherwise(F.lit(copies[0])))
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(shards)) - 1))
    one = times.withColumn("turn", turn).withColumn("shard", F.pmod(F.pmod(F.xxhash64("label", "of", "window"), F.lit(shards)) + F.col("turn"), F.lit(shards)))
    count = F.floor(F.col("n") / shards).cast("long") + (F.col("turn") < F.col("n") % shards).cast("long")
    rows = F.sort_array(F.collect_list(F.struct("label", "of", count.alias("count"), "window"))).alias("rows")
    return one.repartitionByRange(min(shards, 2000), "shard").groupBy("shard").agg(rows)


def samples(rows: pa.StructArray, seed: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, label, share of its candidate's weight) of a shard, with new varied copies of its positives."""
    label, of, count = (rows.field(x).to_numpy(zero_copy_only=False) for x in ("label", "of", "count"))
    window = np.frombuffer(b"".join(rows.field("window").to_pylist()), np.uint8).reshape(-1, PIECE)
    label, share, window = np.repeat(label, count), np.repeat(1 / of, count), np.repeat(window, count, axis=0)
    positive, share_positive = window[label == 1], share[label == 1]
    if len(positive) and len(positive) < len(window):
        more = varied(positive, window[label == 0], seed)
        window, label, share = np.concatenate([window, more]), np.r_[label, np.ones(len(more), int)], np.r_[share, share_positive, share_positive]
    return window, label, share


def train_round(shards: DataFrame, state: np.ndarray, nth: int, weight: dict[int, float]) -> np.ndarray:
    """The state after every shard's samples were gone through once, from the same state; averaged by samples."""
    shared = shards.sparkSession.sparkContext.broadcast(state)
    kind = pa.list_(pa.float32())

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, rows in zip(batch.column("shard").to_pylist(), batch.column("rows"), strict=True):
                window, label, share = samples(rows.values, [shard, nth])
                weights, steps = share * np.where(label == 1, weight[1], weight[0]), nth * -(-len(label) // BATCH)
                rng = np.random.default_rng([shard, nth, 1])
                after = char_cnn.one_pass(shared.value, steps, window[:, :WINDOW], window[:, WINDOW].astype(int), label, weights, rng)
                columns = [pa.array([shard], pa.int64()), pa.array([len(label)], pa.int64()), pa.array([after], kind)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "n", "state"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}  # in the order of shards, so that reruns agree to the last bit
        for batch in batches:
            for part, n, after in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("state"), strict=True):
                total, so_far = sums.get(part, (0, 0.0))
                sums[part] = total + n, so_far + n * after.values.to_numpy().astype(float)
        for part, (n, total) in sums.items():
            columns = [pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "n", "state"])

    trained = materialise(shards.mapInArrow(train, "shard long, n long, state array<float>")).withColumn("part", F.col("shard") % FAN_IN)
    added = trained.repartition(FAN_IN, "part").sortWithinPartitions("shard").mapInArrow(add, "part long, n long, state array<double>")
    rows = sorted(added.collect(), key=lambda r: r.part)
    shared.destroy()
    return (sum(np.array(r.state) for r in rows) / sum(r.n for r in rows)).astype(np.float32)


def train_detector(examined: DataFrame, rounds: int = 6, seed: int = 0) -> dict | None:
    """Weights learnt from every window of every labelled candidate in the training folds; None where a class is missing."""
    counted = materialise(counted_windows(examined))
    whole = lambda x: F.sum(x.cast("decimal(28,12)"))  # noqa: E731 (exact, so that the order of rows has no say)
    totals = counted.groupBy("label").agg(F.sum("n").alias("n"), whole(F.col("n") / F.col("of")).alias("candidates")).collect()
    n, candidates = {r.label: int(r.n) for r in totals}, {r.label: float(r.candidates) for r in totals}
    if len(n) < 2:
        return None
    candidates[1], n[1] = 3 * candidates[1], 3 * n[1]  # with the two varied copies
    copies = {x: max(1, round(candidates[1 - x] / candidates[x] / RARER)) for x in (0, 1)}
    size = sum(copies[x] * n[x] for x in (0, 1))
    shards = materialise(deal(counted, copies, max(1, round(size / SHARD))))
    weight = {x: 0.5 * size / (copies[x] * candidates[x]) for x in (0, 1)}
    start = char_cnn.flat(char_cnn.initial(seed))
    state = np.r_[start, np.zeros(2 * len(start), np.float32)]
    for nth in range(rounds):
        state = train_round(shards, state, nth, weight)
    return char_cnn.unflat(state)[0]


def calibration_logits(examined: DataFrame, weights: dict) -> DataFrame:
    """(label, z, rank) of every labelled candidate of the calibration fold: its likeliest window's logit, and a number in the same order."""
    shared = examined.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, of, pieces = _candidates(batch)
            z = np.zeros(0, np.float32)
            if len(of):
                z = np.maximum.reduceat(char_cnn.logits(shared.value, pieces[:, :WINDOW], pieces[:, WINDOW].astype(int)), np.cumsum(of) - of)
            asked = (label == 0) | (label == 1)
            label, z = label[asked], z[asked].astype(np.float32)
            bits = z.view(np.uint32)
            rank = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(z.astype(float)), pa.array(rank)], ["label", "z", "rank"])

    rows = examined.filter(fold(F.col("id")) == 1).select("run_label", "run_pieces", "pieces")
    return materialise(rows.mapInArrow(score, "label int, z double, rank long"))


def calibrate(logits: DataFrame, pos: int, neg: int) -> tuple[float, float]:
    """(a, b) of ``char_cnn.platt`` from exact sums over all rows."""
    low, high = char_cnn.platt_targets(pos, neg)
    z, target = F.col("z"), F.when(F.col("label") == 1, F.lit(high)).otherwise(F.lit(low))

    def sums(a: float, b: float) -> tuple:
        within = lambda x, most: F.greatest(F.least(x, F.lit(most)), F.lit(-most))
        value = within(z * float(a) + float(b), 1e6)
        p = 1 / (1 + F.exp(-within(value, 30.0)))
        d, q = p - target, p * (1 - p)
        loss = F.greatest(value, F.lit(0.0)) + F.log1p(F.exp(-F.abs(value))) - target * value
        terms = [F.sum(x.cast("decimal(28,15)")) for x in (loss, d * z, d, q * z * z, q * z, q)]
        return tuple(float(x) for x in logits.agg(*terms).first())

    return char_cnn.platt_by_sums(sums)


def nth_largest(values: DataFrame, name: str, nth: int) -> int:
    """The ``nth`` largest (from 1) of integers below 2^32, by counts of one byte after another; needs ``nth`` rows."""
    found = 0
    for shift in (24, 16, 8, 0):
        byte = F.shiftright(name, shift).bitwiseAND(255).alias("byte")
        counts = values.filter(F.shiftright(name, shift + 8) == found).groupBy(byte).count().collect()
        for b, n in sorted(((r[0], r[1]) for r in counts), reverse=True):
            if nth <= n:
                found = found * 256 + b
                break
            nth -= n
    return found


def fit_detector(examined: DataFrame, recall: float = 0.98, rounds: int = 6) -> Detector | None:
    """Network, calibration and threshold from all labelled candidates; None where a class is missing in a fold."""
    weights = train_detector(examined, rounds)
    if weights is None:
        return None
    logits = calibration_logits(examined, weights)
    n = {r.label: r["count"] for r in logits.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    a, b = calibrate(logits, n[1], n[0])
    if a <= 0:
        return None
    rank = np.array([nth_largest(logits.filter("label = 1"), "rank", max(int(np.ceil(recall * n[1])), 1))], np.uint32)
    z = np.where(rank >> 31, rank ^ np.uint32(1 << 31), ~rank).view(np.float32)
    return Detector(weights, a, b, float(char_cnn.sigmoid(a * z.astype(float) + b)[0]))


def _added(batch: pa.RecordBatch, detector: Detector | None) -> Iterator[list[tuple]]:
    """Of each row the (start, kind, end, probability) that the network adds; a run counts by its likeliest window."""
    column = lambda name: batch.column(name).to_pylist()
    rows = list(zip(*map(column, ("run_start", "run_end", "run_pieces", "kind", "start", "end")), strict=True))
    packed = np.frombuffer(b"".join(column("pieces")), np.uint8).reshape(-1, PIECE)
    counts = np.array([n for r in rows for n in r[2]], np.int64)
    if detector is None or not len(counts):
        yield from ([] for _ in rows)
        return
    free = np.array([not any(s < e and b < t for b, e in zip(r[4], r[5], strict=True)) for r in rows for s, t in zip(r[0], r[1], strict=True)])
    p, asked = np.zeros(len(packed)), np.repeat(free, counts)
    p[asked] = detector.probabilities(packed[asked, :WINDOW], packed[asked, WINDOW].astype(int))
    best, at = np.maximum.reduceat(p, np.cumsum(counts) - counts), 0
    for starts, ends, *_ in rows:
        likely = range(len(starts))
        yield [(starts[i], len(RULES), ends[i], float(best[at + i])) for i in likely if free[at + i] and best[at + i] >= detector.threshold]
        at += len(starts)


def add_spans(examined: DataFrame, detector: Detector | None) -> DataFrame:
    """(id, spans): each row's rule spans (probability null) and those that the network adds."""
    shared = examined.sparkSession.sparkContext.broadcast(detector)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for batch in batches:
            out = []
            base = zip(*(batch.column(x).to_pylist() for x in ("start", "kind", "end")), strict=True)
            for found, added in zip(base, _added(batch, shared.value), strict=True):
                every = sorted([(*x, None) for x in zip(*found, strict=True)] + added, key=lambda x: x[:3])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "probability": p} for s, k, e, p in every])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, span)], ["id", "spans"])

    schema = T.StructType([examined.schema["id"], *T.DataType.fromDDL("spans array<struct<kind:string,start:long,end:long,probability:double>>").fields])
    return examined.mapInArrow(spans, schema)


def scan_secrets(docs: DataFrame, recall: float = 0.98, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row: one pass over the texts, then training on all labelled candidates and scoring of all candidates."""
    examined = materialise(examine(docs, id_col, text_col))
    return add_spans(examined, fit_detector(examined, recall))
