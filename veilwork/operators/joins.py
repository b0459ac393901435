"""Nearest neighbours, similarities and other joins of private rows and candidates.

Frames of vectors are (id, embedding, label, ...). Candidates that fit a block are broadcast and private
rows stream past them in Arrow batches. More are written once in blocks that the tasks of the private
rows read for themselves (``blocks``), skipping those that can't hold a winner; nothing is replicated.
Every private row meets all its candidates in one task, so its ranks need no shuffle. Distances of the
winners are computed from differences, so the expanded form's rounding doesn't decide ties.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..sources.tables import shared_folder
from . import blocks
from .blocks import matrix

BLOCK = 16_384


def _vectors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors) by rising id; a null label is -1."""
    ids = np.asarray(rows.column("id").combine_chunks())
    order = np.argsort(ids, kind="stable")
    labels = np.asarray(rows.column("label").fill_null(-1).combine_chunks())
    return ids[order], labels[order], matrix(rows.column("embedding"))[order]


def _plain(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("label").cast("long").alias("label"), "embedding").filter("embedding IS NOT NULL")


def _readable(df: DataFrame) -> bool:
    return blocks.readable(shared_folder(df.sparkSession) if "://" in shared_folder(df.sparkSession) else f"file://{shared_folder(df.sparkSession)}")


def _each_block(rows: DataFrame, cand: DataFrame, block: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` of every part of ``rows`` with every block of ``cand``, as one frame; both have (id, label, embedding).

    Up to ``block`` candidates are broadcast; more are files of the shared folder. Only where tasks can't
    open such files are rows sent to each block and candidates to each part by a shuffle.
    """
    rows, cand = _plain(rows), _plain(cand)
    n = cand.count()
    if n <= block:
        shared = cand.sparkSession.sparkContext.broadcast(cand.toArrow())

        def stream(batches):
            for batch in batches:
                if batch.num_rows and shared.value.num_rows:
                    yield from work(pa.Table.from_batches([batch]), shared.value).to_batches()

        return rows.mapInArrow(stream, schema)
    if _readable(cand):
        files = blocks.store_plain(cand, max(1, block // 2))

        def meet_files(batches):
            for chunk in blocks.chunks(batches):
                for file in files:
                    yield from work(chunk, blocks.open_block(file)).to_batches()

        return rows.mapInArrow(meet_files, schema)
    return _dealt(rows, cand, n, block, work, schema)


def _dealt(rows: DataFrame, cand: DataFrame, n: int, block: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Rows dealt into parts and candidates into blocks, each pair of them in a task: the way without a readable folder."""
    n_blocks, parts = -(-n // max(1, block // 2)), max(1, -(-rows.count() // max(1, block // 2)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", dealt(parts).alias("part"), every(n_blocks).alias("block"))
    right = cand.select("*", dealt(n_blocks).alias("block"), every(parts).alias("part"))
    empty = pa.table({"id": pa.array([], pa.int64()), "label": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32()))})

    def meet(key, x: pa.Table, c: pa.Table) -> pa.Table:
        return work(x, c) if x.num_rows and c.num_rows else work(empty, empty)

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, schema)


def _crowded(rank: np.ndarray, near: np.ndarray, q: int, squares: np.ndarray, width: int) -> dict[int, np.ndarray]:
    """Rows with more candidates than ``near`` holds within rounding of the q-th rank, and these candidates.

    An expanded distance is off by (width + 3) * eps * (|x| + |c|)^2 at most; ``squares`` are |x|^2 plus the largest |c|^2.
    """
    kept = np.take_along_axis(rank, near, 1)
    limit = np.partition(kept, q - 1, axis=1)[:, q - 1] + 4 * (width + 4) * np.finfo(float).eps * squares
    full = np.flatnonzero((kept <= limit[:, None]).all(1) & np.isfinite(kept).all(1))
    return {int(i): np.flatnonzero((rank[i] <= limit[i]) & np.isfinite(rank[i])) for i in full}


def _winners(x: np.ndarray, own: np.ndarray, cand: pa.Table, q: int, rule: str, far: bool) -> tuple[np.ndarray, np.ndarray]:
    """(distances, candidate ids), rows x q, in order; the places left over hold infinity and -1."""
    ids, labels, c = _vectors(cand)
    largest = (c * c).sum(1).max() if len(ids) else 0.0
    sign = -1.0 if far else 1.0
    dist, found = np.full((len(x), q), np.inf), np.full((len(x), q), -1, np.int64)
    for lo in range(0, len(x) if len(ids) else 0, 256):
        part, mine = x[lo : lo + 256], own[lo : lo + 256]
        rank = sign * ((part * part).sum(1)[:, None] - 2 * part @ c.T + (c * c).sum(1))
        if rule != "all":
            same = mine[:, None] == labels
            rank = np.where(same if rule == "same" else ~same, rank, np.inf)
        take = min(q + 8, len(ids))
        near = np.argpartition(rank, take - 1, axis=1)[:, :take] if take < len(ids) else np.tile(np.arange(len(ids)), (len(part), 1))
        crowded = _crowded(rank, near, q, (part * part).sum(1) + largest, c.shape[1]) if take < len(ids) else {}
        exact = np.sqrt(((part[:, None, :] - c[near]) ** 2).sum(2))
        value = np.where(np.isfinite(np.take_along_axis(rank, near, 1)), sign * exact, np.inf)
        order = np.lexsort((ids[near], value), axis=1)[:, :q]
        value, near = np.take_along_axis(value, order, 1), np.take_along_axis(near, order, 1)
        here = slice(lo, lo + len(part))
        dist[here, : order.shape[1]] = np.where(np.isinf(value), np.inf, sign * value)
        found[here, : order.shape[1]] = np.where(np.isinf(value), -1, ids[near])
        for i, at in crowded.items():
            low = np.sqrt(((part[i] - c[at]) ** 2).sum(1))
            first = np.lexsort((ids[at], sign * low))[:q]
            dist[lo + i, : len(first)], found[lo + i, : len(first)] = low[first], ids[at[first]]
    return dist, found


def knn(private: DataFrame, cand: DataFrame, q: int = 1, rule: str = "all", farthest: bool = False, block: int = BLOCK) -> DataFrame:
    """(id, cand_id, dist, rank): the q nearest (or farthest) candidates of each private row by L2.

    ``rule``: all candidates, those of the ``same`` or of an ``other`` label. Ties go to the smaller
    candidate id. Rows without a vector have no neighbours; repeated rows have their own.

    Beyond ``block`` candidates, private rows are sorted by range of their nearest pivot, so that a chunk's
    rows need the same few blocks of candidates (see ``blocks``).
    """
    rows, cand = _plain(private), _plain(cand).withColumn("label", F.coalesce("label", F.lit(-1)))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, cand_id long, dist double, rank int"

    def found(chunk: pa.Table, search) -> pa.RecordBatch:
        own = np.asarray(chunk.column("label").fill_null(-1))
        dist, ids = search(matrix(chunk.column("embedding")), own)
        row, place = np.nonzero(np.isfinite(dist))
        return pa.RecordBatch.from_arrays(
            [chunk.column("id").combine_chunks().take(pa.array(row)), pa.array(ids[row, place]), pa.array(dist[row, place]), pa.array((place + 1).astype(np.int32))],
            ["id", "cand_id", "dist", "rank"],
        )

    n = cand.count()
    if n <= block:
        shared = cand.sparkSession.sparkContext.broadcast(cand.toArrow())

        def stream(batches):
            for batch in batches:
                if batch.num_rows:
                    yield found(pa.Table.from_batches([batch]), lambda x, own: _winners(x, own, shared.value, q, rule, farthest))

        return rows.mapInArrow(stream, schema)
    if not _readable(cand):

        def pairs(x: pa.Table, c: pa.Table) -> pa.Table:
            return pa.Table.from_batches([found(x, lambda v, own: _winners(v, own, c, q, rule, farthest))])

        met = _dealt(rows, cand, n, block, pairs, schema).drop("rank")
        first = F.col("dist").desc() if farthest else F.col("dist")
        rank = F.row_number().over(W.partitionBy("id").orderBy(first, "cand_id"))
        return met.withColumn("rank", rank).filter(F.col("rank") <= q)
    rings = blocks.store_rings(cand, max(1, block // 2), rule == "same")
    shared = cand.sparkSession.sparkContext.broadcast(rings)
    kind = f"id {rows.schema['id'].dataType.simpleString()}, label long, embedding {rows.schema['embedding'].dataType.simpleString()}"
    placed = rows.mapInArrow(lambda b: blocks.to_pivot(b, shared.value.pivots), kind + ", pivot long, reach double, slack double")
    near = ["label", "pivot", "reach", "id"] if rule == "same" else ["pivot", "reach", "id"]

    def visit(batches):
        for chunk in blocks.chunks(batches):
            search = lambda x, own, c: _winners(x, own, c, q, rule, farthest)
            yield found(chunk, lambda x, own: blocks.visit(x, own, shared.value, search, q, farthest))

    return placed.drop("slack").repartitionByRange(*near).sortWithinPartitions(*near).mapInArrow(visit, schema)


def nearest(private: DataFrame, cand: DataFrame) -> DataFrame:
    return knn(private, cand, 1)


def client_similarity(clients: DataFrame, cand: DataFrame, client="party") -> DataFrame:
    """(client, cand_id, similarity): cosines of a candidate to all rows of a client, summed.

    The sum equals the dot product with the client's summed unit vectors, so a client is one row.
    """
    long = clients.select(client, v.norm(F.col("embedding")).alias("__n"), F.posexplode("embedding").alias("pos", "x"))
    sums = long.filter("__n > 0").groupBy(client, "pos").agg(F.sum(F.col("x") / F.col("__n")).alias("s"))
    total = sums.groupBy(client).agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("v"))
    total = total.select(client, F.col("v.s").alias("__v"))
    both = total.join(cand.select(F.col("id").alias("cand_id"), "embedding"), F.lit(True))
    e = F.col("embedding")
    return both.select(client, "cand_id", (v.dot(e, F.col("__v")) / F.nullif(v.norm(e), F.lit(0.0))).alias("similarity"))


def to_prototypes(df: DataFrame, protos: DataFrame) -> DataFrame:
    """(id, label, class, dist): distance to each class mean; ``protos`` has one row a class."""
    p = protos.select(F.col("label").alias("class"), F.col("embedding").alias("__p"))
    return df.join(p, F.lit(True)).select("id", "label", "class", v.l2(F.col("embedding"), F.col("__p")).alias("dist"))


def own_class_nearest(df: DataFrame, protos: DataFrame) -> DataFrame:
    """(id, label, score): minus the distance to the own class mean; null where another mean is strictly nearer."""
    d = to_prototypes(df, protos)
    own = F.min(F.when(F.col("class") == F.col("label"), F.col("dist")))
    out = d.groupBy("id", "label").agg(own.alias("own"), F.min("dist").alias("least"))
    return out.select("id", "label", F.when(F.col("own") <= F.col("least"), -F.col("own")).alias("score"))


def mean_self_similarity(df: DataFrame) -> DataFrame:
    """(n, mean_cosine) over all ordered pairs of different rows, in closed form."""
    unit = df.select("id", v.norm(F.col("embedding")).alias("__n"), F.posexplode("embedding").alias("pos", "x")).filter("__n > 0")
    sums = unit.groupBy("pos").agg(F.sum(F.col("x") / F.col("__n")).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.agg(F.max("n").alias("n"), ((F.sum(F.col("s") * F.col("s")) - F.max("n")) / (F.max("n") * (F.max("n") - 1))).alias("mean_cosine"))


def max_self_similarity(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, max_cosine) to any other row: unit vectors are searched in blocks by L2."""
    unit = df.withColumn("__n", v.norm(F.col("embedding"))).filter("__n > 0")
    unit = unit.select("id", "label", F.transform("embedding", lambda x: x.cast("double") / F.col("__n")).alias("embedding"))
    near = knn(unit, unit, 2, block=block).filter("id <> cand_id")
    return near.groupBy("id").agg((1 - F.min(F.col("dist") * F.col("dist")) / 2).alias("max_cosine"))


def mean_cross_distance(syn: DataFrame, real: DataFrame, block: int = BLOCK) -> DataFrame:
    """(label, mean_l2, mean_cosine) over all pairs of equal label; a class missing on one side gives null."""
    sums = _each_block(syn.filter("label IS NOT NULL"), real.filter("label IS NOT NULL"), block, _pair_sums, "label long, l2 double, cosine double, n long")
    out = sums.groupBy("label").agg((F.sum("l2") / F.sum("n")).alias("mean_l2"), (F.sum("cosine") / F.sum("n")).alias("mean_cosine"))
    labels = syn.select(F.col("label").cast("long").alias("label")).union(real.select(F.col("label").cast("long").alias("label"))).distinct()
    return labels.join(out, "label", "left")


def _classes(rows: pa.Table, cand: pa.Table):
    """(label, vectors of one side, vectors of the other) of each label that both have."""
    _, own, x = _vectors(rows)
    _, labels, c = _vectors(cand)
    for label in np.intersect1d(own, labels):
        yield int(label), x[own == label], c[labels == label]


def _pair_sums(rows: pa.Table, cand: pa.Table) -> pa.Table:
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    out = []
    for label, a, b in _classes(rows, cand):
        l2 = sum(float(np.sqrt(((b - row) ** 2).sum(1)).sum()) for row in a)
        out.append((label, l2, float(unit(a).sum(0) @ unit(b).sum(0)), len(a) * len(b)))
    label, l2, cosine, n = zip(*out, strict=True) if out else ((),) * 4
    return pa.table({
        "label": pa.array(label, pa.int64()), "l2": pa.array(l2, pa.float64()), "cosine": pa.array(cosine, pa.float64()), "n": pa.array(n, pa.int64())
    })


def mean_pair_psnr(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """(label, psnr): mean over all pairs of a class of 10 log10(1 / (MSE / 3)), 100 where equal.

    Pairs are summed block by block and never become rows. Rows without a vector or a label have no pairs.
    """
    kind = a.schema["label"].dataType
    sums = _each_block(a.filter("label IS NOT NULL"), b.filter("label IS NOT NULL"), block, _psnr_sums, "label long, s double, n long")
    return sums.groupBy(F.col("label").cast(kind).alias("label")).agg((F.sum("s") / F.sum("n")).alias("psnr"))


def _psnr_sums(rows: pa.Table, cand: pa.Table) -> pa.Table:
    out = []
    for label, x, c in _classes(rows, cand):
        total = 0.0
        for row in x:
            mse = ((c - row) ** 2).sum(1) / c.shape[1] / 3
            total += float(np.where(mse > 0, np.minimum(-10 * np.log10(np.where(mse > 0, mse, 1.0)), 100.0), 100.0).sum())
        out.append((label, total, len(x) * len(c)))
    label, s, n = zip(*out, strict=True) if out else ((),) * 3
    return pa.table({"label": pa.array(label, pa.int64()), "s": pa.array(s, pa.float64()), "n": pa.array(n, pa.int64())})


def align_by_index(a: DataFrame, b: DataFrame, key="idx") -> DataFrame:
    """Rows of equal index side by side; a different number of rows is an error."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} and {m} rows can't be aligned")
    return a.join(b, key)


def take(df: DataFrame, ids: DataFrame, keys=("source_model", "idx")) -> DataFrame:
    return df.join(ids.select(*keys).distinct(), list(keys), "left_semi")


def take_mask(df: DataFrame, ids: DataFrame, keys=("source_model", "idx")) -> DataFrame:
    marked = ids.select(*keys).distinct().withColumn("__m", F.lit(1))
    return df.join(marked, list(keys), "left").withColumn("mask", F.coalesce("__m", F.lit(0))).drop("__m")


def not_seen(new: DataFrame, old: DataFrame, text="text") -> DataFrame:
    seen = old.select(F.xxhash64(text).alias("__h"), F.col(text).alias("__t")).distinct()
    return new.join(seen, (F.xxhash64(new[text]) == F.col("__h")) & (new[text] == F.col("__t")), "left_anti")


def generation_grid(attributes: DataFrame, labels: DataFrame) -> DataFrame:
    """Every attribute with every label: two configuration lists, and their product is what is asked for."""
    return attributes.join(labels, F.lit(True))


def preference_pairs(df: DataFrame) -> DataFrame:
    """Five ordered pairs a question: truth over plain, tuned and private answers; tuned and private over plain."""
    pair = lambda a, b: F.struct(F.col(a).alias("chosen"), F.col(b).alias("rejected"), F.lit(f"{a}>{b}").alias("kind"))
    five = [("truth", "plain"), ("truth", "tuned"), ("truth", "private"), ("tuned", "plain"), ("private", "plain")]
    return df.select("question", F.explode(F.array(*[pair(a, b) for a, b in five])).alias("p")).select("question", "p.*")


def cross_evaluate(scores: DataFrame, scope: str = "all") -> DataFrame:
    """(model_id, source_model, n, accuracy, loss) of each model on each source, for ``all``, ``other`` or ``own`` sources."""
    model = F.col("model_id") % 3
    keep = {"all": F.lit(True), "other": model != F.col("source_model"), "own": model == F.col("source_model")}[scope]
    loss = -F.log(F.element_at("prob", F.col("label").cast("int") + 1))
    right = (F.col("pred") == F.col("label")).cast("double")
    return scores.filter(keep).groupBy("model_id", "source_model").agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.avg(loss).alias("loss"))


def change_after(before: DataFrame, after: DataFrame, keys=("source_model", "idx")) -> DataFrame:
    """Differences (after - before) of loss, error and probability norm; whether correctness was gained; the new prediction."""
    a = after.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("loss", "error", "correct", "pred", "norm")])
    j = before.join(a, list(keys))
    gained = F.col("__correct").cast("int") - F.col("correct").cast("int")
    return j.select(
        *keys, (F.col("__loss") - F.col("loss")).alias("loss_change"), (F.col("__error") - F.col("error")).alias("error_change"),
        gained.alias("gained"), F.col("__pred").alias("new_pred"), (F.col("__norm") - F.col("norm")).alias("norm_change"),
    )
