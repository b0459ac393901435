"""Histograms of two sets over a tree of clusters.

Clusters are the leaves of a bisecting tree: a node is cut by two-means, started on either side of the
mean of its widest axis, and its number of leaves is shared by its halves in proportion to their rows. A
row is compared with two centres a level, so assignment costs rows times depth, not rows times clusters.
Nodes of many rows are cut by all tasks together (sums of each half are all that is gathered); a node of
``local`` rows or fewer is finished by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise
from .aggregates import moments
from .blocks import matrix

#: Refinements of a cut; rows of a node that one task finishes.
STEPS, LOCAL = 3, 20_000


def nearer(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which rows are nearer to ``high`` than to ``low``."""
    return ((x - high) ** 2).sum(1) < ((x - low) ** 2).sum(1)


def cut(x: np.ndarray, steps: int = STEPS) -> np.ndarray | None:
    """The half of each row of a node; None where all rows are equal."""
    axis = x.var(0).argmax()
    side = x[:, axis] > x[:, axis].mean()
    if side.all() or not side.any():
        return None
    for _ in range(steps):
        new = nearer(x, x[~side].mean(0), x[side].mean(0))
        if new.all() or not new.any():
            break
        side = new
    return side


def quotas(leaves: int, low: int, high: int) -> tuple[int, int]:
    """Leaves of two halves of ``low`` and ``high`` rows: in proportion, one at least."""
    first = min(max(int(np.floor(leaves * low / (low + high) + 0.5)), 1), leaves - 1)
    return first, leaves - first


def leaf_numbers(x: np.ndarray, leaves: int, steps: int = STEPS) -> np.ndarray:
    """The leaf of each row of a node, from 0; unused numbers belong to nodes that couldn't be cut."""
    out, todo = np.zeros(len(x), np.int64), [(np.arange(len(x)), leaves)]
    while todo:
        rows, n = todo.pop()
        side = cut(x[rows], steps) if n > 1 and len(rows) > 1 else None
        if side is not None:
            low, high = quotas(n, int((~side).sum()), int(side.sum()))
            out[rows[side]] += low
            todo += [(rows[~side], low), (rows[side], high)]
    return out


def _sums(batches: Iterator[pa.RecordBatch], centres: dict) -> Iterator[pa.RecordBatch]:
    """(node, side, n, sums, sums of squares) of the task's rows; a node without centres has one side."""
    total: dict = {}
    for batch in batches:
        nodes, x = np.asarray(batch.column("node"), np.int64), matrix(batch.column("x"))
        for node in np.unique(nodes):
            of = x[nodes == node]
            side = np.zeros(len(of), bool) if centres[node] is None else _side(of, centres[node])
            for s in (False, True):
                if (side == s).any():
                    part = of[side == s]
                    n, sums, squares = total.get((int(node), s), (0, 0.0, 0.0))
                    total[int(node), s] = (n + len(part), sums + part.sum(0), squares + (part * part).sum(0))
    rows = [(node, s, *map(list, ([n], a, b))) for (node, s), (n, a, b) in total.items()]
    if rows:
        node, s, n, a, b = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(s), pa.array([[*map(float, x), *y, *z] for x, y, z in zip(n, a, b, strict=True)])], ["node", "side", "v"])


def _side(x: np.ndarray, rule: tuple) -> np.ndarray:
    kind, *at = rule
    return x[:, at[0]] > at[1] if kind == "axis" else nearer(x, *at)


def _gathered(rows: DataFrame, centres: dict) -> dict:
    """(node, side) to (rows, mean, variance): one line a position and node is summed, few nodes are left open."""
    parts = rows.mapInArrow(lambda b: _sums(b, centres), "node long, side boolean, v array<double>")
    summed = parts.select("node", "side", F.posexplode("v").alias("pos", "x")).groupBy("node", "side", "pos").agg(F.sum("x").alias("x"))
    out: dict = {}
    for r in summed.orderBy("node", "side", "pos").collect():
        out.setdefault((r.node, r.side), []).append(r.x)
    return {k: (int(v[0]), *_mean_and_variance(np.array(v))) for k, v in out.items()}


def _mean_and_variance(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = (len(v) - 1) // 2
    mean = v[1 : width + 1] / v[0]
    return mean, np.maximum(v[width + 1 :] / v[0] - mean**2, 0)


def _moved(batches: Iterator[pa.RecordBatch], rules: dict, shift: dict) -> Iterator[pa.RecordBatch]:
    """Rows of the upper halves go to their node's new number."""
    for batch in batches:
        nodes, x = np.asarray(batch.column("node"), np.int64).copy(), matrix(batch.column("x"))
        for node in np.unique(nodes):
            if node in rules:
                at = np.flatnonzero(nodes == node)
                nodes[at[_side(x[at], rules[node])]] += shift[node]
        yield batch.set_column(batch.schema.get_field_index("node"), "node", pa.array(nodes))


def tree_histogram(rows: DataFrame, leaves: int, steps: int = STEPS, local: int = LOCAL) -> DataFrame:
    """(cluster, set, n) of rows (set, x): the rows of each set in each leaf."""
    rows = materialise(rows.select("set", "x", F.lit(0).cast("long").alias("node")))
    schema = "set string, x array<double>, node long"
    open_, small, done = {0: (rows.count(), leaves)}, {}, set()
    while True:
        for node in [k for k, (n, _) in open_.items() if n <= local]:
            small[node] = open_.pop(node)
        done |= {k for k, (_, q) in open_.items() if q == 1}
        open_ = {k: x for k, x in open_.items() if k not in done}
        if not open_:
            break
        here = rows.filter(F.col("node").isin(*open_)) if len(open_) < 1000 else rows.join(F.broadcast(_frame(rows, open_)), "node", "left_semi")
        stats = _gathered(here, dict.fromkeys(open_))
        rules: dict = {}
        for node in open_:
            _, mean, variance = stats[node, False]
            axis = int(variance.argmax())
            rules[node] = ("axis", axis, float(mean[axis]))
        halves = _gathered(here, rules)
        alive = {k for k in rules if (k, False) in halves and (k, True) in halves}
        for _ in range(steps):
            tried = {k: ("centres", halves[k, False][1], halves[k, True][1]) if k in alive else rules[k] for k in open_}
            new = _gathered(here, tried)
            for k in list(alive):
                if (k, False) in new and (k, True) in new:
                    rules[k], halves[k, False], halves[k, True] = tried[k], new[k, False], new[k, True]
                else:
                    alive.discard(k)
        cuttable = {k for k in rules if (k, False) in halves and (k, True) in halves}
        shift, after = {}, {}
        for k, (_, q) in open_.items():
            if k not in cuttable:
                done.add(k)
                continue
            low, high = quotas(q, halves[k, False][0], halves[k, True][0])
            shift[k] = low
            after |= {k: (halves[k, False][0], low), k + low: (halves[k, True][0], high)}
        moving = {k: rules[k] for k in cuttable}
        rows = materialise(rows.mapInArrow(lambda b, m=moving, s=shift: _moved(b, m, s), schema))
        open_ = after
    quota = _frame(rows, {k: q for k, (_, q) in small.items()})

    def finished(part: pa.Table) -> pa.Table:
        order = part.sort_by([("set", "ascending")])
        leaf = part.column("node")[0].as_py() + leaf_numbers(matrix(order.column("x")), part.column("quota")[0].as_py(), steps)
        return pa.table({"cluster": pa.array(leaf), "set": order.column("set")}).group_by(["cluster", "set"]).aggregate([([], "count_all")]).rename_columns(["cluster", "set", "n"])

    counted = rows.join(F.broadcast(quota), "node").groupBy("node").applyInArrow(finished, "cluster long, set string, n long")
    whole = rows.join(F.broadcast(_frame(rows, dict.fromkeys(done, 1))), "node", "left_semi").groupBy(F.col("node").alias("cluster"), "set").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(whole)


def _frame(rows: DataFrame, of: dict) -> DataFrame:
    """(node, quota) of open or finished nodes: a node for each ``local`` rows or so."""
    return rows.sparkSession.createDataFrame([(int(k), int(q[1] if isinstance(q, tuple) else q)) for k, q in of.items()], "node long, quota long")


def cluster_histograms(a: DataFrame, b: DataFrame, variance: float = 0.9, clusters: int | None = None, steps: int = STEPS, local: int = LOCAL) -> DataFrame:
    """(cluster, p, q): shares of two sets over the clusters of their unit vectors, projected on the axes that hold ``variance``.

    As many clusters as a tenth of the smaller set (two at least) unless ``clusters`` is given. Rows without a
    vector are left out; a zero vector stays zero.
    """
    unit = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"), F.sqrt)
    both = a.select("embedding", F.lit("p").alias("set")).unionByName(b.select("embedding", F.lit("q").alias("set")))
    both = both.filter("embedding IS NOT NULL").withColumn("__n", unit)
    both = both.select("set", F.transform("embedding", lambda x: F.when(F.col("__n") > 0, x.cast("double") / F.col("__n")).otherwise(0.0)).alias("embedding"))
    sizes = {r.set: r["count"] for r in both.groupBy("set").count().collect()}
    _, _, cov = moments(both)
    w, q = np.linalg.eigh(cov)
    w, q = np.maximum(w[::-1], 0), q[:, ::-1]
    axes = q[:, : int(np.searchsorted(np.cumsum(w) / max(w.sum(), 1e-300), variance)) + 1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding")) @ axes if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("set"), pa.array(list(x), pa.list_(pa.float64()))], ["set", "x"])

    leaves = clusters or max(2, round(min(sizes.get("p", 0), sizes.get("q", 0)) / 10))
    n = tree_histogram(both.mapInArrow(project, "set string, x array<double>"), leaves, steps, local)
    of = lambda s: (F.coalesce(F.sum(F.when(F.col("set") == s, F.col("n"))), F.lit(0)) / max(sizes.get(s, 0), 1)).alias(s)
    return n.groupBy("cluster").agg(of("p"), of("q"))
