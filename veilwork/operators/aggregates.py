"""Votes, prototypes, corpus distances and classification metrics as aggregations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keyed
from ..functions import vectors as v
from ..sources.tables import materialise
from .blocks import matrix
from .selection import prefix_sums, reindex


def vote_histogram(nn: DataFrame, cand: DataFrame) -> DataFrame:
    """(cand_id, votes, mean_dist): hits of each candidate; candidates without hits stay, with 0."""
    hits = nn.groupBy("cand_id").agg(F.count(F.lit(1)).cast("double").alias("votes"), F.avg("dist").alias("mean_dist"))
    return cand.select(F.col("id").alias("cand_id")).join(hits, "cand_id", "left").fillna(0.0, ["votes"])


def ranked_votes(knn: DataFrame, cand: DataFrame, party="party") -> DataFrame:
    """(party, cand_id, votes) for every party and candidate; rank i gives 2^-(i - 1)."""
    parties = knn.select(party).distinct()
    got = knn.groupBy(party, "cand_id").agg(F.sum(F.pow(F.lit(2.0), 1 - F.col("rank"))).alias("votes"))
    every = parties.join(cand.select(F.col("id").alias("cand_id")), F.lit(True))
    return every.join(got, [party, "cand_id"], "left").fillna(0.0, ["votes"])


def noisy_votes(hist: DataFrame, sigma: float, seed, clamp: bool = False, key: Column | None = None, bits: int = 32) -> DataFrame:
    """Gaussian noise on every bin, empty ones too."""
    key = F.col("cand_id") if key is None else key
    noisy = F.col("votes") + sigma * keyed.gaussian(seed, key, 0, bits)
    return hist.withColumn("votes", F.greatest(noisy, F.lit(0.0)) if clamp else noisy)


def threshold_votes(hist: DataFrame, h: float) -> DataFrame:
    return hist.withColumn("votes", F.greatest(F.col("votes") - h, F.lit(0.0)))


def sum_parties(hist: DataFrame) -> DataFrame:
    return hist.groupBy("cand_id").agg(F.sum("votes").alias("votes"))


def to_probability(hist: DataFrame, by: str | None = None, floor: float = 1e-15) -> DataFrame:
    """Shares of the clamped votes (overall or inside a class); uniform where all votes are zero."""
    up = hist.withColumn("__v", F.greatest(F.col("votes"), F.lit(0.0)) + floor)
    keys = [by] if by else []
    total = up.groupBy(*keys).agg(F.sum("__v").alias("__t"))
    joined = up.join(total, keys) if by else up.crossJoin(F.broadcast(total))
    return joined.withColumn("p", F.col("__v") / F.col("__t")).drop("__v", "__t")


def source_score(hist: DataFrame, source="source_model") -> DataFrame:
    """(source, score): share of the votes times rows over rows of the source."""
    per = hist.groupBy(source).agg(F.sum("votes").alias("v"), F.count(F.lit(1)).alias("n"))
    total = F.broadcast(per.agg(F.sum("v").alias("tv"), F.sum("n").alias("tn")))
    return per.crossJoin(total).select(source, (F.col("v") / F.col("tv") * F.col("tn") / F.col("n")).alias("score"))


def largest_remainder(df: DataFrame, exact: Column, total: int, key: str, first: list | None = None) -> DataFrame:
    """Adds ``quota``: floors of ``exact``, and one more for those first in order (largest fraction) until ``total``."""
    rows = df.withColumn("__x", exact).withColumn("__f", F.floor("__x"))
    order = first or [(F.col("__x") - F.col("__f")).desc()]
    rank = F.row_number().over(W.orderBy(*order, key))
    rows = rows.withColumn("__r", rank).withColumn("__left", total - F.sum("__f").over(W.partitionBy()))
    return rows.withColumn("quota", (F.col("__f") + (F.col("__r") <= F.col("__left")).cast("long")).cast("long")).drop("__x", "__f", "__r", "__left")


def apportion(scores: DataFrame, total: int, temperature: float = 1.0, source="source_model", score="score") -> DataFrame:
    """Quotas by a softmax of the scores; one row a source."""
    e = F.exp((F.col(score) - F.max(score).over(W.partitionBy())) / temperature)
    soft = scores.withColumn("__e", e).withColumn("__p", F.col("__e") / F.sum("__e").over(W.partitionBy()))
    return largest_remainder(soft, F.round(F.col("__p") * total, 9), total, source).drop("__e", "__p")


def apportion_by_importance(df: DataFrame, total: int, source="source_model", importance="importance", portion: str = "importance") -> DataFrame:
    """floor(total * share), and the rest one each: ``importance`` gives it to the most important sources,
    ``round_robin`` to the first ones in order; ``balance`` gives all sources the same share, the rest to the first ones."""
    share = F.col(importance) / F.sum(importance).over(W.partitionBy())
    exact = F.round(share * total, 9) if portion != "balance" else F.lit(float(total)) / F.count(F.lit(1)).over(W.partitionBy())
    order = {"importance": F.col(importance).desc(), "round_robin": F.col(source), "balance": F.col(source)}[portion]
    return largest_remainder(df, exact, total, source, [order])


def client_scores(sim: DataFrame, client="party", sigma: float = 0.0, seed=None, clip: bool = True) -> DataFrame:
    """(cand_id, score): similarities of all clients summed, with noise, divided by the number of clients.

    ``clip`` bounds a client's influence: z-scores within the client, scaled to norm 1 at most, are summed instead.
    """
    rows = sim.withColumn("z", F.col("similarity"))
    if clip:
        stats = sim.groupBy(client).agg(F.avg("similarity").alias("m"), F.stddev_pop("similarity").alias("s"))
        rows = sim.join(stats, client).withColumn("z", F.when(F.col("s") > 0, (F.col("similarity") - F.col("m")) / F.col("s")).otherwise(0.0))
        norms = rows.groupBy(client).agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("nz"))
        rows = rows.join(norms, client).withColumn("z", F.col("z") / F.greatest(F.col("nz"), F.lit(1.0)))
    clients = F.broadcast(sim.select(client).distinct().agg(F.count(F.lit(1)).alias("k")))
    total = rows.groupBy("cand_id").agg(F.sum("z").alias("t"))
    noise = sigma * keyed.gaussian(seed, F.col("cand_id")) if sigma else F.lit(0.0)
    return total.crossJoin(clients).select("cand_id", ((F.col("t") + noise) / F.col("k")).alias("score"))


def prototypes(df: DataFrame, by="label") -> DataFrame:
    """(label, embedding): mean vector of each class, by partial sums of positions."""
    long = df.filter("embedding IS NOT NULL").select(by, F.posexplode("embedding").alias("pos", "x"))
    means = long.groupBy(by, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("e")).select(by, F.col("e.x").alias("embedding"))


def _partial_moments(batches):
    n, s, q = 0, 0.0, 0.0
    for batch in batches:
        x = matrix(batch.column("embedding"))
        if len(x):
            n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int64()), pa.array([list(s)]), pa.array([list(q.ravel())])], ["n", "s", "q"]
        )


def moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, sample covariance). One partial (1 + d + d * d numbers) a partition; these are summed by position, in one pass."""
    rows = df.select("embedding").filter("embedding IS NOT NULL")
    parts = rows.mapInArrow(_partial_moments, "n long, s array<double>, q array<double>")
    line = parts.select(F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "q")).alias("pos", "x"))
    x = np.array([r.x for r in line.groupBy("pos").agg(F.sum("x").alias("x")).orderBy("pos").collect()])
    n = int(x[0]) if len(x) else 0
    if n < 2:
        raise ValueError("two rows at least are needed for a covariance")
    width = (math.isqrt(4 * len(x) - 3) - 1) // 2
    s, q = x[1 : width + 1], x[width + 1 :].reshape(width, width)
    mean = s / n
    return n, mean, (q - n * np.outer(mean, mean)) / (n - 1)


def frechet(a: DataFrame, b: DataFrame) -> float:
    """Squared mean distance + tr(S1 + S2 - 2 (S1 S2)^1/2); only d x d matrices reach the driver."""
    return frechet_of(moments(a), moments(b))


def frechet_of(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> float:
    (_, m1, s1), (_, m2, s2) = a, b
    w, q = np.linalg.eigh(s1)
    root = (q * np.sqrt(np.maximum(w, 0))) @ q.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ s2 @ root), 0)).sum()
    return float(((m1 - m2) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * cross)


@dataclass(frozen=True)
class SideSums:
    """What one pass over a set of vectors gathers: sums by class (rows, text lengths, vectors, unit vectors) and of products."""

    classes: dict  # label -> (rows, rows with a text, characters, rows with a direction, sum of vectors, sum of unit vectors)
    products: np.ndarray

    @property
    def n(self) -> int:
        return int(sum(c[0] for c in self.classes.values()))

    def mean_length(self) -> float | None:
        texts = sum(c[1] for c in self.classes.values())
        return sum(c[2] for c in self.classes.values()) / texts if texts else None

    def moments(self) -> tuple[int, np.ndarray, np.ndarray]:
        """(rows, mean, sample covariance)."""
        if self.n < 2:
            raise ValueError("two rows at least are needed for a covariance")
        mean = sum(c[4] for c in self.classes.values()) / self.n
        return self.n, mean, (self.products - self.n * np.outer(mean, mean)) / (self.n - 1)

    def self_similarity(self) -> float | None:
        """Mean cosine of all ordered pairs of different rows that have a direction."""
        k, s = sum(c[3] for c in self.classes.values()), sum(c[5] for c in self.classes.values())
        return float((s @ s - k) / (k * (k - 1))) if k > 1 else None

    def _shared(self, other: SideSums) -> list:
        return [(self.classes[c], other.classes[c]) for c in self.classes if c in other.classes and c is not None]

    def cross_cosine(self, other: SideSums) -> float | None:
        """Mean over the classes of both of the mean cosine of all pairs of a class."""
        found = [float(x[5] @ y[5]) / (x[3] * y[3]) for x, y in self._shared(other) if x[3] and y[3]]
        return float(np.mean(found)) if found else None

    def class_mean_distance(self, other: SideSums) -> float | None:
        found = [float(((x[4] / x[0] - y[4] / y[0]) ** 2).sum()) for x, y in self._shared(other)]
        return float(np.mean(found)) if found else None


def _side_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums: a line a class, and one without a class of the products."""
    classes: dict = {}
    products = 0.0
    for batch in batches:
        x = matrix(batch.column("embedding"))
        if not len(x):
            continue
        norm = np.linalg.norm(x, axis=1)
        unit = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
        length = np.asarray(batch.column("length").cast(pa.float64()).fill_null(np.nan))
        labels = np.array(batch.column("label").to_pylist(), object)
        products = products + x.T @ x
        for label in set(labels.tolist()):
            at = np.array([y == label for y in labels])
            line = [at.sum(), np.isfinite(length[at]).sum(), np.nansum(length[at]), (norm[at] > 0).sum(), *x[at].sum(0), *unit[at].sum(0)]
            classes[label] = classes.get(label, 0.0) + np.array(line, float)
    if classes:
        lines = [("class", k, v.tolist()) for k, v in classes.items()] + [("products", None, products.ravel().tolist())]
        kind, label, v = zip(*lines, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(label, pa.string()), pa.array(v, pa.list_(pa.float64()))], ["kind", "label", "v"])


def side_sums(df: DataFrame, text: str | None = None, label: str = "label") -> SideSums:
    """One pass over (label, embedding, text): parts of the tasks are summed by class and position."""
    length = F.length(text).cast("double") if text else F.lit(None).cast("double")
    rows = df.filter("embedding IS NOT NULL").select(F.col(label).cast("string").alias("label"), "embedding", length.alias("length"))
    parts = rows.mapInArrow(_side_parts, "kind string, label string, v array<double>")
    summed = parts.select("kind", "label", F.posexplode("v").alias("pos", "x")).groupBy("kind", "label", "pos").agg(F.sum("x").alias("x"))
    lines: dict = {}
    for r in summed.orderBy("kind", "label", "pos").collect():
        lines.setdefault((r.kind, r.label), []).append(r.x)
    products = np.array(lines.pop(("products", None), []))
    width = math.isqrt(len(products))
    classes = {k: (*v[:4], np.array(v[4 : 4 + width]), np.array(v[4 + width :])) for (_, k), v in lines.items()}
    return SideSums(classes, products.reshape(width, width))


def mean_distance(a: DataFrame, b: DataFrame, by="label") -> DataFrame:
    """(label, distance): squared L2 distance of the class means."""
    p, q = prototypes(a, by), prototypes(b, by).withColumnRenamed("embedding", "__q")
    return p.join(q, by).select(by, v.squared_l2(F.col("embedding"), F.col("__q")).alias("distance"))


def kl_term(p: Column, q: Column) -> Column:
    return F.when(p > 0, p * F.log(p / q)).otherwise(0.0)


def mauve(hist: DataFrame, points: int = 25, scale: float = 5.0) -> DataFrame:
    """(mauve): mean area under the two divergence curves of the mixtures, with the end points (0, 1) and (1, 0)."""
    spark = hist.sparkSession
    w = spark.range(1, points + 1).select((F.col("id") / float(points + 1)).alias("w"))
    r = F.col("w") * F.col("p") + (1 - F.col("w")) * F.col("q")
    mixed = hist.join(w, F.lit(True)).groupBy("w").agg(F.sum(kl_term(F.col("q"), r)).alias("kq"), F.sum(kl_term(F.col("p"), r)).alias("kp"))
    curve = mixed.select("w", F.exp(-scale * F.col("kq")).alias("x"), F.exp(-scale * F.col("kp")).alias("y"))
    ends = spark.createDataFrame([(-1.0, 1.0, 0.0), (2.0, 0.0, 1.0)], "w double, x double, y double")
    line = curve.unionByName(ends)

    def area(a: str, b: str) -> DataFrame:
        order = W.orderBy(a, F.col(b).desc())
        step = (F.col(a) - F.lag(a).over(order)) * (F.col(b) + F.lag(b).over(order)) / 2
        return line.select(step.alias("s")).agg(F.sum("s").alias("area"))

    return area("x", "y").unionByName(area("y", "x")).agg(F.avg("area").alias("mauve"))


def histogram_distances(hist: DataFrame) -> DataFrame:
    """kl, total_variation, frontier_integral and wasserstein of two histograms (p, q).

    The frontier integral is 2 * the mean over mixtures of the linear cost; Wasserstein compares
    the sorted histogram values as samples.
    """
    p, q = F.col("p"), F.col("q")
    frontier = F.when((p > 0) & (q > 0) & (p != q), (p + q) / 2 - p * q * (F.log(p) - F.log(q)) / (p - q)).when((p > 0) & (q > 0), 0.0).otherwise((p + q) / 2)
    sums = hist.agg(
        F.sum(F.when((p > 0) & (q > 0), p * F.log(p / q)).otherwise(0.0)).alias("kl"),
        (F.sum(F.abs(p - q)) / 2).alias("total_variation"),
        F.sum(frontier).alias("frontier_integral"),
    )
    a, b = reindex(hist.select("p"), ["p"], "i"), reindex(hist.select("q"), ["q"], "i")
    return sums.crossJoin(a.join(b, "i").agg(F.avg(F.abs(p - q)).alias("wasserstein")))


def js_divergence(a: DataFrame, b: DataFrame, axes: list[str], bins: int = 8) -> DataFrame:
    """(js): Jensen-Shannon divergence (nats) on a shared grid of equal bins between joint minimum and maximum."""
    both = a.select(*axes, F.lit(0).alias("side")).unionByName(b.select(*axes, F.lit(1).alias("side")))
    ends = F.broadcast(both.agg(*[f(c).alias(f"__{n}{c}") for c in axes for n, f in (("lo", F.min), ("hi", F.max))]))
    cell = [
        F.least(F.floor((F.col(c) - F.col(f"__lo{c}")) / (F.col(f"__hi{c}") - F.col(f"__lo{c}")) * bins), F.lit(bins - 1)).alias(f"b{c}")
        for c in axes
    ]
    names = [f"b{c}" for c in axes]
    counts = both.crossJoin(ends).select("side", *cell).groupBy(*names).agg(
        F.sum(1 - F.col("side")).alias("ca"), F.sum("side").alias("cb"))
    total = F.broadcast(counts.agg(F.sum("ca").alias("ta"), F.sum("cb").alias("tb")))
    p, q = F.col("ca") / F.col("ta"), F.col("cb") / F.col("tb")
    m = (p + q) / 2
    return counts.crossJoin(total).agg(F.sum((kl_term(p, m) + kl_term(q, m)) / 2).alias("js"))


def confusion(df: DataFrame, label="label", pred="pred") -> DataFrame:
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label="label", pred="pred") -> DataFrame:
    """(accuracy, macro_precision, macro_recall, macro_f1); a label without predictions has precision 0."""
    c = confusion(df, label, pred)
    hit = F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0))
    t = c.groupBy(F.col(label).alias("k")).agg(F.sum("n").alias("actual"), hit.alias("tp"))
    g = c.groupBy(F.col(pred).alias("k")).agg(F.sum("n").alias("guessed"))
    per = t.join(g, "k", "full").fillna(0)
    p = F.coalesce(F.col("tp") / F.nullif(F.col("guessed"), F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("tp") / F.nullif(F.col("actual"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return per.agg((F.sum("tp") / F.sum("actual")).alias("accuracy"), F.avg(p).alias("macro_precision"), F.avg(r).alias("macro_recall"), F.avg(f1).alias("macro_f1"))


def topk_accuracy(df: DataFrame, ks=(1, 3, 5), prob="prob", label="label") -> DataFrame:
    """Rank of the label = scores strictly larger + 1."""
    own = F.element_at(prob, F.col(label).cast("int") + 1)
    ranks = df.select((F.size(F.filter(prob, lambda x: x > own)) + 1).alias("r"))
    return ranks.agg(*[F.avg((F.col("r") <= k).cast("double")).alias(f"top{k}") for k in ks])


def client_class_counts(df: DataFrame, client="client_id", label="label") -> DataFrame:
    """(client, label, n, p), dense over the classes met; p is the share within the client."""
    n = df.groupBy(client, label).agg(F.count(F.lit(1)).alias("n"))
    every = n.select(client).distinct().join(n.select(label).distinct(), F.lit(True))
    total = n.groupBy(client).agg(F.sum("n").alias("__t"))
    out = every.join(n, [client, label], "left").fillna(0, ["n"]).join(total, client)
    return out.withColumn("p", F.col("n") / F.col("__t")).drop("__t")


def client_sizes(df: DataFrame, client="client_id") -> DataFrame:
    n = df.groupBy(client).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.avg("n").alias("mean_size"), F.stddev_pop("n").alias("std_size"))


def personalised_accuracy(df: DataFrame, dist: DataFrame, client="client_id", label="label", correct="correct") -> DataFrame:
    """(client, accuracy): class hits and class sizes of the common test set, weighted by the client's class shares."""
    per = df.groupBy(label).agg(F.sum(F.col(correct).cast("int")).alias("hit"), F.count(F.lit(1)).alias("total"))
    j = dist.join(per, label)
    return j.groupBy(client).agg((F.sum(F.col("p") * F.col("hit")) / F.sum(F.col("p") * F.col("total"))).alias("accuracy"))


def perplexity(df: DataFrame, by=None, loss="loss") -> DataFrame:
    return df.groupBy(*([by] if by else [])).agg(F.exp(F.avg(loss)).alias("perplexity"))


def confidence_variability(scores: DataFrame, keys=("source_model", "idx")) -> DataFrame:
    p = F.element_at("prob", F.col("label").cast("int") + 1)
    return scores.groupBy(*keys).agg(F.avg(p).alias("confidence"), F.stddev_samp(p).alias("variability"))


def soft_labels(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(idx, class, p): probabilities of the models in a weighted sum."""
    long = scores.join(weights, "model_id").select("idx", "weight", F.posexplode("prob").alias("class", "x"))
    return long.groupBy("idx", "class").agg(F.sum(F.col("weight") * F.col("x")).alias("p"))


def entropy_soft_labels(scores: DataFrame) -> DataFrame:
    """Weights within each row: softmax over models of (total entropy - own entropy)."""
    e = scores.withColumn("e", v.entropy(F.col("prob")))
    w = W.partitionBy("idx")
    e = e.withColumn("g", F.exp(F.sum("e").over(w) - F.col("e"))).withColumn("weight", F.col("g") / F.sum("g").over(w))
    long = e.select("idx", "weight", F.posexplode("prob").alias("class", "x"))
    return long.groupBy("idx", "class").agg(F.sum(F.col("weight") * F.col("x")).alias("p"))


def majority_vote(scores: DataFrame) -> DataFrame:
    """(idx, label, voted): each model adds 1 - entropy (bits) to its class, the given label adds 1 once; lowest class wins ties."""
    votes = scores.select("idx", F.col("pred").cast("long").alias("class"), (1 - v.entropy(F.col("prob"), True)).alias("w"))
    given = scores.select("idx", F.col("label").cast("long").alias("class")).distinct().withColumn("w", F.lit(1.0))
    total = votes.unionByName(given).groupBy("idx", "class").agg(F.round(F.sum("w"), 9).alias("w"))
    won = total.groupBy("idx").agg(F.max_by("class", F.struct(F.col("w"), -F.col("class"))).alias("voted"))
    return scores.select("idx", "label").distinct().join(won, "idx")


def minimax_vote(scores: DataFrame) -> DataFrame:
    """(idx, voted): pairwise preferences weighted by 1 - entropy (bits); the class with the smallest worst defeat wins."""
    long = scores.select("idx", "model_id", (1 - v.entropy(F.col("prob"), True)).alias("w"), F.posexplode("prob").alias("a", "pa"))
    b = long.select("idx", "model_id", F.col("a").alias("b"), F.col("pa").alias("pb"))
    pairs = long.join(b, ["idx", "model_id"]).filter("a <> b")
    beat = pairs.groupBy("idx", "a", "b").agg(F.sum(F.when(F.col("pb") > F.col("pa"), F.col("w")).otherwise(0.0)).alias("lost"),
                                              F.sum(F.when(F.col("pa") > F.col("pb"), F.col("w")).otherwise(0.0)).alias("won"))
    worst = beat.groupBy("idx", "a").agg(F.round(F.max(F.col("lost") - F.col("won")), 9).alias("defeat"))
    return worst.groupBy("idx").agg(F.min_by("a", F.struct("defeat", "a")).cast("long").alias("voted"))


def label_flip(voted: DataFrame) -> DataFrame:
    """(n, flip_ratio) of (idx, label, voted)."""
    return voted.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") != F.col("voted")).cast("double")).alias("flip_ratio"))


def debias_responses(df: DataFrame, beta: float, classes: int, item="item", cls="class") -> DataFrame:
    """(item, class, estimate): debiased mean of one-hot answers, dense over the classes."""
    n = df.groupBy(item, cls).agg(F.count(F.lit(1)).alias("n"))
    total = df.groupBy(item).agg(F.count(F.lit(1)).alias("t"))
    every = total.select(item, "t", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias(cls))
    dense = every.join(n, [item, cls], "left").fillna(0, ["n"])
    return dense.select(item, cls, ((F.col("n") / F.col("t") - (1 - beta) / classes) / beta).alias("estimate"))


def fed_average(updates: DataFrame, keys=("round", "param_key"), weight="n") -> DataFrame:
    """(keys, values): client vectors averaged with weight over the total, position by position."""
    long = updates.select(*keys, weight, F.posexplode("values").alias("pos", "x"))
    mean = long.groupBy(*keys, "pos").agg((F.sum(F.col(weight) * F.col("x")) / F.sum(weight)).alias("x"))
    return mean.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("e")).select(*keys, F.col("e.x").alias("values"))


def inception_score(df: DataFrame, splits: int = 5, order="idx") -> DataFrame:
    """(score): exp of the mean KL to the split's mean, averaged over contiguous splits; the remainder is dropped."""
    from .selection import reindex

    n = df.count() // splits
    part = reindex(df.select(order, "prob"), [order], "__i").withColumn("split", F.floor(F.col("__i") / max(n, 1))).filter(F.col("split") < splits)
    long = part.select("split", order, F.posexplode("prob").alias("class", "p"))
    means = long.groupBy("split", "class").agg(F.avg("p").alias("m"))
    kl = long.join(means, ["split", "class"]).groupBy("split").agg((F.sum(kl_term(F.col("p"), F.col("m"))) / n).alias("kl"))
    return kl.agg(F.avg(F.exp("kl")).alias("score"))


def recovery_rate(pairs: DataFrame, chosen="clean_chosen", rejected="clean_rejected") -> DataFrame:
    return pairs.agg(F.avg((F.col(chosen) > F.col(rejected)).cast("double")).alias("recovery_rate"))


def weight_update(
    theta: DataFrame,
    scores: DataFrame,
    beta: float = 0.9,
    mode: str = "error",
    only_wrong: bool = False,
    real: str | None = None,
    scope: str = "all",
    trained_on: Column | None = None,
    rounds: int | None = None,
) -> DataFrame:
    """New weights of (source_model, idx, theta): one factor for each model in ``scores``; sums of each source are kept.

    A row that a model gets right shrinks by beta^x, one it gets wrong grows by beta^(-x), where x is the
    ``error`` or the ``loss``. With ``only_wrong``, right rows keep their weight. Rows marked by the column
    ``real`` of ``theta`` get b^(-error) from each model in turn, where b is the odds of the weighted
    average error of the source's real rows (turned over when above 1), by the weights of that moment.

    ``scope``: models judge ``all`` sources, ``other`` ones than they were trained on, or their ``own``
    (``trained_on`` is the source of a model, its model_id by default); a single source is judged by all.
    A model without a score for a row leaves its weight as it is. With ``rounds``, beta follows a source's
    number of rows n instead: 1 + sqrt(max(1, 2 ln(n / rounds))).
    """
    keys = ["source_model", "idx"]
    if scope != "all" and theta.select("source_model").distinct().limit(2).count() > 1:
        of = F.col("model_id") if trained_on is None else trained_on
        scores = scores.filter({"other": of != F.col("source_model"), "own": of == F.col("source_model")}[scope])
    new = theta.withColumn("__t", F.col("theta").cast("double")).withColumn("__beta", F.lit(float(beta)))
    if rounds is not None:
        n = theta.groupBy("source_model").agg((1 + F.sqrt(F.greatest(F.lit(1.0), 2 * F.log(F.count(F.lit(1)) / rounds)))).alias("__beta"))
        new = new.drop("__beta").join(n, "source_model")
    e = v.error_and_confidence(F.col("prob"), F.col("label"))
    x = {"error": e["error"], "loss": e["cross_entropy"]}[mode]
    signed = F.when(e["correct"], F.lit(0.0) if only_wrong else x).otherwise(-x)
    if real is None:
        step = scores.groupBy(*keys).agg(F.sum(signed).alias("__x"))
        new = new.join(step, keys, "left").withColumn("__t", F.col("__t") * F.pow("__beta", F.coalesce("__x", F.lit(0.0))))
    else:
        for (model,) in scores.select("model_id").distinct().orderBy("model_id").collect():
            one = scores.filter(F.col("model_id") == model).select(*keys, signed.alias("__x"), e["error"].alias("__e"))
            rows = materialise(new.join(one, keys, "left"))
            mean = (F.sum(F.col("__t") * F.col("__e")) / F.sum("__t")).alias("__m")
            odds = rows.filter(F.col(real) & F.col("__e").isNotNull()).groupBy("source_model").agg(mean).withColumn("__o", F.col("__m") / (1 - F.col("__m")))
            odds = odds.select("source_model", F.when(F.col("__o") > 1, 1 / F.col("__o")).otherwise(F.col("__o")).alias("__b"))
            rows = rows.join(odds, "source_model", "left")
            factor = F.when(F.col(real), F.pow("__b", -F.col("__e"))).otherwise(F.pow("__beta", "__x"))
            new = rows.withColumn("__t", F.col("__t") * F.coalesce(factor, F.lit(1.0))).drop("__x", "__e", "__b")
    sums = new.groupBy("source_model").agg((F.sum("theta") / F.sum("__t")).alias("__k"))
    return new.join(sums, "source_model").select(*keys, (F.col("__t") * F.col("__k")).alias("theta"))


def source_accuracy(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model_id").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))


def best_of_run(log: DataFrame, keys=("run",), step="step", value="value") -> DataFrame:
    """(keys, first, best, best_step): value of the first step, maximum, and the first step that has it."""
    return log.groupBy(*keys).agg(
        F.min_by(value, step).alias("first"), F.max(value).alias("best"), F.max_by(step, F.struct(F.col(value), -F.col(step))).alias("best_step"))


def mean_over_seeds(results: DataFrame, settings, values) -> DataFrame:
    """(settings, means): results of runs that differ in their seed only, averaged."""
    return results.groupBy(*settings).agg(*[F.avg(c).alias(c) for c in values])


def length_stats(df: DataFrame, by=None, text="text") -> DataFrame:
    return df.groupBy(*([by] if by else [])).agg(F.avg(F.length(text)).alias("mean_length"))


def budget_ledger(queries: DataFrame, delta: float, sigma="sigma") -> DataFrame:
    """(order, epsilon): the best epsilon at delta of all Gaussian releases, over the orders 1.1 .. 100.9."""
    spark = queries.sparkSession
    orders = spark.range(11, 1010).select((F.col("id") / 10.0).alias("a"))
    total = queries.agg(F.sum(1 / (2 * F.col(sigma) * F.col(sigma))).alias("t"))
    a = F.col("a")
    eps = a * F.col("t") + F.log((a - 1) / a) - (math.log(delta) + F.log(a)) / (a - 1)
    both = orders.crossJoin(F.broadcast(total)).withColumn("epsilon", eps)
    return both.agg(F.min_by("a", "epsilon").alias("order"), F.min("epsilon").alias("epsilon"))


def noise_scale(eps: Column, delta: Column, steps: Column, parties: Column, q: Column, contrastive: bool = False) -> Column:
    """S * sqrt(2 ln(1.25 / delta)) * sqrt(steps) / (eps * sqrt(parties)); S = 2 - 2^-(q - 1), doubled for contrast.

    Sound only where nobody sees a single party's noisy votes, and for eps below 1 a step.
    """
    s = (2 - F.pow(F.lit(2.0), 1 - q)) * (2 if contrastive else 1)
    return s * F.sqrt(2 * F.log(1.25 / delta)) * F.sqrt(steps) / (eps * F.sqrt(parties))


def training_dynamics(df: DataFrame, adjusted: bool = False) -> DataFrame:
    """(idx, confidence, variability, correctness, forgetfulness, closeness) of (idx, epoch, p, correct) rows."""
    w = W.partitionBy("idx").orderBy("epoch")
    right = F.col("correct").cast("int")
    lost = F.when((F.lag(right).over(w) == 1) & (right == 0), 1).otherwise(0)
    out = df.withColumn("__l", lost).groupBy("idx").agg(
        F.avg("p").alias("confidence"), F.stddev_pop("p").alias("variability"), F.sum(right).alias("correctness"),
        F.sum("__l").alias("__f"), F.count(F.lit(1)).alias("__n"))
    if adjusted:
        var = F.col("variability") * F.col("variability")
        out = out.withColumn("variability", F.sqrt(var + var * var / F.greatest(F.col("__n") - 1, F.lit(1))))
    never = F.when(F.col("correctness") == 0, 1000).otherwise(F.col("__f"))
    return out.select("idx", "confidence", "variability", "correctness", never.alias("forgetfulness"), (F.col("confidence") * (1 - F.col("confidence"))).alias("closeness"))


def epoch_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("epoch").agg(F.avg(-F.log("p")).alias("loss"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def dynamics_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    names = ("confidence", "variability", "correctness", "forgetfulness", "closeness")
    a = after.select("idx", *[F.col(c).alias(f"__{c}") for c in names])
    return before.join(a, "idx").select("idx", *[(F.col(f"__{c}") - F.col(c)).alias(c) for c in names])


def correctness_band(df: DataFrame, value="correctness") -> DataFrame:
    most = F.broadcast(df.agg(F.max(value).alias("__m")))
    return df.crossJoin(most).withColumn("band", F.round(F.col(value) / F.col("__m"), 1)).drop("__m")


def average_rank(counts: DataFrame, col: str, name: str) -> DataFrame:
    """(value, name): ranks with ties averaged, of the values of ``col`` that stand ``n`` times; see ``prefix_sums``."""
    n = counts.groupBy(F.col(col).alias("__v")).agg(F.sum("n").alias("__c"))
    ranks = prefix_sums(n, "__v", "__c", "__below", "__prev")
    return ranks.select(F.col("__v").alias(col), (F.col("__below") + (F.col("__c") + 1) / 2).alias(name))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """(pearson, spearman) over the rows where both are given; null where either is constant.

    Equal pairs are counted first, so values that many rows share are ranked and joined once.
    """
    pairs = materialise(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    n = F.sum("n").alias("n")
    means = pairs.agg(n, (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mx"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("my")).first()
    middle = ((means.n or 0) + 1) / 2

    def corr(a, b):
        up, left, right = (F.sum(F.col("n") * z) for z in (a * b, a * a, b * b))
        return up / F.nullif(F.sqrt(left * right), F.lit(0.0))

    r = pairs.join(average_rank(pairs, "x", "rx"), "x").join(average_rank(pairs, "y", "ry"), "y")
    rank = corr(F.col("rx") - middle, F.col("ry") - middle).alias("spearman")
    return r.agg(corr(F.col("x") - F.lit(means.mx), F.col("y") - F.lit(means.my)).alias("pearson"), rank)


def selected_per_origin(selected: DataFrame, origins: DataFrame, origin="origin") -> DataFrame:
    n = selected.groupBy(origin).agg(F.count(F.lit(1)).alias("n"))
    return origins.select(origin).distinct().join(n, origin, "left").fillna(0, ["n"])


def class_quota(df: DataFrame, total: int, label="label") -> DataFrame:
    """(label, n, quota, candidates): elite rows by class size with largest remainders; five candidates each."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    exact = F.round(F.col("n") / F.sum("n").over(W.partitionBy()) * total, 9)
    return largest_remainder(n, exact, total, label).withColumn("candidates", 5 * F.col("quota"))
