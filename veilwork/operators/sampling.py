"""Client partitioning, sampling and local mechanisms; all draws are keyed (see ``functions.keyed``)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..functions.keyed import gaussian, gumbel, uniform
from ..sources.tables import materialise
from .selection import class_ranks, cut_points, first_of_group, first_rows, last_before, prefix_sums, ranked, reindex


def iid_clients(df: DataFrame, k: int, seed, key="id") -> DataFrame:
    """Shuffle and deal: sizes differ by one at most."""
    return reindex(df, [uniform(seed, F.col(key)), F.col(key)], "__i").withColumn("client_id", F.col("__i") % k).drop("__i")


def _class_counts(df: DataFrame, label: str) -> dict:
    """Rows of each class: the configuration of the draw."""
    return {r[0]: r[1] for r in df.groupBy(label).count().orderBy(label).collect()}


def dirichlet_shares(counts: dict, k: int, beta: float, seed: int, min_size: int = 10, balance: bool = True) -> dict:
    """Class -> shares of the clients, drawn until every client gets ``min_size`` rows; only counts are needed."""
    rng, n = np.random.default_rng(seed), sum(counts.values())
    for _ in range(10_000):
        sizes, shares = np.zeros(k), {}
        for c, rows in counts.items():
            p = rng.dirichlet([beta] * k)
            if balance:
                p = p * (sizes < n / k)
                p = p / p.sum() if p.sum() else np.full(k, 1 / k)
            shares[c] = p
            edges = np.floor(np.cumsum(p) * rows + 1e-9)
            edges[-1] = rows
            sizes += np.diff(np.concatenate([[0], edges]))
        if sizes.min() >= min(min_size, n // k):
            return shares
    raise ValueError("no draw gives every client enough rows")


def assign_by_shares(df: DataFrame, shares: dict, seed, label="label", key="id") -> DataFrame:
    """Rows of each class in keyed order are cut at the running sums of the clients' shares."""
    spark = df.sparkSession
    kind = df.schema[label].dataType.simpleString()
    rows = [(c, i, float(x)) for c, p in shares.items() for i, x in enumerate(p)]
    table = spark.createDataFrame(rows, f"{label} {kind}, client_id long, p double")
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    cuts = cut_points(counts, table, label)
    rows = class_ranks(df, [uniform(seed, F.col(key)), F.col(key)], label, "__r").withColumn("__r", F.col("__r") - 1)
    placed = rows.join(F.broadcast(cuts), label)
    return placed.filter("__r >= first AND __r < last").drop("__r", "first", "last")


def dirichlet_clients(df: DataFrame, k: int, beta: float, seed: int, min_size: int = 10, balance: bool = True, label="label", key="id") -> DataFrame:
    return assign_by_shares(df, dirichlet_shares(_class_counts(df, label), k, beta, seed, min_size, balance), seed, label, key)


def dirichlet_clients_pinned(df: DataFrame, k: int, beta: float, seed: int, cap: int, label="label", key="id") -> DataFrame:
    """The k last rows (by key) are pinned one to a client; rows above a client's cap move to clients with room."""
    pinned = materialise(df.orderBy(F.col(key).desc()).limit(k))
    pinned = reindex(pinned, [key], "client_id")
    rest = df.join(pinned.select(key), key, "left_anti")
    placed = dirichlet_clients(rest, k, beta, seed, 0, False, label, key).unionByName(pinned)
    if cap * k < df.count():
        raise ValueError("the caps don't hold all rows")
    is_pinned = placed.join(pinned.select(key, F.lit(1).alias("__pin")), key, "left")
    order = [F.coalesce("__pin", F.lit(0)).desc(), uniform(seed, F.col(key), 1), F.col(key)]
    ranked_ = materialise(class_ranks(is_pinned, order, "client_id", "__r").drop("__pin"))
    over = reindex(ranked_.filter(F.col("__r") > cap), ["client_id", "__r"], "__slot").drop("client_id", "__r")
    sizes = ranked_.groupBy("client_id").agg(F.count(F.lit(1)).alias("__n"))
    clients = df.sparkSession.range(k).select(F.col("id").alias("client_id")).join(sizes, "client_id", "left").fillna(0, ["__n"])
    room = F.greatest(F.lit(cap) - F.col("__n"), F.lit(0))
    run = F.sum(room).over(W.orderBy("client_id").rowsBetween(W.unboundedPreceding, 0))
    free = clients.select("client_id", (run - room).alias("__a"), run.alias("__b")).filter("__b > __a")
    moved = over.join(F.broadcast(free), (F.col("__slot") >= F.col("__a")) & (F.col("__slot") < F.col("__b"))).drop("__slot", "__a", "__b")
    return ranked_.filter(F.col("__r") <= cap).drop("__r").unionByName(moved)


def fixed_size_clients(df: DataFrame, size: int, alpha: float, seed: int, label="label", key="id") -> DataFrame:
    """Each client gets ``size`` rows with a Dirichlet class mix; the last client takes the rest."""
    left, rng, quotas = _class_counts(df, label), np.random.default_rng(seed), []
    n, classes = sum(left.values()), list(left)
    client = 0
    while n - client * size >= 2 * size:
        want = rng.dirichlet([alpha] * len(classes)) * size
        got = {c: min(int(w), left[c]) for c, w in zip(classes, want, strict=True)}
        for c in sorted(classes, key=lambda c: -left[c]):
            more = min(size - sum(got.values()), left[c] - got[c])
            got[c] += more
        for c, x in got.items():
            left[c] -= x
            quotas.append((c, client, x))
        client += 1
    quotas += [(c, client, x) for c, x in left.items()]
    kind = df.schema[label].dataType.simpleString()
    q = df.sparkSession.createDataFrame(quotas, f"{label} {kind}, client_id long, q long")
    run = F.sum("q").over(W.partitionBy(label).orderBy("client_id").rowsBetween(W.unboundedPreceding, 0))
    cuts = q.select(label, "client_id", (run - F.col("q")).alias("first"), run.alias("last"))
    rows = class_ranks(df, [uniform(seed, F.col(key)), F.col(key)], label, "__r").withColumn("__r", F.col("__r") - 1)
    placed = rows.join(F.broadcast(cuts), label)
    return placed.filter("__r >= first AND __r < last").drop("__r", "first", "last")


def class_skew_clients(df: DataFrame, k: int, s: int, seed, label="label", key="id") -> DataFrame:
    """s classes for each client, equal slices: slice j of class c (c-th in order) goes to client (c + j * classes) / s."""
    classes = df.select(label).distinct()
    c = classes.withColumn("__c", F.row_number().over(W.orderBy(label)) - 1).withColumn("__k", F.count(F.lit(1)).over(W.partitionBy()))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    rows = class_ranks(df, [uniform(seed, F.col(key)), F.col(key)], label, "__r").withColumn("__r", F.col("__r") - 1)
    rows = rows.join(F.broadcast(c.join(counts, label)), label)
    slices = F.greatest(F.floor(F.lit(k * s) / F.col("__k")), F.lit(1))
    j = F.least(F.floor(F.col("__r") * slices / F.col("__n")), slices - 1)
    client = F.floor((F.col("__c") * slices + j) / s) % k
    return rows.withColumn("client_id", client.cast("long")).drop("__r", "__c", "__k", "__n")


def category_shards(df: DataFrame, k: int, category="label", key="id") -> DataFrame:
    """k div c shards a category, the first k mod c categories one more; rows that don't fill their category's shards are dropped."""
    cats = df.groupBy(category).agg(F.count(F.lit(1)).alias("__n"))
    order = W.orderBy(category)
    cats = cats.withColumn("__i", F.row_number().over(order) - 1).withColumn("__c", F.count(F.lit(1)).over(W.partitionBy()))
    mine = (F.floor(F.lit(k) / F.col("__c")) + (F.col("__i") < F.lit(k) % F.col("__c")).cast("long")).alias("__s")
    cats = cats.select("*", mine)
    first = F.sum("__s").over(order.rowsBetween(W.unboundedPreceding, -1))
    cats = cats.withColumn("__first", F.coalesce(first, F.lit(0))).filter("__s > 0")
    rows = class_ranks(df, [F.col(key)], category, "__r").withColumn("__r", F.col("__r") - 1)
    rows = rows.join(F.broadcast(cats), category)
    size = F.greatest(F.floor(F.col("__n") / F.col("__s")), F.lit(1))
    rows = rows.withColumn("__shard", F.floor(F.col("__r") / size)).filter("__shard < __s")
    return rows.withColumn("client_id", (F.col("__first") + F.col("__shard")).cast("long")).drop("__r", "__n", "__i", "__c", "__s", "__first", "__shard")


def label_parties(df: DataFrame, label="label") -> DataFrame:
    return df.withColumn("client_id", F.col(label))


def weighted_resample(df: DataFrame, n: int, seed, weight="w", key="id") -> DataFrame:
    """(draw, key): n draws with replacement, P proportional to the weight.

    By rising key each row owns an interval as long as its weight; a draw takes the row in whose interval it
    falls. Interval ends are prefix sums over ranges of rows, and draws are sorted and merged with them, so a
    heavy row, however many draws it takes, keeps no task busier than others.
    """
    rows = df.select(F.col(key).alias("key"), F.col(weight).cast("double").alias("w")).filter("w > 0")
    total = rows.agg(F.sum("w")).first()[0]
    if not total:
        raise ValueError("all weights are zero")
    starts = prefix_sums(rows, "key", "w", "at").select("key", "at")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (uniform(seed, F.col("id"), "draw") * total).alias("at"))
    return last_before(starts, draws).withColumnRenamed("key", key)


def weighted_sample(df: DataFrame, n: int, seed, weight="w", key="id") -> DataFrame:
    """n rows without replacement, P proportional to the weight: exponential keys, n smallest."""
    e = -F.log(uniform(seed, F.col(key))) / F.col(weight)
    return first_rows(df.filter(F.col(weight) > 0).withColumn("__e", e), [F.col("__e"), F.col(key)], n).drop("__e")


def entropy_sample(df: DataFrame, n: int, sign: int, seed, prob="prob", key="id") -> DataFrame:
    """n rows, P proportional to exp(sign * entropy), by Gumbel keys."""
    g = sign * v.entropy(F.col(prob)) + gumbel(seed, F.col(key))
    return first_rows(df.withColumn("__g", g), [F.col("__g").desc(), F.col(key)], n).drop("__g")


def random_rows(df: DataFrame, n: int, seed, key="id") -> DataFrame:
    return first_rows(df.withColumn("__u", uniform(seed, F.col(key))), [F.col("__u"), F.col(key)], n).drop("__u")


def bernoulli(df: DataFrame, p: float, seed, key="id") -> DataFrame:
    return df.filter(uniform(seed, F.col(key)) < p)


def few_shot_ids(prompts: DataFrame, pool_size: int, k: int, seed, key="prompt_id") -> DataFrame:
    """(prompt, draw, position): k distinct positions in a pool for each prompt.

    A prompt draws positions until k are distinct, and the first k distinct ones count. Prompts that
    fall short after a round of draws draw on. Join on the pool's position. A prompt's draws stay an array
    in its row, so that nothing is grouped.
    """
    if k > pool_size:
        raise ValueError("the pool is smaller than k")
    done, tries, found = 0, 4 * k + 16, None
    short = prompts.select(key).distinct().withColumn("__drawn", F.array().cast("array<long>"))
    while found is None or not short.isEmpty():
        draw = lambda t: F.floor(uniform(seed, F.col(key), t) * pool_size).cast("long")
        drawn = F.array_distinct(F.concat("__drawn", F.transform(F.sequence(F.lit(done), F.lit(done + tries - 1)), draw)))  # in order of the draws
        rows = materialise(short.withColumn("__drawn", F.slice(drawn, 1, k)))
        full, short = rows.filter(F.size("__drawn") >= k), rows.filter(F.size("__drawn") < k)
        found = full if found is None else found.unionByName(full)
        done, tries = done + tries, 2 * tries
    out = found.select(key, F.posexplode("__drawn").alias("draw", "position"))
    return out.select(key, (F.col("draw") + 1).cast("long").alias("draw"), "position")


def clients_of_round(clients: DataFrame, m: int, round_no: int, seed, key="client_id") -> DataFrame:
    u = uniform(seed, F.concat_ws(":", F.lit(round_no).cast("string"), F.col(key).cast("string")))
    return first_rows(clients.withColumn("__u", u), [F.col("__u"), F.col(key)], m).drop("__u")


def stratified_sample(df: DataFrame, n: int, seed, label="label", key="id") -> DataFrame:
    """round(n * share) rows of each class."""
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("__t")))
    quota = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).crossJoin(total).select(label, F.round(n * F.col("__n") / F.col("__t")).alias("__q"))
    rows = class_ranks(df, [uniform(seed, F.col(key)), F.col(key)], label, "__r").join(F.broadcast(quota), label)
    return rows.filter("__r <= __q").drop("__r", "__q")


def skewed_quotas(counts: dict, n: int, seed: int, draws: int = 10_000) -> dict:
    """Quotas of n rows by a Dirichlet(0.3), drawn again until the largest is twice the smallest at least.

    A class has no more than its rows; what it can't give goes to the classes with most rows left.
    """
    rng, classes, room = np.random.default_rng(seed), list(counts), np.array(list(counts.values()), int)
    n = min(n, int(room.sum()))
    for _ in range(draws):
        q = np.floor(rng.dirichlet([0.3] * len(classes)) * n).astype(int)
        q[-1] += n - q.sum()
        q = np.minimum(q, room)
        while q.sum() < n:
            most = int(np.argmax(room - q))
            q[most] += min(n - q.sum(), room[most] - q[most])
        if len(classes) == 1 or q.max() >= 2 * max(q.min(), 1):
            return dict(zip(classes, q.tolist(), strict=True))
    raise ValueError("no draw makes the largest class twice the smallest")


def skewed_sample(df: DataFrame, n: int, seed: int, skewed: bool = True, label="label", key="id") -> DataFrame:
    """n rows by skewed class quotas (see ``skewed_quotas``), or equal ones."""
    counts = _class_counts(df, label)
    if skewed:
        quota = skewed_quotas(counts, n, seed)
    else:
        quota = {c: min(n // len(counts), rows) for c, rows in counts.items()}
    kind = df.schema[label].dataType.simpleString()
    q = df.sparkSession.createDataFrame(list(quota.items()), f"{label} {kind}, __q long")
    rows = class_ranks(df, [uniform(seed, F.col(key)), F.col(key)], label, "__r").join(F.broadcast(q), label)
    return rows.filter("__r <= __q").drop("__r", "__q")


def split(df: DataFrame, ratio: float, seed, key="id") -> DataFrame:
    """Adds ``is_train``: exactly floor(n * ratio) rows in keyed order."""
    n = math.floor(df.count() * ratio)
    return reindex(df, [uniform(seed, F.col(key)), F.col(key)], "__i").withColumn("is_train", F.col("__i") < n).drop("__i")


def exponential_pick(df: DataFrame, eps: float, tau: float, seed, label="label", score="score", key="id") -> DataFrame:
    """One pick for each class by the exponential mechanism on e^(tau * s), s the min-max score in [-1, 0].

    Null scores keep weight exp(0) = 1, as every candidate must stay possible. The budget is shared
    by the classes. Where a class has equal scores the pick is uniform.
    """
    ends = materialise(df.groupBy(label).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi")))
    lo, hi = F.col("__lo"), F.col("__hi")
    s = F.when(hi > lo, (F.col(score) - lo) / (hi - lo) - 1).otherwise(0.0)
    utility = F.when(F.col(score).isNull() & (hi > lo), 0.0).when(hi > lo, F.exp(tau * s)).otherwise(1.0)
    rows = df.join(ends.withColumnRenamed(label, "__class"), F.col(label).eqNullSafe(F.col("__class")))
    g = utility * (eps / max(ends.count(), 1)) / 2 + gumbel(seed, F.col(key))
    return first_of_group(rows.withColumn("__g", g), label, F.struct(-F.col("__g"), F.col(key)), df.columns)


def feedback_draw(df: DataFrame, seed, label="label", weight="picks", key="id") -> DataFrame:
    """One earlier item for each class, P proportional to its pick count."""
    e = -F.log(uniform(seed, F.col(key))) / F.col(weight)
    rank = F.row_number().over(W.partitionBy(label).orderBy(e, key))
    return df.filter(F.col(weight) > 0).withColumn("__r", rank).filter("__r = 1").drop("__r")


def keep_probability(eps: float, k: int, classes: int) -> float:
    e = math.exp(eps / k)
    return (e - 1) / (e - 1 + classes)


def randomised_response(cls: Column, key: Column, beta: float, classes: int, seed) -> Column:
    """The class with probability beta, else a uniform one (which may equal it)."""
    return F.when(uniform(seed, key, 0) < beta, cls.cast("int")).otherwise(F.floor(uniform(seed, key, 1) * classes).cast("int"))


def gaussian_noise(value: Column, key: Column, sigma: float, seed) -> Column:
    return value + sigma * gaussian(seed, key)


def empirical_draw(df: DataFrame, values: DataFrame, seed, key="id", value="value", weight="weight") -> DataFrame:
    """Adds ``drawn``: a value with P proportional to its weight; ``values`` is a short table of observed values."""
    order = W.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    run = F.sum(weight).over(order)
    total = F.sum(weight).over(W.partitionBy())
    cuts = values.select(F.col(value).alias("drawn"), ((run - F.col(weight)) / total).alias("__a"), (run / total).alias("__b"))
    last = F.max("__b").over(W.partitionBy())
    cuts = cuts.withColumn("__b", F.when(F.col("__b") >= last, 2.0).otherwise(F.col("__b")))
    rows = df.withColumn("__u", uniform(seed, F.col(key)))
    return rows.join(F.broadcast(cuts), (F.col("__u") >= F.col("__a")) & (F.col("__u") < F.col("__b"))).drop("__u", "__a", "__b")


def cap_rows_per_client(df: DataFrame, n: int, seed, client="party", key="id") -> DataFrame:
    """At most n rows of each client, in keyed order (the bound of a client's influence on the votes)."""
    return ranked(df, [uniform(seed, F.col(key)), F.col(key)], client, "__r").filter(F.col("__r") <= n).drop("__r")
