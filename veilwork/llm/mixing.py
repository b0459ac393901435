"""Mixing sources to target weights by entropy balancing.

The mix takes each document at a rate r, as close as possible (in relative entropy) to taking
everything once, such that every source yields its target of words and no rate exceeds ``cap``.
The solution is an exponential tilt, r = min(cap, exp(lambda * size / mean size)), with one dual
variable a source. The dual is convex; safeguarded Newton steps solve it for all sources at once,
as aggregations over the histogram (source, size, documents). Rates are then rounded to whole
copies: a keyed uniform of the document decides whether the fraction counts, and thresholds for
each source, found on histograms of the keyed uniforms, make the copies' words meet the target.

Defined cases: a null text has size 0 and no effect; a null source is a source of its own, sorted
last; a source of size 0 has target 0; repeated rows get equal draws; an empty table gives an
empty result. Sources are the keys of the mix's configuration, so their totals (one row each) are
held by the driver; documents never are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

_BINS = 4096


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def keyed_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def source_targets(sizes: dict, weights: dict, cap: float = 3.0) -> dict:
    """Words to take from each source: total size shared by weight, no source above cap times its size.

    What a capped source can't give is shared again by weight among the rest, until none is above.
    """
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weights[s] / total for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
            open_.remove(s)
        left = float(sum(sizes.values())) - sum(out.values())
    return out


def cycled_weights(sources, cycle=(1.0, 2.0, 3.0)) -> dict:
    """Sources in code point order, null last, weigh 1, 2, 3 and so on again."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def _solve_dual(hist: DataFrame, targets: dict, means: dict, cap: float, steps: int = 60) -> dict:
    """lambda of each source: sum n * size * min(cap, exp(lambda * size / mean)) = target.

    Each step is one distributed aggregation for all sources; Newton steps that leave the bracket
    known so far are replaced by its middle.
    """
    spark = hist.sparkSession
    live = {s: t for s, t in targets.items() if t > 0 and means[s] > 0}
    most = dict(hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size"))).collect())
    done = {s: 60.0 for s in live if live[s] >= (1 - 1e-9) * cap * most[s]}
    state = {s: [-60.0, 60.0, 0.0] for s in live if s not in done}
    for _ in range(steps):
        if not state:
            break
        rows = [(s, v[2], means[s]) for s, v in state.items()]
        now = F.broadcast(spark.createDataFrame(rows, "s string, lam double, mean double"))
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(math.log(cap))))
        words = F.col("n") * F.col("size") * rate
        inner = F.when(F.col("lam") * x < math.log(cap), words * x).otherwise(0.0)
        sums = hist.join(now, F.col("source").eqNullSafe(F.col("s"))).groupBy("source")
        for r in sums.agg(F.sum(words).alias("words"), F.sum(inner).alias("slope")).collect():
            s, (low, high, lam) = r.source, state[r.source]
            gap = r.words - live[s]
            if abs(gap) <= 1e-6 * live[s] or high - low < 1e-9:
                done[s] = lam
                continue
            low, high = (low, lam) if gap > 0 else (lam, high)
            step = lam - gap / r.slope if r.slope > 0 else math.inf
            state[s] = [low, high, step if low < step < high else (low + high) / 2]
        state = {s: v for s, v in state.items() if s not in done}
    return done | {s: v[2] for s, v in state.items()}


def _one_more(sized: DataFrame, rounds: list[dict]) -> DataFrame:
    """Adds ``more``: whether some round so far gives the document one more copy."""
    spark, more = sized.sparkSession, F.lit(False)
    for no, plan in enumerate(rounds):
        rows = [(s, float(limit), shift) for s, (limit, shift) in plan.items()]
        at = F.broadcast(spark.createDataFrame(rows or [(None, 0.0, -2.0)], f"s string, l{no} double, s{no} double"))
        sized = sized.join(at, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        more = more | ((F.col("size") <= F.col(f"l{no}")) & (F.col("key") < F.col(f"s{no}")))
    sized = sized.withColumn("more", more & (F.col("whole") < F.col("most")))
    return sized.drop(*[f"{c}{no}" for no in range(len(rounds)) for c in "ls"])


def _thresholds(sized: DataFrame, targets: dict, rounds: int = 4) -> list[dict]:
    """Source -> (largest size, shift of the rounding threshold), for each round.

    With key = uniform - fraction of the rate, a document no larger than the limit gets one more
    copy where key < shift. Words by source and bin of the key are summed, the bin where the target
    is met is opened into finer bins. What is left of the target is given in the next round to
    documents that fit into it.
    """
    spark, plan = sized.sparkSession, []
    taken = dict(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("whole"))).collect())
    for no in range(rounds):
        left = {s: targets.get(s, 0.0) - w for s, w in taken.items()}
        limit = {s: left[s] if no else math.inf for s in taken}
        low, width = {s: -1.0 for s in taken}, 2.0
        open_docs = _one_more(sized, plan).filter("NOT more AND whole < most AND size > 0")
        for _ in range(3):
            rows = [(s, float(limit[s]), v) for s, v in low.items()] or [(None, 0.0, 0.0)]
            at = F.broadcast(spark.createDataFrame(rows, "s string, most_words double, low double"))
            fit = open_docs.join(at, F.col("source").eqNullSafe(F.col("s"))).filter("size <= most_words")
            bins = fit.select("source", "size", F.floor((F.col("key") - F.col("low")) / (width / _BINS)).alias("bin"))
            sums = bins.filter(f"bin BETWEEN 0 AND {_BINS - 1}").groupBy("source", "bin").agg(F.sum("size").alias("w"))
            by_source: dict = {s: [] for s in taken}
            for r in sums.toLocalIterator():
                by_source[r.source].append((r.bin, r.w))
            for s, found in by_source.items():
                for bin_no, w in sorted(found):
                    if taken[s] + w > targets.get(s, 0.0):
                        low[s] += bin_no * width / _BINS
                        break
                    taken[s] += w
                else:
                    low[s] += width
            width /= _BINS
        plan.append({s: (limit[s], low[s]) for s in taken})
        if all(abs(targets.get(s, 0.0) - w) <= 0.002 * targets.get(s, 0.0) for s, w in taken.items()):
            break
    return plan


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: dict | None = None,
    cap: float = 3.0,
    seed: int = 17,
) -> DataFrame:
    """One row for each document: id, source, size, source_size, target, rate, copies, taken."""
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`").cast("string")
    sizes = materialise(docs.select(F.col(f"`{id_col}`").alias("id"), source.alias("source"), word_count(text).alias("size")))
    hist = materialise(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("n")).collect()
    words = {r.source: r.words for r in totals}
    means = {r.source: r.words / r.n for r in totals}
    targets = source_targets(words, weights or cycled_weights(words), cap)
    lams = _solve_dual(hist, targets, means, cap)
    plan = [(s, words[s], targets[s], lams.get(s, 0.0), means[s] or 1.0) for s in words]
    schema = "s string, source_size long, target double, lam double, mean double"
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(plan or [(None, 0, 0.0, 0.0, 1.0)], schema))
    tilt = F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(cap)))
    rate = F.least(F.exp(tilt), F.lit(float(cap)))
    tilted = sizes.join(known, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", rate).drop("s", "lam", "mean")
    whole = F.floor(F.col("rate") + 1e-9)
    tilted = materialise(
        tilted.withColumn("whole", whole)
        .withColumn("most", F.lit(int(cap)))
        .withColumn("key", keyed_uniform(F.col("id"), seed) - F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    )
    out = _one_more(tilted, _thresholds(tilted, targets))
    out = out.withColumn("copies", F.col("whole") + F.col("more").cast("long"))
    return out.select(
        "id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
