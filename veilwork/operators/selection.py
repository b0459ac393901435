"""Ranks, windows and top-k selection. Ties are broken by the given id, so results are exact."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialise


def reindex(df: DataFrame, order: list, name: str = "idx") -> DataFrame:
    """Dense 0..n-1 numbers in a global order without a one-task window: a range-partitioned sort and
    the row counts of the partitions (one row each) give every row its number."""
    at, part = F.monotonically_increasing_id().alias("__at"), F.spark_partition_id().alias("__part")
    ranged = df.orderBy(*order).select("*", part, at)
    ranged = materialise(ranged.withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1)))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    numbered = ranged.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at"))
    return numbered.drop("__part", "__at", "__before")


def _local_sums(batches: Iterator[pa.RecordBatch], order: str, weight: str) -> Iterator[pa.RecordBatch]:
    """Adds the weight and the order value of the rows before, within the task."""
    total, last = 0.0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        w, value = np.asarray(batch.column(weight).cast(pa.float64()).fill_null(0.0)), batch.column(order)
        run = total + np.cumsum(w)
        before = np.r_[total, run[:-1]]
        head = pa.array([last], value.type)
        yield batch.append_column("__before", pa.array(before)).append_column("__previous", pa.concat_arrays([head, value.slice(0, len(value) - 1)]))
        total, last = float(run[-1]), value[-1].as_py()


def prefix_sums(df: DataFrame, order: str, weight: str, before: str = "before", previous: str = "previous") -> DataFrame:
    """Adds the summed weight of all rows before a row, and the order value of the row before it (null for the first).

    Rows are sorted by range, summed within their tasks, and what the tasks before hold (a row a task) is added
    to each: no task sees all rows. Integer weights are summed exactly up to 2^53; null orders come first.
    """
    kinds = T.StructType([*df.schema.fields, T.StructField("__before", T.DoubleType()), T.StructField("__previous", df.schema[order].dataType)])
    ranged = df.orderBy(order).mapInArrow(lambda b: _local_sums(b, order, weight), kinds)
    ranged = materialise(ranged.withColumn("__part", F.spark_partition_id()))
    past = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    tasks = ranged.groupBy("__part").agg(F.sum(F.col(weight).cast("double")).alias("__sum"), F.max(order).alias("__max"))
    tasks = tasks.select("__part", F.coalesce(F.sum("__sum").over(past), F.lit(0.0)).alias("__offset"), F.max("__max").over(past).alias("__carry"))
    out = ranged.join(tasks, "__part").withColumn(before, F.col("__before") + F.col("__offset"))
    out = out.withColumn(previous, F.coalesce("__previous", "__carry"))
    return out.drop("__part", "__before", "__offset", "__previous", "__carry")


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fills each draw with the key of the last row before it in the task (null at its head); rows stay."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, is_row = batch.column("key"), np.asarray(batch.column("draw").is_null())
        at = np.maximum.accumulate(np.where(is_row, np.arange(len(is_row)) + 1, 0))
        seen = pa.concat_arrays([pa.array([carry], key.type), key]).take(pa.array(at))
        yield pa.RecordBatch.from_arrays([batch.column("at"), seen, batch.column("draw")], ["at", "key", "draw"])
        carry = seen[-1].as_py()


def last_before(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """(draw, key): for each of ``draws`` (draw, at) the key of the last of ``rows`` (key, at) at or before it.

    Both are sorted together by range and merged within the tasks; the last row of the tasks before fills the
    draws at a task's head. A row that a great share of the draws falls on spans as many tasks as its draws need.
    """
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = rows.select("at", "key", none(draws, "draw")).unionAll(draws.select("at", none(rows, "key"), "draw"))
    merged = both.orderBy("at", F.col("draw").asc_nulls_first()).mapInArrow(_last_seen, both.schema)
    merged = materialise(merged.withColumn("part", F.spark_partition_id()))
    ends = merged.filter("draw IS NULL").groupBy("part").agg(F.max_by("key", "at").alias("last"))
    parts = merged.select("part").distinct().join(ends, "part", "left")
    past = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.last("last", ignorenulls=True).over(past).alias("carry"))
    return merged.filter("draw IS NOT NULL").join(parts, "part").select("draw", F.coalesce("key", "carry").alias("key")).filter("key IS NOT NULL")


def ranked(df: DataFrame, order: list, by: list | str | None = None, name: str = "rank") -> DataFrame:
    """1-based rank within groups; without groups the rank is global (see ``reindex``)."""
    if by:
        return df.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long"))
    return reindex(df, order, name).withColumn(name, F.col(name) + 1)


def class_ranks(df: DataFrame, order: list, by: str, name: str = "rank") -> DataFrame:
    """1-based rank within few large classes. A class is sorted by many tasks (see ``reindex``), not by one."""
    rows = reindex(df, [F.col(by), *order], "__no")
    first = rows.groupBy(F.col(by).alias("__class")).agg(F.min("__no").alias("__from"))
    numbered = rows.join(F.broadcast(first), F.col(by).eqNullSafe(F.col("__class")))
    return numbered.withColumn(name, F.col("__no") - F.col("__from") + 1).drop("__no", "__class", "__from")


#: So many rows are merged by one task at most.
FEW = 10_000


def first_rows(df: DataFrame, order: list, n: int, few: int = FEW) -> DataFrame:
    """The n first rows: a distributed top-k, or beyond ``few`` the first numbers of a range-partitioned sort."""
    if n <= few:
        return df.orderBy(*order).limit(n)
    return reindex(df, order, "__first").filter(F.col("__first") < n).drop("__first")


def first_of_group(df: DataFrame, by: str, order: Column, columns: list[str]) -> DataFrame:
    """The row of each group that comes first in ``order``, by an aggregate that tasks start before the shuffle."""
    best = df.groupBy(by).agg(F.min_by(F.struct(*[F.col(c) for c in columns]), order).alias("__first"))
    return best.select("__first.*")


def rank_in_prompt(df: DataFrame, r: int, prompt="prompt", score="score", pos="pos", text="text") -> DataFrame:
    """(prompt, chosen, rejected): the best-scored answer and the one at 0-based rank r."""
    one = ranked(df, [F.col(score).desc(), F.col(pos)], prompt)
    pick = lambda k: F.max(F.when(F.col("rank") == k + 1, F.col(text)))
    return one.groupBy(prompt).agg(pick(0).alias("chosen"), pick(r).alias("rejected")).filter("rejected IS NOT NULL")


def best_worst(df: DataFrame, alpha: float, key="question", reward="reward", ppl="ppl", pos="pos", text="response") -> DataFrame:
    """Best and worst answer by alpha * rank(reward) + (1 - alpha) * rank(perplexity, falling)."""
    a = F.row_number().over(W.partitionBy(key).orderBy(F.col(reward), F.col(pos)))
    b = F.row_number().over(W.partitionBy(key).orderBy(F.col(ppl).desc(), F.col(pos)))
    mixed = df.withColumn("mix", alpha * a + (1 - alpha) * b)
    return mixed.groupBy(key).agg(
        F.max_by(text, F.struct(F.col("mix"), -F.col(pos))).alias("best"),
        F.min_by(text, F.struct(F.col("mix"), F.col(pos))).alias("worst"),
        F.max("mix").alias("best_mix"),
        F.min("mix").alias("worst_mix"),
    )


def cut_points(counts: DataFrame, shares: DataFrame, cls="label", client="client_id", share="p") -> DataFrame:
    """(class, client, first, last): row ranks [first, last) of each class by running sums of shares."""
    run = F.sum(share).over(W.partitionBy(cls).orderBy(client).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum(share).over(W.partitionBy(cls))
    ends = shares.join(counts, cls).withColumn("last", F.floor(run / total * F.col("n") + 1e-9).cast("long"))
    first = F.lag("last", 1, 0).over(W.partitionBy(cls).orderBy(client))
    is_last = F.lead(client).over(W.partitionBy(cls).orderBy(client)).isNull()
    ends = ends.withColumn("last", F.when(is_last, F.col("n")).otherwise(F.col("last")))
    return ends.withColumn("first", first).select(cls, client, "first", "last")


def source_offsets(df: DataFrame, source="source_model") -> DataFrame:
    n = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy(source).rowsBetween(W.unboundedPreceding, -1))
    return n.select(source, "n", F.coalesce(before, F.lit(0)).alias("offset"))


def length_chunks(df: DataFrame, k: int, text="text", key="doc_id") -> DataFrame:
    """Chunks of floor(n / k) rows by rising text length; a short extra chunk when k does not divide n."""
    n = df.count()
    return reindex(df, [F.length(text), F.col(key)]).withColumn("chunk", F.floor(F.col("idx") / max(n // k, 1)).cast("int"))


def last_rounds(df: DataFrame, b: int, round_col="round") -> DataFrame:
    """Rows of the b most recent rounds."""
    recent = df.select(round_col).distinct().orderBy(F.col(round_col).desc()).limit(b)
    return df.join(recent, round_col, "left_semi")


def best_so_far(log: DataFrame, patience: int, run="run", step="step", value="value") -> DataFrame:
    """Running best, steps since the last gain, and whether patience has run out by then."""
    w = W.partitionBy(run).orderBy(step)
    past = w.rowsBetween(W.unboundedPreceding, 0)
    out = log.withColumn("best", F.max(value).over(past))
    gained = F.when(F.coalesce(F.col(value) > F.max(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)), F.row_number().over(w))
    out = out.withColumn("since", F.row_number().over(w) - F.max(gained).over(past))
    return out.withColumn("stop", F.max(F.col("since") >= patience).over(past))


def interleave(df: DataFrame, chunk="chunk", order="pos") -> DataFrame:
    """Rows of all chunks in turn; what longer chunks have beyond the shortest is dropped. Large chunks are ranked by range."""
    out = class_ranks(df, [F.col(order)], chunk, "turn")
    shortest = df.groupBy(chunk).count().agg(F.min("count").alias("shortest"))
    return out.crossJoin(F.broadcast(shortest)).filter("turn <= shortest").drop("shortest")


def top(df: DataFrame, n: int, by: list | str | None = None, value="votes", key="id", ascending=False) -> DataFrame:
    """The n first rows overall or in each group."""
    first = F.col(value) if ascending else F.col(value).desc()
    if not by:
        return first_rows(df, [first, F.col(key)], n)
    return ranked(df, [first, F.col(key)], by).filter(F.col("rank") <= n).drop("rank")


def top_share(df: DataFrame, parts: int, reward="reward", key="pos") -> DataFrame:
    """The first int(n / parts) rows by reward."""
    return top(df, df.count() // parts, None, reward, key)


def top_weight(df: DataFrame, importance: DataFrame, rule: str, n: int = 0, source="source_model", key="idx", bins: int = 40) -> DataFrame:
    """Rows by importance of their source times theta: ``n`` first, ``half`` of the largest, above the
    ``gap`` (the first histogram bin from the top with fewer than five rows), or ``all``."""
    w = df.join(importance, source).withColumn("weight", F.col("importance") * F.col("theta"))
    if rule == "n":
        return top(w, n, None, "weight", key)
    if rule == "all":
        return w
    ends = w.agg(F.max("weight").alias("__hi"), F.min("weight").alias("__lo"))
    both = w.crossJoin(F.broadcast(ends))
    if rule == "half":
        return both.filter("weight >= 0.5 * __hi").drop("__hi", "__lo")
    size = (F.col("__hi") - F.col("__lo")) / bins
    bin_ = F.least(F.floor((F.col("weight") - F.col("__lo")) / size), F.lit(bins - 1)).cast("int")
    both = both.withColumn("__bin", F.coalesce(bin_, F.lit(0)))
    counts = both.groupBy("__bin").agg(F.count(F.lit(1)).alias("c"))
    scale = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("__bin"))
    gap = scale.join(counts, "__bin", "left").filter("coalesce(c, 0) < 5").agg(F.coalesce(F.max("__bin"), F.lit(-1)).alias("__gap"))
    return both.crossJoin(F.broadcast(gap)).filter("__bin > __gap").drop("__hi", "__lo", "__bin", "__gap")


def easy_and_ambiguous(df: DataFrame, n_easy: int, n_ambiguous: int, by=None, value="variability", key="idx") -> DataFrame:
    """Lowest values are easy, highest ambiguous; a row can't be both (easy first).

    Either end is a top list that tasks shorten before the shuffle; ranks of whole groups aren't needed.
    """
    easy = top(df, n_easy, by, value, key, ascending=True).withColumn("kind", F.lit("easy"))
    ends = [F.col(value).desc(), F.col(key).desc()]
    high = ranked(df, ends, by).filter(F.col("rank") <= n_ambiguous).drop("rank") if by else first_rows(df, ends, n_ambiguous)
    keys = [*([by] if isinstance(by, str) else by or []), key]
    taken = easy.select(*[F.col(c).alias(f"__{c}") for c in keys])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])
    return easy.unionByName(high.join(taken, same, "left_anti").withColumn("kind", F.lit("ambiguous")))


def easy_and_ambiguous_v2(df: DataFrame, n_ambiguous: int, n_total: int, guess: float, value="variability", key="idx") -> DataFrame:
    """Tiers: variability of at least 0.79 guess (highest first), then at least 0.5 guess nearest to
    guess, up to ``n_ambiguous``; the easiest others fill up to ``n_total``."""
    x = F.col(value)
    tier = F.when(x >= 0.79 * guess, 0).when(x >= 0.5 * guess, 1).otherwise(2)
    order = F.when(tier == 0, -x).when(tier == 1, F.abs(x - guess)).otherwise(x)
    one = ranked(df.withColumn("tier", tier).withColumn("__by", order), [F.col("tier"), F.col("__by"), F.col(key)], None, "__r")
    one = one.withColumn("kind", F.when((F.col("tier") < 2) & (F.col("__r") <= n_ambiguous), "ambiguous"))
    taken = materialise(one)
    left = max(n_total - taken.filter("kind IS NOT NULL").count(), 0)
    easy = first_rows(taken.filter("kind IS NULL"), [F.col(value), F.col(key)], left).withColumn("kind", F.lit("easy"))
    return taken.filter("kind IS NOT NULL").unionByName(easy).drop("__by", "__r")


def influence_and_variability(df: DataFrame, n: int, influence="influence", value="variability", key="idx") -> DataFrame:
    """By falling influence: n rows near the largest variability, then n rows near the smallest."""
    ends = F.broadcast(df.agg(F.max(value).alias("__hi"), F.min(value).alias("__lo")))
    both = df.crossJoin(ends)
    high = top(both.filter(f"{value} >= 0.96 * __hi"), n, None, influence, key).withColumn("kind", F.lit("variable"))
    low = both.filter(F.col(value) <= F.least(100 * F.col("__lo"), F.lit(0.02)))
    low = top(low.join(high.select(key), key, "left_anti"), n, None, influence, key).withColumn("kind", F.lit("steady"))
    return high.unionByName(low).drop("__hi", "__lo")


def keep_kth(df: DataFrame, k: int, value="votes") -> DataFrame:
    """Values below the k-th largest become 0; ties with it stay."""
    kth = first_rows(df, [F.col(value).desc()], k).agg(F.min(value).alias("__kth"))
    return df.crossJoin(F.broadcast(kth)).withColumn(value, F.when(F.col(value) >= F.col("__kth"), F.col(value)).otherwise(0)).drop("__kth")


def best_spans(logits: DataFrame, n_best: int = 20, max_len: int = 30, key="example", window="window") -> DataFrame:
    """(key, window, first, last, score, prob) of the best span of each example over its windows.

    ``logits``: start and end arrays for each window. Probabilities are a softmax over the n_best
    spans; the null answer is the pair of position 0.
    """
    ends = {}
    for side in ("start", "end"):
        rows = logits.select(key, window, F.posexplode(side).alias("p", "z"))
        ends[side] = ranked(rows, [F.col("z").desc(), F.col("p")], [key, window]).filter(F.col("rank") <= n_best)
    a = ends["start"].select(key, window, F.col("p").alias("first"), F.col("z").alias("za"))
    b = ends["end"].select(key, window, F.col("p").alias("last"), F.col("z").alias("zb"))
    spans = a.join(b, [key, window]).filter(f"last >= first AND last - first + 1 <= {max_len} AND first > 0")
    spans = spans.withColumn("score", F.col("za") + F.col("zb"))
    null = logits.groupBy(key).agg(F.min(F.col("start")[0] + F.col("end")[0]).alias("null_score"))
    best = ranked(spans, [F.col("score").desc(), F.col(window), F.col("first"), F.col("last")], key)
    best = best.filter(F.col("rank") <= n_best)
    total = F.sum(F.exp("score")).over(W.partitionBy(key))
    best = best.withColumn("prob", F.exp("score") / total).filter("rank = 1").join(null, key)
    answered = F.col("score") > F.col("null_score")
    return best.select(key, window, "first", "last", "score", "prob", answered.alias("answered"))


def low_error_fill(df: DataFrame, n: int, own: int, source="source_model", error="error", correct="correct", key="idx") -> DataFrame:
    """Wrong rows of other sources first, then own rows with the lowest error."""
    first = F.when((F.col(source) != own) & ~F.col(correct), 0).when(F.col(source) == own, 1)
    rows = df.withColumn("priority", first).filter("priority IS NOT NULL")
    return first_rows(rows, [F.col(c) for c in ("priority", error, key, source)], n)


def top_ifd(df: DataFrame, rate: float, ratio="ratio", key="id") -> DataFrame:
    """The floor(n * rate) rows of the highest ratio."""
    return top(df, int(df.count() * rate), None, ratio, key)
