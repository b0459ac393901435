"""Iterated pipelines. Each round is written to a table partitioned by round and read back, so plans don't grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.keyed import uniform
from ..operators import aggregates as a
from ..operators import filters as f
from ..operators import joins as j
from ..operators import sampling as m
from ..operators import selection as s
from ..operators import sets
from ..operators.clusters import cluster_histograms
from ..operators.elite import diverse_elite
from ..sources.readers import append_round, save_rejects, write_client_shards
from ..sources.tables import fresh_path, materialise
from . import hooks


def evolve(
    private: DataFrame, seeds: DataFrame, vary: Callable[[DataFrame, int], DataFrame], rounds: int, n: int, seed,
    sigma: float = 1.0, threshold: float = 0.0,
) -> DataFrame:
    """Vote, noise, threshold, resample, vary; the survivors of all rounds with their ``round``.

    ``vary`` maps (draw, id, label, embedding) and the round number to the next candidates
    (id, label, embedding).
    """
    spark, path = private.sparkSession, fresh_path(private.sparkSession, "evolve")
    cand = materialise(seeds.select("id", "label", "embedding"))
    for no in range(rounds):
        hist = a.vote_histogram(j.nearest(private, cand), cand)
        hist = a.threshold_votes(a.noisy_votes(hist, sigma, f"{seed}:{no}"), threshold)
        p = materialise(a.to_probability(hist).withColumnRenamed("cand_id", "id"))
        drawn = m.weighted_resample(p, n, f"{seed}:{no}", "p").join(cand, "id").select("draw", "id", "label", "embedding")
        cand = materialise(vary(drawn, no))
        append_round(cand, path, no)
    return spark.read.parquet(path)


def preference_round(corpus: DataFrame, answers: DataFrame, m_clients: int, round_no: int, rank: int, seed, sigma: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(pairs, recovery rate): clients of the round score the answers, the best and the one at ``rank`` pair up."""
    chosen = m.clients_of_round(corpus.select("party").distinct(), m_clients, round_no, seed, "party")
    sim = materialise(j.client_similarity(corpus.join(chosen, "party", "left_semi"), answers))
    clean = a.client_scores(sim).withColumnRenamed("score", "clean")
    noisy = a.client_scores(sim, sigma=sigma, seed=seed)
    rows = answers.select(F.col("id").alias("cand_id"), "prompt").join(noisy, "cand_id").join(clean, "cand_id")
    ranks = s.ranked(rows, [F.col("score").desc(), F.col("cand_id")], "prompt")
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    pairs = ranks.groupBy("prompt").agg(
        pick(1, "cand_id").alias("chosen"), pick(rank + 1, "cand_id").alias("rejected"),
        pick(1, "clean").alias("clean_chosen"), pick(rank + 1, "clean").alias("clean_rejected")).filter("rejected IS NOT NULL")
    pairs = materialise(pairs)
    return pairs.select("prompt", "chosen", "rejected"), a.recovery_rate(pairs)


def class_feedback_round(private: DataFrame, cand: DataFrame, quota: int, eps: float, tau: float, seed) -> DataFrame:
    """(label, id, round): one pick a class and round by the exponential mechanism until each class has its quota."""
    protos = a.prototypes(private)
    scored = materialise(j.own_class_nearest(cand, protos))
    path, spark = fresh_path(private.sparkSession, "feedback"), private.sparkSession
    for no in range(quota):
        left = scored if no == 0 else scored.join(spark.read.parquet(path), "id", "left_anti")
        append_round(materialise(m.exponential_pick(left, eps / quota, tau, f"{seed}:{no}").select("label", "id")), path, no)
    return spark.read.parquet(path)


def elite_round(private: DataFrame, cand: DataFrame, n: int, threshold: float, sigma: float, seed, rewrites: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Votes within classes, noise, a diverse elite, and the outputs of the rewriting operators in turn with it."""
    nn = j.knn(private, cand, 1, "same")
    votes = a.noisy_votes(a.vote_histogram(nn, cand), sigma, seed, clamp=True).select(F.col("cand_id").alias("id"), "votes")
    elite = materialise(diverse_elite(cand.join(votes, "id"), n, threshold).select("label", "id", "place"))
    streams = {"elite": elite} | {name: rewrite(elite) for name, rewrite in rewrites.items()}
    return sets.merge_operator_outputs(streams, "place")


def contrast_prompts(near: DataFrame, far: DataFrame, texts: DataFrame, header: str, k: int, variants: int, seed) -> DataFrame:
    """(prompt_id, label, prompt): for each class ``variants`` prompts that show half of its ``k`` far texts as bad, then
    the other half's number of its ``k`` near texts as good, drawn anew for each prompt. Braces leave the texts.

    ``near`` and ``far``: (label, cand_id, votes); ``texts``: (id, text).
    """

    def drawn(votes: DataFrame, side: str, m: int) -> DataFrame:
        rows = s.top(votes, k, "label", "votes", "cand_id").withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
        key = F.concat_ws(":", F.lit(side), F.col("label"), F.col("variant"), F.col("cand_id"))
        rows = rows.withColumn("__class", F.concat_ws(":", F.col("label"), F.col("variant")))
        rows = s.ranked(rows, [uniform(seed, key), F.col("cand_id")], "__class", "draw").filter(F.col("draw") <= m).withColumn("bad", F.lit(side == "bad"))
        return rows.select("label", "variant", "bad", "draw", "cand_id")

    shots = drawn(far, "bad", k // 2).unionByName(drawn(near, "good", k - k // 2))
    shots = shots.join(texts.select(F.col("id").alias("cand_id"), "text"), "cand_id")
    line = F.concat(F.when(F.col("bad"), "A bad example: ").otherwise("A good example: "), F.translate(t.flatten_whitespace(F.col("text")), "{}", ""))
    ordered = F.array_sort(F.collect_list(F.struct((~F.col("bad")).alias("good"), "draw", line.alias("line"))))
    lines = shots.groupBy("label", "variant").agg(ordered.alias("s"))
    prompt = F.concat(F.lit(header + "\n"), F.array_join(F.col("s.line"), "\n"))
    return lines.select((F.col("label").cast("long") * variants + F.col("variant")).alias("prompt_id"), "label", prompt.alias("prompt"))


def fusion_round(
    private: DataFrame, cand: DataFrame, scores: DataFrame, total: int, q: int, sigma: float, seed, k: int = 8, variants: int = 6,
    header: str = "Write one more example.",
) -> dict[str, DataFrame]:
    """Ranked private votes of parties over the candidates of several sources.

    Returns ``quota`` (rows to ask of each source), ``near`` and ``far`` (candidates to imitate and
    to avoid, by class) and ``pool`` (easy and ambiguous rows by variability); where the candidates have
    a ``text``, also ``prompts`` (see ``contrast_prompts``).
    """
    party = private.select("id", "party")

    def votes(far: bool) -> DataFrame:
        nn = j.knn(private, cand, q, "same", far).join(party, "id")
        per = a.noisy_votes(a.ranked_votes(nn, cand), sigma, seed, key=F.concat_ws(":", F.col("party"), F.col("cand_id"))) if sigma else a.ranked_votes(nn, cand)
        return a.sum_parties(per).join(cand.select(F.col("id").alias("cand_id"), "source_model", "label"), "cand_id")

    near, far = materialise(votes(False)), materialise(votes(True))
    clamped = near.withColumn("votes", F.greatest("votes", F.lit(0.0)))
    pool = s.easy_and_ambiguous(a.confidence_variability(scores), total // 10, total // 10, "source_model")
    out = {
        "quota": a.apportion(a.source_score(clamped), total, 1.0).select("source_model", "quota"),
        "near": s.top(near, q, "label", "votes", "cand_id"),
        "far": s.top(far, q, "label", "votes", "cand_id"),
        "pool": pool,
    }
    return out | ({"prompts": contrast_prompts(near, far, cand, header, k, variants, seed)} if "text" in cand.columns else {})


def fusion_rounds(
    private: DataFrame, first: DataFrame, score: Callable[[DataFrame], DataFrame], make_generator, make_encoder, rounds: int, total: int,
    q: int, sigma: float, seed, path: str, start: int = 1, **prompts,
) -> DataFrame:
    """All rows of all rounds: (id, source_model, label, text, embedding, round), also kept as a table at ``path``.

    Round 0 is ``first``. Each later round votes on the rows of the rounds before it, asks every source for its
    quota, dealt over the round's prompts, and appends what comes back with ids of its own. A round that is run
    again (``start``) sees the same earlier rows and replaces its own, so a retry doubles nothing.
    """
    spark, names = private.sparkSession, ["id", "source_model", "label", "text", "embedding"]
    if start == 1:
        append_round(first.select(*names), path, 0)
    for no in range(start, start + rounds):
        cand = spark.read.parquet(path).filter(F.col("round") < no).drop("round")
        out = fusion_round(private, cand, score(cand), total, q, sigma, f"{seed}:{no}", **prompts)
        asked = s.reindex(materialise(out["prompts"]).join(out["quota"], F.lit(True)), ["source_model", "prompt_id"], "ask")
        n = out["prompts"].count()
        share = F.floor(F.col("quota") / n) + (F.col("ask") % n < F.col("quota") % n).cast("long")
        asked = materialise(asked.withColumn("share", share).filter("share > 0"))
        made = hooks.generate(asked.select(F.col("ask").alias("prompt_id"), "prompt"), make_generator).withColumnRenamed("prompt_id", "ask")
        made = made.join(asked.select("ask", "source_model", "label", "share"), "ask").filter("attempt < share AND text IS NOT NULL")
        rows = s.reindex(made, ["ask", "attempt"], "place").withColumn("id", F.lit(no * (1 << 40)) + F.col("place"))
        append_round(hooks.embed(rows, make_encoder).select(*names), path, no)
    return spark.read.parquet(path)


def reward_refine(answers: DataFrame, revised: DataFrame, alpha: float, parts: int, ratio: float) -> DataFrame:
    """(question, response, reward, round): the best answers' top share, then revised answers above its floor, and all together."""
    best = s.best_worst(answers, alpha).select("question", F.col("best").alias("response"))
    rows = answers.groupBy("question", "response").agg(F.max("reward").alias("reward"), F.min("pos").alias("pos"))
    kept = materialise(s.top_share(best.join(rows, ["question", "response"]), parts))
    new = f.reward_floor(revised, kept, ratio).withColumn("round", F.lit(1))
    return sets.grow_pool(kept.withColumn("round", F.lit(0)), new).select("question", "response", "reward", "round")


def knowledge_round(scores: DataFrame, n: int, beta: float, classes: int, seed, buffer: int = 25) -> DataFrame:
    """(item, class, estimate): items of high entropy, randomised answers of the clients, debiased means, over the buffer's rounds."""
    latest = s.last_rounds(scores, buffer)
    mean = a.soft_labels(latest.withColumn("model_id", F.lit(0)), latest.sparkSession.createDataFrame([(0, 1.0)], "model_id int, weight double"))
    total = mean.groupBy("idx").agg(F.sum("p").alias("t"))
    prob = mean.join(total, "idx").groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("class", (F.col("p") / F.col("t")).alias("p")))).alias("v"))
    items = materialise(m.entropy_sample(prob.select("idx", F.col("v.p").alias("prob")), n, 1, seed, key="idx").select("idx"))
    answers = latest.join(items, "idx", "left_semi")
    key = F.concat_ws(":", F.col("idx"), F.col("client_id"))
    told = answers.select(F.col("idx").alias("item"), m.randomised_response(F.col("pred"), key, beta, classes, seed).alias("class"))
    return a.debias_responses(told, beta, classes)


def instruction_build(pairs: DataFrame, n_seeds: int, n_prompts: int, k: int, make_generator, seed, path: str, threshold: float = 0.52) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) generated instructions: seeds, few-shot prompts, generator, extraction, novelty filter, shards.

    ``pairs``: (id, instruction, response). Accepted rows are also written as client shards under ``path``.
    """
    spark = pairs.sparkSession
    seeds = materialise(s.reindex(m.random_rows(pairs, n_seeds, seed), ["id"], "position"))
    prompts = spark.range(n_prompts).select(F.col("id").alias("prompt_id"))
    shots = materialise(m.few_shot_ids(prompts, n_seeds, k, seed).join(seeds, "position"))
    asked = t.few_shot_prompt(shots.withColumnRenamed("instruction", "text"), "Write one more example.")
    made = hooks.generate(asked, make_generator)
    parts = t.extract_example(F.col("text"))
    made = materialise(made.select((F.col("prompt_id") * 1000 + F.col("attempt")).alias("id"), "prompt_id", parts["instruction"].alias("text"), parts["output"].alias("output")))
    against = made.select("id", "prompt_id", F.coalesce("text", F.lit("")).alias("text")).join(
        shots.select("prompt_id", F.col("position").alias("seed_id"), F.col("instruction").alias("seed_text")), "prompt_id")
    fresh = f.novelty_filter(against, threshold).select("id", F.lit(True).alias("fresh"))
    judged = made.join(fresh, "id", "left").withColumn("client_id", F.col("prompt_id") % 4)
    whole = F.col("fresh") & (F.length("output") > 1)
    good, bad = save_rejects(judged, whole, f"{path}/rows")
    write_client_shards(good.drop("fresh"), f"{path}/shards")
    return good.drop("fresh"), bad.drop("fresh")


def corpus_report(syn: DataFrame, real: DataFrame, client: str | None = None, text: str | None = None) -> DataFrame:
    """(metric, value) of two sets of (id, label, embedding, ...): Frechet and class mean distances, mauve and histogram
    distances, self-similarity, cross distances, and of each side rows, mean text length, and mean and deviation of the
    clients' sizes (without a ``client`` column, of the classes').

    One pass a side gathers all sums that can be merged (``aggregates.side_sums``); only clusters, distances over
    all pairs and client sizes take passes of their own.
    """
    spark = syn.sparkSession
    one, two = a.side_sums(syn, text), a.side_sums(real, text)
    hist = materialise(cluster_histograms(syn, real))
    rows = [("frechet", a.frechet_of(one.moments(), two.moments())), ("mauve", a.mauve(hist).first()[0])]
    rows += list(a.histogram_distances(hist).first().asDict().items())
    rows += [("self_similarity", one.self_similarity()), ("cross_cosine", one.cross_cosine(two)), ("class_mean_distance", one.class_mean_distance(two))]
    rows.append(("cross_l2", j.mean_cross_distance(syn, real).agg(F.avg("mean_l2")).first()[0]))
    for side, df, sums in (("syn", syn, one), ("real", real, two)):
        sizes = a.client_sizes(df, client or "label").first()
        rows += [(f"{side}_rows", sums.n), (f"{side}_mean_length", sums.mean_length()), (f"{side}_client_size_mean", sizes[0]), (f"{side}_client_size_std", sizes[1])]
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "metric string, value double")


def jitter(drawn: DataFrame, no: int, seed, size: float = 0.05) -> DataFrame:
    """A variation for numeric tests: each coordinate moves by a keyed uniform of at most ``size``."""
    moved = F.transform("embedding", lambda x, i: (x.cast("double") + size * (2 * uniform(seed, F.concat_ws(":", F.col("draw"), F.lit(no)), i) - 1)).cast("float"))
    return drawn.select((F.lit((no + 1) * 1_000_000) + F.col("draw")).alias("id"), "label", moved.alias("embedding"))

