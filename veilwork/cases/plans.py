"""Iterated pipelines on the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.vectors import softmax
from ..operators import aggregates as a
from ..operators import joins as j
from ..operators.elite import diverse_elite
from ..plans import rounds as p
from ..sources.tables import fresh_path
from ..streaming.rounds import vote_stream
from ._case import EMB_SQL, SEED, candidates, case, pairs, r6, read, scores, split_embeddings, u_sql
from .aggregates import CLIENT_SQL, HIST_SQL
from .selection import BW_SQL


@case("t8_diverse_elite")
def t8(spark, d):
    pr, c = split_embeddings(spark, d)
    votes = a.vote_histogram(j.knn(pr, c, 1, "same"), c).select(F.col("cand_id").alias("id"), "votes")
    return diverse_elite(c.join(votes, "id"), 5, 0.1)


@case("l1_evolve")
def l1(spark, d):
    pr, c = split_embeddings(spark, d)
    return p.evolve(pr, c, lambda x, no: p.jitter(x, no, SEED), 2, 60, SEED, 0.5, 0.5).select("id", "label", "round")


_CHOSEN = f"SELECT party FROM (SELECT DISTINCT party FROM emb) ORDER BY {u_sql('concat_ws(chr(58), 0::VARCHAR, party::VARCHAR)')}, party LIMIT 4"


@case("l2_preference_round", f"""WITH {EMB_SQL.replace('priv AS (SELECT * FROM emb WHERE id % 5 <> 0)', f'priv AS (SELECT * FROM emb WHERE id % 5 <> 0 AND party IN ({_CHOSEN}))')}, {CLIENT_SQL},
r AS (SELECT label AS prompt, cand_id, score, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, cand_id) AS k FROM cs JOIN cand ON cand.id = cand_id)
SELECT prompt, max(cand_id) FILTER (k = 1) AS chosen, max(cand_id) FILTER (k = 4) AS rejected FROM r GROUP BY prompt HAVING max(cand_id) FILTER (k = 4) IS NOT NULL""")
def l2(spark, d):
    pr, c = split_embeddings(spark, d)
    return p.preference_round(pr, c.withColumn("prompt", F.col("label")), 4, 0, 3, SEED)[0]


@case("l2_recovery_rate", f"""WITH {EMB_SQL.replace('priv AS (SELECT * FROM emb WHERE id % 5 <> 0)', f'priv AS (SELECT * FROM emb WHERE id % 5 <> 0 AND party IN ({_CHOSEN}))')}, {CLIENT_SQL},
r AS (SELECT label AS prompt, score, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, cand_id) AS k FROM cs JOIN cand ON cand.id = cand_id),
p AS (SELECT max(score) FILTER (k = 1) AS chosen, max(score) FILTER (k = 4) AS rejected FROM r GROUP BY prompt)
SELECT round(avg((chosen > rejected)::INT), 6) AS recovery_rate FROM p WHERE rejected IS NOT NULL""")
def l2_recovery(spark, d):
    pr, c = split_embeddings(spark, d)
    return p.preference_round(pr, c.withColumn("prompt", F.col("label")), 4, 0, 3, SEED)[1].withColumn("recovery_rate", r6("recovery_rate"))


@case("l3_class_feedback_round")
def l3(spark, d):
    pr, c = split_embeddings(spark, d)
    return p.class_feedback_round(pr, c, 3, 5.0, 2.0, SEED)


@case("l4_elite_round")
def l4(spark, d):
    pr, c = split_embeddings(spark, d)
    shift = lambda k: lambda e: e.select("label", (F.col("id") + k).alias("id"), "place")
    return p.elite_round(pr, c, 4, 0.1, 0.5, SEED, {"rewrite_a": shift(1_000_000), "rewrite_b": shift(2_000_000)})


@case("l5_fusion_round")
def l5(spark, d):
    pr, c = split_embeddings(spark, d)
    out = p.fusion_round(pr, with_text(spark, d, c), scores(spark, d), 600, 3, 0.5, SEED)
    none = F.lit(None)
    rows = [out["quota"].select(F.lit("quota").alias("part"), "source_model", none.cast("long").alias("label"), none.cast("long").alias("id"), F.col("quota").cast("double").alias("value"))]
    rows += [out[k].select(F.lit(k).alias("part"), "source_model", "label", F.col("cand_id").alias("id"), F.col("votes").alias("value")) for k in ("near", "far")]
    rows.append(out["pool"].select(F.col("kind").alias("part"), "source_model", none.cast("long").alias("label"), F.col("idx").alias("id"), F.col("variability").alias("value")))
    rows.append(out["prompts"].select(F.lit("prompt").alias("part"), none.cast("long").alias("source_model"), F.col("label").cast("long").alias("label"),
                                      F.col("prompt_id").alias("id"), F.length("prompt").cast("double").alias("value")))
    return reduce(lambda x, y: x.unionByName(y), rows)


def with_text(spark, d, vectors):
    """Candidates with the text of the document of the same number (modulo the documents), empty without one."""
    docs = read(spark, d, "documents").select((F.col("doc_id")).alias("id"), "text")
    return vectors.join(docs, "id", "left").fillna("", "text")


def _answers():
    """A stand-in generator: the first words of each example of the prompt."""
    return lambda prompt: [" ".join(line.split()[3:12]) for line in prompt.split("\n")[1:]]


def _directions():
    """A stand-in encoder: 64 numbers from the text's digest."""
    import hashlib

    return lambda texts: [[(x - 127.5) / 1020 for x in hashlib.sha512(text.encode()).digest()] for text in texts]


def _stand_in_scores(cand):
    """Probabilities of two models that follow the row's first coordinates."""
    rows = [cand.select(F.lit(m).alias("model_id"), F.col("id").alias("idx"), "source_model", (F.col("label") % 4).alias("label"), softmax(F.slice("embedding", 4 * m + 1, 4)).alias("prob")) for m in (0, 1)]
    return rows[0].unionByName(rows[1])


@case("l5_fusion_rounds")
def l5_rounds(spark, d):
    pr, c = split_embeddings(spark, d)
    out = p.fusion_rounds(pr, with_text(spark, d, c), _stand_in_scores, _answers, _directions, 2, 60, 3, 0.5, SEED, fresh_path(spark, "fusion"))
    return out.select("id", "source_model", "label", "round", F.length("text").alias("n_chars"))


REVISED_SQL = f"rev AS (SELECT question, 'revised ' || response AS response, {u_sql('pos', '9')} AS reward FROM answers WHERE pos % 3 = 0)"


@case("l6_reward_refine", f"""WITH {BW_SQL}, {REVISED_SQL},
b AS (SELECT bw.question, best AS response, max(reward) AS reward, min(pos) AS pos FROM bw JOIN answers ON answers.question = bw.question AND answers.response = best GROUP BY ALL),
k AS (SELECT * FROM b QUALIFY row_number() OVER (ORDER BY reward DESC, pos) <= (SELECT count(*) FROM b) // 2)
SELECT question, response, round(reward, 6) AS reward, 0 AS round FROM k UNION ALL SELECT question, response, round(reward, 6), 1 FROM rev WHERE reward * 0.8 >= (SELECT min(reward) FROM k)""")
def l6(spark, d):
    from ._case import u

    c = candidates(spark, d)
    revised = c.filter("pos % 3 = 0").select("question", F.concat(F.lit("revised "), "response").alias("response"), u("pos", 9).alias("reward"))
    return p.reward_refine(c, revised, 0.5, 2, 0.8).withColumn("reward", r6("reward"))


@case("l7_knowledge_round")
def l7(spark, d):
    s = scores(spark, d).select("idx", F.col("model_id").alias("client_id"), "prob", "pred", F.col("model_id").alias("round"))
    return p.knowledge_round(s, 50, 0.7, 4, SEED, 3)


def _echo():
    """A stand-in generator: turns the last example of the prompt around."""
    return lambda prompt: ["##instruction: " + " ".join(reversed(prompt.split()[-12:])) + "\n##output: done\n###example: 2", "no markers"]


@case("l8_instruction_build")
def l8(spark, d):
    rows = pairs(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("q").alias("instruction"), F.col("r").alias("response"))
    return p.instruction_build(rows, 20, 30, 3, _echo, SEED, fresh_path(spark, "build"))[0]


@case("l9_corpus_report")
def l9(spark, d):
    pr, c = split_embeddings(spark, d)
    return p.corpus_report(with_text(spark, d, c), with_text(spark, d, pr), "party", "text").withColumn("value", r6("value"))


@case("stream_votes", f"WITH {HIST_SQL} SELECT cand_id, votes, round(mean_dist, 6) AS mean_dist, 0 AS round FROM hist")
def stream(spark, d):
    pr, c = split_embeddings(spark, d)
    source = fresh_path(spark, "arriving")
    c.select("id", "label", "embedding").write.parquet(source)
    arriving = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    path = fresh_path(spark, "votes")
    vote_stream(arriving, pr, path, fresh_path(spark, "stream")).awaitTermination()
    return spark.read.parquet(path).select("cand_id", "votes", r6("mean_dist").alias("mean_dist"), "round")


