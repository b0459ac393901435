"""Joins and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import aggregates as agg
from ..operators import filters as f
from ..operators import joins as j
from ..operators import selection as sel
from ._case import (
    CAND_SQL, EMB_SQL, PAIRS_SQL, SCORES_SQL, candidates, case, cos_sql, pairs, r6, read, scores, split_embeddings, sq_sql, u, u_sql,
)


def knn_sql(q: int, where: str = "true", desc: str = "") -> str:
    return f"""nn0 AS (SELECT p.id, p.label, p.party, c.id AS cand_id, sqrt({sq_sql('p.embedding', 'c.embedding')}) AS dist
  FROM priv p JOIN cand c ON {where}),
nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist {desc}, cand_id)::INT AS rank FROM nn0 QUALIFY rank <= {q})"""


@case("j1_nearest", f"WITH {EMB_SQL}, {knn_sql(1)} SELECT id, cand_id, round(dist, 6) AS dist FROM nn")
def j1(spark, d):
    p, c = split_embeddings(spark, d)
    return j.nearest(p, c).select("id", "cand_id", r6("dist").alias("dist"))


def _knn(name, q, rule, far, where):
    @case(name, f"WITH {EMB_SQL}, {knn_sql(q, where, 'DESC' if far else '')} SELECT id, cand_id, rank, round(dist, 6) AS dist FROM nn")
    def run(spark, d):
        p, c = split_embeddings(spark, d)
        return j.knn(p, c, q, rule, far, block=64).select("id", "cand_id", "rank", r6("dist").alias("dist"))


_knn("j2_knn_same_class", 3, "same", False, "p.label = c.label")
_knn("j3_knn_other_class", 3, "other", False, "p.label <> c.label")
_knn("j4_farthest_same_class", 2, "same", True, "p.label = c.label")

SIM_SQL = f"""sim AS (SELECT p.party, c.id AS cand_id, sum({cos_sql('p.embedding', 'c.embedding')}) AS similarity
  FROM priv p, cand c GROUP BY ALL)"""


@case("j5_client_similarity", f"WITH {EMB_SQL}, {SIM_SQL} SELECT party, cand_id, round(similarity, 6) AS similarity FROM sim")
def j5(spark, d):
    p, c = split_embeddings(spark, d)
    return j.client_similarity(p, c).withColumn("similarity", r6("similarity"))


PROTO_SQL = """el AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INT AS pos FROM priv),
pm AS (SELECT label, pos, avg(x) AS x FROM el GROUP BY ALL),
proto AS (SELECT label, list(x ORDER BY pos) AS embedding FROM pm GROUP BY label)"""
DIST_SQL = f"pd AS (SELECT c.id, c.label, p.label AS class, sqrt({sq_sql('c.embedding', 'p.embedding')}) AS dist FROM cand c, proto p)"


@case("j6_to_prototypes", f"WITH {EMB_SQL}, {PROTO_SQL}, {DIST_SQL} SELECT id, label, class, round(dist, 6) AS dist FROM pd")
def j6(spark, d):
    p, c = split_embeddings(spark, d)
    return j.to_prototypes(c, agg.prototypes(p)).withColumn("dist", r6("dist"))


@case("f13_own_class_nearest", f"""WITH {EMB_SQL}, {PROTO_SQL}, {DIST_SQL},
o AS (SELECT id, label, min(dist) FILTER (class = label) AS own, min(dist) AS least FROM pd GROUP BY ALL)
SELECT id, label, round(CASE WHEN own <= least THEN -own END, 6) AS score FROM o""")
def f13(spark, d):
    p, c = split_embeddings(spark, d)
    return j.own_class_nearest(c, agg.prototypes(p)).withColumn("score", r6("score"))


@case("j7_self_similarity", f"""WITH {EMB_SQL}, p AS (SELECT a.id, {cos_sql('a.embedding', 'b.embedding')} AS c FROM cand a JOIN cand b ON a.id <> b.id)
SELECT id, round(max(c), 6) AS max_cosine, round((SELECT avg(c) FROM p), 6) AS mean_cosine FROM p GROUP BY id""")
def j7(spark, d):
    _, c = split_embeddings(spark, d)
    mean = F.broadcast(j.mean_self_similarity(c))
    return j.max_self_similarity(c).crossJoin(mean).select("id", r6("max_cosine").alias("max_cosine"), r6("mean_cosine").alias("mean_cosine"))


@case("j8_mean_cross_distance", f"""WITH {EMB_SQL}
SELECT p.label::BIGINT AS label, round(avg(sqrt({sq_sql('p.embedding', 'c.embedding')})), 6) AS mean_l2, round(avg({cos_sql('p.embedding', 'c.embedding')}), 6) AS mean_cosine
FROM priv p JOIN cand c ON p.label = c.label GROUP BY p.label""")
def j8(spark, d):
    p, c = split_embeddings(spark, d)
    return j.mean_cross_distance(c, p).select("label", r6("mean_l2").alias("mean_l2"), r6("mean_cosine").alias("mean_cosine"))


@case("j9_mean_pair_psnr", f"""WITH {EMB_SQL}, m AS (SELECT p.label, {sq_sql('p.embedding', 'c.embedding')} / len(p.embedding) / 3 AS mse FROM priv p JOIN cand c ON p.label = c.label)
SELECT label, round(avg(CASE WHEN mse > 0 THEN least(10 * log10(1 / mse), 100.0) ELSE 100.0 END), 6) AS psnr FROM m GROUP BY label""")
def j9(spark, d):
    p, c = split_embeddings(spark, d)
    return j.mean_pair_psnr(p, c).withColumn("psnr", r6("psnr"))


@case("j10_align_by_index", "SELECT doc_id AS idx, lang, source FROM documents")
def j10(spark, d):
    docs = read(spark, d, "documents")
    a, b = docs.select(F.col("doc_id").alias("idx"), "lang"), docs.select(F.col("doc_id").alias("idx"), "source")
    return j.align_by_index(a, b)


@case("j11_take", """SELECT vec_id AS idx, vec_id % 3 AS source_model, (vec_id % 4 = 1)::INT AS mask FROM embeddings""")
def j11(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), (F.col("vec_id") % 3).alias("source_model"))
    ids = j.take(e, e.filter("idx % 4 = 1"))
    return j.take_mask(e, ids)


@case("j12_not_seen", """SELECT doc_id, text FROM documents a WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 2 = 1 AND b.text = a.text)""")
def j12(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    return j.not_seen(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"))


@case("j13_generation_grid", "SELECT * FROM (SELECT DISTINCT source AS attribute FROM documents), (SELECT DISTINCT lang AS label FROM documents)")
def j13(spark, d):
    docs = read(spark, d, "documents")
    return j.generation_grid(docs.select(F.col("source").alias("attribute")).distinct(), docs.select(F.col("lang").alias("label")).distinct())


@case("j14_preference_pairs", f"""WITH {PAIRS_SQL}, q AS (SELECT q AS question, r AS truth, substr(r, 1, 10) AS plain, substr(r, 1, 20) AS tuned, substr(r, 1, 30) AS private FROM pairs)
SELECT question, truth AS chosen, plain AS rejected, 'truth>plain' AS kind FROM q UNION ALL SELECT question, truth, tuned, 'truth>tuned' FROM q UNION ALL
SELECT question, truth, private, 'truth>private' FROM q UNION ALL SELECT question, tuned, plain, 'tuned>plain' FROM q UNION ALL SELECT question, private, plain, 'private>plain' FROM q""")
def j14(spark, d):
    cut = lambda n: F.substring("r", 1, n)
    q = pairs(spark, d).select(F.col("q").alias("question"), F.col("r").alias("truth"), cut(10).alias("plain"), cut(20).alias("tuned"), cut(30).alias("private"))
    return j.preference_pairs(q)


for _scope, _where in (("all", "true"), ("other", "model_id % 3 <> source_model"), ("own", "model_id % 3 = source_model")):

    def _cross(scope, where):
        @case(f"j15_cross_evaluate_{scope}", f"""WITH {SCORES_SQL}
SELECT model_id, source_model, count(*) AS n, round(avg((pred = label)::INT), 6) AS accuracy, round(avg(-ln(prob[label + 1])), 6) AS loss FROM scores WHERE {where} GROUP BY ALL""")
        def run(spark, d):
            out = j.cross_evaluate(scores(spark, d), scope)
            return out.withColumn("accuracy", r6("accuracy")).withColumn("loss", r6("loss"))

    _cross(_scope, _where)


def state(spark, d, model):
    p = F.col("prob")
    e = v.error_and_confidence(p, F.col("label"))
    return scores(spark, d).filter(F.col("model_id") == model).select(
        "source_model", "idx", e["cross_entropy"].alias("loss"), e["error"].alias("error"), e["correct"].alias("correct"), "pred", v.norm(p).alias("norm"))


@case("j16_change_after", f"""WITH {SCORES_SQL},
s AS (SELECT *, -ln(prob[label + 1]) AS loss, abs(1 - prob[label + 1]) AS error, (pred = label)::INT AS correct, sqrt(list_sum(list_transform(prob, lambda x: x * x))) AS norm FROM scores)
SELECT a.source_model, a.idx, round(b.loss - a.loss, 6) AS loss_change, round(b.error - a.error, 6) AS error_change, b.correct - a.correct AS gained, b.pred AS new_pred, round(b.norm - a.norm, 6) AS norm_change
FROM s a JOIN s b ON a.idx = b.idx AND a.model_id = 0 AND b.model_id = 1""")
def j16(spark, d):
    out = j.change_after(state(spark, d, 0), state(spark, d, 1))
    return out.select("source_model", "idx", "gained", "new_pred", *[r6(c).alias(c) for c in ("loss_change", "error_change", "norm_change")])


W = "len(string_split(text, ' '))"


@case("f1_min_words", f"SELECT doc_id FROM documents WHERE {W} > 20")
def f1(spark, d):
    return f.min_words(read(spark, d, "documents"), 20).select("doc_id")


@case("f2_token_bounds", f"SELECT doc_id FROM documents WHERE {W} BETWEEN 80 AND 1000")
def f2(spark, d):
    return f.token_bounds(read(spark, d, "documents"), 80, 1000).select("doc_id")


@case("f3_not_prefix", "SELECT doc_id FROM documents WHERE NOT starts_with(text, 'The')")
def f3(spark, d):
    return f.not_prefix(read(spark, d, "documents"), "The").select("doc_id")


@case("f4_length_close", "SELECT doc_id FROM documents WHERE abs(n_chars - 2000) <= 0.2 * 2000 OR abs(n_chars - 200) <= 0.8 * 200")
def f4(spark, d):
    n = F.col("n_chars")
    return read(spark, d, "documents").filter(f.length_close(n, F.lit(2000), 0.2) | f.length_close(n, F.lit(200), 0.8)).select("doc_id")


@case("f5_closest_attempt", """WITH a AS (SELECT doc_id // 3 AS id, doc_id % 3 AS attempt, n_chars AS size, 1500 AS target FROM documents),
r AS (SELECT *, abs(size - target) <= 0.2 * target AS ok, abs(size - target) AS gap FROM a)
SELECT id, attempt, size FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY (NOT ok)::INT, CASE WHEN ok THEN attempt ELSE gap END, attempt) = 1""")
def f5(spark, d):
    a = read(spark, d, "documents").select(F.floor(F.col("doc_id") / 3).alias("id"), (F.col("doc_id") % 3).alias("attempt"),
                                           F.col("n_chars").alias("size"), F.lit(1500).alias("target"))
    return f.closest_attempt(a, 0.2).select("id", "attempt", "size")


@case("f6_language_is", "SELECT doc_id, source FROM documents WHERE lang = 'fr'")
def f6(spark, d):
    return f.language_is(read(spark, d, "documents"), "fr").select("doc_id", "source")


@case("f7_complete_only", f"WITH {PAIRS_SQL} SELECT conv_id, count(*)::INT AS n, min(r) AS first FROM pairs WHERE length(r) % 2 = 0 GROUP BY conv_id")
def f7(spark, d):
    p = pairs(spark, d).select("conv_id", F.struct(F.col("r").alias("text"), (F.length("r") % 2 == 0).alias("finished")).alias("a"))
    out = f.complete_only(p.groupBy("conv_id").agg(F.collect_list("a").alias("answers")))
    return out.select("conv_id", F.size("answers").alias("n"), F.array_min("answers.text").alias("first"))


@case("f8_distinct_pair", f"WITH {PAIRS_SQL} SELECT conv_id, turn FROM pairs WHERE substr(q, 1, 1) IS DISTINCT FROM substr(r, 1, 1)")
def f8(spark, d):
    p = pairs(spark, d).select("conv_id", "turn", F.substring("q", 1, 1).alias("c"), F.substring("r", 1, 1).alias("x"))
    return f.distinct_pair(p).select("conv_id", "turn")


@case("f9_class_token_rule", "SELECT doc_id, doc_id % 5 AS label FROM documents WHERE CASE WHEN doc_id % 5 = 4 THEN contains(text, '$') ELSE NOT contains(text, '$') END")
def f9(spark, d):
    return f.class_token_rule(read(spark, d, "documents").withColumn("label", F.col("doc_id") % 5)).select("doc_id", "label")


NOVEL_SQL = """o AS (SELECT doc_id, text, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
np AS (SELECT a.doc_id AS id, a.text AS a, b.doc_id AS seed_id, b.text AS b FROM o a JOIN o b ON a.lang = b.lang AND b.rn - a.rn BETWEEN 1 AND 3),
ta AS (SELECT id, seed_id, token, count(*) AS ca FROM (SELECT id, seed_id, unnest(regexp_extract_all(lower(a), '[0-9A-Za-z_]{2,}')) AS token FROM np) GROUP BY ALL),
tb AS (SELECT id, seed_id, token, count(*) AS cb FROM (SELECT id, seed_id, unnest(regexp_extract_all(lower(b), '[0-9A-Za-z_]{2,}')) AS token FROM np) GROUP BY ALL),
tj AS (SELECT coalesce(ta.id, tb.id) AS id, coalesce(ta.seed_id, tb.seed_id) AS seed_id, CASE WHEN ca IS NULL OR cb IS NULL THEN 1 + ln(1.5) ELSE 1.0 END AS w, coalesce(ca, 0) AS ca, coalesce(cb, 0) AS cb
  FROM ta FULL JOIN tb ON ta.id = tb.id AND ta.seed_id = tb.seed_id AND ta.token = tb.token),
ns AS (SELECT id, seed_id, coalesce(sum(ca * w * cb * w) / nullif(sqrt(sum(ca * w * ca * w) * sum(cb * w * cb * w)), 0), 0) AS s FROM tj GROUP BY ALL),
nf AS (SELECT id, max(s) AS similarity FROM ns GROUP BY id HAVING max(s) <= 0.52)"""


def novelty_pairs(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    o = sel.class_ranks(docs, [F.col("doc_id")], "lang", "rn")  # a language is sorted by many tasks
    a = o.select(F.col("doc_id").alias("id"), "text", "lang", "rn", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k")).withColumn("at", F.col("rn") + F.col("k"))
    b = o.select(F.col("doc_id").alias("seed_id"), F.col("text").alias("seed_text"), "lang", F.col("rn").alias("at"))
    return a.join(b, ["lang", "at"]).select("id", "text", "seed_id", "seed_text")


@case("f10_novelty_filter", f"WITH {NOVEL_SQL} SELECT id, round(similarity, 6) AS similarity FROM nf JOIN documents ON doc_id = id WHERE length(text) > 1")
def f10(spark, d):
    return f.novelty_filter(novelty_pairs(spark, d)).select("id", r6("similarity").alias("similarity"))


IFD_SQL = f"""ifd AS (SELECT doc_id AS id, {u_sql('doc_id', '3')} AS conditional, {u_sql('doc_id', '4')} AS direct, n_chars AS size FROM documents),
ifk AS (SELECT *, conditional / direct AS ratio FROM ifd WHERE conditional / direct <= 1 AND size <= 4000)"""


def ifd(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), u("doc_id", 3).alias("conditional"), u("doc_id", 4).alias("direct"), F.col("n_chars").alias("size"))
    return f.ifd_filter(docs, 4000)


@case("f11_ifd_filter", f"WITH {IFD_SQL} SELECT count(*) AS n, round(avg(ratio), 6) AS ratio FROM ifk")
def f11(spark, d):
    return ifd(spark, d).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ratio")).alias("ratio"))


@case("t12_top_ifd", f"WITH {IFD_SQL} SELECT id, round(ratio, 6) AS ratio FROM ifk QUALIFY row_number() OVER (ORDER BY ratio DESC, id) <= floor((SELECT count(*) FROM ifk) * 0.3)")
def t12(spark, d):
    return sel.top_ifd(ifd(spark, d), 0.3).select("id", r6("ratio").alias("ratio"))


@case("f12_reward_floor", f"WITH {CAND_SQL} SELECT question, pos FROM answers WHERE reward * 1.5 >= (SELECT min(reward) FROM answers WHERE pos % 50 = 0)")
def f12(spark, d):
    c = candidates(spark, d)
    return f.reward_floor(c, c.filter("pos % 50 = 0"), 1.5).select("question", "pos")


INF_SQL = f"inf AS (SELECT doc_id AS idx, {u_sql('doc_id', '5')} - 0.5 AS influence, {u_sql('doc_id', '6')} * 0.5 AS variability FROM documents)"


def influence(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("idx"), (u("doc_id", 5) - 0.5).alias("influence"), (u("doc_id", 6) * 0.5).alias("variability"))


@case("f14_loss_sign", f"""WITH {INF_SQL} SELECT 'helpful' AS kind, * FROM (SELECT idx, round(influence, 6) AS influence FROM inf WHERE influence < 0 ORDER BY inf.influence, idx LIMIT 25)
UNION ALL SELECT 'harmful', * FROM (SELECT idx, round(influence, 6) FROM inf WHERE influence > 0 ORDER BY inf.influence DESC, idx LIMIT 25)""")
def f14(spark, d):
    i = influence(spark, d)
    a = f.loss_sign(i, 25, True).withColumn("kind", F.lit("helpful")).unionByName(f.loss_sign(i, 25, False).withColumn("kind", F.lit("harmful")))
    return a.select("kind", "idx", r6("influence").alias("influence"))
