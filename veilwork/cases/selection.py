"""Windows, top-k, set operations and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..operators import joins as j
from ..operators import sampling as m
from ..operators import selection as s
from ..operators import sets
from ._case import CAND_SQL, EMB_SQL, SCORES_SQL, SEED, candidates, case, r6, read, scores, split_embeddings, u, u_sql
from .aggregates import CV_SQL, HIST_SQL, hist, sourced
from .joins import INF_SQL, influence, knn_sql

U = lambda k, n="0": u_sql(k, n)


@case("w1_rank_in_prompt", f"""WITH {CAND_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY reward DESC, pos) AS k FROM answers)
SELECT question AS prompt, max(response) FILTER (k = 1) AS chosen, max(response) FILTER (k = 4) AS rejected FROM r GROUP BY question""")
def w1(spark, d):
    c = candidates(spark, d).select(F.col("question").alias("prompt"), "pos", F.col("reward").alias("score"), F.col("response").alias("text"))
    return s.rank_in_prompt(c, 3)


BW_SQL = f"""{CAND_SQL}, mx AS (SELECT *, 0.5 * row_number() OVER (PARTITION BY question ORDER BY reward, pos) + 0.5 * row_number() OVER (PARTITION BY question ORDER BY ppl DESC, pos) AS mix FROM answers),
bw AS (SELECT question, first(response ORDER BY mix DESC, pos) AS best, first(response ORDER BY mix, pos) AS worst, max(mix)::DOUBLE AS best_mix, min(mix)::DOUBLE AS worst_mix FROM mx GROUP BY question)"""


@case("w2_best_worst", f"WITH {BW_SQL} SELECT * FROM bw")
def w2(spark, d):
    return s.best_worst(candidates(spark, d), 0.5)


CUT_SQL = """n AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang), p AS (SELECT label, n, c AS client_id, (c + 1) / 10.0 AS p FROM n, (SELECT unnest(range(4))::BIGINT AS c)),
r AS (SELECT label, client_id, CASE WHEN client_id = 3 THEN n ELSE floor(sum(p) OVER (PARTITION BY label ORDER BY client_id) / sum(p) OVER (PARTITION BY label) * n + 1e-9) END::BIGINT AS last FROM p),
cuts AS (SELECT label, client_id, coalesce(lag(last) OVER (PARTITION BY label ORDER BY client_id), 0) AS first, last FROM r)"""


@case("w3_cut_points", f"WITH {CUT_SQL} SELECT * FROM cuts")
def w3(spark, d):
    n = read(spark, d, "documents").groupBy(F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    shares = n.select("label", F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])).alias("client_id"))
    return s.cut_points(n, shares.withColumn("p", (F.col("client_id") + 1) / 10))


@case("w4_source_offsets", 'SELECT source, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM documents GROUP BY source')
def w4(spark, d):
    return s.source_offsets(read(spark, d, "documents"), "source")


@case("w5_length_chunks", "SELECT doc_id, ((row_number() OVER (ORDER BY length(text), doc_id) - 1) // ((SELECT count(*) FROM documents) // 7))::INT AS chunk FROM documents")
def w5(spark, d):
    return s.length_chunks(read(spark, d, "documents").select("doc_id", "text"), 7).select("doc_id", "chunk")


@case("w6_last_rounds", "SELECT vec_id, vec_id % 30 AS round FROM embeddings WHERE vec_id % 30 >= 25")
def w6(spark, d):
    return s.last_rounds(read(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 30).alias("round")), 5).select("vec_id", "round")


LOG_SQL = "lg AS (SELECT user_id % 6 AS run, event_id // 6 AS step, round(max(value), 3) AS value FROM events GROUP BY ALL)"


def log(spark, d):
    e = read(spark, d, "events")
    return e.groupBy((F.col("user_id") % 6).alias("run"), F.floor(F.col("event_id") / 6).alias("step")).agg(F.round(F.max("value"), 3).alias("value"))


@case("w7_best_so_far", f"""WITH {LOG_SQL}, b AS (SELECT *, row_number() OVER w AS rn, max(value) OVER w AS best, coalesce(value > max(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS gain FROM lg WINDOW w AS (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, rn - max(CASE WHEN gain THEN rn END) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS since FROM b)
SELECT run, step, value, best, since, bool_or(since >= 5) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS stop FROM c""")
def w7(spark, d):
    return s.best_so_far(log(spark, d), 5).select("run", "step", "value", "best", "since", "stop")


@case("a37_best_of_run", f"WITH {LOG_SQL} SELECT run, first(value ORDER BY step) AS first, max(value) AS best, first(step ORDER BY value DESC, step) AS best_step FROM lg GROUP BY run")
def a37(spark, d):
    return a.best_of_run(log(spark, d))


@case("a37_mean_over_seeds", "SELECT user_id % 6 AS run, event_type, round(avg(value), 6) AS value, round(avg(event_id), 6) AS step FROM (SELECT user_id, event_type, value, event_id::DOUBLE AS event_id FROM events) GROUP BY ALL")
def a37_seeds(spark, d):
    e = read(spark, d, "events").select((F.col("user_id") % 6).alias("run"), "event_type", "value", F.col("event_id").cast("double").alias("step"))
    return a.mean_over_seeds(e, ["run", "event_type"], ["value", "step"]).withColumns({"value": r6("value"), "step": r6("step")})


@case("w8_interleave", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents),
k AS (SELECT min(c) AS k FROM (SELECT count(*) AS c FROM documents GROUP BY lang)) SELECT doc_id, lang, turn FROM r, k WHERE turn <= k""")
def w8(spark, d):
    return s.interleave(read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", "turn")


@case("t1_top_votes", f"""WITH {HIST_SQL}, h AS (SELECT cand_id, cand_id % 3 AS source_model, votes FROM hist)
SELECT 'most' AS side, * FROM (SELECT cand_id, source_model, votes FROM h ORDER BY votes DESC, cand_id LIMIT 10) UNION ALL
SELECT 'class', * FROM (SELECT cand_id, source_model, votes FROM h QUALIFY row_number() OVER (PARTITION BY source_model ORDER BY votes DESC, cand_id) <= 4) UNION ALL
SELECT 'least', * FROM (SELECT cand_id, source_model, votes FROM h QUALIFY row_number() OVER (PARTITION BY source_model ORDER BY votes, cand_id) <= 4)""")
def t1(spark, d):
    from ..sources.tables import materialise

    h = materialise(sourced(hist(spark, d)).select("cand_id", "source_model", "votes"))
    parts = {"most": s.top(h, 10, None, "votes", "cand_id"), "class": s.top(h, 4, "source_model", "votes", "cand_id"),
             "least": s.top(h, 4, "source_model", "votes", "cand_id", True)}
    out = None
    for side, df in parts.items():
        one = df.select(F.lit(side).alias("side"), "cand_id", "source_model", "votes")
        out = one if out is None else out.unionByName(one)
    return out


@case("t2_top_share", f"WITH {CAND_SQL} SELECT pos, round(reward, 6) AS reward FROM answers QUALIFY row_number() OVER (ORDER BY answers.reward DESC, pos) <= (SELECT count(*) FROM answers) // 8")
def t2(spark, d):
    return s.top_share(candidates(spark, d), 8).select("pos", r6("reward").alias("reward"))


W_SQL = f"""w0 AS (SELECT vec_id AS idx, vec_id % 3 AS source_model, ({U('vec_id', '8')}) * (1 + vec_id % 3) AS weight FROM embeddings)"""
_RULES = {
    "n": "SELECT idx FROM w0 ORDER BY weight DESC, idx LIMIT 40",
    "half": "SELECT idx FROM w0 WHERE weight >= 0.5 * (SELECT max(weight) FROM w0)",
    "gap": """SELECT idx FROM (SELECT idx, coalesce(least(floor((weight - l) / ((h - l) / 40)), 39), 0) AS b FROM w0, (SELECT min(weight) AS l, max(weight) AS h FROM w0))
WHERE b > (SELECT coalesce(max(k), -1) FROM (SELECT unnest(range(40)) AS k) WHERE k NOT IN (SELECT b FROM (SELECT coalesce(least(floor((weight - l) / ((h - l) / 40)), 39), 0) AS b FROM w0, (SELECT min(weight) AS l, max(weight) AS h FROM w0)) GROUP BY b HAVING count(*) >= 5))""",
    "all": "SELECT idx FROM w0",
}


@case("t3_top_weight", f"WITH {W_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, idx FROM ({q})" for k, q in _RULES.items()))
def t3(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), (F.col("vec_id") % 3).alias("source_model"), u("vec_id", 8).alias("theta"))
    imp = spark.createDataFrame([(i, float(1 + i)) for i in range(3)], "source_model long, importance double")
    out = None
    for rule in _RULES:
        one = s.top_weight(e, imp, rule, 40).select(F.lit(rule).alias("rule"), "idx")
        out = one if out is None else out.unionByName(one)
    return out


CVI = f"{SCORES_SQL}, {CV_SQL}"


@case("t4_easy_and_ambiguous", f"""WITH {CVI}, r AS (SELECT *, row_number() OVER (PARTITION BY source_model ORDER BY variability, idx) AS lo, row_number() OVER (PARTITION BY source_model ORDER BY variability DESC, idx DESC) AS hi FROM cv)
SELECT source_model, idx, CASE WHEN lo <= 20 THEN 'easy' ELSE 'ambiguous' END AS kind FROM r WHERE lo <= 20 OR hi <= 15""")
def t4(spark, d):
    return s.easy_and_ambiguous(a.confidence_variability(scores(spark, d)), 20, 15, "source_model").select("source_model", "idx", "kind")


@case("t5_easy_and_ambiguous_v2", f"""WITH {CVI}, t AS (SELECT *, CASE WHEN variability >= 0.79 * 0.3 THEN 0 WHEN variability >= 0.5 * 0.3 THEN 1 ELSE 2 END AS tier FROM cv),
r AS (SELECT *, row_number() OVER (ORDER BY tier, CASE tier WHEN 0 THEN -variability WHEN 1 THEN abs(variability - 0.3) ELSE variability END, idx) AS k FROM t),
am AS (SELECT idx FROM r WHERE tier < 2 AND k <= 60)
SELECT idx, 'ambiguous' AS kind FROM am UNION ALL SELECT idx, 'easy' FROM (SELECT idx FROM r WHERE idx NOT IN (SELECT idx FROM am) ORDER BY variability, idx LIMIT (SELECT 150 - count(*) FROM am))""")
def t5(spark, d):
    return s.easy_and_ambiguous_v2(a.confidence_variability(scores(spark, d)), 60, 150, 0.3).select("idx", "kind")


@case("t6_largest_gain", f"WITH {INF_SQL} SELECT idx, round(influence, 6) AS influence FROM inf ORDER BY inf.influence DESC, idx LIMIT 33")
def t6(spark, d):
    return s.top(influence(spark, d), 33, None, "influence", "idx").select("idx", r6("influence").alias("influence"))


@case("t7_influence_and_variability", f"""WITH {INF_SQL}, h AS (SELECT idx FROM inf WHERE variability >= 0.96 * (SELECT max(variability) FROM inf) ORDER BY influence DESC, idx LIMIT 12),
l AS (SELECT idx FROM inf WHERE variability <= least(100 * (SELECT min(variability) FROM inf), 0.02) AND idx NOT IN (SELECT idx FROM h) ORDER BY influence DESC, idx LIMIT 12)
SELECT idx, 'variable' AS kind FROM h UNION ALL SELECT idx, 'steady' FROM l""")
def t7(spark, d):
    return s.influence_and_variability(influence(spark, d), 12).select("idx", "kind")


@case("t9_keep_kth", f"WITH {HIST_SQL} SELECT cand_id, CASE WHEN votes >= (SELECT min(votes) FROM (SELECT votes FROM hist ORDER BY votes DESC LIMIT 20)) THEN votes ELSE 0 END AS votes FROM hist")
def t9(spark, d):
    return s.keep_kth(hist(spark, d).select("cand_id", "votes"), 20)


def logits(spark, d):
    e = read(spark, d, "embeddings")
    cast = lambda x: F.transform(x, lambda y: y.cast("double"))
    return e.select(F.floor(F.col("vec_id") / 2).alias("example"), (F.col("vec_id") % 2).alias("window"),
                    cast(F.slice("embedding", 1, 32)).alias("start"), cast(F.slice("embedding", 33, 32)).alias("end"))


@case("t10_best_spans", """WITH l AS (SELECT vec_id // 2 AS example, vec_id % 2 AS win, embedding[1:32]::DOUBLE[] AS s, embedding[33:64]::DOUBLE[] AS e FROM embeddings),
s0 AS (SELECT example, win, unnest(s) AS z, unnest(range(32))::INT AS p FROM l), e0 AS (SELECT example, win, unnest(e) AS z, unnest(range(32))::INT AS p FROM l),
s AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY example, win ORDER BY z DESC, p) <= 20),
e AS (SELECT * FROM e0 QUALIFY row_number() OVER (PARTITION BY example, win ORDER BY z DESC, p) <= 20),
c AS (SELECT s.example, s.win, s.p AS first, e.p AS last, s.z + e.z AS score FROM s JOIN e ON s.example = e.example AND s.win = e.win AND e.p >= s.p AND e.p - s.p + 1 <= 30 AND s.p > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY example ORDER BY score DESC, win, first, last) AS k FROM c QUALIFY k <= 20),
n AS (SELECT example, min(s[1] + e[1]) AS null_score FROM l GROUP BY example), q AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY example) AS prob FROM r)
SELECT q.example, win AS "window", first, last, round(score, 6) AS score, round(prob, 6) AS prob, score > null_score AS answered FROM q JOIN n USING (example) WHERE k = 1""")
def t10(spark, d):
    out = s.best_spans(logits(spark, d))
    return out.select("example", "window", "first", "last", r6("score").alias("score"), r6("prob").alias("prob"), "answered")


@case("t11_low_error_fill", f"""WITH {SCORES_SQL}, f AS (SELECT source_model, idx, abs(1 - prob[label + 1]) AS error, CASE WHEN source_model <> 1 AND pred <> label THEN 0 WHEN source_model = 1 THEN 1 END AS pr FROM scores WHERE model_id = 2)
SELECT source_model, idx FROM f WHERE pr IS NOT NULL ORDER BY pr, error, idx, source_model LIMIT 300""")
def t11(spark, d):
    from .joins import state

    return s.low_error_fill(state(spark, d, 2), 300, 1).select("source_model", "idx")


@case("t13_top_voted_report", f"""WITH {EMB_SQL}, {knn_sql(3, 'p.label = c.label')}, {knn_sql(3, 'p.label <> c.label').replace('nn0', 'mm0').replace('nn AS', 'mm AS')},
iv0 AS (SELECT label, cand_id, sum(pow(2.0, 1 - rank)) AS votes FROM nn GROUP BY ALL), ov0 AS (SELECT label, cand_id, sum(pow(2.0, 1 - rank)) AS votes FROM mm GROUP BY ALL),
iv AS (SELECT * FROM iv0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY votes DESC, cand_id) <= 2),
ov AS (SELECT * FROM ov0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY votes DESC, cand_id) <= 2)
SELECT 'inside' AS side, label, cand_id, votes FROM iv UNION ALL SELECT 'outside', label, cand_id, votes FROM ov""")
def t13(spark, d):
    p, c = split_embeddings(spark, d)
    out = None
    for side, rule in (("inside", "same"), ("outside", "other")):
        nn = j.knn(p, c, 3, rule).join(p.select("id", "label"), "id")
        votes = nn.groupBy("label", "cand_id").agg(F.sum(F.pow(F.lit(2.0), 1 - F.col("rank"))).alias("votes"))
        one = s.top(votes, 2, "label", "votes", "cand_id").withColumn("side", F.lit(side))
        out = one if out is None else out.unionByName(one)
    return out.select("side", "label", "cand_id", "votes")


@case("u1_union_sources", " UNION ALL ".join(f"SELECT * FROM (SELECT doc_id AS idx, '{x}' AS source FROM documents WHERE lang = '{x}' ORDER BY {U('doc_id')}, doc_id LIMIT 30)" for x in ("en", "fr", "de", "es")))
def u1(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), "lang")
    return sets.union_sources({x: docs.filter(F.col("lang") == x) for x in ("en", "fr", "de", "es")}, 120, SEED).select("idx", "source")


@case("u2_exact_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def u2(spark, d):
    return sets.exact_dedup(read(spark, d, "documents").select("doc_id", "text"), ["text"], "doc_id").select("doc_id")


@case("u3_grow_pool", "SELECT doc_id, lang, NULL::VARCHAR AS source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL, source FROM documents WHERE doc_id % 2 = 1")
def u3(spark, d):
    docs = read(spark, d, "documents")
    return sets.grow_pool(docs.filter("doc_id % 2 = 1").select("doc_id", "source"), docs.filter("doc_id % 2 = 0").select("doc_id", "lang"))


@case("u4_fill_to", "WITH r AS (SELECT doc_id AS idx, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS c FROM documents), t AS (SELECT unnest(range(4)) AS t) SELECT idx, t::INT AS turn FROM r, t WHERE t * c + i < (7 * c) // 2")
def u4(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("idx"))
    return sets.fill_to(docs, 7 * docs.count() // 2).select("idx", "turn")


@case("u5_merge_operator_outputs", """WITH o AS (SELECT doc_id, ['elite', 'rewrite_a', 'rewrite_b', 'cross', 'fresh'][doc_id % 5 + 1] AS origin FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY doc_id) AS turn FROM o), k AS (SELECT min(c) AS k FROM (SELECT count(*) AS c FROM o GROUP BY origin))
SELECT doc_id, origin, turn FROM r, k WHERE turn <= k""")
def u5(spark, d):
    docs = read(spark, d, "documents").select("doc_id")
    names = ["elite", "rewrite_a", "rewrite_b", "cross", "fresh"]
    return sets.merge_operator_outputs({n: docs.filter(F.col("doc_id") % 5 == i) for i, n in enumerate(names)}, "doc_id").select("doc_id", "origin", "turn")


def docs_as(spark, d, *more):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), *more)


@case("m1_iid_clients", f"SELECT doc_id AS id, (row_number() OVER (ORDER BY {U('doc_id')}, doc_id) - 1) % 7 AS client_id FROM documents")
def m1(spark, d):
    return m.iid_clients(docs_as(spark, d), 7, SEED).select("id", "client_id")


@case("m2_dirichlet_clients")
def m2(spark, d):
    return m.dirichlet_clients(docs_as(spark, d), 5, 0.5, 3).select("id", "label", "client_id")


@case("m3_dirichlet_clients_pinned")
def m3(spark, d):
    docs = docs_as(spark, d)
    return m.dirichlet_clients_pinned(docs, 5, 0.5, 3, -(-docs.count() // 4)).select("id", "label", "client_id")


@case("m4_fixed_size_clients")
def m4(spark, d):
    docs = docs_as(spark, d)
    return m.fixed_size_clients(docs, docs.count() // 9, 0.5, 3).select("id", "label", "client_id")


@case("m2_assign_by_shares", f"""WITH {CUT_SQL}, rr AS (SELECT doc_id AS id, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY {U('doc_id')}, doc_id) - 1 AS r FROM documents)
SELECT id, rr.label, client_id FROM rr JOIN cuts ON rr.label = cuts.label AND rr.r >= first AND rr.r < last""")
def m2b(spark, d):
    docs = docs_as(spark, d)
    shares = {x: [0.1, 0.2, 0.3, 0.4] for x in ("en", "fr", "de", "es")}
    return m.assign_by_shares(docs, shares, SEED).select("id", "label", "client_id")


@case("m5_class_skew_clients", f"""WITH c AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS c, count(*) AS n FROM documents GROUP BY lang), k AS (SELECT count(*) AS k FROM c),
r AS (SELECT doc_id AS id, lang, row_number() OVER (PARTITION BY lang ORDER BY {U('doc_id')}, doc_id) - 1 AS r FROM documents)
SELECT id, (((c * (12 // k) + least(floor(r * (12 // k) / n), 12 // k - 1)::BIGINT) // 2) % 6)::BIGINT AS client_id FROM r JOIN c USING (lang), k""")
def m5(spark, d):
    return m.class_skew_clients(docs_as(spark, d), 6, 2, SEED).select("id", "client_id")


@case("m6_category_shards", """WITH c AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS c FROM documents GROUP BY lang),
s AS (SELECT *, 10 // c + (i < 10 % c)::INT AS s FROM c), f AS (SELECT *, coalesce(sum(s) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM s),
r AS (SELECT doc_id AS id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r FROM documents)
SELECT id, (f + r // greatest(n // s, 1))::BIGINT AS client_id FROM r JOIN f USING (lang) WHERE r // greatest(n // s, 1) < s""")
def m6(spark, d):
    return m.category_shards(docs_as(spark, d), 10).select("id", "client_id")


@case("m7_label_parties", "SELECT doc_id AS id, lang AS client_id FROM documents")
def m7(spark, d):
    return m.label_parties(docs_as(spark, d)).select("id", "client_id")


@case("m8_weighted_resample", f"""WITH c AS (SELECT doc_id AS id, sum(n_chars) OVER (ORDER BY doc_id) AS hi, n_chars AS w FROM documents WHERE n_chars > 0),
d AS (SELECT draw, {U('draw', "'draw'")} * (SELECT sum(n_chars) FROM documents)::DOUBLE AS x FROM range(500) AS r(draw))
SELECT draw, id FROM d JOIN c ON x >= hi - w AND x < hi""")
def m8(spark, d):
    docs = docs_as(spark, d, F.col("n_chars").alias("w"))
    return m.weighted_resample(docs, 500, SEED)


EXP = f"-ln({U('doc_id')}) / n_chars"


@case("m9_weighted_sample", f"SELECT doc_id AS id FROM documents WHERE n_chars > 0 ORDER BY {EXP}, doc_id LIMIT 120")
def m9(spark, d):
    return m.weighted_sample(docs_as(spark, d, F.col("n_chars").alias("w")), 120, SEED).select("id")


@case("m10_entropy_sample", f"""WITH {SCORES_SQL}, e AS (SELECT idx, -list_sum(list_transform(prob, lambda x: x * ln(x))) AS e FROM scores WHERE model_id = 0)
SELECT 'useful' AS kind, * FROM (SELECT idx FROM e ORDER BY e - ln(-ln({U('idx')})) DESC, idx LIMIT 40) UNION ALL SELECT 'sure', * FROM (SELECT idx FROM e ORDER BY -e - ln(-ln({U('idx')})) DESC, idx LIMIT 40)""")
def m10(spark, d):
    p = scores(spark, d).filter("model_id = 0")
    pick = lambda sign, kind: m.entropy_sample(p, 40, sign, SEED, key="idx").select(F.lit(kind).alias("kind"), "idx")
    return pick(1, "useful").unionByName(pick(-1, "sure"))


@case("m11_random_rows", f"SELECT 'head' AS kind, * FROM (SELECT doc_id AS id FROM documents ORDER BY {U('doc_id')}, doc_id LIMIT 77) UNION ALL SELECT 'bernoulli', doc_id FROM documents WHERE {U('doc_id')} < 0.2")
def m11(spark, d):
    docs = docs_as(spark, d).select("id")
    return m.random_rows(docs, 77, SEED).withColumn("kind", F.lit("head")).unionByName(m.bernoulli(docs, 0.2, SEED).withColumn("kind", F.lit("bernoulli")))


SHOT_SQL = f"""t AS (SELECT doc_id AS prompt_id, unnest(range(28)) AS try FROM documents WHERE doc_id % 5 = 0),
a AS (SELECT prompt_id, floor({U('prompt_id', 'try')} * (SELECT count(*) FROM documents))::BIGINT AS position, min(try) AS try FROM t GROUP BY ALL),
shots AS (SELECT prompt_id, row_number() OVER (PARTITION BY prompt_id ORDER BY try) AS draw, position FROM a QUALIFY draw <= 3)"""


def shots(spark, d):
    docs = read(spark, d, "documents")
    return m.few_shot_ids(docs.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("prompt_id")), docs.count(), 3, SEED)


@case("m12_few_shot_ids", f"WITH {SHOT_SQL} SELECT * FROM shots")
def m12(spark, d):
    return shots(spark, d)


@case("p12_few_shot_prompt", f"""WITH {SHOT_SQL}, p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, text FROM documents)
SELECT prompt_id, 'Write one more.' || chr(10) || string_agg('Example: ' || replace(replace(text, chr(10), ' '), chr(9), ' '), chr(10) ORDER BY draw) AS prompt FROM shots JOIN p USING (position) GROUP BY prompt_id""")
def p12(spark, d):
    from ..functions import text as t

    docs = read(spark, d, "documents").select("doc_id", "text")
    pool = s.reindex(docs, ["doc_id"], "position")
    return t.few_shot_prompt(shots(spark, d).join(pool, "position"), "Write one more.")


@case("m13_clients_of_round", " UNION ALL ".join(f"SELECT {r} AS round, * FROM (SELECT client_id FROM (SELECT DISTINCT user_id % 40 AS client_id FROM events) ORDER BY {U(chr(39) + str(r) + ':' + chr(39) + ' || client_id')}, client_id LIMIT 8)" for r in (0, 1, 2)))
def m13(spark, d):
    c = read(spark, d, "events").select((F.col("user_id") % 40).alias("client_id")).distinct()
    out = None
    for r in (0, 1, 2):
        one = m.clients_of_round(c, 8, r, SEED).select(F.lit(r).alias("round"), "client_id")
        out = one if out is None else out.unionByName(one)
    return out


@case("m14_stratified_sample", f"""WITH q AS (SELECT lang, round(150 * count(*) / (SELECT count(*) FROM documents)) AS q FROM documents GROUP BY lang)
SELECT doc_id AS id FROM documents JOIN q USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {U('doc_id')}, doc_id) <= any_value(q) OVER (PARTITION BY lang)""")
def m14(spark, d):
    return m.stratified_sample(docs_as(spark, d), 150, SEED).select("id")


@case("m15_skewed_sample")
def m15(spark, d):
    return m.skewed_sample(docs_as(spark, d), 150, 5).select("id", "label")


@case("m16_split", f"SELECT doc_id AS id, row_number() OVER (ORDER BY {U('doc_id')}, doc_id) <= floor((SELECT count(*) FROM documents) * 0.8) AS is_train FROM documents")
def m16(spark, d):
    return m.split(docs_as(spark, d), 0.8, SEED).select("id", "is_train")


PICK_SQL = f"""sc0 AS (SELECT doc_id AS id, lang AS label, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE {U('doc_id', '1')} END AS score FROM documents),
ut AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM sc0 WINDOW w AS (PARTITION BY label)),
g AS (SELECT *, CASE WHEN hi > lo AND score IS NULL THEN 0.0 WHEN hi > lo THEN exp(4 * ((score - lo) / (hi - lo) - 1)) ELSE 1.0 END * 20 / (SELECT count(DISTINCT label) FROM sc0) / 2 - ln(-ln({U('id')})) AS g FROM ut)"""


@case("m17_exponential_pick", f"WITH {PICK_SQL} SELECT label, id FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY g DESC, id) = 1")
def m17(spark, d):
    docs = docs_as(spark, d, F.when(F.col("doc_id") % 9 != 0, u("doc_id", 1)).alias("score"))
    return m.exponential_pick(docs, 20, 4, SEED).select("label", "id")


@case("m18_feedback_draw", f"SELECT lang AS label, doc_id AS id FROM documents WHERE doc_id % 6 > 0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY -ln({U('doc_id')}) / (doc_id % 6), doc_id) = 1")
def m18(spark, d):
    return m.feedback_draw(docs_as(spark, d, (F.col("doc_id") % 6).alias("picks")), SEED).select("label", "id")


BETA = m.keep_probability(5.0, 2, 5)


@case("m19_randomised_response", f"SELECT event_id, CASE WHEN {U('event_id')} < {BETA!r} THEN (user_id % 5)::INT ELSE floor({U('event_id', '1')} * 5)::INT END AS answer FROM events")
def m19(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", m.randomised_response(F.col("user_id") % 5, F.col("event_id"), BETA, 5, SEED).alias("answer"))


@case("m20_gaussian_noise", f"SELECT event_id, round(value + 2 * sqrt(-2 * ln({U('event_id')})) * cos(2 * pi() * {U('event_id', '1')}), 6) AS value FROM events")
def m20(spark, d):
    return read(spark, d, "events").select("event_id", r6(m.gaussian_noise(F.col("value"), F.col("event_id"), 2.0, SEED)).alias("value"))


@case("m21_empirical_draw", f"""WITH v AS (SELECT source AS v, count(*)::DOUBLE AS w FROM documents GROUP BY source), c AS (SELECT v, (sum(w) OVER (ORDER BY v) - w) / sum(w) OVER () AS a, sum(w) OVER (ORDER BY v) / sum(w) OVER () AS b FROM v)
SELECT doc_id AS id, v AS drawn FROM documents, c WHERE {U('doc_id')} >= a AND {U('doc_id')} < CASE WHEN b >= 1 THEN 2 ELSE b END""")
def m21(spark, d):
    docs = read(spark, d, "documents")
    values = docs.groupBy(F.col("source").alias("value")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return m.empirical_draw(docs_as(spark, d), values, SEED).select("id", "drawn")


@case("m22_rows_of_author", "SELECT source AS author, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS rows FROM documents GROUP BY source")
def m22(spark, d):
    docs = read(spark, d, "documents").select(F.col("source").alias("author"), F.col("doc_id").alias("id"))
    return sets.rows_of_author(docs).withColumn("rows", F.array_join(F.col("rows").cast("array<string>"), ","))


@case("m23_cap_rows_per_client", f"WITH {EMB_SQL} SELECT party, id FROM emb QUALIFY row_number() OVER (PARTITION BY party ORDER BY {U('id')}, id) <= 20")
def m23(spark, d):
    p, c = split_embeddings(spark, d)
    return m.cap_rows_per_client(p.unionByName(c), 20, SEED).select("party", "id")


@case("s10_first_n_per_source", "SELECT source, doc_id AS idx FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def s10(spark, d):
    return sets.first_n_per_source(read(spark, d, "documents").select("source", F.col("doc_id").alias("idx")), 5)


