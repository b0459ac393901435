"""Votes, metrics and other aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import aggregates as a
from ..operators import joins as j
from ..operators import overlap
from ..operators.clusters import cluster_histograms
from ._case import (
    EMB_SQL, SCORES_SQL, SEED, case, pairs, PAIRS_SQL, r6, read, scores, split_embeddings, u, u_sql,
)
from .joins import PROTO_SQL, SIM_SQL, knn_sql


def hist(spark, d):
    p, c = split_embeddings(spark, d)
    return a.vote_histogram(j.nearest(p, c), c)


def party_hist(spark, d, q=3):
    p, c = split_embeddings(spark, d)
    nn = j.knn(p, c, q).join(p.select("id", "party"), "id")
    return a.ranked_votes(nn, c)


def sourced(h):
    return h.withColumn("source_model", F.col("cand_id") % 3)


HIST_SQL = f"""{EMB_SQL}, {knn_sql(1)},
hist AS (SELECT c.id AS cand_id, count(nn.id)::DOUBLE AS votes, avg(dist) AS mean_dist FROM cand c LEFT JOIN nn ON nn.cand_id = c.id GROUP BY c.id)"""
PARTY_SQL = f"""{EMB_SQL}, {knn_sql(3)},
pv AS (SELECT party, cand_id, sum(pow(2.0, 1 - rank)) AS votes FROM nn GROUP BY ALL),
ph AS (SELECT p.party, c.id AS cand_id, coalesce(pv.votes, 0.0) AS votes FROM (SELECT DISTINCT party FROM priv) p CROSS JOIN cand c LEFT JOIN pv ON pv.party = p.party AND pv.cand_id = c.id)"""


@case("a1_vote_histogram", f"WITH {HIST_SQL} SELECT cand_id, votes, round(mean_dist, 6) AS mean_dist FROM hist")
def a1(spark, d):
    return hist(spark, d).select("cand_id", "votes", r6("mean_dist").alias("mean_dist"))


@case("a2_ranked_votes", f"WITH {PARTY_SQL} SELECT * FROM ph")
def a2(spark, d):
    return party_hist(spark, d)


GAUSS = f"sqrt(-2 * ln({u_sql('cand_id', '0')})) * cos(2 * pi() * {u_sql('cand_id', '1')})"


@case("a3_noisy_votes", f"WITH {HIST_SQL} SELECT cand_id, round(greatest(votes + 1.5 * {GAUSS}, 0.0), 6) AS votes FROM hist")
def a3(spark, d):
    return a.noisy_votes(hist(spark, d), 1.5, SEED, clamp=True).select("cand_id", r6("votes").alias("votes"))


@case("a4_threshold_votes", f"WITH {HIST_SQL} SELECT cand_id, greatest(votes - 3.5, 0.0) AS votes FROM hist")
def a4(spark, d):
    return a.threshold_votes(hist(spark, d), 3.5).select("cand_id", "votes")


@case("a5_sum_parties", f"WITH {PARTY_SQL} SELECT cand_id, sum(votes) AS votes FROM ph GROUP BY cand_id")
def a5(spark, d):
    return a.sum_parties(party_hist(spark, d))


@case("a6_to_probability", f"""WITH {HIST_SQL}, h AS (SELECT cand_id, cand_id % 3 AS source_model, greatest(votes - 3, 0) + 1e-15 AS v FROM hist)
SELECT cand_id, round(v / sum(v) OVER (), 6) AS p, round(v / sum(v) OVER (PARTITION BY source_model), 6) AS p_class FROM h""")
def a6(spark, d):
    h = sourced(hist(spark, d)).withColumn("votes", F.col("votes") - 3)
    one = a.to_probability(h, "source_model").withColumnRenamed("p", "p_class")
    return a.to_probability(one).select("cand_id", r6("p").alias("p"), r6("p_class").alias("p_class"))


SCORE_SQL = f"""{PARTY_SQL}, tot AS (SELECT cand_id, cand_id % 3 AS source_model, sum(votes) AS votes FROM ph GROUP BY cand_id),
sc AS (SELECT source_model, sum(votes) / (SELECT sum(votes) FROM tot) * (SELECT count(*) FROM tot) / count(*) AS score FROM tot GROUP BY source_model)"""


def source_scores(spark, d):
    return a.source_score(sourced(a.sum_parties(party_hist(spark, d))))


@case("a7_source_score", f"WITH {SCORE_SQL} SELECT source_model, round(score, 6) AS score FROM sc")
def a7(spark, d):
    return source_scores(spark, d).withColumn("score", r6("score"))


@case("a8_apportion", f"""WITH {SCORE_SQL}, e AS (SELECT *, exp((score - (SELECT max(score) FROM sc)) / 0.5) AS e FROM sc),
x AS (SELECT source_model, round(e / (SELECT sum(e) FROM e) * 1000, 9) AS x FROM e)
SELECT source_model, floor(x)::BIGINT + (row_number() OVER (ORDER BY x - floor(x) DESC, source_model) <= 1000 - (SELECT sum(floor(x)) FROM x))::BIGINT AS quota FROM x""")
def a8(spark, d):
    return a.apportion(source_scores(spark, d), 1000, 0.5).select("source_model", "quota")


@case("a9_apportion_by_importance", """WITH s AS (SELECT source AS source_model, sum(n_chars)::DOUBLE AS importance FROM documents GROUP BY source),
x AS (SELECT *, round(importance / (SELECT sum(importance) FROM s) * 777, 9) AS x FROM s)
SELECT source_model, floor(x)::BIGINT + (row_number() OVER (ORDER BY importance DESC, source_model) <= 777 - (SELECT sum(floor(x)) FROM x))::BIGINT AS quota FROM x""")
def a9(spark, d):
    s = read(spark, d, "documents").groupBy(F.col("source").alias("source_model")).agg(F.sum("n_chars").cast("double").alias("importance"))
    return a.apportion_by_importance(s, 777).select("source_model", "quota")


CLIENT_SQL = f"""{SIM_SQL}, st AS (SELECT party, avg(similarity) AS m, stddev_pop(similarity) AS s FROM sim GROUP BY party),
z AS (SELECT party, cand_id, CASE WHEN s > 0 THEN (similarity - m) / s ELSE 0 END AS z FROM sim JOIN st USING (party)),
zn AS (SELECT party, sqrt(sum(z * z)) AS nz FROM z GROUP BY party),
cs AS (SELECT cand_id, sum(z / greatest(nz, 1.0)) / (SELECT count(*) FROM st) AS score, (SELECT sum(similarity) FROM sim WHERE sim.cand_id = z.cand_id) / (SELECT count(*) FROM st) AS plain FROM z JOIN zn USING (party) GROUP BY cand_id)"""


@case("a9_other_portions", """WITH s AS (SELECT source AS source_model, sum(n_chars)::DOUBLE AS importance, row_number() OVER (ORDER BY source) AS k, count(*) OVER () AS c FROM documents GROUP BY source),
x AS (SELECT *, floor(round(importance / (SELECT sum(importance) FROM s) * 777, 9)) AS f, floor(777 / c) AS e FROM s)
SELECT 'round_robin' AS portion, source_model, f::BIGINT + (k <= 777 - (SELECT sum(f) FROM x))::BIGINT AS quota FROM x
UNION ALL SELECT 'balance', source_model, e::BIGINT + (k <= 777 - (SELECT sum(e) FROM x))::BIGINT FROM x""")
def a9_other(spark, d):
    s = read(spark, d, "documents").groupBy(F.col("source").alias("source_model")).agg(F.sum("n_chars").cast("double").alias("importance"))
    one, two = (a.apportion_by_importance(s, 777, portion=p).select(F.lit(p).alias("portion"), "source_model", "quota") for p in ("round_robin", "balance"))
    return one.unionByName(two)


@case("a10_client_scores", f"WITH {EMB_SQL}, {CLIENT_SQL} SELECT cand_id, round(score, 6) AS score, round(plain, 6) AS plain FROM cs")
def a10(spark, d):
    p, c = split_embeddings(spark, d)
    sim = j.client_similarity(p, c)
    plain = a.client_scores(sim, clip=False).withColumnRenamed("score", "plain")
    return a.client_scores(sim).join(plain, "cand_id").select("cand_id", r6("score").alias("score"), r6("plain").alias("plain"))


@case("a11_prototypes", f"WITH {EMB_SQL}, {PROTO_SQL} SELECT label, pos, round(x, 6) AS x FROM pm")
def a11(spark, d):
    p, _ = split_embeddings(spark, d)
    return a.prototypes(p).select("label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", r6("x"))


@case("a12_moments", f"""WITH {EMB_SQL}, x AS (SELECT id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INT AS i FROM priv),
c AS (SELECT p.i, q.i AS j, covar_samp(p.x, q.x) AS cov FROM x p JOIN x q ON p.id = q.id GROUP BY ALL)
SELECT c.i, c.j, round(m.mean, 6) AS mean, round(cov, 6) AS cov FROM c JOIN (SELECT i, avg(x) AS mean FROM x GROUP BY i) m ON m.i = c.i""")
def a12(spark, d):
    p, _ = split_embeddings(spark, d)
    _, mean, cov = a.moments(p)
    rows = [(i, k, float(mean[i]), float(cov[i, k])) for i in range(len(mean)) for k in range(len(mean))]
    out = spark.createDataFrame(rows, "i int, j int, mean double, cov double")
    return out.select("i", "j", r6("mean").alias("mean"), r6("cov").alias("cov"))


@case("a13_frechet")
def a13(spark, d):
    p, c = split_embeddings(spark, d)
    return spark.createDataFrame([(a.frechet(p, c),)], "frechet double")


@case("a14_mean_distance", f"""WITH {EMB_SQL}, {PROTO_SQL}, ec AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INT AS pos FROM cand),
mc AS (SELECT label, pos, avg(x) AS x FROM ec GROUP BY ALL)
SELECT label, round(sum((pm.x - mc.x) * (pm.x - mc.x)), 6) AS distance FROM pm JOIN mc USING (label, pos) GROUP BY label""")
def a14(spark, d):
    p, c = split_embeddings(spark, d)
    return a.mean_distance(p, c).withColumn("distance", r6("distance"))


@case("a15_cluster_histograms")
def a15(spark, d):
    p, c = split_embeddings(spark, d)
    return cluster_histograms(p, c)


PQ_SQL = """pq AS (SELECT source, count(*) FILTER (lang = 'en')::DOUBLE AS a, count(*) FILTER (lang <> 'en')::DOUBLE AS b FROM documents GROUP BY source),
h AS (SELECT source, (a + 1) / (SELECT sum(a + 1) FROM pq) AS p, (b + 1) / (SELECT sum(b + 1) FROM pq) AS q FROM pq)"""


def pq(spark, d):
    en = (F.col("lang") == "en").cast("int")
    n = read(spark, d, "documents").groupBy("source").agg((F.sum(en) + 1.0).alias("a"), (F.sum(1 - en) + 1.0).alias("b"))
    total = F.broadcast(n.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")))
    return n.crossJoin(total).select("source", (F.col("a") / F.col("ta")).alias("p"), (F.col("b") / F.col("tb")).alias("q"))


@case("a16_mauve", f"""WITH {PQ_SQL}, w AS (SELECT unnest(range(1, 26)) / 26.0::DOUBLE AS w),
m AS (SELECT w, sum(q * ln(q / (w * p + (1 - w) * q))) AS kq, sum(p * ln(p / (w * p + (1 - w) * q))) AS kp FROM h, w GROUP BY w),
line AS (SELECT exp(-5 * kq) AS x, exp(-5 * kp) AS y FROM m UNION ALL SELECT 1.0, 0.0 UNION ALL SELECT 0.0, 1.0),
s AS (SELECT (x - lag(x) OVER o) * (y + lag(y) OVER o) / 2 AS s1, (y - lag(y) OVER r) * (x + lag(x) OVER r) / 2 AS s2 FROM line WINDOW o AS (ORDER BY x, y DESC), r AS (ORDER BY y, x DESC))
SELECT round((sum(s1) + sum(s2)) / 2, 6) AS mauve FROM s""")
def a16(spark, d):
    return a.mauve(pq(spark, d)).withColumn("mauve", r6("mauve"))


@case("a17_histogram_distances", f"""WITH {PQ_SQL}, i AS (SELECT p, q, row_number() OVER (ORDER BY p) AS ip, row_number() OVER (ORDER BY q) AS iq FROM h)
SELECT round(sum(p * ln(p / q)), 6) AS kl, round(sum(abs(p - q)) / 2, 6) AS total_variation,
round(sum(CASE WHEN p = q THEN 0 ELSE (p + q) / 2 - p * q * (ln(p) - ln(q)) / (p - q) END), 6) AS frontier_integral,
round((SELECT avg(abs(x.p - y.q)) FROM i x JOIN i y ON x.ip = y.iq), 6) AS wasserstein FROM h""")
def a17(spark, d):
    out = a.histogram_distances(pq(spark, d))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@case("a18_js_divergence", f"""WITH {EMB_SQL}, b AS (SELECT (id % 5 = 0)::INT AS side, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM emb),
e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM b),
c AS (SELECT least(floor((x - lx) / (hx - lx) * 8), 7) AS bx, least(floor((y - ly) / (hy - ly) * 8), 7) AS b_y, sum(1 - side) AS ca, sum(side) AS cb FROM b, e GROUP BY ALL),
s AS (SELECT ca / (SELECT sum(ca) FROM c) AS p, cb / (SELECT sum(cb) FROM c) AS q FROM c)
SELECT round(sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2), 6) AS js FROM s""")
def a18(spark, d):
    axes = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xy")]
    p, c = (x.select(*axes) for x in split_embeddings(spark, d))
    return a.js_divergence(p, c, ["x", "y"]).withColumn("js", r6("js"))


@case("a19_classification_report", f"""WITH {SCORES_SQL}, s AS (SELECT label, pred FROM scores),
k AS (SELECT DISTINCT label AS k FROM s UNION SELECT DISTINCT pred FROM s),
t AS (SELECT k, (SELECT count(*) FROM s WHERE label = k) AS ac, (SELECT count(*) FROM s WHERE pred = k) AS gu, (SELECT count(*) FROM s WHERE label = k AND pred = k) AS tp FROM k),
m AS (SELECT *, coalesce(tp / nullif(gu, 0), 0) AS p, coalesce(tp / nullif(ac, 0), 0) AS r FROM t)
SELECT round(sum(tp) / sum(ac), 6) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6) AS macro_f1 FROM m""")
def a19(spark, d):
    out = a.classification_report(scores(spark, d))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@case("a19_confusion", f"WITH {SCORES_SQL} SELECT model_id, label, pred, count(*) AS n FROM scores GROUP BY ALL")
def a19b(spark, d):
    s = scores(spark, d)
    return s.groupBy("model_id", "label", "pred").agg(F.count(F.lit(1)).alias("n"))


@case("a20_topk_accuracy", f"""WITH {SCORES_SQL}, r AS (SELECT len(list_filter(prob, lambda x: x > prob[label + 1])) + 1 AS r FROM scores)
SELECT round(avg((r <= 1)::INT), 6) AS top1, round(avg((r <= 3)::INT), 6) AS top3, round(avg((r <= 5)::INT), 6) AS top5 FROM r""")
def a20(spark, d):
    out = a.topk_accuracy(scores(spark, d))
    return out.select(*[r6(c).alias(c) for c in out.columns])


CLIENTS_SQL = """cl AS (SELECT user_id % 12 AS client_id, event_type AS label FROM events),
cn AS (SELECT client_id, label, count(*) AS n FROM cl GROUP BY ALL),
cc AS (SELECT c.client_id, l.label, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY c.client_id) AS p
  FROM (SELECT DISTINCT client_id FROM cl) c CROSS JOIN (SELECT DISTINCT label FROM cl) l LEFT JOIN cn ON cn.client_id = c.client_id AND cn.label = l.label)"""


def clients(spark, d):
    return read(spark, d, "events").select((F.col("user_id") % 12).alias("client_id"), F.col("event_type").alias("label"), "event_id", "value")


@case("a30_client_class_counts", f"WITH {CLIENTS_SQL} SELECT client_id, label, n, round(p, 6) AS p FROM cc")
def a30(spark, d):
    return a.client_class_counts(clients(spark, d)).select("client_id", "label", "n", r6("p").alias("p"))


@case("a30_client_sizes", f"WITH {CLIENTS_SQL}, s AS (SELECT client_id, count(*) AS n FROM cl GROUP BY client_id) SELECT round(avg(n), 6) AS mean_size, round(stddev_pop(n), 6) AS std_size FROM s")
def a30b(spark, d):
    return a.client_sizes(clients(spark, d)).select(r6("mean_size").alias("mean_size"), r6("std_size").alias("std_size"))


@case("a21_personalised_accuracy", f"""WITH {CLIENTS_SQL}, t AS (SELECT event_type AS label, sum((event_id % 3 = 0)::INT) AS hit, count(*) AS total FROM events GROUP BY ALL)
SELECT client_id, round(sum(p * hit) / sum(p * total), 6) AS accuracy FROM cc JOIN t USING (label) GROUP BY client_id""")
def a21(spark, d):
    c = clients(spark, d)
    out = a.personalised_accuracy(c.withColumn("correct", F.col("event_id") % 3 == 0), a.client_class_counts(c))
    return out.withColumn("accuracy", r6("accuracy"))


@case("a22_perplexity", f"WITH {SCORES_SQL} SELECT model_id, round(exp(avg(-ln(prob[label + 1]))), 6) AS perplexity FROM scores GROUP BY model_id")
def a22(spark, d):
    s = scores(spark, d).withColumn("loss", v.error_and_confidence(F.col("prob"), F.col("label"))["cross_entropy"])
    return a.perplexity(s, "model_id").withColumn("perplexity", r6("perplexity"))


CV_SQL = "cv AS (SELECT source_model, idx, avg(prob[label + 1]) AS confidence, stddev_samp(prob[label + 1]) AS variability FROM scores GROUP BY ALL)"


@case("a23_confidence_variability", f"WITH {SCORES_SQL}, {CV_SQL} SELECT source_model, idx, round(confidence, 6) AS confidence, round(variability, 6) AS variability FROM cv")
def a23(spark, d):
    return a.confidence_variability(scores(spark, d)).select("source_model", "idx", r6("confidence").alias("confidence"), r6("variability").alias("variability"))


@case("a24_soft_labels", f"""WITH {SCORES_SQL}, e AS (SELECT *, -list_sum(list_transform(prob, lambda x: x * ln(x))) AS e FROM scores),
g AS (SELECT *, exp(sum(e) OVER (PARTITION BY idx) - e) AS g FROM e), w AS (SELECT *, g / sum(g) OVER (PARTITION BY idx) AS ew FROM g),
l AS (SELECT idx, (model_id + 1) / 10.0 AS mw, ew, unnest(prob) AS x, unnest(range(4))::INT AS class FROM w)
SELECT idx, class, round(sum(mw * x), 6) AS p, round(sum(ew * x), 6) AS pe FROM l GROUP BY ALL""")
def a24(spark, d):
    s = scores(spark, d)
    w = spark.createDataFrame([(m, (m + 1) / 10) for m in range(4)], "model_id int, weight double")
    e = a.entropy_soft_labels(s).withColumnRenamed("p", "pe")
    return a.soft_labels(s, w).join(e, ["idx", "class"]).select("idx", "class", r6("p").alias("p"), r6("pe").alias("pe"))


VOTE_SQL = f"""{SCORES_SQL}, en AS (SELECT *, 1 + list_sum(list_transform(prob, lambda x: x * log2(x))) AS w FROM scores),
mv AS (SELECT idx, class, round(sum(w), 9) AS w FROM (SELECT idx, pred::BIGINT AS class, w FROM en UNION ALL SELECT DISTINCT idx, label::BIGINT, 1.0 FROM scores) GROUP BY ALL),
voted AS (SELECT idx, class AS voted FROM mv QUALIFY row_number() OVER (PARTITION BY idx ORDER BY w DESC, class) = 1)"""


@case("a25_majority_vote", f"WITH {VOTE_SQL} SELECT DISTINCT idx, label, voted FROM voted JOIN scores USING (idx)")
def a25(spark, d):
    return a.majority_vote(scores(spark, d))


@case("a26_minimax_vote", f"""WITH {VOTE_SQL}, l AS (SELECT idx, model_id, w, unnest(prob) AS p, unnest(range(4))::BIGINT AS c FROM en),
b AS (SELECT x.idx, x.c AS a, y.c AS b, sum(CASE WHEN y.p > x.p THEN x.w ELSE 0 END) - sum(CASE WHEN x.p > y.p THEN x.w ELSE 0 END) AS d
  FROM l x JOIN l y ON x.idx = y.idx AND x.model_id = y.model_id AND x.c <> y.c GROUP BY ALL),
w AS (SELECT idx, a, round(max(d), 9) AS d FROM b GROUP BY ALL)
SELECT idx, a AS voted FROM w QUALIFY row_number() OVER (PARTITION BY idx ORDER BY d, a) = 1""")
def a26(spark, d):
    return a.minimax_vote(scores(spark, d))


@case("a27_label_flip", f"WITH {VOTE_SQL}, v AS (SELECT DISTINCT idx, label, voted FROM voted JOIN scores USING (idx)) SELECT count(*) AS n, round(avg((label <> voted)::INT), 6) AS flip_ratio FROM v")
def a27(spark, d):
    return a.label_flip(a.majority_vote(scores(spark, d))).withColumn("flip_ratio", r6("flip_ratio"))


@case("a28_debias_responses", """WITH n AS (SELECT event_id % 40 AS item, user_id % 4 AS class, count(*) AS n FROM events GROUP BY ALL),
t AS (SELECT item, sum(n) AS t FROM n GROUP BY item)
SELECT t.item, c.class, round((coalesce(n, 0) / t - (1 - 0.6) / 4) / 0.6, 6) AS estimate FROM t CROSS JOIN (SELECT unnest(range(4))::INT AS class) c LEFT JOIN n ON n.item = t.item AND n.class = c.class""")
def a28(spark, d):
    e = read(spark, d, "events").select((F.col("event_id") % 40).alias("item"), (F.col("user_id") % 4).cast("int").alias("class"))
    return a.debias_responses(e, 0.6, 4).withColumn("estimate", r6("estimate"))


@case("a29_fed_average", f"""WITH {EMB_SQL}, n AS (SELECT party, count(*) AS n FROM emb GROUP BY party),
x AS (SELECT source_model, n, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INT AS pos FROM emb JOIN n USING (party))
SELECT source_model, pos, round(sum(n * x) / sum(n), 6) AS x FROM x GROUP BY ALL""")
def a29(spark, d):
    p, c = split_embeddings(spark, d)
    e = p.unionByName(c)
    up = e.join(e.groupBy("party").agg(F.count(F.lit(1)).alias("n")), "party").withColumnRenamed("embedding", "values")
    return a.fed_average(up, ("source_model",)).select("source_model", F.posexplode("values").alias("pos", "x")).withColumn("x", r6("x"))


@case("a31_inception_score", f"""WITH {SCORES_SQL}, o AS (SELECT idx, prob, row_number() OVER (ORDER BY idx) - 1 AS i, count(*) OVER () // 5 AS n FROM scores WHERE model_id = 1),
l AS (SELECT i // n AS s, n, idx, unnest(prob) AS p, unnest(range(4)) AS c FROM o WHERE i // n < 5),
m AS (SELECT s, c, avg(p) AS m FROM l GROUP BY ALL),
k AS (SELECT s, sum(p * ln(p / m)) / any_value(n) AS k FROM l JOIN m USING (s, c) GROUP BY s)
SELECT round(avg(exp(k)), 6) AS score FROM k""")
def a31(spark, d):
    return a.inception_score(scores(spark, d).filter("model_id = 1")).withColumn("score", r6("score"))


_W = lambda c: f"list_filter(string_split(lower({c}), ' '), lambda z: z <> '')"
TEXTS_SQL = f"tx AS (SELECT conv_id * 1000 + turn AS id, {_W('q')} AS cand, {_W('r')} AS ref FROM pairs)"


def grams_sql(n: int) -> str:
    side = lambda c, x: f"(SELECT id, g, count(*) AS {x} FROM (SELECT id, array_to_string({c}[p:p + {n - 1}], ' ') AS g FROM (SELECT id, {c}, unnest(range(1, len({c}) - {n - 2})) AS p FROM tx)) GROUP BY ALL)"
    return f"""g{n} AS (SELECT coalesce(a.id, b.id) AS id, sum(least(coalesce(nc, 0), coalesce(nr, 0))) AS matched, sum(coalesce(nc, 0)) AS nc, sum(coalesce(nr, 0)) AS nr
  FROM {side('cand', 'nc')} a FULL JOIN {side('ref', 'nr')} b ON a.id = b.id AND a.g = b.g GROUP BY 1)"""


GRAMS_SQL = ", ".join(grams_sql(n) for n in (1, 2, 3, 4))


def texts(spark, d):
    w = lambda c: F.filter(F.split(F.lower(c), " ", -1), lambda z: z != "")
    return pairs(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), w("q").alias("cand"), w("r").alias("ref"))


@case("a32_corpus_bleu", f"""WITH {PAIRS_SQL}, {TEXTS_SQL}, {GRAMS_SQL},
l AS ({' UNION ALL '.join(f'SELECT ln((sum(matched) + 1) / (sum(nc) + 1)) AS l FROM g{n}' for n in (1, 2, 3, 4))}),
s AS (SELECT sum(len(cand)) AS c, sum(len(ref)) AS r FROM tx)
SELECT round(CASE WHEN c >= r THEN 1 ELSE exp(1 - r / c) END * exp((SELECT avg(l) FROM l)), 6) AS bleu FROM s""")
def a32(spark, d):
    return overlap.corpus_bleu(texts(spark, d)).withColumn("bleu", r6("bleu"))


@case("a33_pair_bleu", f"""WITH {PAIRS_SQL}, {TEXTS_SQL}, {GRAMS_SQL}
SELECT id, round(CASE WHEN len(cand) >= len(ref) THEN 1 ELSE exp(1 - len(ref) / greatest(len(cand), 1)) END * exp((
{' + '.join(f'ln(coalesce((g{n}.matched + 1) / (g{n}.nc + 1), 1))' for n in (1, 2, 3, 4))}) / 4), 6) AS bleu
FROM tx {' '.join(f'LEFT JOIN g{n} USING (id)' for n in (1, 2, 3, 4))}""")
def a33(spark, d):
    return overlap.pair_bleu(texts(spark, d)).withColumn("bleu", r6("bleu"))


@case("a33_pair_rouge_n", f"""WITH {PAIRS_SQL}, {TEXTS_SQL}, {GRAMS_SQL}
SELECT id, round(coalesce(2 * g1.matched / (g1.nc + g1.nr), 0), 6) AS rouge1, round(coalesce(2 * g2.matched / nullif(g2.nc + g2.nr, 0), 0), 6) AS rouge2 FROM tx LEFT JOIN g1 USING (id) LEFT JOIN g2 USING (id)""")
def a33b(spark, d):
    return overlap.pair_rouge(texts(spark, d)).select("id", r6("rouge1").alias("rouge1"), r6("rouge2").alias("rouge2"))


@case("a33_pair_rouge_l", f"""WITH RECURSIVE {PAIRS_SQL}, {TEXTS_SQL},
l(id, i, k, v) AS (
  SELECT id, 0, unnest(range(0, len(ref) + 1)), 0 FROM tx
  UNION ALL
  SELECT id, i + 1, k, max(t) OVER (PARTITION BY id ORDER BY k) FROM (
    SELECT l.id, i, k, CASE WHEN k > 0 AND ref[k] = cand[i + 1] THEN 1 + lag(v) OVER (PARTITION BY l.id ORDER BY k) ELSE v END AS t
    FROM l JOIN tx USING (id) WHERE i < len(cand)))
SELECT id, round(coalesce(2 * max(v) / nullif(any_value(len(cand) + len(ref)), 0), 0), 6) AS rouge_l FROM l JOIN tx USING (id) GROUP BY id""")
def a33c(spark, d):
    return overlap.pair_rouge(texts(spark, d)).select("id", r6("rouge_l").alias("rouge_l"))


REC_SQL = f"rp AS (SELECT doc_id, {u_sql('doc_id', '1')} AS c, {u_sql('doc_id', '2')} AS r FROM documents)"


@case("a34_recovery_rate", f"WITH {REC_SQL} SELECT round(avg((c > r)::INT), 6) AS recovery_rate FROM rp")
def a34(spark, d):
    p = read(spark, d, "documents").select(u("doc_id", 1).alias("clean_chosen"), u("doc_id", 2).alias("clean_rejected"))
    return a.recovery_rate(p).withColumn("recovery_rate", r6("recovery_rate"))


def theta(spark, d):
    return scores(spark, d).filter("model_id = 0").select("source_model", "idx", (1 + u("idx", 7)).alias("theta"))


for _mode in ("error", "loss"):
    for _wrong in (False, True):

        def _weights(mode, wrong):
            x = {"error": "1 - prob[label + 1]", "loss": "-ln(prob[label + 1])"}[mode]
            right = "1.0" if wrong else f"pow(0.8, {x})"

            @case(f"a35_weight_update_{mode}" + "_only_wrong" * wrong, f"""WITH {SCORES_SQL}, s AS (SELECT source_model, idx, product(CASE WHEN pred = label THEN {right} ELSE 1 / pow(0.8, {x}) END) AS s FROM scores GROUP BY ALL),
t AS (SELECT source_model, idx, 1 + {u_sql('idx', '7')} AS theta FROM scores WHERE model_id = 0), n AS (SELECT *, theta * s AS t2 FROM t JOIN s USING (source_model, idx))
SELECT source_model, idx, round(t2 * sum(theta) OVER (PARTITION BY source_model) / sum(t2) OVER (PARTITION BY source_model), 6) AS theta FROM n""")
            def run(spark, d):
                return a.weight_update(theta(spark, d), scores(spark, d), 0.8, mode, wrong).withColumn("theta", r6("theta"))

        _weights(_mode, _wrong)


for _scope, _where in (("other", "model_id % 3 <> source_model"), ("own", "model_id % 3 = source_model")):

    def _scoped(scope, where):
        @case(f"a35_weight_update_{scope}_sources", f"""WITH {SCORES_SQL}, x AS (SELECT *, 1 - prob[label + 1] AS x FROM scores WHERE {where}),
s AS (SELECT source_model, idx, product(CASE WHEN pred = label THEN pow(0.8, x) ELSE pow(0.8, -x) END) AS s FROM x GROUP BY ALL),
t AS (SELECT source_model, idx, 1 + {u_sql('idx', '7')} AS theta FROM scores WHERE model_id = 0), n AS (SELECT t.*, theta * coalesce(s, 1) AS t2 FROM t LEFT JOIN s USING (source_model, idx))
SELECT source_model, idx, round(t2 * sum(theta) OVER (PARTITION BY source_model) / sum(t2) OVER (PARTITION BY source_model), 6) AS theta FROM n""")
        def run(spark, d):
            new = a.weight_update(theta(spark, d), scores(spark, d), 0.8, scope=scope, trained_on=F.col("model_id") % 3)
            return new.withColumn("theta", r6("theta"))

    _scoped(_scope, _where)


@case("a35_weight_update_beta_by_rows", f"""WITH {SCORES_SQL},
b AS (SELECT source_model, 1 + sqrt(greatest(1, 2 * ln(count(*) / 5))) AS beta FROM scores WHERE model_id = 0 GROUP BY 1),
s AS (SELECT source_model, idx, product(pow(beta, CASE WHEN pred = label THEN 1 ELSE -1 END * (1 - prob[label + 1]))) AS s FROM scores JOIN b USING (source_model) GROUP BY ALL),
n AS (SELECT source_model, idx, 1 + {u_sql('idx', '7')} AS theta, (1 + {u_sql('idx', '7')}) * s AS t2 FROM s)
SELECT source_model, idx, round(t2 * sum(theta) OVER (PARTITION BY source_model) / sum(t2) OVER (PARTITION BY source_model), 6) AS theta FROM n""")
def a35_beta(spark, d):
    return a.weight_update(theta(spark, d), scores(spark, d), rounds=5).withColumn("theta", r6("theta"))


_REAL = "idx % 4 = 1"


def _real_sql() -> str:
    """Models in turn, each with the odds of the weighted error of the real rows at that moment."""
    out, last = [], "t0"
    for m in range(4):
        out.append(f"""m{m} AS (SELECT {last}.*, abs(1 - prob[label + 1]) AS er, pred = label AS ok FROM {last} JOIN scores USING (source_model, idx) WHERE model_id = {m}),
o{m} AS (SELECT source_model, q / (1 - q) AS o FROM (SELECT source_model, sum(w * er) / sum(w) AS q FROM m{m} WHERE {_REAL} GROUP BY source_model)),
t{m + 1} AS (SELECT source_model, idx, theta, w * CASE WHEN {_REAL} THEN pow(CASE WHEN o > 1 THEN 1 / o ELSE o END, -er) WHEN ok THEN pow(0.8, er) ELSE pow(0.8, -er) END AS w FROM m{m} JOIN o{m} USING (source_model))""")
        last = f"t{m + 1}"
    return f"""WITH {SCORES_SQL}, t0 AS (SELECT source_model, idx, 1 + {u_sql('idx', '7')} AS theta, 1 + {u_sql('idx', '7')} AS w FROM scores WHERE model_id = 0), {', '.join(out)}
SELECT source_model, idx, round(w * sum(theta) OVER (PARTITION BY source_model) / sum(w) OVER (PARTITION BY source_model), 6) AS theta FROM {last}"""


@case("a35_weight_update_real", _real_sql())
def a35_real(spark, d):
    rows = theta(spark, d).withColumn("is_real", F.expr(_REAL))
    return a.weight_update(rows, scores(spark, d), 0.8, real="is_real").withColumn("theta", r6("theta"))


@case("a36_source_accuracy", f"WITH {SCORES_SQL} SELECT model_id, round(avg((pred = label)::INT), 6) AS accuracy FROM scores GROUP BY model_id")
def a36(spark, d):
    return a.source_accuracy(scores(spark, d)).withColumn("accuracy", r6("accuracy"))


@case("a38_length_stats", "SELECT lang, round(avg(length(text)), 6) AS mean_length FROM documents GROUP BY lang")
def a38(spark, d):
    return a.length_stats(read(spark, d, "documents"), "lang").withColumn("mean_length", r6("mean_length"))


@case("a39_budget_ledger", """WITH q AS (SELECT 8 + (vec_id % 5) AS sigma FROM embeddings), o AS (SELECT unnest(range(11, 1010)) / 10.0::DOUBLE AS a),
t AS (SELECT sum(1 / (2.0 * sigma * sigma)) AS t FROM q), e AS (SELECT a, a * t + ln((a - 1) / a) - (ln(3e-6) + ln(a)) / (a - 1) AS epsilon FROM o, t)
SELECT a AS "order", round(epsilon, 6) AS epsilon FROM e ORDER BY e.epsilon LIMIT 1""")
def a39(spark, d):
    q = read(spark, d, "embeddings").select((8 + F.col("vec_id") % 5).cast("double").alias("sigma"))
    return a.budget_ledger(q, 3e-6).withColumn("epsilon", r6("epsilon"))


@case("a40_noise_scale", """WITH g AS (SELECT DISTINCT label + 1 AS steps, vec_id % 7 + 1 AS parties, vec_id % 4 + 2 AS q FROM embeddings)
SELECT steps, parties, q, round((2 - pow(2.0, 1 - q)) * sqrt(2 * ln(1.25 / 1e-5)) * sqrt(steps) / (0.8 * sqrt(parties)), 6) AS sigma,
round(2 * (2 - pow(2.0, 1 - q)) * sqrt(2 * ln(1.25 / 1e-5)) * sqrt(steps) / (0.8 * sqrt(parties)), 6) AS contrastive FROM g""")
def a40(spark, d):
    g = read(spark, d, "embeddings").select((F.col("label") + 1).alias("steps"), (F.col("vec_id") % 7 + 1).alias("parties"), (F.col("vec_id") % 4 + 2).alias("q")).distinct()
    args = (F.lit(0.8), F.lit(1e-5), F.col("steps"), F.col("parties"), F.col("q"))
    return g.select("*", r6(a.noise_scale(*args)).alias("sigma"), r6(a.noise_scale(*args, contrastive=True)).alias("contrastive"))


DYN_SQL = f"""{SCORES_SQL}, ep AS (SELECT idx, model_id AS epoch, prob[label + 1] AS p, pred = label AS correct FROM scores),
lg AS (SELECT *, lag(correct) OVER (PARTITION BY idx ORDER BY epoch) AS before FROM ep),
dyn AS (SELECT idx, avg(p) AS confidence, stddev_pop(p) AS variability, sum(correct::INT) AS correctness,
  CASE WHEN sum(correct::INT) = 0 THEN 1000 ELSE sum((before AND NOT correct)::INT) END AS forgetfulness, avg(p) * (1 - avg(p)) AS closeness FROM lg GROUP BY idx)"""


def epochs(spark, d):
    return scores(spark, d).select("idx", F.col("model_id").alias("epoch"), F.element_at("prob", F.col("label").cast("int") + 1).alias("p"), (F.col("pred") == F.col("label")).alias("correct"))


@case("a41_training_dynamics", f"WITH {DYN_SQL} SELECT idx, round(confidence, 6) AS confidence, round(variability, 6) AS variability, correctness::BIGINT AS correctness, coalesce(forgetfulness, 0)::BIGINT AS forgetfulness, round(closeness, 6) AS closeness FROM dyn")
def a41(spark, d):
    out = a.training_dynamics(epochs(spark, d))
    return out.select("idx", "correctness", F.col("forgetfulness").cast("long").alias("forgetfulness"), *[r6(c).alias(c) for c in ("confidence", "variability", "closeness")])


@case("a41_epoch_stats", f"WITH {DYN_SQL} SELECT epoch, round(avg(-ln(p)), 6) AS loss, round(avg(correct::INT), 6) AS accuracy FROM ep GROUP BY epoch")
def a41b(spark, d):
    return a.epoch_stats(epochs(spark, d)).select("epoch", r6("loss").alias("loss"), r6("accuracy").alias("accuracy"))


@case("a42_dynamics_delta", f"""WITH {DYN_SQL}, d1 AS (SELECT idx, avg(p) AS c, sum(correct::INT) AS k FROM ep WHERE epoch < 2 GROUP BY idx), d2 AS (SELECT idx, avg(p) AS c, sum(correct::INT) AS k FROM ep WHERE epoch >= 2 GROUP BY idx)
SELECT idx, round(d2.c - d1.c, 6) AS confidence, (d2.k - d1.k)::BIGINT AS correctness FROM d1 JOIN d2 USING (idx)""")
def a42(spark, d):
    e = epochs(spark, d)
    out = a.dynamics_delta(a.training_dynamics(e.filter("epoch < 2")), a.training_dynamics(e.filter("epoch >= 2")))
    return out.select("idx", r6("confidence").alias("confidence"), "correctness")


@case("a43_correctness_band", f"WITH {DYN_SQL} SELECT idx, round(correctness / (SELECT max(correctness) FROM dyn), 1) AS band FROM dyn")
def a43(spark, d):
    return a.correctness_band(a.training_dynamics(epochs(spark, d))).select("idx", "band")


@case("a44_correlation", f"""WITH {DYN_SQL}, r AS (SELECT confidence, variability, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2 AS rx, rank() OVER (ORDER BY variability) + (count(*) OVER (PARTITION BY variability) - 1) / 2 AS ry
FROM (SELECT round(confidence, 9) AS confidence, round(variability, 9) AS variability FROM dyn))
SELECT round(corr(confidence, variability), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""")
def a44(spark, d):
    dyn = a.training_dynamics(epochs(spark, d)).select(F.round("confidence", 9).alias("x"), F.round("variability", 9).alias("y"))
    return a.correlation(dyn, "x", "y").select(r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


@case("a45_selected_per_origin", "SELECT source AS origin, count(*) FILTER (doc_id % 3 = 0 AND lang = 'de') AS n FROM documents GROUP BY source")
def a45(spark, d):
    docs = read(spark, d, "documents").withColumn("origin", F.col("source"))
    return a.selected_per_origin(docs.filter("doc_id % 3 = 0 AND lang = 'de'"), docs)


@case("a46_class_quota", """WITH n AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang), x AS (SELECT *, round(n / (SELECT sum(n) FROM n) * 101, 9) AS x FROM n),
q AS (SELECT label, n, floor(x)::BIGINT + (row_number() OVER (ORDER BY x - floor(x) DESC, label) <= 101 - (SELECT sum(floor(x)) FROM x))::BIGINT AS quota FROM x)
SELECT label, n, quota, 5 * quota AS candidates FROM q""")
def a46(spark, d):
    return a.class_quota(read(spark, d, "documents").select(F.col("lang").alias("label")), 101)


