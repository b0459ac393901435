"""Text, label and prompt functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vectors as v
from ..operators import selection
from ._case import EMB_SQL, PAIRS_SQL, SCORES_SQL, SEED, case, cos_sql, dot_sql, pairs, r6, read, scores, split_embeddings, sq_sql, u_sql

NL = "chr(10)"
TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@case("p1_unify_pairs", f"""WITH {PAIRS_SQL}
SELECT 'dialogue' AS kind, conv_id, q AS instruction, r AS response FROM pairs UNION ALL
SELECT 'instruction', conv_id, CASE WHEN turn % 4 = 0 THEN q ELSE q || ' ' || conv_id END, r FROM pairs UNION ALL
SELECT 'conversation', conv_id, q, r FROM pairs""")
def unify(spark, d):
    p = pairs(spark, d)
    frames = {
        "dialogue": p.select("conv_id", F.col("q").alias("patient"), F.col("r").alias("doctor")),
        "instruction": p.select("conv_id", F.col("q").alias("instruction"), F.col("r").alias("output"),
                                F.when(F.col("turn") % 4 == 0, "").otherwise(F.col("conv_id").cast("string")).alias("input")),
        "conversation": p.select("conv_id", F.array(F.struct(F.col("q").alias("content")), F.struct(F.col("r").alias("content"))).alias("conversation")),
    }
    out = None
    for kind, df in frames.items():
        a, b = t.pair_columns(kind)
        one = df.select(F.lit(kind).alias("kind"), "conv_id", a.alias("instruction"), b.alias("response"))
        out = one if out is None else out.unionByName(one)
    return out


@case("p2_instruction_with_input", f"""WITH {PAIRS_SQL}
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN q ELSE q || ' ' || r END AS text FROM pairs""")
def with_input(spark, d):
    extra = F.when(F.col("turn") % 4 == 0, "").otherwise(F.col("r"))
    return pairs(spark, d).select("conv_id", "turn", t.instruction_with_input(F.col("q"), extra).alias("text"))


@case("p3_clean_generated", f"""SELECT doc_id, regexp_replace({TRIM("split_part(text, ' of ', 1)")}, '\\n+', ' ', 'g') AS text FROM documents""")
def clean(spark, d):
    return read(spark, d, "documents").select("doc_id", t.clean_generated(F.col("text"), " of ").alias("text"))


@case("p4_flatten_whitespace", f"""SELECT doc_id, replace(replace(text, {NL}, ' '), chr(9), ' ') AS flat,
replace(replace(replace(replace(text, {NL}, ' '), chr(9), ' '), '"', ''), '''', '') AS csv FROM documents""")
def flatten(spark, d):
    return read(spark, d, "documents").select(
        "doc_id", t.flatten_whitespace(F.col("text")).alias("flat"), t.flatten_whitespace(F.col("text"), True).alias("csv"))


_CUT = f"""CASE WHEN contains(x, '"') THEN split_part(x, '"', 1) WHEN contains(x, {NL}) THEN split_part(x, {NL}, 1)
WHEN contains(x, '.') THEN regexp_extract(x, '^(.*\\.)', 1, 's') END"""


@case("p5_cut_output", f"""WITH g AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, {NL}, ' ') WHEN doc_id % 3 = 1 THEN replace(text, ', ', '" ') ELSE text END AS x FROM documents),
c AS (SELECT doc_id, {TRIM(_CUT)} AS cut FROM g)
SELECT doc_id, CASE WHEN cut <> '' AND len(string_split(cut, ' ')) >= 8 THEN cut END AS cut FROM c""")
def cut_output(spark, d):
    docs = read(spark, d, "documents")
    x = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit(" "))).when(
        F.col("doc_id") % 3 == 1, F.replace("text", F.lit(", "), F.lit('" '))).otherwise(F.col("text"))
    return docs.select("doc_id", t.cut_output(x, min_words=8).alias("cut"))


@case("p6_cut_question", f"""WITH g AS (SELECT doc_id, replace(text, '.', '?') AS x, substr(text, 3, 4) AS a FROM documents),
c AS (SELECT doc_id, a, CASE WHEN contains(x, '?') THEN {TRIM("split_part(x, '?', 1) || '?'")} END AS cut FROM g)
SELECT doc_id, CASE WHEN cut <> '' AND len(string_split(cut, ' ')) >= 3 AND NOT contains(lower(cut), lower(a)) THEN cut END AS cut FROM c""")
def cut_question(spark, d):
    docs = read(spark, d, "documents")
    x = F.replace(F.col("text"), F.lit("."), F.lit("?"))
    return docs.select("doc_id", t.cut_question(x, F.substring("text", 3, 4), 3).alias("cut"))


@case("p7_cut_answer", f"""WITH g AS (SELECT doc_id, CASE WHEN contains(text, '"') THEN split_part(text, '"', 1) WHEN contains(text, '.') THEN split_part(text, '.', 1) END AS x FROM documents)
SELECT doc_id, CASE WHEN {TRIM('x')} <> '' THEN {TRIM('x')} END AS cut FROM g""")
def cut_answer(spark, d):
    return read(spark, d, "documents").select("doc_id", t.cut_answer(F.col("text")).alias("cut"))


@case("p8_extract_example", f"""WITH {PAIRS_SQL}
SELECT conv_id, turn, CASE WHEN turn % 4 <> 0 THEN {TRIM('q')} END AS instruction, CASE WHEN turn % 4 <> 0 THEN {TRIM('r')} END AS output FROM pairs""")
def extract(spark, d):
    p = pairs(spark, d)
    mark = F.when(F.col("turn") % 4 == 0, F.lit("##")).otherwise(F.lit(""))
    x = F.concat(F.lit("##instruction: "), F.col("q"), F.lit("\n##output: "), F.col("r"), mark, F.lit("\n###example: 2"))
    e = t.extract_example(x)
    return p.select("conv_id", "turn", e["instruction"].alias("instruction"), e["output"].alias("output"))


@case("p9_strip_markers", f"SELECT conv_id, turn, {TRIM('text')} AS text FROM conversations")
def markers(spark, d):
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", t.strip_markers(F.concat("text", F.lit("<|im_end|>##more"))).alias("text"))


_CHAT = {
    "one_sep": ("'sys '", "role || ': ' || text || ' '", "role || ': ' || text || ' '"),
    "two_sep": ("'sys '", "role || ': ' || text || ' '", "role || ': ' || text || '</s>'"),
    "newline": (f"'sys' || {NL}", f"role || {NL} || text || {NL}", f"role || {NL} || text || {NL}"),
    "no_colon": ("'sys'", "role || text", "role || text"),
    "blocks": (f"'<|system|>' || {NL} || 'sys' || {NL}",) + (f"'<|' || role || '|>' || {NL} || text || {NL}",) * 2,
}


@case("p10_render_chat", " UNION ALL ".join(
    f"SELECT '{s}' AS style, conv_id, {h} || string_agg(CASE WHEN role = 'user' THEN {a} ELSE {b} END, '' ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id"
    for s, (h, a, b) in _CHAT.items()))
def chat(spark, d):
    return t.render_chats(read(spark, d, "conversations"), list(t.CHAT_STYLES), "sys")


@case("p11_split_preference_pair", """WITH p AS (
  SELECT doc_id, 'Shared: ' || text AS a, 'Shared: ' || lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents),
l AS (SELECT *, coalesce(list_min([i FOR i IN range(0, least(len(a), len(b))) IF a[i + 1] <> b[i + 1]]), least(len(a), len(b))) AS n FROM p WHERE b IS NOT NULL)
SELECT doc_id, substr(a, 1, n) AS history, substr(a, n + 1) AS chosen_answer, substr(b, n + 1) AS rejected_answer FROM l""")
def preference(spark, d):
    from pyspark.sql import Window as W

    docs = read(spark, d, "documents")
    b = F.lag("text").over(W.partitionBy("source").orderBy("doc_id"))
    p = docs.select("doc_id", F.concat(F.lit("Shared: "), "text").alias("a"),
                    F.concat(F.lit("Shared: "), b).alias("b")).filter("b IS NOT NULL")
    cols = t.split_preference_pair(F.col("a"), F.col("b"))
    return p.select("doc_id", *[c.alias(n) for n, c in cols.items()])


@case("p13_label_index", "SELECT value, (row_number() OVER (ORDER BY value) - 1)::INT AS index FROM (SELECT DISTINCT source AS value FROM documents)")
def index(spark, d):
    return t.label_index(read(spark, d, "documents"), "source")


@case("p14_split_joint_label", """SELECT doc_id, ((doc_id % 25) // 5)::INT AS category, (doc_id % 5)::INT AS rating, lang || '_' || source AS joined,
string_split(lang || '_' || source, '_')[2] AS second FROM documents""")
def joint(spark, d):
    docs = read(spark, d, "documents")
    a, b = t.split_joint_label(F.col("doc_id") % 25)
    joined = F.concat_ws("_", "lang", "source")
    return docs.select("doc_id", a.alias("category"), b.alias("rating"), joined.alias("joined"), F.split(joined, "_")[1].alias("second"))


@case("p15_reindex", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS idx FROM documents")
def reindex(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    return selection.reindex(docs, [F.col("n_chars").desc(), F.col("doc_id")]).select("doc_id", "idx")


@case("p16_truncate_tokens", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:12], ' ') AS text FROM documents")
def truncate(spark, d):
    return read(spark, d, "documents").select("doc_id", t.truncate_tokens(F.col("text"), 12).alias("text"))


@case("p17_blank_tokens", f"""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS i FROM w)
SELECT doc_id, string_agg(CASE WHEN {u_sql('doc_id', 'i')} < 0.3 THEN '_' ELSE token END, ' ' ORDER BY i) AS text FROM e GROUP BY doc_id""")
def blank(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", t.blank_tokens(F.col("text"), F.col("doc_id"), 0.3, SEED).alias("text"))


@case("p18_mask_positions", f"""WITH w AS (SELECT doc_id % 50 AS batch, doc_id AS id, string_split(text, ' ') AS w FROM documents),
e AS (SELECT batch, id, unnest(w) AS token, unnest(range(len(w)))::INT AS pos FROM w),
k AS (SELECT * FROM e WHERE token <> 'the'),
m AS (SELECT batch, floor(min(c) * 0.15) AS m FROM (SELECT batch, id, count(*) AS c FROM k GROUP BY ALL) GROUP BY batch),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {u_sql('id', 'pos')}, pos) AS draw FROM k)
SELECT id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM r JOIN m USING (batch) WHERE draw <= m GROUP BY id""")
def mask(spark, d):
    docs = read(spark, d, "documents").select(
        (F.col("doc_id") % 50).alias("batch"), F.col("doc_id").alias("id"), t.words(F.col("text")).alias("tokens"))
    out = t.mask_positions(docs, 0.15, SEED, special=("the",))
    return out.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


_SPANS = """w AS (SELECT doc_id AS id, string_split(text, ' ') AS w FROM documents),
s AS (SELECT id, w, unnest(range(greatest(ceil((len(w) - 32) / 16.0)::INT + 1, 1))) AS win FROM w),
spans AS (SELECT id, win::INT AS window, (win * 16)::INT AS start, w[win * 16 + 1:win * 16 + 32] AS tokens FROM s)"""


def _spans(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), t.words(F.col("text")).alias("tokens"))
    return t.sliding_spans(docs, 32, 16)


@case("p19_sliding_spans", f"""WITH {_SPANS} SELECT id, "window", start, array_to_string(tokens, ' ') AS tokens FROM spans""")
def spans(spark, d):
    return _spans(spark, d).withColumn("tokens", F.array_join("tokens", " "))


@case("p20_align_answer_span", f"""WITH {_SPANS}, a AS (SELECT *, (id % 60)::INT AS f, (id % 60 + 2)::INT AS l FROM spans)
SELECT id, "window", CASE WHEN f >= start AND l < start + len(tokens) THEN f - start ELSE 0 END AS first, CASE WHEN f >= start AND l < start + len(tokens) THEN l - start ELSE 0 END AS last FROM a""")
def align(spark, d):
    first = (F.col("id") % 60).cast("int")
    a, b = t.align_answer_span(F.col("start"), F.size("tokens"), first, first + 2)
    return _spans(spark, d).select("id", "window", a.alias("first"), b.alias("last"))


@case("p21_pair_text", f"WITH {PAIRS_SQL} SELECT conv_id, turn, q AS x0, q || '[SEP]' || r AS c FROM pairs")
def pair(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.col("q").alias("x0"), t.pair_text(F.col("q"), F.col("r")).alias("c"))


@case("p22_softmax_sigmoid_entropy", f"""WITH {SCORES_SQL}
SELECT model_id, idx, round(prob[1], 6) AS p0, round(1 / (1 + exp(-prob[1] / 0.5)), 6) AS squashed,
round(-list_sum(list_transform(prob, lambda x: x * ln(x))), 6) AS nats, round(-list_sum(list_transform(prob, lambda x: x * log2(x))), 6) AS bits FROM scores""")
def soft(spark, d):
    p = F.col("prob")
    return scores(spark, d).select("model_id", "idx", r6(p[0]).alias("p0"), r6(v.sigmoid(p[0], 0.5)).alias("squashed"),
                                   r6(v.entropy(p)).alias("nats"), r6(v.entropy(p, True)).alias("bits"))


@case("p23_vector_ops", f"""WITH {EMB_SQL}
SELECT a.id AS a, b.id AS b, round(sqrt({sq_sql('a.embedding', 'b.embedding')}), 6) AS l2, round({sq_sql('a.embedding', 'b.embedding')}, 6) AS sq,
round({cos_sql('a.embedding', 'b.embedding')}, 6) AS cosine, round({dot_sql('a.embedding', 'b.embedding')}, 6) AS dot,
round(sqrt({dot_sql('a.embedding', 'a.embedding')}), 6) AS norm, round(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE)) / len(a.embedding), 6) AS mean
FROM cand a JOIN cand b ON b.id = a.id + 5""")
def ops(spark, d):
    _, c = split_embeddings(spark, d)
    b = c.select((F.col("id") - 5).alias("id"), F.col("embedding").alias("y"))
    j = c.join(b, "id")
    x, y = F.col("embedding"), F.col("y")
    return j.select(F.col("id").alias("a"), (F.col("id") + 5).alias("b"), r6(v.l2(x, y)).alias("l2"), r6(v.squared_l2(x, y)).alias("sq"),
                    r6(v.cosine(x, y)).alias("cosine"), r6(v.dot(x, y)).alias("dot"), r6(v.norm(x)).alias("norm"), r6(v.mean(x)).alias("mean"))


@case("p24_error_and_confidence", f"""WITH {SCORES_SQL}
SELECT model_id, idx, round(abs(1 - prob[label + 1]), 6) AS error, round(prob[label + 1], 6) AS confidence, pred = label AS correct,
round(-ln(prob[label + 1]), 6) AS cross_entropy FROM scores""")
def errors(spark, d):
    e = v.error_and_confidence(F.col("prob"), F.col("label"))
    return scores(spark, d).select("model_id", "idx", *[(c if n == "correct" else r6(c)).alias(n) for n, c in e.items()])


@case("p25_name_hint", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || ' The function should be named ' || source || '.' ELSE lang END AS text FROM documents")
def hint(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", t.name_hint(F.col("lang"), F.when(F.col("doc_id") % 3 == 0, F.col("source"))).alias("text"))


@case("p26_feedback_prompts", f"""WITH {PAIRS_SQL}
SELECT conv_id, turn, 'Question: ' || q || {NL} || 'Better answer: ' || r || {NL} || 'Worse answer: ' || q || {NL} || 'Say what the worse answer lacks.' AS feedback,
'Question: ' || q || {NL} || 'Answer: ' || q || {NL} || 'Feedback: ' || r || {NL} || 'Write a better answer.' AS revise FROM pairs""")
def feedback(spark, d):
    q, r = F.col("q"), F.col("r")
    return pairs(spark, d).select("conv_id", "turn", t.feedback_prompt(q, r, q).alias("feedback"), t.revise_prompt(q, q, r).alias("revise"))
