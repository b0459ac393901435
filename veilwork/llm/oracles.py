"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

from . import license_scan, url_filter

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE = r"[^\x20\x09-\x0D]+"


def _words(text: str, pattern: str, lower: bool) -> str:
    text = f"coalesce({text}, '')"
    return f"regexp_extract_all({f"translate({text}, '{_UP}', '{_LOW}')" if lower else text}, '{pattern}')"


OP2 = f"""
WITH d AS (SELECT doc_id, {_words('text', _ALNUM, True)} AS w FROM documents),
i AS (SELECT item_id, {_words('text', _ALNUM, True)} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, array_to_string(w[p:p + 9], ' ') AS pat, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS pat
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw USING (pat, n)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM hit) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _op3() -> str:
    fits = {
        (h, p, v): f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        for h, p, v in sorted(url_filter.DEFAULT_RULES, key=lambda r: -len(r[0] + r[1]))
    }
    rule = " ".join(f"WHEN {c} THEN '{h}{p}'" for (h, p, _), c in fits.items())
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for (_, _, v), c in fits.items())

    def hits(terms) -> str:
        return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT * {w}" for t, w in terms)

    strict = [(t, 1) for t, w in url_filter.DEFAULT_VOCABULARY if w >= 1]
    soft = [(t, 1) for t, w in url_filter.DEFAULT_VOCABULARY if w < 1]
    return f"""
WITH h AS (
  SELECT page_id, lower(coalesce(url, '')) AS u,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_UP}', '{_LOW}'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
s AS (
  SELECT *, ({hits(strict)})::INT AS n_strict, ({hits(soft)})::INT AS n_soft,
    ({hits(url_filter.DEFAULT_VOCABULARY)})::DOUBLE AS url_score FROM h)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft, url_score
FROM s"""


OP8 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def _op9() -> str:
    idf = license_scan.idf_weights(license_scan.DEFAULT_TEMPLATES)
    found = []
    for t in license_scan.DEFAULT_TEMPLATES:
        key = "[" + ", ".join(f"'{w}'" for w in t.key_words) + "]"
        words = "[" + ", ".join(f"'{w}'" for w in t.words) + "]"
        weights = "[" + ", ".join(repr(idf[w]) for w in t.words) + "]::DOUBLE[]"
        total = repr(sum(idf[w] for w in t.words))
        cover = (
            f"list_sum([CASE WHEN k - {t.key_at} + j > 1 AND w[k - {t.key_at} + j - 1] = ({words})[j] THEN ({weights})[j] ELSE 0.0 END "
            f"FOR j IN range(1, {len(t.words) + 1})])"
        )
        score = "1.0" if t.base else f"round({cover} / {total}, 6)"
        found.append(
            f"SELECT doc_id, '{t.label}' AS label, {t.base} AS base, k - 1 - {t.key_at} AS start, {score} AS coverage "
            f"FROM p JOIN d USING (doc_id) WHERE word = '{t.key_words[0]}' AND w[k:k + {len(t.key_words) - 1}] = {key}"
        )
    return f"""
WITH d AS (SELECT doc_id, {_words('text', _ALNUM, True)} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
found AS ({' UNION ALL '.join(found)}),
ok AS (SELECT * FROM found WHERE coverage >= 0.6),
g AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM ok GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (doc_id)"""


def _repeats(words: str, window: int, separator: str, counted: str) -> str:
    """Symbols not covered by a window whose sequence also starts in a document with a smaller id."""
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
win AS (
  SELECT doc_id, p, CASE WHEN p + {window - 1} <= len(w) THEN array_to_string(w[p:p + {window - 1}], chr(10) || chr(32)) END AS seq, w[p] AS word
  FROM s),
dup AS (
  SELECT doc_id, p, word, seq IS NOT NULL AND min(doc_id) OVER (PARTITION BY seq) < doc_id AS gone FROM win),
cov AS (
  SELECT doc_id, p, word,
    coalesce(bool_or(gone) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW), false) AS gone
  FROM dup),
g AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS n_removed,
    string_agg(word, {separator} ORDER BY p) FILTER (NOT gone) AS kept FROM cov GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS {counted}, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""


OP7 = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
s AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS q, len(l) AS n FROM d),
w AS (
  SELECT doc_id, q, line, row_number() OVER o AS p, sum(strlen(line)) OVER o AS c
  FROM s WHERE line <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY q)),
lines AS (SELECT doc_id, list(line ORDER BY q) AS w FROM w GROUP BY doc_id),
runs AS (
  SELECT a.doc_id, a.p, b.p AS e FROM w a ASOF JOIN w b ON a.doc_id = b.doc_id AND a.c - strlen(a.line) + 50 <= b.c),
seq AS (SELECT doc_id, p, e, array_to_string(w[p:e], chr(10)) AS seq FROM runs JOIN lines USING (doc_id)),
dup AS (
  SELECT doc_id, p, e, min(doc_id) OVER (PARTITION BY seq) < doc_id OR min(p) OVER (PARTITION BY seq, doc_id) < p AS gone FROM seq),
cov AS (SELECT DISTINCT doc_id, unnest(range(p, e + 1)) AS p FROM dup WHERE gone),
m AS (
  SELECT s.doc_id, s.q, s.n, s.line, w.p, cov.p IS NOT NULL AS gone
  FROM s LEFT JOIN w ON w.doc_id = s.doc_id AND w.q = s.q LEFT JOIN cov ON cov.doc_id = s.doc_id AND cov.p = w.p)
SELECT doc_id, count(p)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line || CASE WHEN q < n THEN chr(10) ELSE '' END, '' ORDER BY q) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text', _SPACE, True)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a AS u, b AS v FROM link UNION ALL SELECT b, a FROM link),
reach(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.u, e.v FROM reach r JOIN edge e ON e.u = r.v),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


OP1 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(hex(encode(coalesce(text, '')))), '..') AS w FROM documents),
b AS (SELECT doc_id, unnest(w) AS b, unnest(range(len(w))) AS p FROM d),
k2 AS (SELECT doc_id, p, b, b || lead(b, 1) OVER o AS k2 FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
k4 AS (SELECT *, k2 || lead(k2, 2) OVER o AS k4 FROM k2 WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
k8 AS (SELECT doc_id, p, b, k2, k4 || lead(k4, 4) OVER o AS k8 FROM k4 WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
k16 AS (SELECT doc_id, p, b, k2, k8 || lead(k8, 8) OVER o AS k16 FROM k8 WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
k50 AS (
  SELECT doc_id, p, b, k16 || lead(k16, 16) OVER o || lead(k16, 32) OVER o || lead(k2, 48) OVER o AS k
  FROM k16 WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
dup AS (SELECT doc_id, p, b, k IS NOT NULL AND min(doc_id) OVER (PARTITION BY k) < doc_id AS gone FROM k50),
cov AS (
  SELECT doc_id, p, b, bool_or(gone) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM dup),
sp AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM cov),
g AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
    string_agg(b, '' ORDER BY p) FILTER (NOT gone) AS kept FROM sp GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


OP12 = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS a, c.id AS c, a.label = c.label AS same, list_dot_product(a.q, c.q)::BIGINT AS score
  FROM v a JOIN v c ON a.id % 100 = 0 AND a.id <> c.id),
p AS (
  SELECT * FROM (SELECT a, c, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, c) AS r FROM s WHERE same) WHERE r <= 5),
n AS (
  SELECT p.a, p.c AS p, p.score AS ps, s.c, s.score, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.c) AS r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, p AS positive_id, r::INTEGER AS rank, c AS negative_id, ps AS positive_score, score AS negative_score
FROM n WHERE r <= 10
"""


_CRC32 = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT)"""

OP13 = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 5 AS b, {_CRC32} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
own AS (
  SELECT h.c, 0 AS part, pos, r, x FROM h JOIN t ON t.c = h.b AND pos < h
  UNION ALL SELECT h.c, 1, pos, r, x FROM h JOIN t ON t.c = h.c AND pos >= h),
turn AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, r, x FROM own),
prefix AS (
  SELECT c, d, octet_length(encode(x)) AS bytes,
    string_agg(length(r) || ':' || length(x) || ':' || r || x, '') OVER (PARTITION BY c ORDER BY d) AS k FROM turn
  UNION ALL SELECT c, 0, 0, '' FROM h),
path AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, lead(k) OVER (PARTITION BY c ORDER BY d) IS NULL AS ends FROM prefix),
node AS (
  SELECT k, min(c) AS conv_id, min(d) AS depth, min(up) AS up, count(*) AS n_convs, min(bytes) AS bytes,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM path GROUP BY k),
child AS (SELECT up AS k, count(*) AS n_children FROM node GROUP BY up),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (k)),
below AS (
  SELECT v.k, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved_tokens
  FROM full_node v JOIN full_node u ON starts_with(u.k, v.k) GROUP BY v.k)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens,
  n.ends_sha256
FROM full_node n JOIN below USING (k) LEFT JOIN node p ON p.k = n.up
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array_dedup": OP1,
        "op2_benchmark_decontamination": OP2,
        "op3_url_filter": _op3(),
        "op4_substring_dedup": _repeats(_words("text", _SPACE, False), 50, "' '", "n_words"),
        "op6_ngram_jaccard_join": OP6,
        "op7_line_dedup": OP7,
        "op8_exact_dedup": OP8,
        "op9_license_scan": _op9(),
        "op12_hard_negatives": OP12,
        "op13_prefix_trie": OP13,
    }
