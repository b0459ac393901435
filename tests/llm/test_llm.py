"""The training-data operators against SQL twins, brute-force versions and edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from sqltwin import same

from veilwork.llm import (
    decontaminate, exact_dedup, license_scan, line_dedup, mixing, ngram_join, oracles, quality, queries, substring_dedup, suffix_dedup, url_filter,
)
from veilwork.llm._words import Words
from veilwork.llm.components import connected_components
from veilwork.llm.suffix_array import suffix_arrays

DOCS = "doc_id long, text string"
EDGES = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "one"), (6, "Ünïcode ÄÖ word"), (7, "x" * 300), (8, "x" * 300), (8, "x" * 300), (None, "one")]


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf).toPandas(), oracles.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_operator_has_its_query(name):
    assert re.fullmatch(r"op([1-9]|1[0-3])_\w+", name)


def random_docs(rng, n, words, low, high, copies):
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < copies:
            w = list(rng.choice(texts))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            cut = rng.choice([0, 0, 3])
            w = w[cut:]
        else:
            w = [rng.choice(words) for _ in range(rng.randint(low, high))]
        texts.append(w)
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    return rows


def covered(rows, window, symbols):
    first, order = {}, sorted(rows, key=lambda r: r[0])
    for i, text in order:
        s = symbols(text)
        for p in range(len(s) - window + 1):
            first.setdefault(tuple(s[p : p + window]), i)
    out = {}
    for i, text in order:
        s = symbols(text)
        gone = [False] * len(s)
        for p in range(len(s) - window + 1):
            if first[tuple(s[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out[i] = (len(s), gone, s)
    return out


@pytest.mark.parametrize("window,seed", [(5, 1), (12, 2), (50, 3)])
def test_substring_dedup_over_many_buckets(spark, window, seed):
    rng = random.Random(seed)
    rows = random_docs(rng, 60, ["a", "b", "cc", "dé", "E", "ff"] + [f"w{i}" for i in range(30)], 0, 160, 0.6)
    want = covered(rows, window, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t))
    got = substring_dedup.substring_dedup(docs(spark, rows).repartition(5), window, bucket_bytes=2000).collect()
    assert len(got) == 60
    for r in got:
        n, gone, s = want[r.id]
        assert (r.n_symbols, r.n_removed, r.kept_text) == (n, sum(gone), " ".join(x for x, g in zip(s, gone) if not g))


def lines_by_hand(rows, least):
    runs = {}
    for i, text in rows:
        lines = [(k, x) for k, x in enumerate(text.split("\n")) if x]
        for p in range(len(lines)):
            for e in range(p, len(lines)):
                if sum(len(x.encode()) for _, x in lines[p : e + 1]) >= least:
                    runs.setdefault(tuple(x for _, x in lines[p : e + 1]), []).append((i, [k for k, _ in lines[p : e + 1]]))
                    break
    gone = {i: set() for i, _ in rows}
    for found in runs.values():
        for i, places in found:
            if i > found[0][0] or places[0] > min(p[0] for x, p in found if x == i):
                gone[i] |= set(places)
    out = {}
    for i, text in rows:
        lines = text.split("\n")
        kept = "".join(x + "\n" * (k < len(lines) - 1) for k, x in enumerate(lines) if k not in gone[i])
        out[i] = (sum(map(bool, lines)), len(gone[i]), kept)
    return out


@pytest.mark.parametrize("least,seed", [(1, 4), (12, 5), (50, 6)])
def test_line_dedup_over_many_buckets(spark, least, seed):
    rng = random.Random(seed)
    rows = [(i, t.replace(" ", "\n").replace("line3", "").replace("line7", "a much longer line than the others, Ä")) for i, t in random_docs(rng, 80, [f"line{i}" for i in range(14)], 0, 25, 0.5)]
    want = lines_by_hand(sorted(rows), least)
    for r in line_dedup.line_dedup(docs(spark, rows), least, bucket_bytes=500).collect():
        assert (r.n_symbols, r.n_removed, r.kept_text) == want[r.id]


def test_one_long_line_and_repeats_in_a_document_go(spark):
    long, short = "x" * 60, "too short"
    rows = [(1, f"{long}\n\n{short}"), (2, f"{short}\n{long}\nown"), (3, f"{long}y\nz\n{long}y"), (3, f"{long}y")]
    got = sorted((r.id, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(docs(spark, rows)).collect())
    assert got == [(1, 0, rows[0][1]), (2, 1, f"{short}\nown"), (3, 0, f"{long}y"), (3, 1, f"{long}y\nz\n")]


def same_bytes_removed(got, rows, length=50):
    want = covered(rows, length, lambda t: list(t.encode()))
    assert len(got) == len(rows)
    for r in got:
        n, gone, s = want[r.id]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (n, sum(gone), spans, bytes(x for x, g in zip(s, gone) if not g))


@pytest.mark.parametrize("piece,dealt,hot,seed", [(32, 4096, 64, 5), (2, 3, 2, 6), (3, 4096, 64, 7)])
def test_suffix_dedup_over_many_buckets(spark, monkeypatch, piece, dealt, hot, seed):
    for name, value in (("PIECE", piece), ("DEALT_RUNS", dealt), ("HOT_RUNS", hot), ("FLUSH_ROWS", 64)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(seed)
    rows = random_docs(rng, 50, ["a", "bb", "cä", "ddd"] + [f"w{i}" for i in range(25)], 0, 70, 0.7)
    rows += [(100 + i, "ab" * (20 + i)) for i in range(8)] + [(200, "q" * 49), (201, "q" * 49), (202, "q" * 50), (203, "q" * 50)]
    same_bytes_removed(suffix_dedup.suffix_dedup(docs(spark, rows), bucket_bytes=1500).collect(), rows)


@pytest.mark.parametrize("bucket_bytes", [6 << 20, 3000])
def test_suffix_dedup_of_one_passage_in_a_thousand_documents(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(suffix_dedup, "DEALT_RUNS", 200)
    rng = random.Random(8)
    edge = lambda: "".join(rng.choice("abcdefgh") for _ in range(30))
    passage = "".join(rng.choice("klmnopqr ") for _ in range(64))
    rows = [(i, edge() + passage + edge()[: rng.randint(0, 30)]) for i in range(1000)]
    same_bytes_removed(suffix_dedup.suffix_dedup(docs(spark, rows), bucket_bytes=bucket_bytes).collect(), rows)


def test_suffix_arrays_equal_sorted_suffixes():
    rng = np.random.default_rng(0)
    for trial in range(120):
        strings = []
        for _ in range(rng.integers(1, 5)):
            x = rng.integers(1, (2, 3, 5)[trial % 3] + 1, rng.integers(1, 40))
            strings.append(np.append(np.tile(x[:6], 4) if rng.random() < 0.3 else x, 0))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in strings])])
        want = []
        for at, x in zip(offsets, strings):
            want += [at + i for i in sorted(range(len(x)), key=lambda i, x=x.tolist(): x[i:])]
        assert suffix_arrays(np.concatenate(strings), offsets).tolist() == want


def test_words_match_the_patterns():
    texts = ["", "  a b\tc ", "Ä1 b-c_D\x7f e", "\n", "x" * 50 + " y"]
    for kind, pattern in (("space", r"[^\x20\x09-\x0D]+"), ("alnum_lower", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        data = b"".join(t.encode() for t in texts)
        offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
        w = Words(np.frombuffer(data, np.uint8), offsets, kind)
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), t) if kind == "alnum_lower" else t for t in texts]
        want = [re.findall(pattern, t) for t in low]
        assert w.counts().tolist() == [len(x) for x in want]
        flat = [x for ws in want for x in ws]
        assert [re.sub("[A-Z]", lambda m: m[0].lower(), data[s:e].decode()) if kind == "alnum_lower" else data[s:e].decode() for s, e in zip(w.starts, w.ends)] == flat
        assert len(set(w.hash.tolist())) == len(set(flat))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()


@pytest.mark.parametrize("seed,words,low,high", [(7, 400, 5, 120), (8, 6, 0, 9), (9, 3000, 150, 400)])
def test_near_duplicates_equal_brute_force(spark, seed, words, low, high):
    rng = random.Random(seed)
    rows = random_docs(rng, 150, [f"w{i}" for i in range(words)], low, high, 0.7)
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(sets, 2):
        both = len(sets[x] & sets[y])
        if both and 100 * both >= 85 * len(sets[x] | sets[y]):
            a, b = sorted((find(x), find(y)))
            parent[b] = a
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs(spark, rows).repartition(3)).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


def test_bands_allow_every_similar_pair():
    b = ngram_join.Bands(85, 5000)
    for n in range(1, 4000, 37):
        for other in range(n, 100 * n // 85 + 1):
            if 100 * n < 85 * other:
                continue
            low, high = b.of(np.array([n]))[0], b.of(np.array([other]))[0]
            assert high - low in (0, 1)
            assert (n + other) * 15 // 185 <= b.differ[low]
    assert b.deletion.any() and (b.segments + b.deletion >= b.differ + 1 + b.slack).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (3, 3)] + [(100, 100 + i) for i in range(1, 40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6} | {100 + i: 100 for i in range(40)}
    assert got == want


def test_digest_index_reopened_under_another_shuffle_setting(spark, tmp_path):
    path, texts = str(tmp_path / "index"), docs(spark, [(i, f"text {i}") for i in range(400)])
    first = exact_dedup.DigestIndex(spark, path, 8)
    assert exact_dedup.new_rows(texts, first, batch="one").count() == 400
    for buckets in (3, 8, None):
        again = exact_dedup.DigestIndex(spark, path, buckets)
        assert again.buckets == 8
        assert exact_dedup.new_rows(texts, again, batch=f"again {buckets}").count() == 0
    more = docs(spark, [(i, f"text {i}") for i in range(390, 410)])
    assert exact_dedup.new_rows(more, exact_dedup.DigestIndex(spark, path, 5)).count() == 10


def test_digest_index_persists_and_appends(spark, tmp_path):
    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, path, 4)
    first = exact_dedup.new_rows(docs(spark, [(1, "a"), (2, "a"), (3, None), (4, "")]), index)
    assert {r.doc_id for r in first.collect()} == {1, 3}
    index.drop()
    again = exact_dedup.DigestIndex(spark, path, 4)
    batch = spark.createDataFrame([(7, "a", 1), (8, "b", 2), (9, "b", 3)], "doc_id long, text string, digest int")
    assert [tuple(r) for r in exact_dedup.new_rows(batch, again, keep="last").collect()] == [(9, "b", 3)]
    assert again.table().select("digest").distinct().count() == 3
    plan = batch.select(F.unhex(exact_dedup.text_digest(F.col("text"))).alias("digest")).join(again.table().hint("merge"), "digest", "left_anti")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2


def test_a_batch_given_again_answers_as_before(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    exact_dedup.new_rows(docs(spark, [(1, "a"), (2, "b")]), index, batch="one").collect()
    batch = docs(spark, [(3, "b"), (4, "c"), (5, "c"), (None, "d")])
    exact_dedup.new_rows(batch, index, batch="two")  # its result is lost
    size = index.table().count()
    assert {r.doc_id for r in exact_dedup.new_rows(batch, index, batch="two").collect()} == {4, None}
    assert index.table().count() == size
    more = exact_dedup.exact_groups(docs(spark, [(8, "a"), (9, "a"), (None, "e")]), index=index, batch="three").collect()
    assert {(r.id, r.keep_id, r.group_size, r.kept) for r in more} == {(8, 9, 3, False), (9, 9, 3, True), (None, None, 1, True)}
    index.drop()


def test_exact_groups_with_a_hot_digest(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 40}") for i in range(600)]
    got = {r.id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs(spark, rows)).collect()}
    by = {}
    for i, t in rows:
        by.setdefault(t, []).append(i)
    assert got == {i: (max(by[t]), len(by[t])) for i, t in rows}


def test_decontamination_blocks_agree_with_one_block(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "x y"), (3, ""), (4, None), (5, "X Y"), (10, "z")], "item_id long, text string")
    rows = [(1, "q a b c d e f g h i j k l q"), (2, "x-Y z!"), (3, "a b c d e f g h i"), (4, None), (5, "y x"), (6, "xx y")]
    run = lambda block: {r.id: (r.n_words, list(r.hit_words), list(r.items)) for r in decontaminate.scan(docs(spark, rows), items, block=block).collect()}
    one, many = run(200_000), run(2)
    assert one == many
    assert one[1] == (14, list(range(1, 13)), ["1"]) and one[2] == (3, [0, 1, 2], ["10", "2", "5"])
    assert one[3][1] == [] and one[4] == (0, [], []) and one[5][1] == [] and one[6][1] == []
    clean = decontaminate.drop_contaminated(docs(spark, rows).withColumn("items", F.lit(1)), items, block=2)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6]
    none = decontaminate.scan(docs(spark, rows), items.limit(0)).collect()
    assert all(list(r.hit_words) == [] for r in none)


def test_url_rules_and_vocabulary(spark):
    urls = ["http://www.EXAMPLE.com/en/a?x", "http://example.com/en/", "http://a.example.com/fr", "http://x.net/es/1", None, "no scheme porn",
            "http://x.org/free-casino", "http://x.org/freed/winner", "http://x.org/free/win", "http://x.com"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("old"))
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).orderBy("page_id").collect()]
    assert got[0] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[1][2:] == ("example.com/en/", "block") and got[2][2:] == ("com/", "allow") and got[3][2:] == ("net/es/", "block")
    assert got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "block")
    assert [g[3] for g in got[6:]] == ["block", "allow", "block", "allow"] and got[9][1:3] == ("", None)


def test_license_index_finds_every_key_phrase():
    index = license_scan.rare_postings(license_scan.DEFAULT_TEMPLATES)
    for no, t in enumerate(license_scan.DEFAULT_TEMPLATES):
        held = {at for ps in index.values() for n, at in ps if n == no}
        assert held & set(range(t.key_at, t.key_at + len(t.key_words)))


def test_license_places(spark):
    text = "MIT\nLicense, the mit-license; Permission is hereby granted, free of charge, to any person obtaining a copy of this Software"
    r = license_scan.scan_licenses(docs(spark, [(1, text), (2, None), (3, "mit")])).orderBy("id").collect()
    assert (r[0].n_base, r[0].first_word, r[0].last_word, r[0].base_labels, r[0].labels) == (2, 0, 3, "mit", "mit")
    assert (r[1].n_words, r[1].score, r[2].n_base, r[2].first_word) == (0, 0.0, 0, None)
    plan = license_scan.scan_licenses(docs(spark, [(1, text)]).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan.replace("Scan ExistingRDD", ""))


def test_mix_meets_its_targets(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "c", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, DOCS + ", source string").withColumn("size", F.lit("clash"))
    out = mixing.mix_sources(df)
    got = [r.asDict() for r in out.collect()]
    assert len(got) == 1500
    again = {r.id: r.taken for r in mixing.mix_sources(df.repartition(7)).collect()}
    assert again == {r["id"]: r["taken"] for r in got}
    size = {i: len(t.split()) for i, t, _ in rows}
    sums = {}
    for i, _, s in rows:
        sums[s] = sums.get(s, 0) + size[i]
    want = mixing.source_targets(sums, {"a": 1, "b": 2, "c": 3, None: 1})
    for s in sums:
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sums[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) < 0.01 * want[s]
        assert all(r["size"] == size[r["id"]] and 0 <= r["taken"] <= 3 * r["size"] for r in mine)


def test_targets_reshare_what_capped_sources_leave():
    t = mixing.source_targets({"a": 100, "b": 10, "c": 10}, {"a": 1, "b": 2, "c": 3})
    assert t["b"] == 30 and t["c"] == 30 and abs(t["a"] - 60) < 1e-9
    assert mixing.source_targets({"a": 0, "b": 5}, {"a": 1, "b": 1}) == {"a": 0, "b": 5}
    assert list(mixing.cycled_weights(["b", None, "a", "B"]).items()) == [("B", 1.0), ("a", 2.0), ("b", 3.0), (None, 1.0)]


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op10_quality_classifier(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())
    both = got[got.held_out].merge(labels, on="doc_id")
    assert len(both) > 40 and (both.predicted == both.quality).mean() >= 0.97
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_quality_without_positives_scores_alike(spark):
    none = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, quality int")
    elsewhere = spark.createDataFrame([(i, 1) for i in range(1000, 1020)], "doc_id long, quality int")
    for labels in (none, none.limit(0), elsewhere):
        model = quality.fit_quality(docs(spark, EDGES), labels)
        assert {r.score for r in quality.score_quality(docs(spark, EDGES), model).collect()} == {0.5}
        assert quality.keep_good(docs(spark, EDGES), model).count() == len(EDGES)


def test_quality_risk_minimum_and_whole_unlabelled_set(spark):
    rng = np.random.default_rng(3)
    n = quality.N_FEATURES
    x = rng.random((9000, n)).astype(np.float32)
    stats = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<float>").repartition(40)
    mean, scale, w = quality.nnpu_fit(x[:500].astype(float), stats, 0.4)
    assert np.allclose(mean, x.astype(float).mean(0)) and np.allclose(scale, x.astype(float).std(0) + 1e-3)
    u = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    p = u[:500]
    best = np.linalg.solve(u.T @ u / len(u) / 2 + 1e-3 * np.eye(n + 1), 0.4 * p.mean(0) - u.mean(0) / 2)
    assert ((1 + u @ best) ** 2).mean() > 0.4 * ((1 + p @ best) ** 2).mean()  # the part that must not be negative is not
    assert np.abs(w - best).max() < 1e-3

    # separable: the unbiased risk's own minimum has a negative part, the descent's has not
    good, bad = rng.normal(3, 0.1, (40, 3)), rng.normal(-3, 0.1, (10, 3))
    one = lambda x: np.hstack([x, np.ones((len(x), 1))])
    p, u = one(good[:8]), one(np.vstack([good, bad]))
    w = quality.nnpu_descent(quality._moments(p) / len(p), quality._moments(u) / len(u), 0.95)
    assert ((1 + u @ w) ** 2).mean() / 4 - 0.95 * ((1 + p @ w) ** 2).mean() / 4 > -0.02
    assert (one(bad) @ w).max() < (one(good) @ w).min()


def test_tracking_tags_do_not_block(spark):
    urls = ["https://shop.org/p?utm_source=feed&ref=x", "https://shop.org/free-win/", "https://shop.org/casino", "https://casinos2.org/sexual", None, ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge_urls(df).orderBy("page_id").collect()] == ["allow", "block", "block", "allow", "allow", "allow"]
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_edge_rows_everywhere(spark, sf):
    df = docs(spark, EDGES)
    for frame, n in ((df, len(EDGES)), (df.limit(0), 0)):
        assert suffix_dedup.suffix_dedup(frame).count() == n
        assert substring_dedup.substring_dedup(frame).count() == n
        assert line_dedup.line_dedup(frame).count() == n
        assert ngram_join.near_duplicates(frame).count() == n
        assert exact_dedup.exact_groups(frame).count() == n
        assert license_scan.scan_licenses(frame).count() == n
        assert mixing.mix_sources(frame.withColumn("source", F.lit(None).cast("string"))).count() == n
        items = spark.read.parquet(f"{sf}/benchmark.parquet")
        assert decontaminate.report(decontaminate.scan(frame, items)).count() == n
    got = {(r.id, r.n_shingles): r.component_id for r in ngram_join.near_duplicates(df).collect()}
    assert got[(4, 1)] == got[(5, 1)] == got[(None, 1)] == 4 and got[(1, 0)] == 1 and got[(8, 1)] == 7
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    scores = [r.score for r in quality.score_quality(df, model).collect()]
    assert len(scores) == len(EDGES) and all(0 <= x <= 1 for x in scores)
    assert set(quality.keep_good(df.withColumn("score", F.lit(1)), model).columns) == {"doc_id", "text", "score"}


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline as cp

    frames, now = {}, spark.read.parquet(f"{sf}/documents.parquet")
    columns = now.columns
    for name, stage in cp.STAGES:
        frames[name] = (now.toPandas(), (after := cp.materialise(stage(spark, now, sf))).toPandas())
        now = after
        assert name == "mixing sources" or now.columns == columns
    before, after = frames["exact dedup"]
    assert sorted(after.doc_id) == sorted(before.groupby("text").doc_id.max())
    before, after = frames["benchmark decontamination"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    items = [words(t) for t in spark.read.parquet(f"{sf}/benchmark.parquet").toPandas().text]
    grams = {tuple(w[i : i + 10]) for w in items for i in range(max(len(w) - 9, 1))}
    dirty = {r.doc_id for r in before.itertuples() if any(tuple(w[i : i + n]) in grams for w in [words(r.text)] for n in {len(g) for g in grams} for i in range(len(w) - n + 1))}
    assert set(after.doc_id) == set(before.doc_id) - dirty
    before, after = frames["n-gram Jaccard join"]
    sets = {r.doc_id: shingles(r.text) for r in before.itertuples()}
    kept = set(after.doc_id)
    for x, y in itertools.combinations(sorted(kept), 2):
        assert 100 * len(sets[x] & sets[y]) < 85 * len(sets[x] | sets[y]) or not sets[x]
    before, after = frames["quality classifier"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    bad = set(labels[labels.quality == 0].doc_id)
    assert len(bad & set(after.doc_id)) <= 0.1 * len(bad) + 1
    good = set(labels[labels.quality == 1].doc_id) & set(before.doc_id)
    assert len(good - set(after.doc_id)) <= 0.02 * len(good) + 1
    before, after = frames["mixing sources"]
    for s, rows in after.groupby("source", dropna=False):
        assert abs(rows.taken.sum() - rows.target.iloc[0]) <= before[before.source == s].n_chars.max() / 3


def test_digests_of_the_queries(spark, sf):
    r = queries.op4_substring_dedup(spark, sf).filter("n_removed = 0").orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").filter(F.col("doc_id") == r.doc_id).first().text
    joined = " ".join(re.findall(r"[^\x20\x09-\x0D]+", text))
    assert r.kept_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_near_stage_equals_brute_force(spark, sf):
    import corpus_pipeline as cp

    rng = random.Random(11)
    rows = random_docs(rng, 150, [f"w{i}" for i in range(400)], 5, 120, 0.7)
    long = [f"v{i}" for i in range(49)]
    rows += [(500, " ".join(long)), (501, " ".join(long[:24] + ["other"] + long[25:]))]
    w = {i: t.split() for i, t in rows}
    sets = {i: {tuple(x[p : p + 5]) for p in range(max(len(x) - 4, 1))} if x else set() for i, x in w.items()}
    assert 10 * len(sets[500] & sets[501]) == 8 * len(sets[500] | sets[501])
    four = [shingles(" ".join(w[i])) for i in (500, 501)]
    assert 100 * len(four[0] & four[1]) < 85 * len(four[0] | four[1])
    low = {i: i for i in sets}
    links = [p for p in itertools.combinations(sorted(sets), 2) if 0 < 10 * len(sets[p[0]] & sets[p[1]]) >= 8 * len(sets[p[0]] | sets[p[1]])]
    for _ in sets:
        for x, y in links:
            low[x] = low[y] = min(low[x], low[y])
    got = {r.doc_id for r in cp.near_dedup_stage(spark, docs(spark, rows).repartition(3), sf).collect()}
    assert got == {i for i in sets if low[i] == i}


def test_near_duplicates_of_repeated_and_null_ids(spark, sf):
    import corpus_pipeline as cp

    rng = random.Random(12)
    texts = [[f"g{g}w{i}" for i in range(80)] for g in range(12)]
    rows = []
    for g, w in enumerate(texts):
        near = w[:40] + [f"new{g}"] + w[41:]
        ids = ((None, None), (7, 7), (None, 100 + g))[g % 3]
        rows += [(ids[0], " ".join(w)), (ids[1], " ".join(near))]
    rows += [(None, None), (7, ""), (None, "alone")]
    rng.shuffle(rows)
    got = [tuple(r) for r in ngram_join.near_duplicates(docs(spark, rows).repartition(3)).collect()]
    alone = {i: c for i, n, c in got if i is not None and i >= 100}
    assert alone == {100 + g: 100 + g for g in range(2, 12, 3)}
    assert sorted(c for i, n, c in got if i is None and c < 1000) == sorted(alone)
    kept = [tuple(r) for r in cp.near_dedup_stage(spark, docs(spark, rows).repartition(3), sf).collect()]
    assert kept.count((None, "alone")) == kept.count((None, None)) == kept.count((7, "")) == 1
    assert len(kept) == len(texts) + 3 and set(kept) <= set(rows)
    for g in range(12):
        mine = [i for i, t in kept if t and t.startswith(f"g{g}w0 ")]
        assert mine == [(None, 7, 100 + g)[g % 3]]
    again = [tuple(r) for r in cp.near_dedup_stage(spark, docs(spark, rows[::-1]).repartition(5), sf).collect()]
    assert sorted(map(repr, again)) == sorted(map(repr, kept))


@pytest.mark.parametrize("percent,size", [(80, 5), (85, 4), (60, 2)])
def test_first_elements_leave_out_only_sets_without_a_partner(spark, percent, size):
    rng = random.Random(percent)
    rows = []
    for g in range(40):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 8, 20, 60, 120]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            x = list(w)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                x[rng.randrange(len(x))] = f"w{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(x[: len(x) - rng.randrange(0, 1 + len(x) // 10)])))
    sets = {i: set(zip(*[t.split()[k:] for k in range(size)])) or {tuple(t.split())} for i, t in rows}
    low = {i: i for i in sets}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            low[max(x, y)] = min(x, y)
    got = ngram_join.near_duplicates(docs(spark, rows).repartition(7), size, percent).collect()
    assert {r.id: r.component_id for r in got} == {i: top(i) for i in sets}
