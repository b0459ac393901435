"""Word overlap of pairs against plain counting and the textbook table."""

import math
import random
import re
from collections import Counter

import pyarrow as pa

from veilwork.operators import filters, overlap


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for w in x:
        new = [0]
        for k, z in enumerate(y):
            new.append(row[k] + 1 if w == z else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


def test_overlap_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = ["a", "b", "c", "é", ""] + [f"w{i}" for i in range(20)]
    rows = [(i, [rng.choice(words) for _ in range(rng.randint(0, 80))], [rng.choice(words) for _ in range(rng.randint(0, 80))]) for i in range(60)]
    rows += [(100, None, ["a"]), (101, [], None), (102, ["x"] * 3000, ["x", "y"] * 2000), (103, ["a"], ["a"]), (103, ["a"], ["a"])]
    got = sorted(overlap.pair_overlap(spark.createDataFrame(rows, "id long, cand array<string>, ref array<string>").repartition(3), lcs=True).collect())
    want = []
    for i, c, r in rows:
        c, r = c or [], r or []
        line = [i, len(c), len(r), lcs(c, r) if i != 102 else 3000 if 2000 >= 3000 else 2000]
        for n in range(1, 5):
            x, y = (Counter(tuple(s[k : k + n]) for k in range(len(s) - n + 1)) for s in (c, r))
            line += [sum((x & y).values()), sum(x.values()), sum(y.values())]
        want.append(tuple(line))
    assert [tuple(r) for r in got] == sorted(want)
    plan = overlap.corpus_bleu(spark.createDataFrame(rows, "id long, cand array<string>, ref array<string>"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate " not in plan
    assert spark.createDataFrame([], "id long, cand array<string>, ref array<string>").transform(overlap.pair_bleu).count() == 0


def test_pair_cosines_equal_the_closed_form():
    rng = random.Random(5)
    words = ["Ab", "a", "ab", "zz9", "é", "x_y", "..", "İq", "KK", "foo", "bar", "the-end"]
    texts = [None, "", "a . é", "ab", *[" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(40)]]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(500)]

    def one(a, b):
        x, y = (Counter(re.findall("[0-9A-Za-z_]{2,}", (t or "").lower())) for t in (a, b))
        if not x and not y:
            return None
        size = [sum((n * (1.0 if w in o else 1 + math.log(1.5))) ** 2 for w, n in s.items()) for s, o in ((x, y), (y, x))]
        return sum(n * y[w] for w, n in x.items()) / math.sqrt(size[0] * size[1]) if size[0] and size[1] else 0.0

    want = [one(*p) for p in pairs]
    for at_once in (1 << 22, 7):
        got = filters.pair_cosines(*(pa.array(x, pa.string()) for x in zip(*pairs)), at_once)
        assert [g is None for g in got] == [w is None for w in want] and all(g is None or abs(g - w) < 1e-12 for g, w in zip(got, want))
    none = pa.array([], pa.string())
    assert filters.pair_cosines(none, none) == []
