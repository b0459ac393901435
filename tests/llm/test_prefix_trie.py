"""The prefix trie against a brute-force trie, with edge rows and a sketch that is too small."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from veilwork.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string, depth int, hi string"


def remainder(c, n):
    return abs(c) % n * (1 if c >= 0 else -1)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[c].append((turn is not None, turn or 0, name, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - remainder(c, 5), [])[:h] + own[c][h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].add(c)
    children = defaultdict(set)
    for k in members:
        if k:
            children[k[:-1]].add(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted(
        (
            min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children[k]), leaves[k], saved[k],
            hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest(),
        )
        for k, m in members.items()
    )


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    out = prefix_trie.prefix_trie(df, **options).collect()
    return sorted(tuple(-1 if x is None else x for x in r) for r in out)


def random_rows(seed, n, turns, texts):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 3 * n), n):
        for t in range(rng.randint(1, turns)):
            role = rng.choice(["user", "assistant", None, ""])
            text = rng.choice([None, "", "é", "x" * 50, *[f"t{i}" for i in range(texts)]])
            rows.append((c, rng.choice([t, t, t, None, 3]), role, text, 9, "clash"))
    common = [(c, t, "user", "common", 0, "") for c in range(1000, 1000 + n) for t in range(3)]
    return rows + common + rows[:3] + [(None, 0, "user", "nobody", 0, "")]


@pytest.mark.parametrize("seed,n,turns,texts", [(1, 40, 6, 1), (2, 120, 12, 3), (3, 60, 30, 400)])
def test_equals_brute_force(spark, seed, n, turns, texts):
    rows = random_rows(seed, n, turns, texts)
    assert found(spark, rows) == brute(rows)


def test_a_full_sketch_changes_no_row(spark):
    rows = random_rows(4, 80, 9, 50)
    assert found(spark, rows, max_bits=64, width=16) == brute(rows)


def test_screening_proves_singletons(spark):
    paths = prefix_trie.rebuilt_paths(spark.createDataFrame(random_rows(5, 200, 6, 500), ROWS))
    held = defaultdict(int)
    rows = prefix_trie.screen(paths, 1 << 20).collect()
    for r in rows:
        held[r.hi, r.lo] += 1
    single = [r for r in rows if r.single]
    assert all(held[r.hi, r.lo] == 1 and r.d > 0 for r in single)
    assert len(single) > 0.95 * sum(held[r.hi, r.lo] == 1 for r in rows if r.d > 0)


def test_long_conversations_and_many_equal_ones(spark):
    rows = [(c, t, "user", f"turn {t}", 0, "") for c in range(0, 4000, 5) for t in range(2)]
    rows += [(c, t, "user", f"turn {t}" if t < 290 else f"own {c} {t}", 0, "") for c in (5000, 5005) for t in range(300)]
    assert found(spark, rows) == brute(rows)


def test_empty_tables_and_turnless_conversations(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x", 0, "")]) == []
    without = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert found(spark, [(without, 0, "user", "x", 0, "")]) == [(without, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(without).encode()).hexdigest())]
