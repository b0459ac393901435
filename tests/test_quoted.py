"""JSON arrays and client maps read by byte ranges, against the json module."""

import json
import random

import pytest

from veilwork.sources import quoted, readers


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def strings(rng, n):
    parts = ['"', "\\", "a", "é", "\n", ",", ":", "[", "]", "null", '","', "x" * 40, " ", "{", "}"]
    return [None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("seed,indent,ascii_", [(1, None, True), (2, 2, False)])
def test_arrays_in_many_blocks(spark, tmp_path, small_splits, seed, indent, ascii_):
    rng = random.Random(seed)
    want = set()
    for name, n in (("a.json", 900), ("b.json", 40), ("c.json", 0), ("d.json", 1)):
        texts = strings(rng, n) if n != 1 else ['say "' * 4000]  # one string over many blocks
        (tmp_path / name).write_text(json.dumps(texts, indent=indent, ensure_ascii=ascii_), encoding="utf-8")
        want |= {(name, i, t) for i, t in enumerate(texts)}
    got = readers.read_text_array(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    read = spark.read.option("lineSep", '"').text(str(tmp_path))
    assert read.rdd.getNumPartitions() > 8  # one file, many tasks


@pytest.mark.parametrize("seed", [2])
def test_client_maps_in_many_blocks(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    want = set()
    for name in ("one.json", "two.json"):
        clients = {f'{name} "{c}":': strings(rng, rng.choice([0, 1, 3, 90])) for c in range(12)}
        (tmp_path / name).write_text(json.dumps(clients, indent=seed - 1 or None), encoding="utf-8")
        want |= {(c, i, t) for c, texts in clients.items() for i, t in enumerate(texts)}
    got = readers.read_client_map(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_escaped_quotes_do_not_end_a_string():
    assert quoted._grouped(["[", "a\\", "b", ",", "c\\\\", "]"], "") == (["[", 'a\\"b', ",", "c\\\\", "]"], "")
    assert quoted._grouped(["x\\"], "") == ([], 'x\\"')
