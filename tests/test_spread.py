"""Steps that once met a whole group, or all rows, in one task."""

import glob
import json

from veilwork.cases import joins, selection, sources, text


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_of_a_prompt_stay_in_its_row(spark, sf):
    found = plan(selection.shots(spark, sf))
    assert "Exchange" not in found and "Aggregate" not in found and "Window" not in found


def test_languages_are_numbered_without_a_window(spark, sf):
    assert "row_number" not in plan(joins.novelty_pairs(spark, sf))


def test_conversations_are_brought_together_once(spark, sf):
    assert plan(text.chat(spark, sf)).count("Exchange ") == 1


def test_a_client_is_written_in_lists_of_bounded_size(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(sources, "PART", 7)
    monkeypatch.setattr(sources, "fresh_path", lambda spark, name: f"{tmp_path}/{name}")
    got = {(r.client_id, r.pos): r.text for r in sources.s3(spark, sf).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        want.setdefault(f"{r.lang}{r.doc_id % 3}", []).append(r.text)
    assert got == {(c, i): t for c, texts in want.items() for i, t in enumerate(texts)}
    sizes = [len(v) for f in glob.glob(f"{tmp_path}/clients/part-*") for v in json.load(open(f)).values()]
    assert max(sizes) == 7 and sum(sizes) == len(got)


def test_a_long_list_meets_its_name_in_spans(spark, tmp_path, monkeypatch):
    from veilwork.sources import quoted, readers

    monkeypatch.setattr(quoted, "SPAN", 10)
    clients = {"long": [str(i) for i in range(95)] + [None] * 12, "none": [], "one": ["x"], "nulls": [None] * 25, "end": [":", "null"] * 20}
    (tmp_path / "a.json").write_text(json.dumps(clients))
    read = readers.read_client_map(spark, str(tmp_path))
    assert {tuple(r) for r in read.collect()} == {(c, i, t) for c, texts in clients.items() for i, t in enumerate(texts)}
    assert "span" in plan(read) and read.count() == sum(map(len, clients.values()))
