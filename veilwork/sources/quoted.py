"""JSON files of strings, read by byte ranges.

A file is read by Spark's text source with the quote as line separator, so a large file is split like any
text. A segment between two quotes is the content of a string or the structure around strings; which of
them depends on the number of quotes before it in the file. A task numbers the quotes of its blocks (a
quote behind an odd number of backslashes is none); the blocks' totals, a row a block, give each block its
offset. A string that goes on in the next block is put together by an aggregation of such strings alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import materialise

#: So many elements of a client's list meet its name in one task.
SPAN = 1_000
_COUNTED = ("null", ":")  # tokens of the structure whose number before a segment is kept
_LOCAL = "file string, name string, block long, k long, text string, open boolean, null0 long, null1 long, colon0 long, colon1 long"


def _grouped(texts: list[str], carried: str) -> tuple[list[str], str]:
    """Contents between real quotes, and what is still open: segments joined where the quote between them is escaped."""
    out = []
    for text in texts:
        carried += text
        if (len(carried) - len(carried.rstrip("\\"))) % 2:
            carried += '"'
        else:
            out.append(carried)
            carried = ""
    return out, carried


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents with their number in the block, and how many of the counted tokens stand before them in even and odd contents."""
    at, k, carried, before = None, 0, "", np.zeros((2, 2), np.int64)

    def lines(texts: list[str], open_: bool) -> pa.RecordBatch:
        nonlocal k, before
        column, parity = pa.array(texts, pa.string()), (k + np.arange(len(texts))) % 2
        columns = [pa.array([x] * len(texts)) for x in at] + [pa.array(k + np.arange(len(texts))), column, pa.array([open_] * len(texts), pa.bool_())]
        for i, token in enumerate(_COUNTED):
            n = np.asarray(pc.count_substring(column, token), np.int64)
            for p in (0, 1):
                run = before[i, p] + np.cumsum(np.where(parity == p, n, 0))
                columns.append(pa.array(np.r_[before[i, p], run[:-1]].astype(np.int64)))
                before[i, p] = run[-1]
        k += len(texts)
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _LOCAL.split(", ")])

    for batch in batches:
        keys = list(zip(*(batch.column(x).to_pylist() for x in ("file", "name", "block")), strict=True))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if keys[lo] != at:
                if carried:
                    yield lines([carried], True)
                at, k, carried, before = keys[lo], 0, "", np.zeros((2, 2), np.int64)
            texts, carried = _grouped(batch.column("value").slice(lo, hi - lo).to_pylist(), carried)
            if texts:
                yield lines(texts, False)
    if carried:
        yield lines([carried], True)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, i, text, nulls, colons): contents between quotes by their number in the file, odd for strings,
    and how many nulls and colons the structure before them holds."""
    raw = spark.read.option("lineSep", '"').text(path)
    raw = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    local = materialise(raw.mapInArrow(_numbered, _LOCAL))
    tokens = lambda c, t, p: F.when(F.col("k") % 2 == p, F.regexp_count("text", F.lit(t))).otherwise(0) + F.col(f"{c}{p}")
    sums = [F.max(tokens(c, t, p)).alias(f"all_{c}{p}") for c, t in zip(("null", "colon"), _COUNTED, strict=True) for p in (0, 1)]
    blocks = local.groupBy("file", "block").agg(F.count_if(~F.col("open")).alias("n"), *sums)
    past = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("quotes", F.coalesce(F.sum("n").over(past), F.lit(0)))
    structural = lambda c: F.when(F.col("quotes") % 2 == 0, F.col(f"all_{c}0")).otherwise(F.col(f"all_{c}1"))
    blocks = blocks.select("file", "block", "quotes", *[F.coalesce(F.sum(structural(c)).over(past), F.lit(0)).alias(f"past_{c}") for c in ("null", "colon")])
    here = lambda c: F.col(f"past_{c}") + F.when(F.col("quotes") % 2 == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    rows = local.join(blocks, ["file", "block"]).select(
        "file", "name", "block", (F.col("quotes") + F.col("k")).alias("i"), "text", "open", here("null").alias("nulls"), here("colon").alias("colons")
    )
    cut = rows.filter("open").select("file", "i").distinct()
    names = ["file", "name", "i", "text", "nulls", "colons"]
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "")
    joined = rows.join(cut, ["file", "i"], "left_semi").groupBy("file", "name", "i").agg(
        parts.alias("text"), F.min("nulls").alias("nulls"), F.min("colons").alias("colons")
    )
    return rows.join(cut, ["file", "i"], "left_anti").select(*names).unionAll(joined.select(*names))


def string_of(content):
    """The string whose content between the quotes is ``content``."""
    return F.get(F.from_json(F.concat(F.lit('["'), content, F.lit('"]')), "array<string>"), F.lit(0))


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, at, text, colons) of all strings and nulls in order; ``at`` counts the elements before in the file."""
    return _elements(segments(spark, path))


def _elements(rows: DataFrame) -> DataFrame:
    first = F.floor(F.col("i") / 2) + F.col("nulls")
    strings = rows.filter("i % 2 = 1").select("file", "name", first.alias("at"), string_of(F.col("text")).alias("text"), "colons", "i")
    n = F.regexp_count("text", F.lit("null"))
    nulls = rows.filter("i % 2 = 0").withColumn("n", n).filter("n > 0").select(
        "file", "name", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: first + j)).alias("at"), F.lit(None).cast("string").alias("text"),
        (F.col("colons") + F.regexp_count("text", F.lit(":"))).alias("colons"), "i",
    )
    return strings.unionAll(nulls)


def client_elements(spark: SparkSession, path: str) -> DataFrame:
    """(client_id, pos, text) of objects client -> list of strings.

    A list meets its client's name in spans of ``SPAN`` elements, so that a long list is joined by many tasks.
    """
    rows = materialise(segments(spark, path))
    every = _elements(rows)
    colons = rows.filter("i % 2 = 0 AND contains(text, ':')").select("file", (F.col("i") - 1).alias("i"), (F.col("colons") + 1).alias("colons"), (F.floor(F.col("i") / 2) + F.col("nulls")).alias("base"))
    keys = rows.filter("i % 2 = 1").select("file", "i", string_of(F.col("text")).alias("client_id")).join(colons, ["file", "i"]).drop("i")
    after = keys.select("file", (F.col("colons") - 1).alias("colons"), F.col("base").alias("end"))  # where the next list begins
    last = every.groupBy("file").agg(F.max("at").alias("last"))
    span = lambda at: F.floor(at / SPAN)
    keys = keys.join(after, ["file", "colons"], "left").join(last, "file")
    keys = keys.withColumn("span", F.explode(F.sequence(span(F.col("base")), span(F.greatest("base", F.coalesce("end", "last"))))))
    texts = every.join(colons.select("file", "i"), ["file", "i"], "left_anti").withColumn("span", span(F.col("at")))
    return texts.join(keys, ["file", "colons", "span"]).select("client_id", (F.col("at") - F.col("base")).cast("int").alias("pos"), "text")
