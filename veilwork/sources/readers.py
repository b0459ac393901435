"""Sources and sinks. Every source has an explicit schema; ids are given at ingest, order is never relied on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quoted import array_elements, client_elements

LABELLED = T.StructType([
    T.StructField("idx", T.LongType()), T.StructField("C", T.StringType()), T.StructField("X", T.StringType()),
    T.StructField("Y", T.IntegerType()), T.StructField("is_syn", T.BooleanType()),
])
PAIR = T.StructType([T.StructField(c, T.StringType()) for c in ("instruction", "input", "output", "question", "response", "answer")])
QA = T.StructType([
    T.StructField("context", T.StringType()), T.StructField("question", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("answers", T.StructType([
        T.StructField("answer_start", T.ArrayType(T.IntegerType())), T.StructField("text", T.ArrayType(T.StringType())),
    ])),
])


def read_text_array(spark: SparkSession, path: str) -> DataFrame:
    """(file, sample_id, text) of files that each hold one JSON array of strings (or nulls); a large file is read by many tasks."""
    return array_elements(spark, path).select(F.col("name").alias("file"), F.col("at").cast("int").alias("sample_id"), "text")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = LABELLED) -> DataFrame:
    """One object a line; lines that don't parse keep their text in ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def read_client_map(spark: SparkSession, path: str) -> DataFrame:
    """(client_id, pos, text) of JSON objects client -> list of strings (or nulls); a large object is read by many tasks."""
    return client_elements(spark, path)


def read_csv_corpus(spark: SparkSession, path: str, columns=("text", "label1", "label2")) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape="\\", multiLine=True)


def write_csv_corpus(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, quote='"', escape="\\")


def read_qa_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Standard rows of question answering; text = question + [SEP] + context."""
    rows = spark.read.schema(QA).parquet(path)
    return rows.select("id", "title", "question", "context", F.concat_ws("[SEP]", "question", "context").alias("text"), "answers")


def read_or_build(spark: SparkSession, path: str, builder: Callable[[], DataFrame], rows: int | None = None) -> DataFrame:
    """The table at ``path``, built and written once; a different number of rows than expected is an error."""
    try:
        found = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        builder().write.parquet(path)
        found = spark.read.parquet(path)
    if rows is not None and found.count() != rows:
        raise ValueError(f"{path} doesn't hold {rows} rows")
    return found


def append_round(df: DataFrame, path: str, round_no: int) -> None:
    """Write the rows of one round; writing the round again replaces it, so a retry doesn't duplicate."""
    rows = df.drop("round").withColumn("round", F.lit(round_no))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(path)


def write_client_shards(df: DataFrame, path: str, client="client_id", files_per_client: int = 1) -> None:
    """JSON lines in one folder a client; several files share a large client."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(files_per_client))
    df.withColumn("__s", salt).repartition(client, "__s").drop("__s").write.mode("overwrite").partitionBy(client).json(path)


def merge_by_file_name(spark: SparkSession, root: str, schema: T.StructType = PAIR) -> DataFrame:
    """Rows of all sub-folders with ``file_name``; a file may hold one JSON list or JSON lines."""
    whole = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    parts = F.when(F.startswith(text, F.lit("[")), F.from_json(text, T.ArrayType(schema))).otherwise(
        F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, schema)))
    return whole.select(F.col("_metadata.file_name").alias("file_name"), F.explode(parts).alias("r")).select("file_name", "r.*")


def read_run_log(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(file, line, keys): values of ``key=value`` in each line; null where a key is missing."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    value = lambda k: F.nullif(F.regexp_extract("line", rf"{k}=([^,\s]+)", 1), F.lit(""))
    return rows.select("file", "line", *[value(k).alias(k) for k in keys])


def label_from_path(path: Column) -> Column:
    """The label in square brackets of a file name; null without one."""
    return F.nullif(F.regexp_extract(path, r"\[(.+)\]", 1), F.lit(""))


def save_rejects(df: DataFrame, good: Column, path: str) -> tuple[DataFrame, DataFrame]:
    from ..operators.filters import passed_and_failed

    return passed_and_failed(df, good, path)
