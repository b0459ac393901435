"""Registration of queries, and the derived inputs that several of them share (Spark and SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keyed, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEED = "fixture"


def case(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def u_sql(key: str, draw: str = "0", seed: str = SEED) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', '{seed}', ({key})::VARCHAR, ({draw})::VARCHAR)), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def u(key, draw=0, seed: str = SEED):
    return keyed.uniform(seed, F.col(key) if isinstance(key, str) else key, draw)


def r6(c):
    return F.round(c, 6)


def split_embeddings(spark, d):
    """(private, candidates): a candidate where vec_id divides by 5; source_model = vec_id mod 3, party = vec_id mod 7."""
    e = read(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        "embedding",
        "label",
        (F.col("vec_id") % 3).alias("source_model"),
        (F.col("vec_id") % 7).alias("party"),
    )
    return e.filter("id % 5 <> 0"), e.filter("id % 5 = 0")


EMB_SQL = """emb AS (SELECT vec_id AS id, embedding, label, vec_id % 3 AS source_model, vec_id % 7 AS party FROM embeddings),
priv AS (SELECT * FROM emb WHERE id % 5 <> 0), cand AS (SELECT * FROM emb WHERE id % 5 = 0)"""


def sq_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def cos_sql(a: str, b: str) -> str:
    return f"({dot_sql(a, b)} / (sqrt({dot_sql(a, a)}) * sqrt({dot_sql(b, b)})))"


def scores(spark, d):
    """(model_id, idx, source_model, label, prob, pred) for models 0..3: softmax of four coordinates; label mod 4 is true."""
    e = read(spark, d, "embeddings")
    parts = [
        e.select(
            F.lit(m).alias("model_id"),
            F.col("vec_id").alias("idx"),
            (F.col("vec_id") % 3).alias("source_model"),
            (F.col("label") % 4).alias("label"),
            vectors.softmax(F.slice("embedding", 4 * m + 1, 4)).alias("prob"),
        )
        for m in range(4)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("pred", vectors.argmax(F.col("prob")))


SCORES_SQL = """ex AS (
  SELECT m AS model_id, vec_id AS idx, vec_id % 3 AS source_model, label % 4 AS label,
    list_transform(embedding[4 * m + 1:4 * m + 4], lambda x: x::DOUBLE) AS v
  FROM embeddings, (SELECT unnest(range(4))::INT AS m)),
ex2 AS (SELECT *, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM ex),
scores AS (
  SELECT model_id, idx, source_model, label, list_transform(e, lambda x: x / list_sum(e)) AS prob,
    (list_position(v, list_max(v)) - 1)::INT AS pred FROM ex2)"""


def candidates(spark, d):
    """Answers to questions: question = source, reward and ppl keyed by doc_id."""
    docs = read(spark, d, "documents")
    return docs.select(
        F.col("source").alias("question"),
        F.col("doc_id").alias("pos"),
        F.col("text").alias("response"),
        u("doc_id", 1).alias("reward"),
        (1 + 9 * u("doc_id", 2)).alias("ppl"),
    )


CAND_SQL = f"""answers AS (
  SELECT source AS question, doc_id AS pos, text AS response, {u_sql('doc_id', '1')} AS reward,
    1 + 9 * {u_sql('doc_id', '2')} AS ppl FROM documents)"""


def pairs(spark, d):
    """User turns with the assistant turn that follows."""
    c = read(spark, d, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    return c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q")).join(a, ["conv_id", "turn"])


PAIRS_SQL = """pairs AS (
  SELECT x.conv_id, x.turn, x.text AS q, a.text AS r FROM conversations x
  JOIN conversations a ON a.conv_id = x.conv_id AND a.turn = x.turn + 1 WHERE x.role = 'user' AND a.role = 'assistant')"""
