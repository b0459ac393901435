"""Exact deduplication against a persistent digest index.

The index is a table of SHA-256 digests, bucketed and sorted by digest. New rows are first
pre-aggregated by digest (map-side combine, so a digest shared by a third of the rows costs one
row a task), then compared with the index by a sort-merge anti-join, and what is new is appended.
The bucketed side is read without a shuffle.

Each batch is kept under its name: giving the same batch again (after a failure) adds nothing and
answers as before.

Defined cases: a null text counts as the empty text; repeated rows (same id, same text) form one
group and all carry the same answer; of equal texts the row with the largest id (or the smallest,
``keep="first"``) stays; an empty input gives an empty result; extra columns are ignored by
``exact_groups`` and kept by ``new_rows``; a null id counts as the largest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise

NO_ID = (1 << 63) - 1


def text_digest(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class DigestIndex:
    """Digests seen so far: (digest, keep_id, group_size, batch), in ``buckets`` buckets sorted by digest.

    ``path`` is a folder shared by the cluster; opened again later, it holds all that was appended. The number
    of buckets is written beside the digests when the folder is first used and followed ever after, whatever
    ``buckets`` or the session's shuffle setting says by then: files dealt by one number can't be read by another.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = f"digest_index_{uuid.uuid4().hex}"
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if path:
            noted = f"{path.rstrip('/')}/buckets"
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("ignore").parquet(noted)
            buckets = spark.read.schema("buckets int").parquet(noted).first()[0]
        where = f"LOCATION '{path.rstrip('/')}/digests'" if path else ""
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS {where}"
        )
        self.buckets = buckets

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Append ``groups`` (digest, keep_id, group_size; one row a digest) under a name; what the batch has added before is left out."""
        own = self.table().filter(F.col("batch") == batch).select("digest")
        fresh = groups.join(own.hint("merge"), "digest", "left_anti")
        (
            fresh.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .format("parquet")
            .saveAsTable(self.name)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digest_groups(digests: DataFrame, keep: str = "last") -> DataFrame:
    """One row a digest of (digest, id): the id that stays and the number of rows."""
    pick = F.max if keep == "last" else F.min
    return digests.groupBy("digest").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _keyed(id_col: str, text_col: str) -> list[Column]:
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id")
    return [key, F.unhex(text_digest(F.col(f"`{text_col}`"))).alias("digest")]


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "last",
    index: DigestIndex | None = None,
    batch: str | None = None,
) -> DataFrame:
    """For each row: (id, digest, keep_id, group_size, kept), after adding the batch to ``index``.

    With a filled index, group_size counts the rows of all its batches and keep_id is chosen among them.
    Digests that hold at least 1/512 of all rows number 512 at most; these are answered by a
    broadcast of that proven size, so no task receives a hot digest's rows. All others meet the
    bucketed index in a sort-merge join. The result is a table of its own, so the index can go.
    """
    own = DigestIndex(docs.sparkSession) if index is None else index
    digests = materialise(docs.select(*_keyed(id_col, text_col)))
    groups = materialise(digest_groups(digests, keep))
    own.append(groups, batch or uuid.uuid4().hex)
    rows = digests.count()
    hot_keys = groups.filter(F.col("group_size") > max(64, rows // 512)).select("digest")
    pick = F.max if keep == "last" else F.min
    known = own.table().groupBy("digest").agg(pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    hot = known.join(F.broadcast(hot_keys), "digest", "left_semi")
    answered = digests.join(F.broadcast(hot), "digest", "left")
    cold = answered.filter("keep_id IS NULL").select("id", "digest").join(known.hint("merge"), "digest")
    names = ["id", "digest", "keep_id", "group_size"]
    every = answered.filter("keep_id IS NOT NULL").select(*names).unionByName(cold.select(*names))
    every = every.withColumn("kept", F.col("id") == F.col("keep_id"))
    every = materialise(every.withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in ("id", "keep_id")}))
    if index is None:
        own.drop()
    return every


def new_rows(
    docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", keep: str = "first", batch: str | None = None
) -> DataFrame:
    """The rows of a new batch that are neither in the index nor a copy within the batch; the index then holds them.

    ``batch`` names the batch: given again, it is compared with the other batches only, so a rerun returns the
    same rows. Without a name each call is a batch of its own. All columns are kept, also such as are named like
    the index's. Of rows repeated with the same id and text one stays.
    """
    batch = batch or uuid.uuid4().hex
    key, digest = _keyed(id_col, text_col)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(key.alias("__id"), digest.alias("__digest"), whole)
    groups = materialise(digest_groups(rows.select(F.col("__id").alias("id"), F.col("__digest").alias("digest")), keep))
    known = index.table().filter(F.col("batch") != batch).select("digest").hint("merge")
    fresh = groups.join(known, "digest", "left_anti")
    fresh = materialise(fresh.select(F.col("keep_id").alias("__id"), F.col("digest").alias("__digest")))
    index.append(groups, batch)
    return rows.join(fresh, ["__id", "__digest"], "left_semi").dropDuplicates(["__id", "__digest"]).select("__row.*")
