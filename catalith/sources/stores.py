"""Stores by key: texts by content hash, and recorded interactions by the digest of their request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions import hashing as H


def put_artifacts(pages: DataFrame, path: str) -> None:
    """Append texts that the store lacks: (sha, text), partitioned by the first two digits of the hash."""
    new = pages.select(H.sha256("text").alias("sha"), "text").where("text IS NOT NULL")
    first = new.withColumn("rn", F.row_number().over(Window.partitionBy("sha").orderBy(F.lit(1)))).where("rn = 1").drop("rn")
    have = _stored(pages.sparkSession, path)
    if have is not None:
        first = first.join(have.select("sha"), "sha", "left_anti")
    first.withColumn("prefix", F.substring("sha", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema("sha string, text string, prefix string").parquet(path)


def load_artifacts(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted (sha) with text and status: OK, MISSING, or CORRUPT where the text no longer has its hash."""
    have = spark.read.schema("sha string, text string, prefix string").parquet(path).select("sha", "text")
    rows = wanted.select("sha").distinct().join(have, "sha", "left")
    status = F.when(F.col("text").isNull(), "MISSING").when(H.sha256("text") != F.col("sha"), "CORRUPT").otherwise("OK")
    return rows.withColumn("status", status)


def request_key(fields: dict):
    """The digest of a request's fields (columns by name)."""
    return H.digest(fields)


def replay(requests: DataFrame, records: DataFrame) -> DataFrame:
    """requests (key) with response and outcome HIT or MISS; of several records of a key the latest counts. A miss is never a live call."""
    last = records.groupBy("key").agg(F.max_by("response", F.struct("captured_at", "response")).alias("response"))
    return requests.join(last, "key", "left").withColumn("outcome", F.when(F.col("response").isNull(), "MISS").otherwise("HIT"))
