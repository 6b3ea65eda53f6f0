"""A store of texts by content hash that can delete.

Texts lie in partitions by the first two digits of their hash (see catalith.sources.stores). A deletion is a
tombstone beside the store and holds at once for every reader. purge() then rewrites the partitions
that tombstones touch, and no others: what stays of them is staged whole beside the store before
anything is overwritten, so a purge that breaks off is taken up again from its stage and loses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import hashing as H
from catalith.sources import artifacts as A
from catalith.sources.stores import put_artifacts

STORED = "sha string, text string, prefix string"


class StoreError(RuntimeError):
    """The store may not be changed, or a hash is none."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _fs(spark, path)
    return fs.exists(hadoop)


def _delete(spark: SparkSession, path: str) -> None:
    fs, hadoop = _fs(spark, path)
    fs.delete(hadoop, True)


def _tombstones(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.schema("sha string").parquet(f"{path}-deleted").distinct() if _exists(spark, f"{path}-deleted") else None


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(sha, text) of what the store holds, without what was deleted."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "sha string, text string")
    have, gone = spark.read.schema(STORED).parquet(path).select("sha", "text"), _tombstones(spark, path)
    return have if gone is None else have.join(gone, "sha", "left_anti")


def put(texts: DataFrame, path: str, writable: bool = True) -> None:
    """Store texts (text) that the store lacks; one that was deleted comes back. A second call with the same texts changes nothing."""
    if not writable:
        raise StoreError("READ_ONLY")
    spark = texts.sparkSession
    gone = _tombstones(spark, path)
    if _exists(spark, f"{path}-purge") or (gone is not None and not texts.select(H.sha256("text").alias("sha")).join(gone, "sha", "left_semi").isEmpty()):
        purge(spark, path)
    put_artifacts(texts.select("text"), path)


def ingest(pages: DataFrame, id_col: str, path: str, writable: bool = True, **limits) -> DataFrame:
    """Read pages within their limits, store those that are sound, and say of each how it went: (id_col, sha256, status), status STORED or why not."""
    found = A.read_artifacts(pages, id_col, **limits).select(id_col, "sha256", "status")
    put(pages.join(found.where("status = 'PARSED'").select(id_col), id_col, "left_semi").select(F.col("html").alias("text")), path, writable)
    return found.withColumn("status", F.when(F.col("status") == "PARSED", "STORED").otherwise(F.col("status")))


def delete(hashes: DataFrame, path: str, writable: bool = True) -> None:
    """Delete texts by their hash (sha); hashes that the store doesn't hold do no harm, what is no hash stops the call."""
    if not writable:
        raise StoreError("READ_ONLY")
    rows = hashes.select("sha").distinct()
    if not rows.where(~F.coalesce(H.is_sha256("sha"), F.lit(False))).isEmpty():
        raise StoreError("NOT_A_HASH")
    rows.write.mode("append").parquet(f"{path}-deleted")


def purge(spark: SparkSession, path: str) -> list[str]:
    """Remove deleted texts for good and forget their tombstones; the prefixes (at most 256) whose files were rewritten."""
    stage, gone = f"{path}-purge", _tombstones(spark, path)
    if gone is None and not _exists(spark, f"{stage}/_SUCCESS"):
        return []
    if not _exists(spark, f"{stage}/_SUCCESS"):
        _delete(spark, stage)
        have = spark.read.schema(STORED).parquet(path)
        touched = have.join(gone, "sha", "left_semi").select("prefix").distinct()
        kept = have.join(F.broadcast(touched), "prefix", "left_semi").join(gone, "sha", "left_anti").select("sha", "text", "prefix", F.lit(True).alias("kept"))
        # A row for each prefix, so that one of which nothing stays is known from the stage as well.
        marks = touched.select(F.lit(None).cast("string").alias("sha"), F.lit(None).cast("string").alias("text"), "prefix", F.lit(False).alias("kept"))
        kept.unionByName(marks).write.mode("overwrite").parquet(stage)
    staged = spark.read.schema(f"{STORED}, kept boolean").parquet(stage)
    prefixes = sorted(r.prefix for r in staged.where("NOT kept").select("prefix").distinct().collect())
    left = staged.where("kept").drop("kept")
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(path)
    filled = {r.prefix for r in left.select("prefix").distinct().collect()}
    for prefix in prefixes:
        if prefix not in filled:
            _delete(spark, f"{path}/prefix={prefix}")
    _delete(spark, f"{path}-deleted")
    _delete(spark, stage)
    return prefixes
