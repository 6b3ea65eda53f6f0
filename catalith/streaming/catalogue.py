"""The catalogue stages on a stream of files. They keep no state, so the batch functions run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators import catalogue as C


def decisions(rows: DataFrame, cues, precedence=()) -> DataFrame:
    """Clean, parse, decide and classify; the same for a batch and a stream."""
    return C.parse_manufacturer(C.brand_consensus(C.cleaned(C.classify(rows, cues, precedence))))


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """New delimited files of a folder as catalogue rows; a short record's missing fields are empty."""
    schema = ", ".join(f"{c} string" for c in C.FIELDS)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).csv(folder, header=True, quote='"', escape='"', multiLine=True)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in C.FIELDS])


def write_decisions(rows: DataFrame, out: str, checkpoint: str, cues, precedence=()):
    """Append decided rows as Parquet, each file once, and stop when the folder is read through."""
    return decisions(rows, cues, precedence).drop("candidates").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, kind: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by time window and kind; rows later than `late` behind the newest are dropped, which is the watermark's meaning."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
