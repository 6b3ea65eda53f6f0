"""Interactions with a provider, recorded once and replayed from the record.

A store of records has a partition for each batch of a run. Writing a batch overwrites its own partition and no
other, so a batch that a stream gives twice leaves the same records, and a broken write is
mended by the next try. Failures are records like answers. Readers see one record a key: the latest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import hashing as H
from catalith.sources.artifactstore import StoreError

RECORD = "key string, outcome string, response string, error_type string, error_message string, latency double, captured_at timestamp"
MODES = ("REPLAY", "RECORD")


class RecordedError(RuntimeError):
    """A provider failed; the failure is in the store."""


def require_mode(mode: str) -> str:
    """REPLAY or RECORD; a run may not be asked to be both."""
    if mode not in MODES:
        raise ValueError(f"mode {mode} can't be requested; one of {', '.join(MODES)}")
    return mode


def latest(records: DataFrame) -> DataFrame:
    """One record for each key: that captured last; of those captured at once, the one that is greatest in its fields."""
    fields = [c.split()[0] for c in RECORD.split(", ") if not c.startswith("key ")]
    order = F.struct("captured_at", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("outcome", "response", "error_type", "error_message")))
    return records.groupBy("key").agg(F.max_by(F.struct(*fields), order).alias("r")).select("key", "r.*")


def scrubbed(answers: DataFrame) -> DataFrame:
    """Answers (key, response, error_type, error_message, latency, and captured_at if known) as records, without secrets."""
    at = F.col("captured_at") if "captured_at" in answers.columns else F.current_timestamp()
    failed = F.col("error_type").isNotNull()
    return answers.select(
        "key", F.when(failed, "error").otherwise("success").alias("outcome"), F.when(~failed, H.redact_text("response")).alias("response"), "error_type", F.when(failed, H.redact_text(F.coalesce("error_message", F.lit("")))).alias("error_message"),
        F.greatest(F.coalesce(F.col("latency").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("latency"), at.cast("timestamp").alias("captured_at"),
    )


def record(answers: DataFrame, path: str, batch: str, writable: bool = True, fail: bool = False) -> None:
    """Write a batch of answers, one record a key. With fail, failures are raised once they are written."""
    if not writable:
        raise StoreError("READ_ONLY")
    rows = latest(scrubbed(answers)).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    if fail and (bad := recorded(answers.sparkSession, path, batch).where("outcome = 'error'").orderBy("key").take(1)):
        raise RecordedError(f"{bad[0].key}: {bad[0].error_type}: {bad[0].error_message}")


def recorded(spark: SparkSession, path: str, batch: str | None = None) -> DataFrame:
    """The records of a store, one a key, or those of one batch."""
    rows = spark.read.schema(f"{RECORD}, batch string").parquet(path)
    return latest(rows if batch is None else rows.where(F.col("batch") == batch))


def replayed(requests: DataFrame, records: DataFrame, strict: bool = False) -> DataFrame:
    """requests (key) with response, outcome (HIT, ERROR, MISS), error_type and error_message; never a live call.

    With strict, a recorded failure is raised again by the job that reads it, and so is a miss.
    """
    df = requests.join(latest(records).select("key", F.col("outcome").alias("_outcome"), "response", "error_type", "error_message"), "key", "left")
    outcome = F.when(F.col("_outcome").isNull(), "MISS").when(F.col("_outcome") == "error", "ERROR").otherwise("HIT")
    if strict:
        said = F.when(F.col("_outcome").isNull(), F.concat(F.lit("no record of "), "key")).otherwise(F.concat_ws(": ", F.lit("recorded failure"), "error_type", "error_message"))
        outcome = F.when(F.coalesce(F.col("_outcome") == "success", F.lit(False)), "HIT").otherwise(F.raise_error(said).cast("string"))
    return df.withColumn("outcome", outcome).drop("_outcome")


def run_interactions(requests: DataFrame, path: str, mode: str, answer: Callable[[DataFrame], DataFrame] | None = None, batch: str = "0", writable: bool = True, strict: bool = False) -> DataFrame:
    """requests (key, ...) with their outcomes: from the store alone (REPLAY), or answered, recorded and then read back (RECORD)."""
    if require_mode(mode) == "RECORD":
        if answer is None:
            raise ValueError("RECORD needs something that answers")
        record(answer(requests), path, batch, writable)
    return replayed(requests, recorded(requests.sparkSession, path), strict)


def record_stream(requests: DataFrame, path: str, checkpoint: str, answer: Callable[[DataFrame], DataFrame], run: str, writable: bool = True):
    """Answer and record a stream of requests by batch, and stop when it is read through; a run that begins again overwrites its own batches."""
    if not writable:
        raise StoreError("READ_ONLY")

    def each(rows: DataFrame, number: int) -> None:
        record(answer(rows), path, f"{run}-{number:09d}")

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
