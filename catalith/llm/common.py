"""Reading input tables and settling intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for sessions that name no shared folder (tests on one machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
_WRITTEN: list[tuple[SparkSession, str, int]] = []
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bits of a row's place in its file.
FILE_BITS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder in spark.checkpoint.dir; on one machine, where it names none, one of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


def _path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/catalith-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, folder, os.getpid()))
    return f"{folder}/{name}"


def forget_settled() -> None:
    """Delete what this process has settled; for when all results that read it are written. Done at the process's end too."""
    while _WRITTEN:
        spark, folder, pid = _WRITTEN.pop()
        if pid != os.getpid():  # a copy of the process that wrote it
            continue
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        forget_settled()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    The lineage ends at the files, so a lost executor costs only the task that
    reads them, and values drawn while writing (partition numbers, row numbers)
    are the same for every later reader.
    """
    spark = df.sparkSession
    path = _path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_scan(docs: DataFrame) -> bool:
    """Whether docs are columns of files as they are read, with nothing between that may change the rows or their order, and rows know their place."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project" and plan.deterministic():
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:  # no files, or of a format whose rows have no place
        return False
    return True


def numbered(docs: DataFrame) -> DataFrame:
    """(doc, rid): the rows of docs, and a number of each row's own: that of its file, and its place in the file.

    How Spark packs files into partitions depends on the executors alive when a
    plan is made, but a row's place in its file does not, so all plans over docs
    give a row the same rid, and files need not be written again to number their
    rows. Paths reach the driver, which lists them in any case.
    """
    if not is_scan(docs):
        docs = settle(docs, "plain")
    place = docs.metadataColumn("_metadata")
    rows = docs.select(F.struct("*").alias("doc"), place["file_path"].alias("file"), place["row_index"].alias("at"))
    paths = sorted(r.file for r in rows.select("file").distinct().collect())
    files = docs.sparkSession.createDataFrame([(p, i << FILE_BITS) for i, p in enumerate(paths)], "file string, base long")
    return rows.join(F.broadcast(files), "file").select("doc", (F.col("base") + F.col("at")).alias("rid"))


def settle_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """settle(), in buckets by key: readers that group or cogroup by the key need no exchange.

    The table has a name only until it is read back; its files are outside the
    warehouse and stay.
    """
    spark = df.sparkSession
    path, known_as = _path(spark, name), f"catalith_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(known_as)
    out = spark.table(known_as)
    spark.sql(f"DROP TABLE {known_as}")
    return out


_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembers(owner: str, clear: Callable[[], None]) -> None:
    """Say how to drop what an operator's tasks keep in their worker for its next tasks."""
    _REMEMBERED[owner] = clear


def begins(owner: str) -> None:
    """A task of this operator begins: drop what the tasks of others have left in its worker, which serves many stages."""
    for name, clear in _REMEMBERED.items():
        if name != owner:
            clear()
    trim()


def slices(batches, rows: int = 512):
    """Arrow batches in parts of few rows, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trim()


def parts(batches, size: int):
    """Arrow batches in parts of about so many bytes of text; a text is in one part."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)) + 1
            yield batch.slice(at, upto - at)
            at = min(upto, batch.num_rows)
    trim()


def trim() -> None:
    """Give back what a task has freed: its worker lives on for other tasks, and other stages' libraries."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)
