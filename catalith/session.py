"""Session settings shared by tests, the benchmark and ad-hoc use."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid

from pyspark.sql import SparkSession

#: Only for sessions that name no shared folder (tests on one machine).
LOCAL_FOLDER = "/tmp/checkpoints"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's spark.checkpoint.dir, for files that a query writes and reads again; deleted when the process ends."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder, owner = f"{(named or LOCAL_FOLDER).rstrip('/')}/catalith-{uuid.uuid4().hex}", os.getpid()

    def forget() -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            if os.getpid() == owner:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(forget)
    return f"{folder}/{name}"


def local_session(cpus: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, ANSI)."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    } | extra
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("catalith").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
