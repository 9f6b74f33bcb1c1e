"""Session construction for tests and the bench.

On a cluster the session comes from the launcher and already names a shared
``spark.checkpoint.dir``; this module only fills settings that are unset.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",   # no call-site lookup for every column expression
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "pitchside") -> SparkSession:
    """Return the active session, or build a local one for tests and the bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    master = master or os.environ.get("PITCHSIDE_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", os.environ.get("PITCHSIDE_DRIVER_MEMORY", "8g"))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names it; only when it is unset (local tests) is a fresh scratch
    folder created and registered.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            # A machine-local folder is not shared by executors: refuse rather than guess.
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="pitchside-ckpt-")
        spark.sparkContext.setCheckpointDir(path)
    return path
