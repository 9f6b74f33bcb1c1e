"""Materialise an intermediate table as parquet in the shared checkpoint folder.

Used for a derived table that several branches of one plan read (the player
table feeds the main projection and every table-wide scalar). Writing it once
cuts the lineage — a lost executor re-reads shared files instead of
recomputing the wide join — and later scans still get column pruning and
filter pushdown, which an RDD checkpoint would not give.

A ``Staging`` removes its own tables when closed. What is left goes when the
Python process ends, if its session still runs.
"""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from pitchside.session import checkpoint_dir

_left: list[tuple[SparkSession, str]] = []
_owners: list[Staging] = []


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _write(df: DataFrame, name: str) -> str:
    path = os.path.join(checkpoint_dir(df.sparkSession), "pitchside-stage", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = _write(df, name)
    _left.append((df.sparkSession, path))
    return df.sparkSession.read.parquet(path)


class Staging:
    """Tables staged for one owner, removed together by ``close``."""

    def __init__(self) -> None:
        self._paths: list[tuple[SparkSession, str]] = []
        _owners.append(self)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = _write(df, name)
        self._paths.append((df.sparkSession, path))
        return df.sparkSession.read.parquet(path)

    def folder(self, spark: SparkSession, name: str) -> str:
        """A new folder name in the shared folder, for files of the owner's own."""
        path = os.path.join(checkpoint_dir(spark), "pitchside-stage", f"{name}-{uuid.uuid4().hex}")
        self._paths.append((spark, path))
        return path

    def close(self) -> None:
        """Remove the tables; plans over them can no longer run."""
        while self._paths:
            _remove(*self._paths.pop())


@atexit.register
def _remove_left() -> None:
    for spark, path in [*_left, *(x for owner in _owners for x in owner._paths)]:
        sc = spark.sparkContext
        if sc._jsc is None or sc._gateway is None or sc._jsc.sc().isStopped():
            continue
        _remove(spark, path)
