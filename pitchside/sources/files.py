"""Small files and folders through Hadoop's file system, so that any store Spark reads will do."""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def listing(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Name -> (bytes, time of change in ms) of what lies in a folder; nothing for a missing one."""
    fs, target = _at(spark, path)
    if not fs.exists(target):
        return {}
    return {s.getPath().getName(): (s.getLen(), s.getModificationTime()) for s in fs.listStatus(target)}


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _at(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A new file that appears whole: written under a hidden name, then renamed. An existing one raises ``FileExistsError``."""
    fs, target = _at(spark, path)
    folder, _, name = path.rpartition("/")
    _, aside = _at(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = fs.create(aside)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)
