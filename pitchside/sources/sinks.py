"""Result sinks: publish an operator's output as a table with whole versions.

``<path>/data-<id>/`` holds the files of one version and ``<path>/_versions/<number>.json`` names it. The folder is written first, the
number file last; it appears whole and never changes. Readers follow the largest number, so they see the old version or
the new one, never a mixture, and a write that dies leaves nothing but a folder that nobody reads.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pitchside.sources import files

#: Versions that stay readable, and the age from which a folder that no version names counts as left behind.
KEEP, ORPHAN_HOURS = 3, 24.0


def versions(spark: SparkSession, path: str) -> list[dict]:
    """What each published version says of itself (number, folder, format, schema, note), oldest first."""
    names = sorted(n for n in files.listing(spark, f"{path}/_versions") if n.endswith(".json") and n[:-5].isdigit())
    return [json.loads(files.read_text(spark, f"{path}/_versions/{n}")) for n in names]


def _newest(spark: SparkSession, path: str) -> int:
    return max((int(n[:-5]) for n in files.listing(spark, f"{path}/_versions") if n.endswith(".json") and n[:-5].isdigit()), default=0)


def publish(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
            keep: int = KEEP, note: str | None = None) -> int:
    """Publish ``df`` as the next version of the table at ``path`` (the re-aim of the dashboard's rendered tables); its number.

    The executors write, task by task, with Spark's commit protocol. Two writers at once both publish, one after the other.
    Versions older than the last ``keep`` expire (0: none does).
    """
    spark, folder = df.sparkSession, f"data-{uuid.uuid4().hex}"
    writer = df.write.format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(f"{path}/{folder}")
    said = {"folder": folder, "format": fmt, "schema": df.schema.jsonValue(), "note": note}
    number = _newest(spark, path)
    while True:
        number += 1
        try:
            files.write_new(spark, f"{path}/_versions/{number:020d}.json", json.dumps({"number": number} | said))
            break
        except FileExistsError:
            continue
    if keep:
        expire(spark, path, keep)
    return number


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version of the table at ``path``, or the one of that number; missing: ``FileNotFoundError``."""
    number = _newest(spark, path) if version is None else version
    entry = f"{path}/_versions/{number:020d}.json"
    if not number or not files.exists(spark, entry):
        raise FileNotFoundError(f"no published version {version or ''} at {path}")
    said = json.loads(files.read_text(spark, entry))
    return spark.read.schema(T.StructType.fromJson(said["schema"])).format(said["format"]).load(f"{path}/{said['folder']}")


def expire(spark: SparkSession, path: str, keep: int = KEEP, orphan_hours: float = ORPHAN_HOURS) -> None:
    """Remove all versions but the last ``keep`` (at least one), and folders left by dead writes for over ``orphan_hours``."""
    known = versions(spark, path)
    for old in known[: -max(1, keep)]:
        files.remove(spark, f"{path}/_versions/{old['number']:020d}.json")   # first the name, then the data
        files.remove(spark, f"{path}/{old['folder']}")
    named, before = {v["folder"] for v in known}, (time.time() - orphan_hours * 3600) * 1000
    for name, (_, changed) in files.listing(spark, path).items():
        if name.startswith("data-") and name not in named and changed < before:
            files.remove(spark, f"{path}/{name}")
