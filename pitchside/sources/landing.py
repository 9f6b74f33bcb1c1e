"""Landing folders: documents that arrive in generations.

``<root>/data/<version>-<id>/`` holds the documents of one generation, ``<root>/manifests/<version>.json`` says that it is
complete: its kind and every file with its size. The manifest is written last and appears whole, so a generation that is
still landing, was given up or has lost a file is not there for readers. A ``snapshot`` is the whole truth at its time: what it does not hold is
gone. ``changes`` hold only rows that came or changed since. The current rows are those of the newest complete snapshot and of
the complete changes after it, the newest of each key.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchside.sources import files

SNAPSHOT, CHANGES = "snapshot", "changes"
#: Rows of a document; a JSON document is read by one task.
ROWS_PER_DOCUMENT = 5_000
MANIFEST = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("folder", T.StringType()),
    T.StructField("files", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("bytes", T.LongType())])))])


@dataclass(frozen=True)
class Generation:
    version: int
    kind: str
    paths: tuple[str, ...]


def is_landing(spark: SparkSession, root: str) -> bool:
    """Whether ``root`` is a landing folder (a path with a wildcard or a single document is none)."""
    return not any(c in root for c in "*?[{") and files.exists(spark, f"{root}/manifests")


def _manifests(spark: SparkSession, root: str) -> dict[int, str]:
    found = files.listing(spark, f"{root}/manifests")
    return {int(n[:-5]): f"{root}/manifests/{n}" for n in found if n.endswith(".json") and n[:-5].isdigit()}


def _complete(spark: SparkSession, root: str, manifest: str) -> Generation | None:
    said = json.loads(files.read_text(spark, manifest))
    folder = f"{root}/data/{said['folder']}"
    there = files.listing(spark, folder)
    if any(there.get(f["name"], (None, 0))[0] != f["bytes"] for f in said["files"]):
        return None
    return Generation(said["version"], said["kind"], tuple(f"{folder}/{f['name']}" for f in said["files"]))


def current(spark: SparkSession, root: str, upto: int | None = None) -> list[Generation]:
    """The newest complete snapshot, then the complete changes after it, in order; no generation after ``upto``. None: empty."""
    found: list[Generation] = []
    manifests = _manifests(spark, root)
    for version in sorted(manifests, reverse=True):
        if upto is not None and version > upto:
            continue
        generation = _complete(spark, root, manifests[version])
        if generation is not None:
            found.append(generation)
            if generation.kind == SNAPSHOT:
                return found[::-1]
    return []   # changes without a snapshot below them are changes of nothing known


def documents(spark: SparkSession, schema: T.StructType, paths: list[str], corrupt: str) -> DataFrame:
    """The documents at ``paths`` with their text in ``corrupt`` if it is not of this shape, and ``_landed``, ascending as they landed."""
    shape = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    read = spark.read.schema(shape).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
    version = F.regexp_extract("_metadata.file_path", r"/data/([0-9]{20})-[^/]+/[^/]+$", 1)
    landed = F.struct(version.alias("version"), F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"))
    return read.json(paths).select(*schema.names, corrupt, landed.alias("_landed"))


def newest_per_key(rows: DataFrame, row: str, order: Column, key: str = "id") -> DataFrame:
    """One struct ``row`` per key, that of the largest ``order``; rows without a key are left out. One aggregate with map-side combine."""
    rows = rows.filter(F.col(f"{row}.{key}").isNotNull())
    return rows.groupBy(F.col(f"{row}.{key}").alias("_key")).agg(F.max_by(row, order).alias(row)).select(f"{row}.*")


def parts_of(df: DataFrame, rows_per_document: int = ROWS_PER_DOCUMENT) -> Column:
    """The document that a row goes to: as many documents as the rows need, whatever their number."""
    count = max(1, math.ceil(df.count() / rows_per_document))
    return F.pmod(F.xxhash64(*df.columns), F.lit(count)).alias("_part")


def write_documents(texts: DataFrame, root: str, kind: str, version: int) -> str:
    """The text column ``value`` as one document a row in a new folder; its name. Without a manifest nobody reads it."""
    folder = f"{version:020d}-{uuid.uuid4().hex}"
    texts.select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/data/{folder}")
    return folder


def land(texts: DataFrame, root: str, kind: str = SNAPSHOT) -> int:
    """Land the documents in the column ``value`` as one generation; its version, one after the newest."""
    if kind not in (SNAPSHOT, CHANGES):
        raise ValueError(f"kind must be {SNAPSHOT} or {CHANGES}")
    spark = texts.sparkSession
    version = max(_manifests(spark, root), default=0) + 1
    folder = write_documents(texts, root, kind, version)
    there = files.listing(spark, f"{root}/data/{folder}")
    listed = [{"name": n, "bytes": size} for n, (size, _) in sorted(there.items()) if n[0] not in "._"]
    said = {"version": version, "kind": kind, "folder": folder, "files": listed}
    files.write_new(spark, f"{root}/manifests/{version:020d}.json", json.dumps(said))   # fails if another writer took this version
    return version


def expire(spark: SparkSession, root: str) -> None:
    """Remove what no reader needs any more: generations before the current snapshot. Folders without a manifest stay, they may be landing."""
    needed = current(spark, root)
    for version, path in _manifests(spark, root).items():
        if needed and version < needed[0].version:
            folder = json.loads(files.read_text(spark, path))["folder"]
            files.remove(spark, path)
            files.remove(spark, f"{root}/data/{folder}")
