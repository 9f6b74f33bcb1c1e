"""Landed JSON documents: the bootstrap snapshot and the fixtures list.

The reference fetches both over HTTP at start-up; here they are files already
landed in storage (one document per file, read in parallel, one task per file
since a JSON document cannot be split). What belongs together is a generation of
a landing folder (``landing``). Schemas are declared, never inferred. Each
source is parsed once and staged; its tables are read from the staged copy.
"""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchside.operators.fixtures import empty_upcoming, upcoming_fixtures
from pitchside.sources import files, landing, schemas
from pitchside.sources.stage import Staging, stage

CORRUPT = "_corrupt"


def _read_json(spark: SparkSession, schema: T.StructType, path: str, upto: int | None = None) -> DataFrame | None:
    """Documents with what landed when, unparsable text in CORRUPT; ``None`` for a missing path or nothing complete in it."""
    paths, single = [path], not any(c in path for c in "*?[{")
    if single and not files.exists(spark, path):
        return None
    if landing.is_landing(spark, path):
        generations = landing.current(spark, path, upto)
        if not generations:
            return None
        paths = [p for g in generations for p in g.paths]
        if not paths:   # a complete snapshot of nothing
            landed = T.StructType([T.StructField("version", T.StringType()), T.StructField("time", T.TimestampType()), T.StructField("file", T.StringType())])
            return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType()), T.StructField("_landed", landed)]))
    try:
        return landing.documents(spark, schema, paths, CORRUPT)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err) or "Path does not exist" in str(err):
            return None
        raise


def _latest(docs: DataFrame, column: str) -> DataFrame:
    """One row per id, from the document landed last (generation, file time, then file name)."""
    rows = docs.select("_landed", F.posexplode(column).alias("_at", "_e"))
    return landing.newest_per_key(rows, "_e", F.struct("_landed", "_at"))


def read_bootstrap(spark: SparkSession, path: str, upto: int | None = None,
                   staging: Staging | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(players_raw, teams, positions)`` from the bootstrap document(s) at ``path``.

    A landing folder (``landing``) gives its newest complete snapshot and the changes after it: a player whom that snapshot does not
    hold has left, and a generation that is not complete is ignored. ``upto`` reads an older state, up to that version.
    Plain documents (a file, a folder, a wildcard) are parts of one snapshot, each id as it landed last. ``staging`` owns the
    parsed copy (else it goes with the process).

    A missing, empty or malformed players source is fatal (the reference stops): a missing path, a landing folder without a
    complete snapshot, a document that is no JSON of this shape, or no document with players raises.
    """
    docs = _read_json(spark, schemas.BOOTSTRAP, path, upto)
    if docs is None:
        raise FileNotFoundError(f"players source not found: {path}")
    docs = staging.stage(docs, "bootstrap") if staging else stage(docs, "bootstrap")
    bad = [r.file for r in docs.filter(F.col(CORRUPT).isNotNull()).select("_landed.file").limit(5).collect()]
    if bad:
        raise ValueError(f"malformed players document(s): {bad}")
    if docs.filter(F.size("elements") > 0).isEmpty():
        raise ValueError(f"no document with players at {path}")
    return _latest(docs, "elements"), _latest(docs, "teams"), _latest(docs, "element_types")


def read_fixtures(spark: SparkSession, path: str, upto: int | None = None, staging: Staging | None = None) -> DataFrame | None:
    """Fixture rows from JSON array document(s), one per id as it landed last; ``None`` when the source is missing.

    A landing folder gives its newest complete snapshot merged with the changes after it, so a fixture that was moved or
    finished is there once and a withdrawn one is gone (``upto``: as of that version). Plain documents are merged by id alone.
    Malformed documents are reported by a warning and give no rows (the reference goes on without fixtures).
    """
    docs = _read_json(spark, schemas.FIXTURES_RAW, path, upto)
    if docs is None:
        return None
    docs = staging.stage(docs, "fixtures") if staging else stage(docs, "fixtures")
    bad = [r.file for r in docs.filter(F.col(CORRUPT).isNotNull()).select("_landed.file").distinct().limit(5).collect()]
    if bad:
        warnings.warn(f"malformed fixtures document(s) left out: {bad}", stacklevel=2)
    rows = docs.filter(F.col(CORRUPT).isNull()).select("_landed", F.struct(*schemas.FIXTURES_RAW.names).alias("_e"))
    return landing.newest_per_key(rows, "_e", F.struct("_landed", "_e"))


def load_upcoming(spark: SparkSession, path: str, teams: DataFrame, staging: Staging | None = None) -> DataFrame:
    """Upcoming fixtures from a landed document, or the fixed-schema empty table.

    An empty document needs no special case: the same plan yields zero rows
    with the same schema, and every consumer works on zero rows.
    """
    raw = read_fixtures(spark, path, staging=staging)
    if raw is None:
        return empty_upcoming(spark)
    return upcoming_fixtures(raw, teams)


def parse_elements(text: DataFrame, column: str = "value", mode: str = "FAILFAST") -> DataFrame:
    """Player objects from JSON text, one object per row (JSON lines), with the declared schema.

    The per-row form of the bootstrap source: splittable, parsed by
    ``from_json`` in the JVM. Malformed text fails the job; with mode
    ``PERMISSIVE`` it yields a row of NULLs instead.
    """
    return text.select(F.from_json(F.col(column), schemas.PLAYERS_RAW, {"mode": mode}).alias("e")).select("e.*")


def to_json_lines(players_raw: DataFrame) -> DataFrame:
    """Serialise player rows to JSON text (one object per row), the shape landed feeds have."""
    return players_raw.select(F.to_json(F.struct(*players_raw.columns)).alias("value"))


def bootstrap_documents(players_raw: DataFrame, teams: DataFrame, positions: DataFrame, rows_per_document: int = landing.ROWS_PER_DOCUMENT) -> DataFrame:
    """The JSON text (``value``) of bootstrap documents: rows of all three tables dealt over as many documents as they need."""
    tables = {"elements": players_raw, "teams": teams, "element_types": positions}
    part = landing.parts_of(players_raw, rows_per_document)
    dealt = None
    for name, df in tables.items():
        at = part if df is players_raw else landing.parts_of(df, rows_per_document)
        rows = df.select(at, *[(F.struct(*df.columns) if n == name else F.lit(None).cast(schemas.BOOTSTRAP[n].dataType.elementType)).alias(n) for n in tables])
        dealt = rows if dealt is None else dealt.unionByName(rows)
    docs = dealt.groupBy("_part").agg(*[F.collect_list(n).alias(n) for n in tables])
    return docs.select(F.to_json(F.struct(*tables)).alias("value"))


def land_bootstrap(players_raw: DataFrame, teams: DataFrame, positions: DataFrame, root: str, kind: str = landing.SNAPSHOT,
                   rows_per_document: int = landing.ROWS_PER_DOCUMENT) -> int:
    """Land one generation of players and dimensions in the landing folder ``root``; its version."""
    return landing.land(bootstrap_documents(players_raw, teams, positions, rows_per_document), root, kind)


def land_fixtures(fixtures_raw: DataFrame, root: str, kind: str = landing.SNAPSHOT, rows_per_document: int = landing.ROWS_PER_DOCUMENT) -> int:
    """Land one generation of fixtures, as JSON array documents, in the landing folder ``root``; its version."""
    rows = fixtures_raw.select(landing.parts_of(fixtures_raw, rows_per_document), F.struct(*schemas.FIXTURES_RAW.names).alias("_e"))
    texts = rows.groupBy("_part").agg(F.to_json(F.collect_list("_e")).alias("value"))
    return landing.land(texts, root, kind)
