"""pitchside: player analytics for a sports league, written as Spark DataFrame plans.

Layout
------
``sources``    readers for landed tables and JSON documents, the mapping from the
               driver's test tables, and result sinks.
``functions``  column-expression helpers (R-compatible NULL/NaN/rounding rules) and
               the fixed values the league rules define.
``operators``  one module per operator family; every public operator is
               ``DataFrame(s), params -> DataFrame`` and never collects.
``plans``      the named-query catalog used by tests, the bench and the driver, plus
               the DuckDB oracle SQL for each query.
``streaming``  incremental ingest of landed snapshot files.
"""

from pitchside.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
