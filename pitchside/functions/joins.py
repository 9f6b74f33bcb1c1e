"""Joins to a small table by a key that few values share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, table_key: str, spread_by: str, salts: int = SALTS) -> DataFrame:
    """``rows`` left-joined to ``table`` (one row per ``table_key``) on ``key``.

    Each row of ``table`` stands ``salts`` times and each of ``rows`` takes one copy by a hash of ``spread_by``, so a
    shuffled join deals a hot key over ``salts`` tasks. A planner that knows the table to be small broadcasts it as before.
    """
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    copies = table.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = rows.withColumn("_salt", salt).join(copies, (F.col(key) == F.col(table_key)) & (F.col("_salt") == F.col("_copy")), "left")
    return joined.drop("_salt", "_copy")
