"""Joins with a side that is small in fact, not by hope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a few narrow columns that an executor holds without effort (some tens of MB).
BROADCAST_ROWS = 500_000
#: Bytes of a side whose rows have no fixed width.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is small enough, else as it is (a shuffled join).

    Small: at most ``max_rows`` rows and, where a column holds texts, arrays or structures, at most ``max_bytes`` bytes of these
    as JSON, which is more than they take. Looks at no more than ``max_rows`` + 1 rows; call it on a staged or tiny table.
    """
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType))]
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in wide]))) if wide else F.lit(0)
    seen = df.select(width.cast("long").alias("width")).limit(max_rows + 1).agg(F.count("*").alias("rows"), F.sum("width").alias("bytes")).first()
    return F.broadcast(df) if seen["rows"] <= max_rows and (seen["bytes"] or 0) <= max_bytes else df
