"""Bounded samples of rows to fit models on, chosen by a hash: the same rows in every run and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, key: str, rows: int, salt: int = 11) -> DataFrame:
    """At most ``rows`` rows of ``df``: those with the smallest hash of ``key`` (all, if fewer).

    One count, then a filter that leaves about 1.5 times as many rows, of which the first are taken; so no
    more than a small multiple of ``rows`` is ever sorted.
    """
    total = df.count()
    h = F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 40))
    if total > 2 * rows:
        df = df.filter(h < int((1 << 40) * min(1.0, (1.5 * rows + 50) / total)))
    return df.orderBy(h, key).limit(rows)
