"""Vectors of whole numbers for the operators whose results must be exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest size of a scaled component; squared differences, summed over a vector of up to 4,096 components, stay in 64 bits.
LARGEST = 1 << 24


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, label: Column, scale: int = 256) -> DataFrame:
    """(id, label, v): the rows that take part, each component x as the integer floor(scale * x).

    Left out: null and empty vectors, vectors with a null or non-finite component, and vectors of another length than the
    commonest. A scaled component beyond ``LARGEST`` either way fails the job: its squares would not fit in 64 bits.
    """
    v = F.col("v")
    rows = df.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vec_col).alias("v")).filter(
        v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()

    def scaled(x: Column) -> Column:
        y = x.cast("double") * scale
        too_large = F.raise_error(F.lit(f"a vector component is over {LARGEST // scale}")).cast("int")
        return F.when(F.abs(y) <= LARGEST, F.floor(y).cast("int")).otherwise(too_large)

    return rows.filter(F.size("v") == (size[0][0] if size else 0)).select("id", "label", F.transform("v", scaled).alias("v"))


def integer_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, all of one length, as an int64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)
