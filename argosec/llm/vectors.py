"""Arrow list columns of numbers as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column that all have `dim` elements."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dim)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim): rows with an id and a vector without null, NaN or infinity and not all zero."""
    v = F.col("embedding").cast("array<double>")
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    x = x.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0))
    return x.withColumn("dim", F.size("v")).dropDuplicates(["vec_id", "v"])
