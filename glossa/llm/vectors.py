"""Vectors as whole numbers: which rows take part, and their components as exact integers.

A vector takes part if it is not null, holds no null or non-finite component, has the most
common dimension (ties: the smaller one) and components small enough that a squared distance or
an inner product fits a long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def limit_for(dimension: int) -> int:
    """Whole components below this in size keep dimension * (2 * component)**2 within a long."""
    return math.isqrt((1 << 61) // max(dimension, 1))


def whole_vectors(df: DataFrame, id_col: str, vector: str, scale: int, keep: tuple[str, ...] = (), multiple: int = 1) -> tuple[DataFrame, int, int]:
    """((vec_id, kept, v), dimension, rows of that dimension): vectors that take part, dimensions a multiple of `multiple`.

    kept is a struct of the columns named in keep (of one true value if none is named).
    """
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(True).alias("none"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), kept.alias("kept"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % multiple == 0) & finite)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d, n = (dims[0]["d"], dims[0]["count"]) if dims else (0, 0)
    small = F.forall("v", lambda x: F.abs(x.cast("double")) < float(limit_for(d)) / scale)
    return rows.where((F.size("v") == d) & small), d, n


def whole(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * component) of each vector, one row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), -1)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    lo, hi = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max))
