"""Vectors as integer arrays, exact sums of them, and totals by key; shared by the vector operators.

A component ``x`` becomes ``floor(scale * x)`` in double precision. Results beyond 2**24 either way are held
at that bound, so that squared distances stay exact in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest component of a lattice vector, either way.
LARGEST = 1 << 24
#: Keys up to which totals by key are broadcast; beyond, both sides are dealt by key and salt.
MOST_TOTALS = 100_000
SALTS = 16


def finite(vector: Column) -> Column:
    """True for a vector that is not null and has no component that is null, NaN or infinite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def lattice(vector: Column, scale: int) -> Column:
    held = lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * scale))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("int"))


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column whose lists are equally long as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def lists_of(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1), kind))


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((points - centres) ** 2).sum(-1)


def floor_means(sums: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count); where nothing was counted, the old values."""
    return np.where(counts > 0, sums // np.maximum(counts, 1), old)


def with_total(rows: DataFrame, key: str, value: str, total: str, spread: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over rows of an equal ``key``, nulls together.

    The totals are broadcast after they were counted. Beyond the bound the join is dealt by key and a salt
    made from ``spread``, so that a frequent key is not one task's.
    """
    totals = rows.groupBy(key).agg(F.sum(value).alias(total)).withColumnRenamed(key, "_key")
    if totals.limit(MOST_TOTALS + 1).count() <= MOST_TOTALS:
        return rows.join(F.broadcast(totals), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    every = totals.withColumn("_each", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_each"))).drop("_key", "_salt", "_each")
