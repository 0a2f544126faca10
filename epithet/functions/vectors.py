"""Dense vectors as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def has_direction(a: Column) -> Column:
    """Neither null, nor all zero, nor holding a NaN: a cosine can be taken."""
    return F.exists(a, lambda x: x != 0) & ~F.exists(a, lambda x: F.isnan(x))


def mean_pool(
    df: DataFrame, keys: Sequence[str], vector: str, weight: str | None = None
) -> DataFrame:
    """Mean vector per key; rows count by ``weight`` if given, so a mask of 0 and 1 leaves rows out.

    The mean is a partially aggregated vector summary, so a key that holds a large
    share of the rows costs one small buffer per task, not a gathered group.
    """
    as_vector = array_to_vector(F.col(vector).cast("array<double>"))
    pooled = df.where(F.col(vector).isNotNull()).groupBy(*keys).agg(
        Summarizer.mean(as_vector, None if weight is None else F.col(weight)).alias("_mean")
    )
    return pooled.select(*keys, vector_to_array("_mean").alias(vector))
