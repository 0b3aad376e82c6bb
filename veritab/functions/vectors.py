"""Vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length (V01); a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(x).cast("double"))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, renormalise: bool = False) -> DataFrame:
    """The mean vector of each key, as ``mean`` (A16): one average a component, so only one row a key is shuffled. A component counts where a vector has it, and a mean is as long as its key's longest vector."""
    dims = df.agg(F.max(F.size(vector))).first()[0] or 0
    mean = F.array(*[F.avg(F.try_element_at(vector, F.lit(i + 1)).cast("double")) for i in range(max(dims, 0))]).cast("array<double>")
    means = df.groupBy(*keys).agg(F.slice(mean, 1, F.greatest(F.lit(0), F.coalesce(F.max(F.size(vector)), F.lit(0)))).alias("mean"))
    return means.withColumn("mean", unit(F.col("mean"))) if renormalise else means


def min_max(v: Column) -> Column:
    """Components between 0 and 1, with the customary 1e-8 against division by zero."""
    low, high = F.array_min(v), F.array_max(v)
    return F.transform(v, lambda x: (x - low) / (high - low + F.lit(1e-8)))


def ratio(a: Column, b: Column) -> Column:
    """Component by component, an attention map over another (V04); null where the other is 0."""
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))
