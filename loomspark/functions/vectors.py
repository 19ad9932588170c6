"""Vector functions as Column expressions; all sums are in doubles and in order of the components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """0 where lengths differ, a vector is null or its norm is zero."""
    size = (a_norm if a_norm is not None else norm(a)) * (b_norm if b_norm is not None else norm(b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def centroids(df: DataFrame, by: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """Element-wise means per group: sums combine before the shuffle, so a group may be of any size."""
    parts = df.select(*by, F.posexplode(vector).alias("dim", "x"))
    means = parts.groupBy(*by, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "m")))
    return means.groupBy(*by).agg(F.transform(ordered, lambda p: p["m"]).alias(out))
