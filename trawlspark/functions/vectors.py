"""Vector expressions: sums in double, stored values in float."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

TINY = 1e-9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def stored_norm(v: Column) -> Column:
    """The norm as it is kept beside a vector, in single precision."""
    return norm(v).cast("float")


def literal(vector: Sequence[float]) -> Column:
    return F.lit([float(x) for x in vector])


def cosine(v: Column, v_norm: Column, query: Column, query_norm: Column) -> Column:
    """Cosine with 0 where the product of the norms is next to nothing."""
    below = v_norm.cast("double") * query_norm.cast("double")
    return F.when(below < TINY, F.lit(0.0)).otherwise(dot(v, query) / below)


def limits(vectors: DataFrame, column: str) -> DataFrame:
    """One row (vmin, vmax, scale) over all numbers of all vectors; partial minima and maxima, no shuffle of vectors."""
    found = vectors.agg(F.min(F.array_min(column)).cast("double").alias("vmin"), F.max(F.array_max(column)).cast("double").alias("vmax"))
    return found.withColumn("scale", (F.col("vmax") - F.col("vmin")) / F.lit(255.0))


def quantized(v: Column, vmin: Column, scale: Column) -> Column:
    """Whole numbers 0..255, halves to even; a constant table is all 0."""
    level = lambda x: F.rint((x.cast("double") - vmin) / scale)
    clipped = F.transform(v, lambda x: F.when(scale == 0, F.lit(0.0)).otherwise(F.least(F.greatest(level(x), F.lit(0.0)), F.lit(255.0))).cast("smallint"))
    return clipped


def dequantized(q: Column, vmin: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: (x.cast("double") * scale + vmin).cast("float"))
