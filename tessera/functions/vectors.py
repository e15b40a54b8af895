"""Vector columns: array<double> and map<string,double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, factor: Column | float) -> Column:
    return F.transform(a, lambda x: x * factor)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def norm(a: Column, power: float = 2) -> Column:
    if power == 2:
        return F.sqrt(dot(a, a))
    return F.pow(_total(F.transform(a, lambda x: F.pow(F.abs(x).cast("double"), F.lit(float(power))))), F.lit(1.0 / power))


def distance(a: Column, b: Column, power: float = 2) -> Column:
    return norm(subtract(a, b), power)


def normalize(a: Column) -> Column:
    return F.transform(a, lambda x: x / norm(a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distortion(a: Column, b: Column) -> Column:
    """Sum of squared differences of two sparse vectors over the number of keys they don't share; null if they share all."""
    merged = F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, F.lit(0.0)).alias("x"), F.coalesce(y, F.lit(0.0)).alias("y"), (x.isNull() | y.isNull()).cast("int").alias("own")))
    pairs = F.map_values(merged)
    own = F.aggregate(pairs, F.lit(0), lambda s, p: s + p["own"])
    return F.try_divide(_total(F.transform(pairs, lambda p: (p["x"] - p["y"]) * (p["x"] - p["y"]))), own)
