"""Vectors as ``array<double>`` columns, with Spark's higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    """Sum of an array; 0 for an empty one, null for null."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; null if either is null or a coordinate is."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def relu(x: Column) -> Column:
    """max(0, x); null stays null, which ``greatest`` would turn into 0."""
    return F.when(x.isNull(), None).otherwise(F.greatest(F.lit(0.0), x))


def softmax(values: Column) -> Column:
    """Softmax of an array, shifted by its largest value."""
    raised = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(raised, lambda x: x / total(raised))


def squared_error(predicted: Column, actual: Column) -> Column:
    """Sum of squared differences of two arrays of one size."""
    return squared_distance(predicted, actual)


def absolute_error(predicted: Column, actual: Column) -> Column:
    return total(F.zip_with(predicted, actual, lambda p, y: F.abs(p - y)))


def comma_list(values: Column) -> Column:
    return F.concat_ws(",", values)
