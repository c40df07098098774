"""Protein descriptors: attaching, pooling and standardising dense vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pocketloom.operators.contracts import assert_index_range
from pocketloom.operators.lookups import join_many_to_one


def with_descriptors(examples: DataFrame, matrix: DataFrame, index: str = "protein_idx", vector: str = "descriptor") -> DataFrame:
    """examples with the row of matrix (index, vector) that index names; an index beyond the matrix is an error."""
    rows = matrix.agg(F.max(index)).first()[0]
    assert_index_range(examples, index, -1 if rows is None else rows + 1)
    return join_many_to_one(examples, matrix.select(index, vector), [index], "left", "the descriptor matrix")


def mean_pooled(tokens: DataFrame, key: str, vector: str, out: str = "pooled") -> DataFrame:
    """The mean of the vectors of each key, component by component. Null vectors don't count."""
    summed = tokens.where(F.col(vector).isNotNull()).groupBy(key).agg(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("m"))
    return summed.select(key, vector_to_array("m").alias(out))


def standard_moments(train: DataFrame, vector: str) -> tuple[list[float], list[float]]:
    """Mean and population standard deviation of each component, in one pass."""
    column = array_to_vector(F.col(vector).cast("array<double>"))
    mean, variance, n = train.where(F.col(vector).isNotNull()).agg(Summarizer.mean(column), Summarizer.variance(column), F.count(F.lit(1))).first()
    if not n:
        return [], []
    return mean.toArray().tolist(), [(v * (n - 1) / n) ** 0.5 if n > 1 else 0.0 for v in variance.toArray().tolist()]


def standardized(df: DataFrame, vector: str, mean: list[float], deviation: list[float], out: str) -> DataFrame:
    """Each component less its mean, over its deviation; a constant component is only centred."""
    scale = [d if d > 0 else 1.0 for d in deviation]
    moved = F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, mean)), lambda x, m: x - m)
    return df.withColumn(out, F.zip_with(moved, F.array(*map(F.lit, scale)), lambda x, s: x / s))


def target_moments(train: DataFrame, target: str) -> tuple[float, float]:
    """Mean and population standard deviation of a number, of the train rows only; 0 and 1 where there are none."""
    mean, deviation = train.agg(F.avg(target), F.stddev_pop(target)).first()
    return (mean or 0.0), (deviation or 1.0)


def scaled_target(df: DataFrame, target: str, mean: float, deviation: float) -> DataFrame:
    return df.withColumn(target, (F.col(target) - F.lit(mean)) / F.lit(deviation))


def unscaled_target(df: DataFrame, target: str, mean: float, deviation: float) -> DataFrame:
    return df.withColumn(target, F.col(target) * F.lit(deviation) + F.lit(mean))
