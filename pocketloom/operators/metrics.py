"""Fitting a line and judging predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pocketloom.operators.contracts import ContractError

NAN = float("nan")


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two columns; NaN for fewer than two rows or a column that is constant."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(NAN))


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (slope, intercept, n, n_x) of the least-squares line of y on x; n_x counts distinct x. The line is null
    where x is constant."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"), F.count_distinct(x).alias("n_x"))


def fitted_line(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    """Slope and intercept; fewer than two rows or two distinct x are an error."""
    row = fit_line(df, x, y).first()
    if row["n"] < 2:
        raise ContractError("a line needs at least two train examples")
    if row["n_x"] < 2:
        raise ContractError("a line needs at least two distinct Glide scores")
    return row["slope"], row["intercept"]


def with_errors(df: DataFrame, true: str = "true_affinity", predicted: str = "predicted_affinity") -> DataFrame:
    residual = F.col(predicted) - F.col(true)
    return df.withColumns({"abs_error": F.abs(residual), "squared_error": residual * residual})


def metrics_by(df: DataFrame, by: list[str], true: str = "true_affinity", predicted: str = "predicted_affinity") -> DataFrame:
    """num_examples, pearson_r, rmse and mae of each group, in one pass; for no columns, of all rows, NaN if none."""
    residual = F.col(predicted) - F.col(true)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_examples"), pearson(F.col(predicted), F.col(true)).alias("pearson_r"),
        F.coalesce(F.sqrt(F.avg(residual * residual)), F.lit(NAN)).alias("rmse"), F.coalesce(F.avg(F.abs(residual)), F.lit(NAN)).alias("mae"),
    )


def with_prediction(df: DataFrame, x: str, slope: float, intercept: float, name: str = "predicted_affinity") -> DataFrame:
    return df.withColumn(name, F.lit(slope) * F.col(x) + F.lit(intercept))
