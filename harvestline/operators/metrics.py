"""Regression metrics, residuals and their reports, each in one aggregate."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from harvestline import fixed_values as fv
from harvestline.functions.numbers import half_even
from harvestline.operators.insights import histogram


def regression_metrics(
    scored: DataFrame, by: Sequence[str] = (), truth: str = "y_true", guess: str = "y_pred", rounded: bool = True
) -> DataFrame:
    """n, RMSE, MAE, R² and MAPE. A group of one row has no metrics; MAPE leaves out targets near zero.

    With a constant target R² is 1 for a perfect prediction and 0 otherwise.
    """
    y, p = F.col(truth), F.col(guess)
    error = y - p
    sums = scored.groupBy(*by).agg(
        F.count(truth).alias("n"),
        F.avg(error * error).alias("_mse"),
        F.avg(F.abs(error)).alias("_mae"),
        F.var_pop(truth).alias("_var"),
        F.avg(F.when(y > fv.MAPE_FLOOR, F.abs(error / y))).alias("_ape"),
    )
    r2 = F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var")).otherwise(
        F.when(F.col("_mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    enough = F.col("n") >= 2
    mape = F.coalesce(F.col("_ape") * 100, F.lit(0.0))

    def shown(value, digits):
        return F.when(enough, half_even(value, digits) if rounded else value)

    return sums.select(
        *by,
        "n",
        shown(F.sqrt("_mse"), 4).alias("rmse"),
        shown(F.col("_mae"), 4).alias("mae"),
        shown(r2, 4).alias("r2"),
        shown(mape, 2).alias("mape"),
    )


def residuals(scored: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    return scored.withColumn("residual", F.col(guess) - F.col(truth))


def residual_histogram(scored: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(residuals(scored), "residual", bins)


def prediction_range(scored: DataFrame, truth: str = "y_true", guess: str = "y_pred", margin: float = 0.05) -> DataFrame:
    """Common axis range of actual and predicted values, widened on both sides."""
    ends = scored.agg(
        F.least(F.min(truth), F.min(guess)).alias("lowest"), F.greatest(F.max(truth), F.max(guess)).alias("highest")
    )
    pad = (F.col("highest") - F.col("lowest")) * margin
    return ends.select(
        "lowest", "highest", (F.col("lowest") - pad).alias("axis_low"), (F.col("highest") + pad).alias("axis_high")
    )


def check_quality(metrics: DataFrame, minimum: float = fv.MIN_R2) -> float:
    """R² of a one-row metrics table; below the minimum is an error."""
    r2 = metrics.first()["r2"]
    if r2 is None or r2 < minimum:
        raise ValueError(f"R² {r2} is below the minimum {minimum}")
    return r2
