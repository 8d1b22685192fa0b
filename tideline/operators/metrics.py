"""Forecast errors, epoch losses, ablation deltas and the early-stop decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.vectors import absolute_error, squared_error


def errors(predicted: Column, actual: Column) -> list[Column]:
    """Aggregates n, mse and mae over all elements of all rows: a row's sums first, then one division."""
    n = F.sum(F.size(actual))
    return [
        F.coalesce(n, F.lit(0)).alias("n"), (F.sum(squared_error(predicted, actual)) / n).alias("mse"), (F.sum(absolute_error(predicted, actual)) / n).alias("mae"),
    ]


def forecast_metrics(rows: DataFrame, predicted: str = "pred", actual: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """n, mse and mae, element-weighted, of each group; without groups one row, with n = 0 and nulls for no rows."""
    return rows.groupBy(*by).agg(*errors(F.col(predicted), F.col(actual)))


def constant_metrics(rows: DataFrame, value: Column, actual: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """forecast_metrics of a forecast that is one value over the whole horizon. Targets that are null don't count."""
    error = F.col("_p") - F.col("_y")
    each = rows.select(*by, value.alias("_p"), F.explode(actual).alias("_y"))
    return each.groupBy(*by).agg(F.count("_y").alias("n"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"))


def batch_losses(rows: DataFrame, batch_size: int, predicted: str = "pred", actual: str = "y", ordinal: str = "ordinal") -> DataFrame:
    """batch_id and loss (mean squared error) of each run of ``batch_size`` ordinals."""
    batch = F.floor(F.col(ordinal) / batch_size).alias("batch_id")
    return rows.groupBy(batch).agg(*errors(F.col(predicted), F.col(actual))).select("batch_id", F.col("mse").alias("loss"))


def epoch_loss(losses: DataFrame) -> DataFrame:
    """n_batches and epoch_loss: the unweighted mean of the batches' losses (0 for none)."""
    return losses.agg(F.count("*").alias("n_batches"), (F.coalesce(F.sum("loss"), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias("epoch_loss"))


def deltas(reports: DataFrame, steps: list[tuple[str, str]], metrics: tuple[str, ...] = ("mse", "mae"), by: str = "horizon") -> DataFrame:
    """A row for each ``by``: every model's metrics side by side, and the change of each step from one model to the next."""
    models = sorted({m for s in steps for m in s})
    wide = reports.groupBy(by).pivot("model", models).agg(*[F.first(m).alias(m) for m in metrics])
    changes = [(F.col(f"{b}_{m}") - F.col(f"{a}_{m}")).alias(f"delta_{a}_{b}_{m}") for a, b in steps for m in metrics]
    return wide.select("*", *changes)


def early_stop(curve: DataFrame, patience: int, epoch: str = "epoch", value: str = "val") -> DataFrame:
    """One row: best_epoch, best_val, stop_epoch, of a curve of one row an evaluation.

    An evaluation improves if it lies strictly below all before it; NaN and infinity never do. The stop is the first one
    that makes the streak without improvement ``max(patience, 1)`` long, else the last. best_epoch and best_val are null
    if none improved. A curve has a row an epoch, so its one window group is bounded by the number of epochs.
    """
    by = Window.orderBy(epoch)
    v = F.when(~F.isnan(value) & (F.col(value) < float("inf")), F.col(value))
    rows = curve.select(F.col(epoch).alias("e"), v.alias("v"), F.row_number().over(by).alias("k"))
    least = F.min("v").over(Window.orderBy("e").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("improved", F.col("v").isNotNull() & (least.isNull() | (F.col("v") < least)))
    last = F.max(F.when(F.col("improved"), F.col("k"))).over(Window.orderBy("e").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("streak", F.col("k") - F.coalesce(last, F.lit(0)))
    stopped = F.min(F.when(F.col("streak") >= max(patience, 1), F.col("k"))).over(Window.partitionBy())
    kept = rows.withColumn("stop", stopped).filter(F.col("stop").isNull() | (F.col("k") <= F.col("stop")))
    best = F.when(F.col("improved"), F.col("k"))
    return kept.agg(F.max_by("e", best).alias("best_epoch"), F.max_by("v", best).alias("best_val"), F.max_by("e", "k").alias("stop_epoch"))
