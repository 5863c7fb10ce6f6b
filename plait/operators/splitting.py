"""Splitting by time, and statistics of the training part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rows_per_day(rows: DataFrame, day: str = "day") -> DataFrame:
    return rows.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"))


def boundary(rows: DataFrame, fraction: float, day: str = "day") -> DataFrame:
    """One row: the first validation day whose share of later rows is nearest ``fraction`` (the earliest of equals).

    Candidates are all days but the first.  The window runs over days, not rows."""
    return boundary_of(rows_per_day(rows, day), fraction)


def boundary_of(days: DataFrame, fraction: float) -> DataFrame:
    """:func:`boundary` from (day, n), where the days' rows are counted already."""
    before = F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy())
    scored = days.select("day", before.alias("before"), total.alias("total")).where("before is not null")
    error = F.abs((F.col("total") - F.col("before")) / F.col("total") - F.lit(fraction))
    return scored.select("day", F.round(error, 9).alias("error")).agg(F.min_by("day", F.struct("error", "day")).alias("valid_from"), F.min("error").alias("error"))


def split(rows: DataFrame, fraction: float, day: str = "day") -> DataFrame:
    """Adds ``split``; the boundary stays in the plan as a one-row broadcast."""
    cut = boundary(rows, fraction, day).select("valid_from")
    return rows.crossJoin(F.broadcast(cut)).withColumn("split", F.when(F.col(day) < F.col("valid_from"), "train").otherwise("valid")).drop("valid_from")


def first_held_out(days: DataFrame, fraction: float):
    """The boundary's date (None without one) of (day, n), for :func:`before` and :func:`since`: taken once, it serves all parts of a query."""
    return boundary_of(days, fraction).first()["valid_from"]


def before(rows: DataFrame, cut, day: str = "day") -> DataFrame:
    """The training rows by a boundary that is known."""
    return rows.where(F.col(day) < F.lit(cut))


def since(rows: DataFrame, cut, day: str = "day") -> DataFrame:
    """The held-out rows by a boundary that is known, without those that have no day."""
    return rows.where(F.col(day) >= F.lit(cut))


def training(rows: DataFrame, fraction: float, day: str = "day") -> DataFrame:
    """The training rows.  The boundary, one date, is taken first, so that it filters the scan."""
    return before(rows, first_held_out(rows_per_day(rows, day), fraction), day)


def validation(rows: DataFrame, fraction: float, day: str = "day") -> DataFrame:
    """The rows that :func:`training` leaves out, but for those without a day."""
    return since(rows, first_held_out(rows_per_day(rows, day), fraction), day)


def feature_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and deviation of each column; a missing or zero deviation is 1."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}_mean"), F.coalesce(F.nullif(F.stddev_samp(x), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_std")]
    return rows.agg(*aggs)


def standardised(rows: DataFrame, stats: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    joined = rows.crossJoin(F.broadcast(stats))
    for c in columns:
        joined = joined.withColumn(c + suffix, (F.col(c).cast("double") - F.col(f"{c}_mean")) / F.col(f"{c}_std"))
    return joined.drop(*stats.columns)
