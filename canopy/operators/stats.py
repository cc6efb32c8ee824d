"""Descriptive statistics over videos, trackings and image names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_histogram(every: DataFrame, rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """(n, groups): how many keys of `every` have n rows, keys without rows included."""
    counts = rows.groupBy(key).agg(F.count("*").alias(name))
    return every.select(key).join(counts, key, "left").groupBy(F.coalesce(name, F.lit(0)).alias(name)).agg(F.count("*").alias("groups"))


def durations(video: DataFrame, bin_seconds: int = 10) -> DataFrame:
    """(bin, videos): by duration."""
    return video.groupBy((F.floor(F.col("frames") / F.col("fps") / bin_seconds) * bin_seconds).alias("bin")).agg(F.count("*").alias("videos"))


def quarter_hours(video: DataFrame, column: str = "start_time") -> DataFrame:
    """(bin, videos): by quarter of the day, 0 to 95."""
    return video.where(F.col(column).isNotNull()).groupBy(F.floor((F.hour(column) * 60 + F.minute(column)) / 15).alias("bin")).agg(F.count("*").alias("videos"))


def sessions(rows: DataFrame, keys: tuple[str, ...], order: Column, gap: int) -> DataFrame:
    """rows with `session`: its number within the keys; a step over gap starts one."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((order - F.lag(order).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("__new")


def with_ties(rows: DataFrame, n: int, column: str) -> DataFrame:
    """Rows whose value is among the n largest, ties included: the n-th value is found by a top-n and joined back."""
    least = rows.select(column).orderBy(F.desc(column)).limit(n).agg(F.min(column).alias("__least"))
    return rows.join(F.broadcast(least), F.col(column) >= F.col("__least")).drop("__least")


def describe(rows: DataFrame, column: str) -> DataFrame:
    """Mean, median, population deviation, extremes and quartiles (linear between neighbours)."""
    return rows.agg(
        F.avg(column).alias("mean"), F.percentile(column, 0.5).alias("median"), F.stddev_pop(column).alias("std"),
        F.min(column).alias("low"), F.max(column).alias("high"), F.percentile(column, 0.25).alias("p25"), F.percentile(column, 0.75).alias("p75"),
    )


def grid(rows: DataFrame, x: str, y: str, cell: int = 100) -> DataFrame:
    """(x, y, n): counts by cells of a plane."""
    return rows.groupBy((F.floor(F.col(x) / cell) * cell).alias("x"), (F.floor(F.col(y) / cell) * cell).alias("y")).agg(F.count("*").alias("n"))


def running_max(rows: DataFrame, order: str, value: str, width: int = 1 << 16) -> DataFrame:
    """rows with `running`, the largest value up to and at this place in the order of a whole number; nulls are passed over.

    Maxima run inside ranges of the order; what went before comes from one maximum for each range.
    """
    ranged = rows.withColumn("__range", F.floor(F.col(order) / width))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    most = ranged.groupBy("__range").agg(F.max(value).alias("__m")).select("__range", F.max("__m").over(before).alias("__before"))
    inner = F.max(value).over(Window.partitionBy("__range").orderBy(order))
    return ranged.join(most, "__range").withColumn("running", F.greatest(inner, "__before")).drop("__range", "__before")
