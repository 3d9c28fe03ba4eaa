"""Smoothing and forecasts of value series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from spectraloom.functions.expect import gumbel_density, savgol


def savgol_column(values: str, width: int, degree: int) -> Column:
    """Savitzky–Golay smoothing of an array column, one row a series."""
    import pandas as pd

    @pandas_udf("array<double>")
    def smooth(s: pd.Series) -> pd.Series:
        return s.map(lambda v: savgol(v, width, degree).tolist())

    return smooth(values)


def savgol_inner(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Width 5, degree 2 by its fixed kernel as a window expression; the two rows at either end keep their value."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    at = lambda k: F.lag(value, -k).over(w) if k else F.col(value)
    mid = (-3 * at(-2) + 12 * at(-1) + 17 * at(0) + 12 * at(1) - 3 * at(2)) / 35
    return df.withColumn("smooth", F.coalesce(mid, F.col(value)))


def derivative_inner(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """First derivative of the same fit; null at the two rows of either end."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    at = lambda k: F.lag(value, -k).over(w)
    return df.withColumn("slope", (-2 * at(-2) - at(-1) + at(1) + 2 * at(2)) / 10)


def holt(df: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.5, beta: float = 0.3) -> DataFrame:
    """key, n, level, trend, forecast: double exponential smoothing of each series.

    A series is folded in order by one expression; its level starts at the
    first value, its trend at 0. A key's series is one row: this is for many
    keys of moderate length.
    """
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("s"))
    start = F.struct(F.get("s", F.lit(0))["_v"].cast("double").alias("level"), F.lit(0.0).alias("trend"))

    def step(acc, x):
        level = F.lit(alpha) * x["_v"] + F.lit(1 - alpha) * (acc["level"] + acc["trend"])
        trend = F.lit(beta) * (level - acc["level"]) + F.lit(1 - beta) * acc["trend"]
        return F.struct(level.alias("level"), trend.alias("trend"))

    folded = rows.select(key, F.size("s").alias("n"), F.aggregate(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), start, step).alias("f"))
    return folded.select(key, F.col("n").cast("long").alias("n"), F.col("f.level").alias("level"), F.col("f.trend").alias("trend"), (F.col("f.level") + F.col("f.trend")).alias("forecast"))


def holt_irregular(times, values, alpha: float = 0.5, beta: float = 0.3, ahead: float = 1.0) -> float:
    """Forecast at ``ahead`` after the last time of an irregular series: the trend is per unit of time."""
    level, trend, last = float(values[0]), 0.0, float(times[0])
    for t, v in zip(times[1:], values[1:], strict=True):
        gap = float(t) - last
        new = alpha * float(v) + (1 - alpha) * (level + trend * gap)
        trend = beta * (new - level) / gap + (1 - beta) * trend if gap > 0 else trend
        level, last = new, float(t)
    return level + trend * ahead


def gumbel_curve(a: int, z: int, mu: float, beta: float) -> Column:
    """Gumbel density at a, …, z as an array column; ``gumbel_density`` in numpy is the same."""
    return F.transform(F.sequence(F.lit(a), F.lit(z)), lambda x: F.exp(-((x - F.lit(mu)) / F.lit(beta) + F.exp(-(x - F.lit(mu)) / F.lit(beta)))) / F.lit(beta))


__all__ = ["derivative_inner", "gumbel_curve", "gumbel_density", "holt", "holt_irregular", "savgol_column", "savgol_inner"]
