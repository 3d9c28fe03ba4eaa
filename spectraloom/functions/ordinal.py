"""Row numbers and running sums in a total order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, bucket: Column, order: list[Column | str], out: str) -> DataFrame:
    """``df`` with ``out`` = 1, 2, … in the order of ``bucket``, then ``order``.

    ``bucket`` must not decrease along the order and must have few values: only
    its counts meet in one task, the rows of a bucket in one each.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return df.join(offsets, "_bucket").withColumn(out, F.col("_offset") + F.row_number().over(inside)).drop("_bucket", "_offset")
