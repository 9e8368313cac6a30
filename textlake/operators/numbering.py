"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def number_rows(df: DataFrame, order_by: Sequence[str], name: str = "n", slices: int | None = None,
                rows_per_slice: int = 500_000) -> DataFrame:
    """1-based position of each row in ascending `order_by` order, which must be
    total. The rows are range-partitioned by their keys into slices of about
    `rows_per_slice` rows, stored with the number of their slice, numbered inside each,
    and shifted by the number of rows in the slices before. Rows with equal keys stay
    together, and are numbered in any order."""
    count = slices or max(1, -(-df.count() // rows_per_slice))
    keys = [F.col(c) for c in order_by]
    sliced = materialize(
        df.repartitionByRange(count, *keys).withColumn("_slice", F.spark_partition_id()), "numbered")
    # one row per slice, so this single-partition window sees at most `slices` rows
    counts = sliced.groupBy("_slice").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_slice").orderBy(*order_by)
    return (
        sliced.withColumn("_pos", F.row_number().over(inside))
        .join(offsets, "_slice")
        .withColumn(name, F.col("_pos") + F.col("_before"))
        .drop("_slice", "_pos", "_before")
    )
