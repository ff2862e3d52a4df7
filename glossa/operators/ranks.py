"""Places in an order over all rows, without ordering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import cut


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their numbers from 0 in an order: ranges are numbered apart, each after
    the rows of those before it."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn(name, place.cast("long")).join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
