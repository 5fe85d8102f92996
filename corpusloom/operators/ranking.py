"""Global row numbers without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_checkpoint


def number_rows(rows: DataFrame, out: str, *order: Column) -> DataFrame:
    """Add ``out``: the number of each row from 0 in a total ``order``.

    The rows are range-partitioned and written with the number of their range, so
    a range holds a bounded share of them whatever their values; ranges are
    numbered within, and the small table of their sizes gives each its first
    number. ``order`` should end in a unique column.
    """
    ranged = shared_checkpoint(rows.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))  # one row a range
    within = Window.partitionBy("_range").orderBy(*order)
    numbered = ranged.withColumn("_within", F.row_number().over(within) - 1).join(firsts, "_range")
    return numbered.withColumn(out, (F.col("_first") + F.col("_within")).cast("long")).drop("_range", "_first", "_within")
