"""Running totals over a whole table, in ranges: no task sees more than its range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from siltstream.plans.shared import stage


def running_total(rows: DataFrame, value: str, order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows up to each in the order of columns that together tell rows apart.

    Rows are dealt into ranges of the order and written; each range's total is one row, the totals before a range are summed over
    those few rows, and within a range a window goes on from there. Null values count as 0.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    # one row for each range
    totals = dealt.groupBy("_range").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_own"))
    before = totals.select("_range", (F.sum("_own").over(W.Window.orderBy("_range")) - F.col("_own")).alias("_before"))
    own = F.sum(F.coalesce(F.col(value), F.lit(0))).over(W.Window.partitionBy("_range").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0))
    return dealt.withColumn("_upto", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_upto") + F.col("_before")).drop("_range", "_upto", "_before")
