"""Running totals and numbers over a whole table in order, without a task that holds the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agewise.functions.lineage import settle


def in_ranges(df: DataFrame, order: Sequence[str | Column], name: str = "ranges") -> DataFrame:
    """``df`` dealt by sampled ranges of ``order`` and written, each row with the number of its range in ``__range``: all rows of a range come
    before those of the next. Ranges hold about equally many rows wherever the values lie; rows that are equal in all of ``order`` share
    one, so ``order`` should tell rows apart, or equal rows be counted before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(max(2, n), *order).withColumn("__range", F.spark_partition_id())
    return settle(dealt, name)


def totals_before(ranged: DataFrame, amount: Column, to: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, __range, ``to``): the sum of ``amount`` over all earlier ranges, within groups; a row for each range and group that share rows.
    Without groups these are as few as there are ranges."""
    sums = ranged.groupBy(*by, "__range").agg(F.sum(amount).alias("__s"))
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("__s").over(order.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(*by, "__range", F.coalesce(before, F.lit(0)).alias(to))


def number_rows(df: DataFrame, order: Sequence[str | Column], to: str) -> DataFrame:
    """``df`` with its rows numbered from 1 in ``order`` in the column ``to``: rows are numbered within sampled ranges, and begin after those of all
    earlier ranges. Writes a table. An empty table stays empty; which of equal rows comes first is open."""
    ranged = in_ranges(df, order, "numbered")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    before = totals_before(ranged, F.lit(1), "__before")
    return ranged.withColumn("__own", own).join(before, "__range").select(*df.columns, (F.col("__before") + F.col("__own")).alias(to))
