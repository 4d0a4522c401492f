"""Running totals over a total order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.session import materialize


def running_totals(
    df: DataFrame, order: Sequence[Column], sums: dict[str, Column], ranges: int | None = None
) -> DataFrame:
    """Adds, per name in ``sums``, the total up to and including each row in the given order.

    Rows are range-partitioned by the order and stored once with the number of their range. Each
    range is summed, only the range sums are accumulated centrally, and each range then runs its
    own window on top of its offset.
    """
    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(ranges, *order).withColumns(
        {"range_no": F.spark_partition_id(), **{f"part_{k}": v for k, v in sums.items()}})
    placed = materialize(placed, "ordered")
    per_range = placed.groupBy("range_no").agg(*[F.sum(f"part_{k}").alias(f"off_{k}") for k in sums])
    # one row per range: as many as partitions were asked for
    earlier = Window.partitionBy(F.lit(0)).orderBy("range_no").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = F.broadcast(per_range.select("range_no", *[
        F.coalesce(F.sum(f"off_{k}").over(earlier), F.lit(0)).alias(f"off_{k}") for k in sums]))
    inside = Window.partitionBy("range_no").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return placed.join(offsets, "range_no").select(
        *df.columns,
        *[(F.col(f"off_{k}") + F.sum(f"part_{k}").over(inside)).alias(k) for k in sums])


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row."""
    single = F.broadcast(one_row.withColumn("constant_key", F.lit(0)))
    return df.withColumn("constant_key", F.lit(0)).join(single, "constant_key").drop("constant_key")
