"""Ordered computations on groups of any size.

A plain window puts a whole group into one task. Here every group is first cut
into buckets along its order; rows only meet within a bucket, and one summary
row per bucket carries what crosses the borders. ``bucket`` must never fall as
the order rises. Ties are settled by the last order column, which callers make
unique. Null order values come first, as their own bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatloom.session import written


def _buckets(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    return df.withColumn("_bucket", F.coalesce(bucket.cast("bigint"), F.lit(-(1 << 62))))


def running_total(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: Column, out: str) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over all earlier rows of the group."""
    rows = _buckets(df, keys, bucket).withColumn("_value", F.coalesce(value, F.lit(0)).cast("bigint"))
    by_group = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum")).select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(by_group), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carried, [*keys, "_bucket"])
    return joined.withColumn(out, F.col("_carried") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_bucket", "_value", "_carried")


def numbered(df: DataFrame, order: list[Column], bucket: Column | None, out: str) -> DataFrame:
    """Adds ``out``, the number of each row from 1 over the whole table.

    Without a bucket the rows are split by ranges of their order and written to
    the shared folder while the query is built, so that every later look at
    them sees the same ranges; the windows see a range or one row for each.
    """
    if bucket is None:
        rows = written(df.select("*", *[c.alias(f"_order{i}") for i, c in enumerate(order)]).repartitionByRange(*[f"_order{i}" for i in range(len(order))]).withColumn("_bucket", F.spark_partition_id()), "numbered")
        order = [F.col(f"_order{i}") for i in range(len(order))]
    else:
        rows = df.withColumn("_bucket", bucket)
    along = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return rows.join(sizes, "_bucket").withColumn(out, F.col("_carried") + F.row_number().over(inside)).select(*df.columns, out)


def lagged(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, values: dict[str, Column]) -> DataFrame:
    """Adds, for each name in ``values``, the value on the row before (null on a group's first row)."""
    rows = _buckets(df, keys, bucket).withColumn("_row", F.struct(*[c.alias(name) for name, c in values.items()]))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    last = rows.withColumn("_n", F.row_number().over(inside)).groupBy(*keys, "_bucket").agg(F.max_by("_row", "_n").alias("_last"))
    by_group = Window.partitionBy(*keys).orderBy("_bucket")
    carried = last.select(*keys, "_bucket", F.lag("_last").over(by_group).alias("_carried"))
    before = F.coalesce(F.lag("_row").over(inside), F.col("_carried"))
    joined = rows.join(carried, [*keys, "_bucket"]).withColumn("_before", before)
    return joined.select(*df.columns, *[F.col("_before")[name].alias(name) for name in values])
