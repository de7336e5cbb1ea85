"""Positions inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.session import written


def positions(df: DataFrame, group: list[str], order: list[Column], out: str = "position", weight: Column | None = None, total: str | None = None) -> DataFrame:
    """Add the 1-based position of each row in its group, as row_number() would, though a group may hold any share of the rows.

    The rows are range-partitioned by (group, order), so a hot group is spread over many partitions. Ranks are taken
    inside (group, slice) and shifted by the sizes of the earlier slices of that group, of which there are at most as
    many as partitions. With `weight`, the running sum of weight up to and including the row comes in its place.
    `total` names a further column for the group's whole sum. The order columns must make the order total and the group
    columns must not be NULL. The sliced rows are written once, so that both readers see the same range bounds;
    keep df narrow and attach wide columns afterwards.
    """
    spark = df.sparkSession
    names = [f"__o{i}" for i in range(len(order))]
    keys = [F.col(g) for g in group] + [F.col(n) for n in names]
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready = df.withColumns(dict(zip(names, order, strict=True)) | {"__w": F.lit(1).cast("long") if weight is None else weight})
    sliced = written(ready.repartitionByRange(slices, *keys).withColumn("__slice", F.spark_partition_id()), "slices")
    inside = Window.partitionBy(*group, "__slice").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy(*group, "__slice").agg(F.sum("__w").alias("__n"))
    shifts = sizes.select(*group, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"), F.sum("__n").over(Window.partitionBy(*group)).alias("__total"))
    done = sliced.withColumn("__in", F.sum("__w").over(inside)).join(shifts, [*group, "__slice"]).withColumn(out, F.col("__in") + F.col("__shift"))
    if total:
        done = done.withColumn(total, F.col("__total"))
    return done.drop("__w", "__slice", "__in", "__shift", "__total", *names)
