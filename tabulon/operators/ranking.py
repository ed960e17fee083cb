"""0-based dense numbering of many distinct values without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.session import ensure_checkpoint_dir

SINGLE_TASK_VALUES = 100_000


def number_in_order(table: DataFrame, order: list[str], name: str, count: int, single_task: int = SINGLE_TASK_VALUES) -> DataFrame:
    """Add ``name``: the position of each row of ``table`` in ``order`` (unique), from 0.

    A small table (checked) is numbered by one window.  A larger one is
    range-partitioned and checkpointed, which fixes the ranges; then each range is
    numbered on its own and shifted by the row count of the ranges before it.
    """
    if count <= single_task:
        return table.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    ranges = table.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    # one row per range, that is per shuffle partition
    sizes = {r["_range"]: r["n"] for r in ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, start = [], 0
    for number in sorted(sizes):
        offsets.append((number, start))
        start += sizes[number]
    shifts = spark.createDataFrame(offsets, "_range int, _start bigint")
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return (
        ranges.join(F.broadcast(shifts), "_range")
        .withColumn(name, (F.col("_start") + local).cast("bigint"))
        .drop("_range", "_start")
    )


def number_within(
    df: DataFrame, group: list[str], order: list[Column], name: str, largest_group: int | None = None, single_task: int = 1_000_000
) -> DataFrame:
    """Add ``name``: the 0-based position of each row in its group, for groups of any size.

    If no group exceeds ``single_task`` rows, a window does it.  Otherwise rows are
    range-partitioned by group and order and checkpointed, so that a hot group spans
    many ranges.  Only the first group of a range can have begun earlier, hence one
    offset per range is enough to turn positions within a range into positions
    within the group.
    """
    if largest_group is None:
        sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
        largest_group = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if largest_group <= single_task:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("bigint"))
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    key = F.struct(*group)
    ranges = df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    edges = (
        ranges.groupBy("_range")
        .agg(F.min(key).alias("first"), F.max(key).alias("last"))
        .join(ranges.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("n")), "_range")
        .filter((key == F.col("first")) | (key == F.col("last")))
        .select("_range", key.alias("key"), "first", "n")
    )
    # at most two rows per range: the group it begins with and the one it ends with
    carried, open_key, running = [], None, 0
    for r in sorted(edges.collect(), key=lambda r: (r["_range"], r["key"] != r["first"])):
        if r["key"] != open_key:
            open_key, running = r["key"], 0
        if r["key"] == r["first"]:
            carried.append((r["_range"], running))
        running += r["n"]
    shifts = spark.createDataFrame(carried, "_range int, _start bigint")
    firsts = edges.filter(F.col("key") == F.col("first")).select("_range", F.col("key").alias("_first"))
    starts = shifts.join(firsts, "_range")
    local = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order)) - 1
    return (
        ranges.join(F.broadcast(starts), "_range")
        .withColumn(name, (local + F.when(key == F.col("_first"), F.col("_start")).otherwise(F.lit(0))).cast("bigint"))
        .drop("_range", "_start", "_first")
    )


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Add ``name``: some numbering of all rows from 0, without moving them.

    The checkpoint fixes which row is in which partition; ids within a partition
    are consecutive, so one offset per partition makes them global.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    fixed = df.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_id", 33)
    sizes = fixed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("low")).collect()
    offsets, start = [], 0
    for r in sorted(sizes, key=lambda r: r["p"]):
        offsets.append((r["p"], r["low"], start))
        start += r["n"]
    shifts = spark.createDataFrame(offsets, "_part bigint, _low bigint, _start bigint")
    return (
        fixed.withColumn("_part", part)
        .join(F.broadcast(shifts), "_part")
        .withColumn(name, F.col("_id") - F.col("_low") + F.col("_start"))
        .drop("_id", "_part", "_low", "_start")
    )
