"""Queries over append-only run logs: newest artifact, stage fallback, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.columns import col
from tabulon.operators.evaluate import latest_per_key
from tabulon.operators.lookup import join_null_safe
from tabulon.operators.ranking import number_within


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Write rows so that they replace the partitions they belong to, for instance the evaluations of an experiment."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def latest_artifact(log: DataFrame, keys: list[str], created: str, tie_break: list[str]) -> DataFrame:
    """The newest run per key."""
    return latest_per_key(log, keys, created, tie_break)


def stage_source(log: DataFrame, dataset: str, stage: str, created: str, run: str, fallback: list[str]) -> DataFrame:
    """``(dataset, source_stage, source_run)``: the newest run of the first stage in ``fallback`` a dataset has.

    One row per dataset and task survives until the shuffle; a dataset without any of the stages has nulls.
    """
    place = F.coalesce(*[F.when(col(stage) == s, F.lit(i)) for i, s in enumerate(fallback)], F.lit(len(fallback)))
    first = Window.partitionBy(col(dataset)).orderBy(place, col(created).desc_nulls_last(), col(run).desc_nulls_last())
    best = log.select(col(dataset), col(stage), col(run), place.alias("_place"), F.row_number().over(first).alias("_nth")).filter("_nth = 1")
    known = F.col("_place") < len(fallback)
    return best.select(col(dataset), F.when(known, col(stage)).alias("source_stage"), F.when(known, col(run)).alias("source_run"))


def history(log: DataFrame, keys: list[str], created: str, tie_break: list[str], single_task: int = 1_000_000) -> DataFrame:
    """Every run with its 0-based position within ``keys``, newest first, and the total per key."""
    totals = log.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("total"))
    order = [col(created).desc(), *[col(c).desc() for c in tie_break]]
    largest = totals.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
    placed = number_within(log, keys, order, "position", largest, single_task)
    return join_null_safe(placed, totals, keys)
