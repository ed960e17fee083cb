"""Column and table profiles as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import BOOLEAN, CATEGORICAL, DATETIME, NUMERICAL, fold_nan
from tabulon.operators.stats import ALL_GROUPS, ColumnStats, TableStats, collect_stats

COLUMN_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("non_null_count", T.LongType()),
    T.StructField("unique_count", T.LongType()),
    T.StructField("min_value", T.DoubleType()),
    T.StructField("max_value", T.DoubleType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("stddev", T.DoubleType()),
    T.StructField("variance", T.DoubleType()),
    T.StructField("q1", T.DoubleType()),
    T.StructField("q3", T.DoubleType()),
    T.StructField("iqr", T.DoubleType()),
    T.StructField("outlier_count", T.LongType()),
    T.StructField("lower_bound", T.DoubleType()),
    T.StructField("upper_bound", T.DoubleType()),
    T.StructField("min_date", T.StringType()),
    T.StructField("max_date", T.StringType()),
    T.StructField("memory_bytes", T.LongType()),
    T.StructField("top_values", T.ArrayType(T.StringType())),
    T.StructField("top_value_counts", T.ArrayType(T.LongType())),
])


def _column_row(c: ColumnStats) -> tuple:
    categorical = c.data_type == CATEGORICAL
    return (
        c.name, c.position, c.data_type, c.dtype, c.row_count, c.null_count, c.non_null_count, c.distinct_count,
        c.min_value, c.max_value, c.mean, c.median, c.stddev, c.variance, c.q1, c.q3, c.iqr, c.outlier_count,
        c.lower_bound, c.upper_bound, c.min_date, c.max_date, c.value_bytes,
        [v for v, _ in c.top] if categorical else None,
        [n for _, n in c.top] if categorical else None,
    )


def percent(part: str, whole: str = "row_count"):
    """Percentage of rows, 0 for an empty table."""
    return F.coalesce(F.try_divide(F.col(part) * F.lit(100.0), F.col(whole)), F.lit(0.0))


def column_profile(df: DataFrame, groups=ALL_GROUPS, stats: TableStats | None = None, **options) -> DataFrame:
    """One row per column: class, type, null and distinct counts, numeric, date and top-value statistics."""
    table = stats or collect_stats(fold_nan(df), set(groups) - {"duplicates"}, **options)
    frame = df.sparkSession.createDataFrame([_column_row(c) for c in table.columns], COLUMN_SCHEMA)
    share = F.when(
        F.col("row_count") > 0,
        F.transform("top_value_counts", lambda n: n * F.lit(100.0) / F.col("row_count")),
    ).otherwise(F.array().cast("array<double>"))
    return frame.select(
        "*",
        percent("null_count").alias("null_percentage"),
        percent("unique_count").alias("unique_percentage"),
        percent("outlier_count").alias("outlier_percentage"),
        share.alias("top_value_percentages"),
    )


TABLE_SCHEMA = T.StructType([
    T.StructField("row_count", T.LongType()),
    T.StructField("column_count", T.IntegerType()),
    T.StructField("duplicate_row_count", T.LongType()),
    T.StructField("memory_bytes", T.LongType()),
    T.StructField("missing_cells", T.LongType()),
    T.StructField("numerical_columns", T.IntegerType()),
    T.StructField("categorical_columns", T.IntegerType()),
    T.StructField("datetime_columns", T.IntegerType()),
    T.StructField("boolean_columns", T.IntegerType()),
])


def table_profile(df: DataFrame, stats: TableStats | None = None) -> DataFrame:
    """One row about the whole table."""
    table = stats or collect_stats(fold_nan(df), {"duplicates", "bytes"})
    kinds = [c.data_type for c in table.columns]
    row = (
        table.row_count, len(table.columns), table.duplicate_count,
        sum(c.value_bytes for c in table.columns), sum(c.null_count for c in table.columns),
        kinds.count(NUMERICAL), kinds.count(CATEGORICAL), kinds.count(DATETIME), kinds.count(BOOLEAN),
    )
    frame = df.sparkSession.createDataFrame([row], TABLE_SCHEMA)
    return frame.withColumn("duplicate_row_percentage", percent("duplicate_row_count"))


def profile(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """``(table profile, column profile)`` from one set of statistics."""
    table = collect_stats(fold_nan(df), **options)
    return table_profile(df, table), column_profile(df, stats=table)
