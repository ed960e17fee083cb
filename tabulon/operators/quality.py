"""Quality rules: issues, score, recommendations and summary as DataFrames.

The rules are column expressions over the small per-column statistics table, so
the statistics of any number of tables can be unioned and judged in one run.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import CATEGORICAL, NUMERICAL, fold_nan
from tabulon.functions.text import fixed
from tabulon.operators.stats import TableStats, collect_stats
from tabulon.session import run_together

# Name parts that mark a column as a quantity that must not be negative.
QUANTITY_WORDS = ["qty", "quantity", "amount", "count", "price", "balance"]

# One recommendation text per issue type.
RECOMMENDATIONS = {
    "missing_values": "Consider imputing or removing missing values depending on the column's role and missingness rate.",
    "duplicate_rows": "Review duplicate records and remove them if they represent repeated observations.",
    "constant_column": "Consider removing this column because it contains no useful variation.",
    "near_constant_column": "Consider whether the slight variation in this column is meaningful or if it can be dropped.",
    "numeric_outliers": "Review extreme values and determine whether they are legitimate observations or potential data-entry errors.",
    "high_cardinality": "Consider grouping infrequent categories or applying target encoding for predictive modeling.",
    "suspicious_values": "Investigate anomalous values (e.g. negative prices, empty strings) as they likely indicate data entry errors.",
    "potential_identifier": "Review whether this column should be excluded from model training because it may uniquely identify records.",
    "empty_dataset": "Upload a valid dataset with data.",
}

STATS_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("duplicate_count", T.LongType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("distinct_count", T.LongType()),
    T.StructField("top_count", T.LongType()),
    T.StructField("iqr", T.DoubleType()),
    T.StructField("outlier_count", T.LongType()),
    T.StructField("negative_count", T.LongType()),
    T.StructField("blank_count", T.LongType()),
])

QUALITY_GROUPS = frozenset({"negatives", "blanks", "distinct", "duplicates", "outliers"})


def quality_stats(df: DataFrame, table_name: str = "table", groups=QUALITY_GROUPS, **options) -> DataFrame:
    """The statistics the rules read, one row per column of ``df``."""
    table = collect_stats(fold_nan(df), groups, **options)
    return stats_frame(df, table, table_name)


def quality_stats_of(tables: dict[str, DataFrame], groups=QUALITY_GROUPS, **options) -> DataFrame:
    """The statistics of several tables in one frame; their jobs run side by side."""
    parts = run_together(*[partial(quality_stats, df, name, groups, **options) for name, df in tables.items()])
    return reduce(DataFrame.unionByName, parts)


def stats_frame(df: DataFrame, table: TableStats, table_name: str = "table") -> DataFrame:
    rows = [
        (
            table_name, c.position, c.name, c.data_type, c.row_count, table.duplicate_count or 0, c.null_count,
            c.distinct_count, c.top_count, c.iqr, c.outlier_count, c.negative_count, c.blank_count,
        )
        for c in table.columns
    ]
    return df.sparkSession.createDataFrame(rows, STATS_SCHEMA)


def _band(value: Column, high: float, medium: float) -> Column:
    return F.when(value > high, "high").when(value > medium, "medium").otherwise("low")


def _issue(condition: Column, order: int, kind: str, severity: Column, description: Column, metric: Column, whole_table=False) -> Column:
    """A struct for one rule, null where the rule does not fire."""
    return F.when(
        condition,
        F.struct(
            F.lit(order).alias("rule_order"),
            F.lit(kind).alias("issue_type"),
            severity.alias("severity"),
            (F.lit(None).cast("string") if whole_table else F.col("column_name")).alias("column_name"),
            description.alias("description"),
            metric.cast("double").alias("metric_value"),
        ),
    )


def _rules() -> list[Column]:
    rows, filled = F.col("row_count"), F.col("row_count") - F.col("null_count")
    not_empty = rows > 0
    has_values = filled > 0
    distinct, top = F.col("distinct_count"), F.col("top_count")
    lower = F.lower("column_name")
    text_like = F.col("data_type") == CATEGORICAL

    missing = F.try_divide(F.col("null_count") * 100.0, rows)
    duplicates = F.try_divide(F.col("duplicate_count") * 100.0, rows)
    top_share = F.try_divide(top.cast("double"), filled)
    outliers = F.try_divide(F.col("outlier_count") * 100.0, rows)
    quantity_name = F.lit(False)
    for word in QUANTITY_WORDS:
        quantity_name = quantity_name | lower.contains(word)
    unique_text = text_like & (distinct == filled) & (distinct > 1)

    return [
        _issue((rows == 0) & (F.col("position") == 0), 0, "empty_dataset", F.lit("high"), F.lit("Dataset is empty"), F.lit(None), True),
        _issue(
            not_empty & (F.col("position") == 0) & (F.col("duplicate_count") > 0), 1, "duplicate_rows", _band(duplicates, 20, 5),
            F.format_string("Dataset has %d duplicate rows (%s%%).", F.col("duplicate_count"), fixed(duplicates, 2)), duplicates, True,
        ),
        _issue(
            not_empty & (F.col("null_count") > 0), 2, "missing_values", _band(missing, 20, 5),
            F.format_string("Column has %d missing values (%s%%).", F.col("null_count"), fixed(missing, 2)), missing,
        ),
        _issue(
            has_values & (distinct == 1), 3, "constant_column", F.lit("high"),
            F.lit("Column has only 1 unique value."), F.lit(1),
        ),
        _issue(
            has_values & (distinct > 1) & (top_share > 0.99), 4, "near_constant_column", F.lit("medium"),
            F.lit("Column is near-constant (>99% same value)."), top_share,
        ),
        _issue(
            has_values & (F.col("iqr") > 0) & (F.col("outlier_count") > 0), 5, "numeric_outliers", _band(outliers, 10, 5),
            F.format_string("Column has %d IQR outliers (%s%%).", F.col("outlier_count"), fixed(outliers, 2)), outliers,
        ),
        _issue(
            has_values & (F.col("data_type") == NUMERICAL) & quantity_name & (F.col("negative_count") > 0), 6,
            "suspicious_values", F.lit("high"),
            F.format_string("Found %d negative values in a likely quantity column.", F.col("negative_count")), F.col("negative_count"),
        ),
        _issue(
            has_values & text_like & (distinct > 10) & (F.try_divide(distinct.cast("double"), filled) > 0.5), 7,
            "high_cardinality", F.lit("low"),
            F.format_string("Categorical column has very high cardinality (%d unique).", distinct), distinct,
        ),
        _issue(
            has_values & text_like & (F.col("blank_count") > 0), 8, "suspicious_values", F.lit("medium"),
            F.format_string("Found %d empty or whitespace-only strings.", F.col("blank_count")), F.col("blank_count"),
        ),
        _issue(
            has_values & (lower.contains("id") | unique_text), 9, "potential_identifier", F.lit("low"),
            F.lit("Column appears to be an identifier (name contains 'id'/'uuid' or is a fully unique string column)."), distinct,
        ),
    ]


def issues_from_stats(stats: DataFrame) -> DataFrame:
    """All fired rules: ``(table_name, issue_order, issue_type, severity, column_name, description, metric_value)``."""
    fired = F.filter(F.array(*_rules()), lambda r: r.isNotNull())
    return (
        stats.select("table_name", "position", F.explode(fired).alias("r"))
        .select(
            "table_name",
            # the duplicate rule comes before all columns, then columns in order, then rules in order
            F.when(F.col("r.rule_order") < 2, F.col("r.rule_order"))
            .otherwise((F.col("position") + 1) * 100 + F.col("r.rule_order")).alias("issue_order"),
            "r.issue_type", "r.severity", "r.column_name", "r.description", "r.metric_value",
        )
    )


def find_issues(df: DataFrame, table_name: str = "table", **options) -> DataFrame:
    return issues_from_stats(quality_stats(df, table_name, **options))


def quality_score(stats: DataFrame, issues: DataFrame) -> DataFrame:
    """``(table_name, quality_score, quality_band)``; an empty table scores 0."""
    tables = stats.groupBy("table_name").agg(F.max("row_count").alias("row_count"))
    penalty = (
        F.when(F.col("severity") == "high", 5).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 1).otherwise(0)
    )
    lost = issues.groupBy("table_name").agg(F.sum(penalty).alias("lost"))
    score = F.when(F.col("row_count") == 0, 0).otherwise(F.greatest(F.lit(0), 100 - F.coalesce("lost", F.lit(0)))).cast("int")
    return tables.join(lost, "table_name", "left").select(
        "table_name",
        score.alias("quality_score"),
        F.when(score >= 80, "Good").when(score >= 50, "Needs attention").otherwise("Poor").alias("quality_band"),
    )


def recommendations(issues: DataFrame) -> DataFrame:
    """One text per issue type of a table, in order of first appearance."""
    texts = issues.sparkSession.createDataFrame(list(RECOMMENDATIONS.items()), "issue_type string, recommendation_text string")
    first_seen = issues.groupBy("table_name", "issue_type").agg(F.min("issue_order").alias("first_order"))
    # nine fixed rows
    return first_seen.join(F.broadcast(texts), "issue_type").select("table_name", "issue_type", "recommendation_text", "first_order")


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("table_name", "severity").agg(F.count(F.lit(1)).alias("issue_count"))


def quality_summary(stats: DataFrame, issues: DataFrame) -> DataFrame:
    """Percentages over all cells and rows, and how many findings of each family a table has."""
    cells = stats.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"),
        F.max("duplicate_count").alias("duplicate_count"),
        F.sum("null_count").alias("missing_cells"),
        F.sum("row_count").alias("cells"),
    )

    def found(*kinds: str) -> Column:
        return F.count_if(F.col("issue_type").isin(*kinds))

    families = issues.groupBy("table_name").agg(
        found("constant_column", "near_constant_column").alias("constant_columns"),
        found("high_cardinality").alias("high_cardinality_columns"),
        found("numeric_outliers").alias("outlier_columns"),
        found("suspicious_values").alias("suspicious_columns"),
        found("potential_identifier").alias("potential_identifiers"),
    )
    names = families.columns[1:]
    return cells.join(families, "table_name", "left").select(
        "table_name",
        F.when(F.col("row_count") == 0, F.lit(100.0)).otherwise(F.try_divide(F.col("missing_cells") * 100.0, "cells")).alias("missing_percentage"),
        F.coalesce(F.try_divide(F.col("duplicate_count") * 100.0, "row_count"), F.lit(0.0)).alias("duplicate_percentage"),
        *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names],
    )


def analyze_quality(df: DataFrame, table_name: str = "table", **options) -> dict[str, DataFrame]:
    """The full report: ``stats``, ``issues``, ``score``, ``recommendations``, ``summary``, ``severities``."""
    stats = quality_stats(df, table_name, **options)
    issues = issues_from_stats(stats)
    return {
        "stats": stats,
        "issues": issues,
        "score": quality_score(stats, issues),
        "recommendations": recommendations(issues),
        "summary": quality_summary(stats, issues),
        "severities": severity_counts(issues),
    }
