"""Cleaning: blank strings to null, median and mode imputation, duplicate removal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import NUMERICAL, col, column_class, fold_nan
from tabulon.functions.text import blank_to_null, is_blank
from tabulon.operators.counts import distinct_row_count, modes
from tabulon.operators.quantiles import exact_quantiles
from tabulon.operators.stats import aggregate_in_chunks
from tabulon.session import run_together

OPERATION_SCHEMA = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("operation", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("affected_rows", T.LongType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("replacement_value", T.StringType()),
    T.StructField("detail", T.StringType()),
])


@dataclass
class CleaningResult:
    data: DataFrame
    operations: DataFrame
    stats: DataFrame


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Strings that are empty after stripping white space become null; a pure projection."""
    strings = set(_string_columns(df))
    return df.select(*[blank_to_null(col(c)).alias(c) if c in strings else col(c) for c in df.columns])


def missing_and_blank_counts(df: DataFrame) -> tuple[int, dict[str, int], dict[str, int]]:
    """Row count, and per column the nulls after blank folding and the blank strings, in one scan."""
    expressions = {"rows": F.count(F.lit(1))}
    strings = set(_string_columns(df))
    for i, c in enumerate(df.columns):
        if c in strings:
            expressions[f"blank:{i}"] = F.count_if(is_blank(col(c)))
        expressions[f"null:{i}"] = F.count_if(col(c).isNull())
    row = aggregate_in_chunks(df, expressions)
    blanks = {c: int(row.get(f"blank:{i}") or 0) for i, c in enumerate(df.columns)}
    nulls = {c: int(row[f"null:{i}"]) + blanks[c] for i, c in enumerate(df.columns)}
    return int(row["rows"]), nulls, blanks


def imputation_values(df: DataFrame, missing: dict[str, int], row_count: int) -> dict[str, object]:
    """Median per numeric and mode per other column that has both gaps and values."""
    todo = [c for c in df.columns if 0 < missing[c] < row_count]
    numeric = [c for c in todo if column_class(df.schema[c].dataType) == NUMERICAL]
    other = [c for c in todo if c not in numeric]
    medians, most_frequent = run_together(
        lambda: exact_quantiles(df, {c: [0.5] for c in numeric}), lambda: modes(df, other)
    )
    return {c: v[0] for c, v in medians.items()} | most_frequent


def impute(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Fill the given columns with literals in one projection; numeric ones become double."""
    out = []
    for f in df.schema.fields:
        if f.name not in values:
            out.append(col(f.name))
        elif column_class(f.dataType) == NUMERICAL:
            out.append(F.coalesce(col(f.name).cast("double"), F.lit(float(values[f.name]))).alias(f.name))
        else:
            out.append(F.coalesce(col(f.name), F.lit(values[f.name]).cast(f.dataType)).alias(f.name))
    return df.select(*out)


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Keep one copy of each full row; copies are equal, so it does not matter which."""
    return df.dropDuplicates()


def _operations(df: DataFrame, missing: dict[str, int], blanks: dict[str, int], values: dict[str, object], duplicates: int) -> list[tuple]:
    log: list[tuple] = []
    for c in df.columns:
        if blanks[c]:
            log.append(("empty_string_as_missing", c, blanks[c], "treat_as_missing", None,
                        f"Converted {blanks[c]} empty/whitespace-only strings to NA in column '{c}'."))
    for c in df.columns:
        n = missing[c]
        if not n:
            continue
        if c not in values:
            log.append(("missing_values_unresolved", c, n, "no_usable_values", None,
                        f"Column '{c}' has no usable values; cannot impute."))
        elif column_class(df.schema[c].dataType) == NUMERICAL:
            log.append(("median_imputation", c, n, "median", str(values[c]),
                        f"Imputed {n} missing values with median={values[c]} in column '{c}'."))
        else:
            log.append(("mode_imputation", c, n, "mode", str(values[c]),
                        f"Imputed {n} missing values with mode='{values[c]}' in column '{c}'."))
    if duplicates:
        log.append(("duplicate_removal", None, duplicates, "keep_first", None,
                    f"Removed {duplicates} duplicate rows, keeping first occurrence."))
    return [(i, *entry) for i, entry in enumerate(log)]


STATS_SCHEMA = T.StructType([
    T.StructField("rows_before", T.LongType()),
    T.StructField("rows_after", T.LongType()),
    T.StructField("columns_before", T.IntegerType()),
    T.StructField("columns_after", T.IntegerType()),
    T.StructField("missing_values_handled", T.LongType()),
    T.StructField("duplicates_removed", T.LongType()),
])


def imputed(df: DataFrame) -> tuple[DataFrame, int, dict[str, int], dict[str, int], dict[str, object]]:
    """Blank folding and imputation: the filled frame and what was counted and chosen for it."""
    df = fold_nan(df)
    row_count, missing, blanks = missing_and_blank_counts(df)
    folded = blanks_to_null(df)
    values = imputation_values(folded, missing, row_count)
    return impute(folded, values), row_count, missing, blanks, values


def clean(df: DataFrame) -> CleaningResult:
    """Blanks, imputation, duplicates, in this order; statistics run now, the data stays lazy."""
    spark = df.sparkSession
    filled, row_count, missing, blanks, values = imputed(df)
    duplicates = int(distinct_row_count(filled).first()["duplicate_count"]) if row_count else 0
    data = remove_duplicates(filled) if duplicates else filled
    log = _operations(df, missing, blanks, values, duplicates)
    handled = sum(missing[c] for c in values)
    n_cols = len(df.columns)
    return CleaningResult(
        data,
        spark.createDataFrame(log, OPERATION_SCHEMA),
        spark.createDataFrame([(row_count, row_count - duplicates, n_cols, n_cols, handled, duplicates)], STATS_SCHEMA),
    )
