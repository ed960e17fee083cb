"""Column classification and feature derivation: dates, text, numbers, interactions, encodings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import BOOLEAN, CATEGORICAL, DATETIME, NUMERICAL, as_double, as_text, col, column_class, columns_of, fold_nan
from tabulon.functions.text import lowercase_count, non_space_count, punctuation_count, uppercase_count, word_count
from tabulon.operators.correlation import correlation_table, strong_pairs
from tabulon.operators.counts import cardinalities, value_counts, value_text
from tabulon.operators.lookup import BROADCAST_VALUES, lookup
from tabulon.operators.ranking import SINGLE_TASK_VALUES, number_in_order
from tabulon.operators.stats import aggregate_in_chunks
from tabulon.session import ensure_checkpoint_dir, materialise, run_together

DATE_RATE = 0.8
CATEGORY_RATIO = 0.5
INTERACTION_CORR = 0.3
ISO_DATE = r"^\s*\d{4}-\d{2}-\d{2}"


@dataclass
class ColumnClasses:
    datetime: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    other: list[str] = field(default_factory=list)

    def frame(self, df: DataFrame) -> DataFrame:
        rows = [(c, kind) for kind, cols in vars(self).items() for c in cols]
        return df.sparkSession.createDataFrame(rows, "column_name string, feature_class string")


# -- classification ---------------------------------------------------------


def parse_timestamp(c: Column, formats: list[str] | None = None) -> Column:
    """ISO text to a timestamp, then any listed format; null where nothing fits.

    The ISO form must begin with a full date: a bare number such as 2024 is no date.
    """
    parsed = F.when(c.rlike(ISO_DATE), c.try_cast("timestamp_ntz"))
    for fmt in formats or []:
        parsed = F.coalesce(parsed, F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz"))
    return parsed


def date_rates(df: DataFrame, formats: list[str] | None = None) -> dict[str, float]:
    """Share of non-null strings per string column that parse as a date."""
    strings = columns_of(df, CATEGORICAL)
    expressions = {}
    for i, c in enumerate(strings):
        expressions[f"parsed:{i}"] = F.count(parse_timestamp(as_text(df, c), formats))
        expressions[f"filled:{i}"] = F.count(col(c))
    row = aggregate_in_chunks(df, expressions) if expressions else {}
    return {
        c: (row[f"parsed:{i}"] / row[f"filled:{i}"] if row[f"filled:{i}"] else 0.0) for i, c in enumerate(strings)
    }


def is_categorical(distinct: int, filled: int, ratio: float = CATEGORY_RATIO) -> bool:
    if filled == 0:
        return False
    return distinct <= 1 or distinct / filled <= ratio


def classify(df: DataFrame, formats: list[str] | None = None) -> ColumnClasses:
    """Dates (native or parseable), numbers, then strings by distinct ratio; booleans belong to none."""
    strings = columns_of(df, CATEGORICAL)
    rates, counted = run_together(
        lambda: date_rates(df, formats), lambda: cardinalities(df, strings).collect() if strings else []
    )
    counts = {r["column"]: r for r in counted}
    out = ColumnClasses()
    for f in df.schema.fields:
        kind = column_class(f.dataType)
        if kind == DATETIME or rates.get(f.name, 0.0) >= DATE_RATE:
            out.datetime.append(f.name)
        elif kind == NUMERICAL:
            out.numeric.append(f.name)
        elif kind == BOOLEAN:
            out.other.append(f.name)
        elif f.name in counts and is_categorical(counts[f.name]["distinct_count"], counts[f.name]["non_null_count"]):
            out.categorical.append(f.name)
        else:
            out.text.append(f.name)
    return out


# -- dates ------------------------------------------------------------------


def _timestamp(df: DataFrame, name: str, formats: list[str] | None) -> Column:
    kind = column_class(df.schema[name].dataType)
    return col(name).cast("timestamp_ntz") if kind == DATETIME else parse_timestamp(as_text(df, name), formats)


def datetime_features(df: DataFrame, cols: list[str], formats: list[str] | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """Calendar parts, weekend flag and whole days since the earliest date of each column."""
    if not cols:
        return df, {}
    parsed = {c: _timestamp(df, c, formats) for c in cols}
    earliest = aggregate_in_chunks(df, {str(i): F.min(parsed[c]) for i, c in enumerate(cols)})
    new, made = {}, {}
    for i, c in enumerate(cols):
        ts = parsed[c]
        features = {
            f"{c}_year": F.year(ts),
            f"{c}_month": F.month(ts),
            f"{c}_day": F.dayofmonth(ts),
            f"{c}_day_of_week": F.weekday(ts),
            f"{c}_quarter": F.quarter(ts),
            f"{c}_is_weekend": F.coalesce((F.weekday(ts) >= 5).cast("int"), F.lit(0)),
        }
        if earliest[str(i)] is not None:
            features[f"{c}_days_since_reference"] = F.timestamp_diff("DAY", F.lit(earliest[str(i)]).cast("timestamp_ntz"), ts)
        new.update(features)
        made[c] = list(features)
    return df.withColumns(new), made


# -- text -------------------------------------------------------------------


def text_features(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    new, made = {}, {}
    for c in cols:
        text = F.coalesce(as_text(df, c), F.lit(""))
        words = word_count(text)
        features = {
            f"{c}_word_count": words,
            f"{c}_char_count": F.length(text),
            f"{c}_avg_word_length": F.coalesce(F.try_divide(non_space_count(text).cast("double"), words), F.lit(0.0)),
            f"{c}_uppercase_count": uppercase_count(text),
            f"{c}_lowercase_count": lowercase_count(text),
            f"{c}_punctuation_count": punctuation_count(text),
        }
        new.update(features)
        made[c] = list(features)
    return df.withColumns(new), made


# -- numbers ----------------------------------------------------------------


def numeric_features(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Square, cube, log1p and square root; negatives and nulls count as 0 in the last two."""
    new, made = {}, {}
    for c in cols:
        x = col(c).cast("double")
        floor0 = F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))
        features = {
            f"{c}_squared": x * x,
            f"{c}_cubed": x * x * x,
            f"{c}_log": F.log1p(floor0),
            f"{c}_sqrt": F.sqrt(floor0),
        }
        new.update(features)
        made[c] = list(features)
    return df.withColumns(new), made


def correlated_pairs(df: DataFrame, cols: list[str], threshold: float = INTERACTION_CORR) -> DataFrame:
    """Pairs in name order whose absolute correlation reaches the threshold."""
    return correlation_table(df, sorted(cols)).filter(F.abs("corr") >= threshold)


def interaction_columns(a: str, b: str) -> dict[str, Column]:
    x = F.coalesce(col(a).cast("double"), F.lit(0.0))
    y = F.coalesce(col(b).cast("double"), F.lit(0.0))
    return {f"{a}_x_{b}": x * y, f"{a}_div_{b}": F.coalesce(F.try_divide(x, y), F.lit(0.0))}


def interaction_features(
    df: DataFrame, cols: list[str], threshold: float = INTERACTION_CORR
) -> tuple[DataFrame, dict[tuple[str, str, float], list[str]]]:
    """Product and ratio of each correlated pair; a zero denominator gives 0."""
    if len(cols) < 2:
        return df, {}
    new, made = {}, {}
    for a, b, r in strong_pairs(df, sorted(cols), F.abs("corr") >= threshold):  # in name order
        features = interaction_columns(a, b)
        new.update(features)
        made[a, b, r] = list(features)
    return df.withColumns(new) if new else df, made


# -- categories -------------------------------------------------------------


@dataclass
class CategoryTable:
    """``values`` has ``(value, n, freq, label)``; its size and the number of counted rows are known."""

    values: DataFrame
    value_count: int
    total: int


def _count_categories(df: DataFrame, cols: list[str], order_by: str | None) -> DataFrame:
    """``(column, value, n[, first_seen])`` of all columns."""
    if order_by is None:
        return value_counts(df, cols).select("column", value_text().alias("value"), "n")
    parts = [
        df.filter(col(c).isNotNull())
        .groupBy(as_text(df, c).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(col(order_by)).alias("first_seen"))
        .select(F.lit(c).alias("column"), "value", "n", "first_seen")
        for c in cols
    ]
    return reduce(DataFrame.unionByName, parts)


def category_tables(
    df: DataFrame, cols: list[str], order_by: str | None = None, single_task: int = SINGLE_TASK_VALUES
) -> dict[str, CategoryTable]:
    """Values, frequencies and labels of all columns, counted in one pass and kept.

    Labels count from 0 in value order, or by the smallest ``order_by`` per value.
    The counts are checkpointed: every later job would otherwise count again.
    """
    if not cols:
        return {}
    ensure_checkpoint_dir(df.sparkSession)
    counted = _count_categories(df, cols, order_by).checkpoint()
    sizes = {
        r["column"]: r
        for r in counted.groupBy("column").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).collect()
    }
    order = ["value"] if order_by is None else ["first_seen", "value"]
    out = {}
    for c in cols:
        size, total = (sizes[c]["size"], sizes[c]["total"]) if c in sizes else (0, 0)
        mine = counted.filter(F.col("column") == F.lit(c)).drop("column")
        labelled = number_in_order(mine, order, "label", size, single_task)
        freq = F.col("n") / F.lit(float(max(total, 1)))
        out[c] = CategoryTable(labelled.select("value", "n", freq.alias("freq"), "label"), size, total)
    return out


def categorical_features(
    df: DataFrame,
    cols: list[str],
    order_by: str | None = None,
    broadcast_values: int = BROADCAST_VALUES,
    single_task: int = SINGLE_TASK_VALUES,
    tables: dict[str, CategoryTable] | None = None,
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Frequency among non-null rows (null gives 0) and label encoding (null gives -1)."""
    made, out = {}, df
    for c, table in (tables if tables is not None else category_tables(df, cols, order_by, single_task)).items():
        out = lookup(out, as_text(df, c), table.values, ["freq", "label"], table.value_count, table.total, broadcast_values)
        out = out.withColumns({
            f"{c}_freq": F.coalesce("freq", F.lit(0.0)),
            f"{c}_label": F.coalesce("label", F.lit(-1).cast("bigint")),
        }).drop("freq", "label")
        made[c] = [f"{c}_freq", f"{c}_label"]
    return out, made


# -- the whole stage --------------------------------------------------------

OPERATION_SCHEMA = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("operation", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("new_features", T.ArrayType(T.StringType())),
    T.StructField("strategy", T.StringType()),
    T.StructField("affected_rows", T.LongType()),
    T.StructField("detail", T.StringType()),
])

STATS_SCHEMA = T.StructType([
    T.StructField("rows_before", T.LongType()),
    T.StructField("rows_after", T.LongType()),
    T.StructField("columns_before", T.IntegerType()),
    T.StructField("columns_after", T.IntegerType()),
    T.StructField("features_added", T.IntegerType()),
    T.StructField("features_removed", T.IntegerType()),
])


@dataclass
class FeatureResult:
    data: DataFrame
    operations: DataFrame
    stats: DataFrame
    new_features: list[str]
    classes: ColumnClasses


def engineer(
    df: DataFrame,
    formats: list[str] | None = None,
    order_by: str | None = None,
    protect: list[str] | None = None,
    corr_threshold: float = INTERACTION_CORR,
) -> FeatureResult:
    """Classify, derive all features, then select; ``protect`` names columns selection must keep."""
    from tabulon.operators.selection import select_features

    df = fold_nan(df)
    classes = classify(df, formats)
    log: list[tuple] = []
    added: list[str] = []

    def note(operation: str, column: str | None, names: list[str], strategy: str, detail: str, rows: int | None = None):
        added.extend(names)
        log.append((len(log), operation, column, names, strategy, rows, detail))

    # all three look at the original columns only
    (out, made), (_, pairs), tables = run_together(
        lambda: datetime_features(df, classes.datetime, formats),
        lambda: interaction_features(df, classes.numeric, corr_threshold),
        lambda: category_tables(df, classes.categorical, order_by),
    )
    for c, names in made.items():
        note("date_extraction", c, names, "component_extraction", f"Extracted {len(names)} datetime features from '{c}'.")
    out, made = text_features(out, classes.text)
    for c, names in made.items():
        note("text_features", c, names, "statistical_extraction", f"Extracted {len(names)} text features from '{c}'.")
    out, made = numeric_features(out, classes.numeric)
    for c, names in made.items():
        note("numeric_transformation", c, names, "polynomial_log_sqrt", f"Created {len(names)} numeric features from '{c}'.")
    for (a, b, r), names in pairs.items():
        out = out.withColumns(interaction_columns(a, b))
        note("interaction_features", f"{a}, {b}", names, "product_ratio",
             f"Created product and ratio features for correlated columns '{a}' and '{b}' (corr={r:.3f}).")
    out, made = categorical_features(out, classes.categorical, tables=tables)
    for c, names in made.items():
        note("categorical_encoding", c, names, "frequency_label_encoding",
             f"Created frequency and label encoding features for '{c}'.")

    # selection looks at every column several times: derive them once
    selection = select_features(materialise(out, "features"), protect)
    for operation, strategy, detail in selection.log:
        note(operation, None, [], strategy, detail, selection.row_count)
    kept = set(selection.data.columns)
    surviving = [f for f in added if f in kept]
    spark = df.sparkSession
    stats = (
        selection.row_count, selection.row_count, len(df.columns), len(selection.data.columns),
        len(added), len(added) - len(surviving),
    )
    return FeatureResult(
        selection.data, spark.createDataFrame(log, OPERATION_SCHEMA), spark.createDataFrame([stats], STATS_SCHEMA), surviving, classes
    )
