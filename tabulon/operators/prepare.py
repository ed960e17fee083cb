"""Leakage-free preparation: split, fit on the training rows, transform all rows by projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import CATEGORICAL, as_double, as_text, col, column_class, fold_nan
from tabulon.operators import dictionary
from tabulon.operators.dictionary import Dictionary
from tabulon.operators.quantiles import exact_quantiles
from tabulon.operators.split import SPLIT, SplitResult, train_test_split
from tabulon.operators.stats import aggregate_in_chunks
from tabulon.session import materialise, run_together
from tabulon.sources.infer import number_of_text

COLUMNS, VECTOR = "columns", "vector"
MIN_ROWS = 4
MOST_COLUMNS = 10_000  # values of one column that "columns" spreads out, unless the caller says otherwise


class PreparationError(ValueError):
    pass


@dataclass
class NumericParameter:
    column: str
    median: float
    mean: float
    scale: float


@dataclass
class CategoricalParameter:
    column: str
    mode: str
    categories: list[str]
    # set for columns that become one vector column
    dictionary: Dictionary | None = None

    @property
    def wide(self) -> bool:
        return self.dictionary is not None

    @property
    def width(self) -> int:
        return self.dictionary.width if self.wide else len(self.categories)


@dataclass
class Parameters:
    """Everything learned from the training rows."""

    target: str
    numeric: list[NumericParameter]
    categorical: list[CategoricalParameter]
    dropped: list[str] = field(default_factory=list)
    # feature columns without a value in the training rows are inputs without an output
    numeric_inputs: list[str] = field(default_factory=list)
    categorical_inputs: list[str] = field(default_factory=list)

    @property
    def feature_names(self) -> list[str]:
        names = [p.column for p in self.numeric]
        for p in self.categorical:
            names += [f"{p.column}_onehot"] if p.wide else [f"{p.column}_{v}" for v in p.categories]
        return names

    @property
    def input_columns(self) -> list[str]:
        return list(dict.fromkeys(self.numeric_inputs + self.categorical_inputs))


@dataclass
class PreparedData:
    data: DataFrame
    parameters: Parameters
    operations: DataFrame
    stats: DataFrame
    split: SplitResult


def feature_classes(df: DataFrame, target: str | None = None) -> tuple[list[str], list[str]]:
    """``(numeric, categorical)`` features; what is neither text nor number (dates, booleans) counts as numeric."""
    numeric, categorical = [], []
    for f in df.schema.fields:
        if f.name != target:
            (categorical if column_class(f.dataType) == CATEGORICAL else numeric).append(f.name)
    return numeric, categorical


def validate(df: DataFrame, target: str, test_size: float) -> tuple[int, int]:
    """Check the request; return all rows and rows with a target."""
    if not 0.1 <= test_size <= 0.5:
        raise PreparationError(f"a test share of {test_size}: possible are 0.1 to 0.5")
    if target not in df.columns:
        raise PreparationError(f"no target column '{target}'")
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count(col(target)).alias("filled")).first()
    if row["filled"] == 0:
        raise PreparationError(f"'{target}' has no value at all")
    if row["rows"] < MIN_ROWS:
        raise PreparationError(f"{row['rows']} rows, a split needs {MIN_ROWS}")
    if row["filled"] < MIN_ROWS:
        raise PreparationError(f"{row['filled']} rows with a target, a split needs {MIN_ROWS}")
    return row["rows"], row["filled"]


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(col(target).isNotNull())


def fit_numeric(train: DataFrame, cols: list[str]) -> list[NumericParameter]:
    """Training median, then mean and population deviation of the imputed values (0 becomes 1)."""
    medians = {c: v[0] for c, v in exact_quantiles(train, {c: [0.5] for c in cols}).items()}
    known = [c for c in cols if medians[c] is not None]
    expressions = {}
    for i, c in enumerate(known):
        x = F.coalesce(as_double(train, c), F.lit(float(medians[c])))
        expressions[f"mean:{i}"] = F.avg(x)
        expressions[f"scale:{i}"] = F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(F.stddev_pop(x))
    row = aggregate_in_chunks(train, expressions) if expressions else {}
    return [NumericParameter(c, medians[c], row[f"mean:{i}"], row[f"scale:{i}"] or 1.0) for i, c in enumerate(known)]


def fit_categorical(train: DataFrame, cols: list[str], one_hot: str | dict[str, str] = COLUMNS, most_columns: int = MOST_COLUMNS) -> list[CategoricalParameter]:
    """Training mode and sorted categories.

    ``one_hot`` says how a column is laid out, for all columns or by name: "columns" (a column per value, whose names come
    to the driver; more than ``most_columns`` values are refused before any is fetched) or "vector" (one sparse vector
    column, whose values stay in a dictionary table).
    """
    if not cols:
        return []
    layout = {c: one_hot if isinstance(one_hot, str) else one_hot.get(c, COLUMNS) for c in cols}
    if unknown := set(layout.values()) - {COLUMNS, VECTOR}:
        raise PreparationError(f"one-hot layout {unknown.pop()}: known are {COLUMNS} and {VECTOR}")
    counted = dictionary.count_values(train, cols)
    narrow, wide = ([c for c in cols if layout[c] == kind and c in counted.sizes] for kind in (COLUMNS, VECTOR))
    for c in narrow:
        if counted.sizes[c][0] > most_columns:
            raise PreparationError(f"'{c}' has {counted.sizes[c][0]} values, as columns at most {most_columns} are wanted: lay it out as a vector")
    values: dict[str, list[tuple[str, int]]] = {c: [] for c in narrow}
    if narrow:
        for r in counted.of(narrow).collect():
            values[r["column"]].append((r["value"], r["n"]))
    spark, dictionaries = train.sparkSession, dictionary.build(counted, wide)
    out = []
    for c in cols:
        if c in values:
            mode = min(values[c], key=lambda v: (-v[1], v[0]))[0]
            out.append(CategoricalParameter(c, mode, sorted(v for v, _ in values[c])))
        elif c in dictionaries:
            out.append(CategoricalParameter(c, dictionaries[c].most_frequent(spark), [], dictionaries[c]))
    return out


def fit(train: DataFrame, target: str, one_hot: str | dict[str, str] = COLUMNS, most_columns: int = MOST_COLUMNS) -> Parameters:
    """Learn all parameters from training rows; columns without a training value are dropped."""
    features = train.drop(SPLIT)
    numeric, categorical = feature_classes(features, target)
    num, cat = run_together(
        lambda: fit_numeric(train, numeric), lambda: fit_categorical(train, categorical, one_hot, most_columns)
    )
    learned = {p.column for p in num} | {p.column for p in cat}
    return Parameters(target, num, cat, [c for c in numeric + categorical if c not in learned], numeric, categorical)


def scaled(df: DataFrame, p: NumericParameter) -> Column:
    text = isinstance(df.schema[p.column].dataType, T.StringType)
    x = number_of_text(col(p.column)) if text else as_double(df, p.column)
    x = F.when(~F.isnan(x), x)  # not a number is a missing value, here and in training
    return (F.coalesce(x, F.lit(float(p.median))) - F.lit(float(p.mean))) / F.lit(float(p.scale))


def filled_category(df: DataFrame, p: CategoricalParameter) -> Column:
    return F.coalesce(as_text(df, p.column), F.lit(p.mode))


def transform(df: DataFrame, parameters: Parameters, keep: list[str] | None = None) -> DataFrame:
    """Apply stored parameters: ``keep`` columns, then all features, in one projection."""
    out = []
    for p in parameters.numeric:
        out.append(scaled(df, p).alias(p.column))
    for p in parameters.categorical:
        if not p.wide:
            filled = filled_category(df, p)
            out += [(filled == F.lit(v)).cast("double").alias(f"{p.column}_{v}") for v in p.categories]
    kept = [col(c).alias(f"_keep_{c}") for c in keep or []]
    wide = [p for p in parameters.categorical if p.wide]
    sources = [filled_category(df, p).alias(f"_wide_{p.column}") for p in wide]
    frame = df.select(*kept, *out, *sources)
    for p in wide:
        frame = dictionary.one_hot_vector(frame, F.col(f"`_wide_{p.column}`"), p.dictionary, f"{p.column}_onehot").drop(f"_wide_{p.column}")
    return frame.select(
        *[F.col(f"`_keep_{c}`").alias(c) for c in keep or []], *[col(f) for f in parameters.feature_names]
    )


OPERATION_SCHEMA = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("operation", T.StringType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("affected_columns", T.ArrayType(T.StringType())),
    T.StructField("fit_on", T.StringType()),
    T.StructField("detail", T.StringType()),
])

STATS_SCHEMA = T.StructType([
    T.StructField("rows_before", T.LongType()),
    T.StructField("rows_after", T.LongType()),
    T.StructField("train_rows", T.LongType()),
    T.StructField("test_rows", T.LongType()),
    T.StructField("original_feature_count", T.IntegerType()),
    T.StructField("processed_feature_count", T.IntegerType()),
    T.StructField("numeric_column_count", T.IntegerType()),
    T.StructField("categorical_column_count", T.IntegerType()),
])


def prepare(
    df: DataFrame,
    target: str,
    test_size: float = 0.20,
    seed: int = 42,
    key: list[str] | None = None,
    one_hot: str | dict[str, str] = COLUMNS,
    most_columns: int = MOST_COLUMNS,
) -> PreparedData:
    """Split, fit on train, transform train and test: ``__split__``, features, target last."""
    df = fold_nan(df)
    rows_before, rows = validate(df, target, test_size)
    supervised = drop_null_target(df, target)
    split = train_test_split(supervised, test_size, seed, key, target, rows)
    # fitting reads the training rows several times: split them once
    split.data = materialise(split.data, "split")
    parameters = fit(split.data.filter(F.col(SPLIT) == "train"), target, one_hot, most_columns)
    ready = transform(split.data, parameters, keep=[SPLIT, target])
    ready = ready.select(SPLIT, *[col(f) for f in parameters.feature_names], col(target))

    log = []
    numeric, categorical = parameters.numeric_inputs, parameters.categorical_inputs
    if numeric:
        log.append(("numeric_preprocessing", "median_imputation+standard_scaling", numeric, "train",
                    "Median imputation and standard scaling, fitted on training rows only."))
    if categorical:
        log.append(("categorical_preprocessing", "most_frequent_imputation+one_hot_encoding", categorical, "train",
                    "Most frequent value imputation and one-hot encoding, fitted on training rows only."))
    if parameters.dropped:
        log.append(("feature_dropped", "no_training_values", parameters.dropped, "train",
                    "Columns without any value in the training rows were dropped."))
    if split.note:
        log.append(("split", "unstratified", [target], "all", split.note))
    spark = df.sparkSession
    stats = (
        rows_before, rows, split.train_rows, split.test_rows, len(df.columns) - 1,
        len(parameters.feature_names), len(numeric), len(categorical),
    )
    return PreparedData(
        ready, parameters,
        spark.createDataFrame([(i, *entry) for i, entry in enumerate(log)], OPERATION_SCHEMA),
        spark.createDataFrame([stats], STATS_SCHEMA), split,
    )
