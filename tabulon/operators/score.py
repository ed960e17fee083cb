"""Batch scoring with stored parameters and models, and the prediction log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import CATEGORICAL, as_text, col, column_class
from tabulon.operators.lookup import join_null_safe
from tabulon.operators.prepare import Parameters, transform
from tabulon.operators.runlog import replace_partitions
from tabulon.operators.stats import aggregate_in_chunks
from tabulon.operators.train import FittedModel
from tabulon.sources.infer import fold_na, number_of_text
from tabulon.sources.sinks import load_model


class PredictionError(ValueError):
    pass


def check_columns(df: DataFrame, parameters: Parameters, extra: list[str] | None = None) -> None:
    """The input must have exactly the feature columns (plus ``extra`` ones carried along)."""
    present, required = df.columns, parameters.input_columns
    if parameters.target in present:
        raise PredictionError(f"'{parameters.target}' is what the model predicts and cannot be an input")
    missing = [c for c in required if c not in present]
    if missing:
        raise PredictionError(f"inputs not given: {', '.join(missing)}")
    unexpected = sorted(set(present) - set(required) - set(extra or []))
    if unexpected:
        raise PredictionError(f"columns the model does not know: {', '.join(unexpected)}")


def type_violations(df: DataFrame, numeric: list[str]) -> DataFrame:
    """``(column_name, bad_rows)`` per numeric input given as text: values that are no number, in one scan.

    Spellings of a missing value are allowed, they are imputed.
    """
    textual = [c for c in numeric if c in df.columns and column_class(df.schema[c].dataType) == CATEGORICAL]
    expressions = {
        str(i): F.count_if(fold_na(as_text(df, c)).isNotNull() & number_of_text(as_text(df, c)).isNull()) for i, c in enumerate(textual)
    }
    row = aggregate_in_chunks(df, expressions) if expressions else {}
    rows = [(c, int(row[str(i)])) for i, c in enumerate(textual)]
    return df.sparkSession.createDataFrame(rows, "column_name string, bad_rows long")


def check_types(df: DataFrame, parameters: Parameters) -> None:
    bad = [r["column_name"] for r in type_violations(df, parameters.numeric_inputs).filter("bad_rows > 0").collect()]
    if bad:
        raise PredictionError(f"texts where numbers belong: {', '.join(bad)}")


def score_batch(df: DataFrame, parameters: Parameters, model: FittedModel, keep: list[str] | None = None) -> DataFrame:
    """Validate, transform with the stored parameters and predict; no fitting takes place."""
    keep = keep or []
    check_columns(df, parameters, keep)
    check_types(df, parameters)
    # a carried column may also be an input, so it travels under a name of its own
    carried = {c: f"_carried_{i}" for i, c in enumerate(keep)}
    ready = transform(df.withColumns({n: col(c) for c, n in carried.items()}), parameters, list(carried.values()))
    scored = model.predict(ready, list(carried.values()))
    return scored.select(*[col(n).alias(c) for c, n in carried.items()], "prediction")


LOG_SCHEMA = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("experiment_id", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("input_data", T.StringType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])


def log_records(
    df: DataFrame, parameters: Parameters, model: FittedModel, experiment_id: str, batch_id: str | None = None
) -> DataFrame:
    """Score ``df`` and turn each row into a log record with its inputs as JSON."""
    inputs = F.to_json(F.struct(*[col(c) for c in parameters.input_columns]), {"ignoreNullFields": "false"}).alias("input_data")
    carried = df.select(*[col(c) for c in parameters.input_columns]).withColumn("_input_data", inputs)
    scored = score_batch(carried, parameters, model, keep=["_input_data"])
    return scored.select(
        F.lit(batch_id or uuid.uuid4().hex).alias("batch_id"),
        F.lit(experiment_id).alias("experiment_id"),
        F.lit(model.name).alias("model_name"),
        F.lit(model.problem_type).alias("model_type"),
        F.col("_input_data").alias("input_data"),
        F.col("prediction").cast("string").alias("prediction"),
        F.current_timestamp().alias("created_at"),
    )


def append_log(records: DataFrame, path: str) -> None:
    """Add batches to the log; a batch that is there already is replaced as a whole, so a repeated job leaves one copy.

    The log is partitioned by experiment and batch: a history reads one folder, and no other batch is touched.
    """
    replace_partitions(records, path, ["experiment_id", "batch_id"])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The whole log; ids stay the texts they were written as, whatever they look like."""
    return spark.read.schema(LOG_SCHEMA).parquet(path).select(*LOG_SCHEMA.fieldNames())


def load_trained(spark: SparkSession, results: DataFrame, model_name: str, path: str) -> FittedModel:
    """The stored model of an experiment, refused unless its training is recorded as successful."""
    row = results.filter(F.col("model_name") == model_name).select("status").first()
    if row is None or row["status"] != "trained":
        raise PredictionError(f"{model_name} is {row['status'] if row else 'not part of the experiment'} and cannot predict")
    return load_model(spark, path)


def history(log: DataFrame, by: list[str], created: str = "created_at", tie_break: list[str] | None = None) -> DataFrame:
    """All records newest first with the number of records per ``by`` key in ``total``.

    The totals come from a pre-aggregated join, not from a window, so a model with
    most of the records does not end up in one task.
    """
    totals = log.groupBy(*[col(b) for b in by]).agg(F.count(F.lit(1)).alias("total"))
    order = [col(created).desc()] + [col(c).desc() for c in tie_break or []]
    return join_null_safe(log, totals, by).orderBy(*order)
