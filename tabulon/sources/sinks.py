"""Stage tables, fitted parameters and models on shared storage."""

from __future__ import annotations

import json
import uuid

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabulon.operators import trees
from tabulon.operators.dictionary import Dictionary
from tabulon.operators.prepare import CategoricalParameter, NumericParameter, Parameters
from tabulon.operators.split import SPLIT
from tabulon.operators.train import FittedModel


class ModelError(ValueError):
    """A stored model that is missing or cannot be read."""


def write_stage(df: DataFrame, folder: str, stage: str, fmt: str = "parquet", run_id: str | None = None) -> str:
    """Write a stage table below ``folder`` under a new name and return its path.

    An existing path is an error, so no input is ever overwritten; Spark's commit
    protocol leaves nothing readable behind when the job fails.
    """
    path = f"{folder.rstrip('/')}/{stage}_{run_id or uuid.uuid4().hex}.{fmt}"
    writer = df.write.mode("errorifexists")
    if SPLIT in df.columns:
        # the two sides are read separately ever after
        writer = writer.partitionBy(SPLIT)
    if fmt == "csv":
        # blanks are values: the writer would trim them
        keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(header=True, escape='"', **keep).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"Unsupported sink format: {fmt}")
    return path


PARAMETER_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("role", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("scale", T.DoubleType()),
    T.StructField("mode", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("width", T.LongType()),
    T.StructField("total", T.LongType()),
])


def parameter_frame(spark: SparkSession, p: Parameters) -> DataFrame:
    """The parameter table: one row per column."""
    rows: list[tuple] = [("target", p.target, None, None, None, None, None, None, None)]
    rows += [("numeric", n.column, n.median, n.mean, n.scale, None, None, None, None) for n in p.numeric]
    rows += [
        ("wide" if c.wide else "categorical", c.column, None, None, None, c.mode, c.categories, c.dictionary.width if c.wide else None, c.dictionary.total if c.wide else None) for c in p.categorical
    ]
    rows += [("dropped", c, None, None, None, None, None, None, None) for c in p.dropped]
    rows += [("numeric_input", c, None, None, None, None, None, None, None) for c in p.numeric_inputs]
    rows += [("categorical_input", c, None, None, None, None, None, None, None) for c in p.categorical_inputs]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PARAMETER_SCHEMA)


def save_parameters(spark: SparkSession, p: Parameters, path: str) -> None:
    parameter_frame(spark, p).coalesce(1).write.mode("errorifexists").parquet(f"{path}/parameters")
    for i, c in enumerate(p.categorical):
        if c.wide:
            c.dictionary.save(spark, f"{path}/wide_{i}")


def load_parameters(spark: SparkSession, path: str) -> Parameters:
    rows = spark.read.parquet(f"{path}/parameters").orderBy("position").collect()
    of = lambda *roles: [r for r in rows if r["role"] in roles]
    categorical = []
    for i, r in enumerate(of("categorical", "wide")):
        stored = Dictionary(r["column"], f"{path}/wide_{i}", r["width"], r["total"]) if r["role"] == "wide" else None
        categorical.append(CategoricalParameter(r["column"], r["mode"], list(r["categories"]), stored))
    return Parameters(
        of("target")[0]["column"],
        [NumericParameter(r["column"], r["median"], r["mean"], r["scale"]) for r in of("numeric")],
        categorical,
        [r["column"] for r in of("dropped")],
        [r["column"] for r in of("numeric_input")],
        [r["column"] for r in of("categorical_input")],
    )


def save_model(spark: SparkSession, fitted: FittedModel, path: str) -> None:
    """The model and, next to it, what is needed to read its predictions."""
    grown = isinstance(fitted.model, trees.TreeModel)
    if grown:
        fitted.model.save(f"{path}/model")
    else:
        fitted.model.write().save(f"{path}/model")
    facts = json.dumps({
        "name": fitted.name, "problem_type": fitted.problem_type, "features": fitted.features,
        "target_type": fitted.target_type, "labels": fitted.labels, "slots": fitted.slots,
        "trees": trees.facts_of(fitted.model) if grown else None,
    })
    spark.createDataFrame([(facts,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/facts")


def load_model(spark: SparkSession, path: str) -> FittedModel:
    try:
        facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
        model: Model | trees.TreeModel = (
            trees.load(spark, f"{path}/model", facts["trees"]) if facts.get("trees") else DefaultParamsReader.loadParamsInstance(f"{path}/model", spark))
        return FittedModel(facts["name"], facts["problem_type"], facts["features"], model, facts["target_type"], facts["labels"], [tuple(s) for s in facts["slots"]])
    except Exception as e:  # whatever is missing or broken, the model cannot be used
        raise ModelError(f"no usable model at {path}: {e}") from e
