"""Evaluate stored models again and write the results back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.evaluate import best_models, evaluate, resolve_primary_metric
from tabulon.operators.runlog import replace_partitions
from tabulon.operators.train import split_scan, spread
from tabulon.sources.sinks import load_model

METRICS = ["accuracy", "precision", "recall", "f1", "mae", "mse", "rmse", "r2"]
SCHEMA = (
    "experiment_id string, model_id int, model_name string, evaluation_status string, error string, primary_metric string, "
    "primary_metric_value double, " + ", ".join(f"{m} double" for m in METRICS) + ", is_best boolean"
)


@dataclass
class Replayed:
    evaluations: DataFrame
    best_model: str | None


def replay_stored(ready: DataFrame, target: str, results: DataFrame, models: dict[str, str], problem_type: str, log: str,
                  stored_metric: str | None = None) -> Replayed:
    """Measure the stored models of an experiment on its held-out rows.

    ``results`` are the experiment's model rows, ``models`` the folders of those that were stored.  A model without a folder
    is skipped, one that cannot be read or fails is recorded; neither stops the others.  The best model is chosen anew from
    the measured ones and marked in its row.  The rows replace the experiment's partition of the table at ``log``, so that
    evaluations and the stored best change in one commit, and a repeated run leaves the same rows.
    """
    spark = ready.sparkSession
    _, test, _ = split_scan(ready, target)
    test = spread(test)
    metric = resolve_primary_metric(problem_type, stored_metric)
    rows = []
    for r in results.select("experiment_id", "model_id", "model_name").orderBy("model_id").collect():
        scores, status, error = {}, "completed", None
        if r["model_name"] not in models:
            status, error = "skipped", "no stored model"
        else:
            try:
                predicted = load_model(spark, models[r["model_name"]]).predict(test, keep=[target])
                scores = evaluate(predicted, problem_type, target, "prediction").first().asDict()
            except Exception as e:  # one model must not stop the others
                status, error = "failed", str(e)
        rows.append((*r, status, error, metric, scores.get(metric), *[scores.get(m) for m in METRICS]))
    measured = spark.createDataFrame([(*r, False) for r in rows], SCHEMA)
    best = best_models(measured.filter("evaluation_status = 'completed'"), problem_type, metric).select("model_name").first()
    name = best["model_name"] if best else None
    replace_partitions(measured.withColumn("is_best", F.col("model_name").eqNullSafe(F.lit(name))), log, ["experiment_id"])
    mine = read_evaluations(spark, log).filter(F.col("experiment_id").isin(list({r[0] for r in rows})))
    return Replayed(mine, name)


def read_evaluations(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(log).select(*[f.split(" ")[0] for f in SCHEMA.split(", ")])


def stored_best(spark: SparkSession, log: str) -> DataFrame:
    """``experiment_id, best_model_id`` of all experiments that have one, as a comparison of models takes it."""
    return read_evaluations(spark, log).filter("is_best").select("experiment_id", F.col("model_id").alias("best_model_id"))
