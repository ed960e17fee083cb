"""What fitted models say: feature importance, tree nodes, and whether logistic weights are an optimum, as tables."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.operators.dictionary import Dictionary
from tabulon.operators.runlog import replace_partitions
from tabulon.operators.train import Experiment, FittedModel, Slots, training_vectors
from tabulon.operators.trees import TreeModel
from tabulon.session import stage_dir

SCHEMA = "position int, feature_name string, importance_value double"


def importance_table(spark: SparkSession, values: list[float], names: list[str] | list[Slots] | None, kind: str) -> DataFrame:
    """Values, their share of the total (0 if there is none) and rank from 1; ties keep feature order.

    Entries that stand for the values of a dictionary get their names from its table, by a join.
    """
    slots = [(n, 1, "") if isinstance(n, str) else n for n in names or []]
    given: list[str] = []
    stored = []
    for name, width, path in slots:
        if path:
            stored.append((len(given), name, Dictionary(name, path, width, 0)))
        given += [name] * width
    rows = pd.DataFrame({
        "position": np.arange(len(values), dtype=np.int32),
        "feature_name": [given[i] if i < len(given) else f"Feature_{i}" for i in range(len(values))],
        "importance_value": np.asarray(values, dtype=np.float64),
    })
    frame = spark.createDataFrame(rows, SCHEMA)
    for start, column, known in stored:
        # entries of a one-hot vector are called column_value
        parts = known.table(spark).select((F.col("slot") + start).alias("position"), F.concat(F.lit(f"{column}_"), "value").alias("_name"))
        frame = frame.join(parts, "position", "left").select("position", F.coalesce("_name", "feature_name").alias("feature_name"), "importance_value")
    total = float(sum(values))
    share = F.col("importance_value") / F.lit(total) if total > 0 else F.lit(0.0)
    # one row per feature of a model
    order = Window.orderBy(F.col("importance_value").desc(), F.col("position").asc())
    return frame.select(
        "feature_name", "importance_value", share.alias("normalized_importance"),
        F.row_number().over(order).alias("rank"), F.lit(kind).alias("importance_type"),
    )


def feature_importance(spark: SparkSession, fitted: FittedModel) -> DataFrame | None:
    """Tree importances, or absolute coefficients (averaged over classes); None if the model has neither."""
    model = fitted.model
    if hasattr(model, "featureImportances"):
        return importance_table(spark, list(model.featureImportances.toArray()), fitted.slots or fitted.features, "tree")
    # a multinomial model refuses its coefficient vector, every logistic model has the matrix
    if hasattr(model, "coefficientMatrix"):
        weights = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
        return importance_table(spark, list(weights), fitted.slots or fitted.features, "linear")
    if hasattr(model, "coefficients"):
        return importance_table(spark, list(np.abs(model.coefficients.toArray())), fitted.slots or fitted.features, "linear")
    return None


ARTIFACT_SCHEMA = (
    "experiment_id string, model_id int, feature_name string, importance_value double, normalized_importance double, rank int, importance_type string"
)
ARTIFACT_COLUMNS = [f.split(" ")[0] for f in ARTIFACT_SCHEMA.split(", ")]


def save_importances(spark: SparkSession, experiment: Experiment, path: str) -> None:
    """Write the importances of all models of an experiment, a partition per model, which a later run replaces.

    A model that has none leaves no rows.
    """
    ids = {r["model_name"]: r["model_id"] for r in experiment.results.select("model_name", "model_id").collect()}
    for name, fitted in experiment.models.items():
        made = feature_importance(spark, fitted)
        if made is not None:
            owned = made.withColumns({"experiment_id": F.lit(experiment.experiment_id), "model_id": F.lit(ids[name])})
            replace_partitions(owned.select(*ARTIFACT_COLUMNS), path, ["experiment_id", "model_id"])


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTIFACT_SCHEMA).parquet(path).select(*ARTIFACT_COLUMNS)


NODE_SCHEMA = (
    "tree int, node long, depth int, feature_name string, threshold double, rows long, prediction string, predicted_value double, "
    "impurity double, gain double"
)


def tree_nodes(spark: SparkSession, fitted: FittedModel) -> DataFrame:
    """The nodes of a tree, or of all trees of a forest, as a table; no rows for other models.

    ``node`` counts from 1 at the root, the children of n are 2n (at most the threshold) and 2n + 1; it is null below the 62nd
    level, where a long is too short.  Leaves have no feature and no threshold.  ``prediction`` is the class or the mean.  The
    nodes of a ``TreeModel`` stay a table; those of Spark's models are read from their stored form, as many as the driver holds already.
    """
    if isinstance(fitted.model, TreeModel):
        return _named_nodes(spark, fitted)
    if not hasattr(fitted.model, "featureImportances"):
        return spark.createDataFrame([], NODE_SCHEMA)
    path = f"{stage_dir(spark, 'trees')}/{uuid.uuid4().hex}"
    fitted.model.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    nodes = stored.select("treeID", "nodeData.*") if "treeID" in stored.columns else stored.withColumn("treeID", F.lit(0))
    by_place = {(r["treeID"], r["id"]): r for r in nodes.collect()}
    names = [n for name, width, kind in fitted.slots for n in ([name] if not kind else [f"{name}_{i}" for i in range(width)])] or fitted.features
    out, ahead = [], [(tree, 0, 1) for tree in sorted({t for t, _ in by_place})]
    while ahead:
        tree, place, node = ahead.pop()
        r = by_place[tree, place]
        inner = r["leftChild"] >= 0
        label = fitted.labels[int(r["prediction"])] if fitted.labels else str(r["prediction"])
        feature, threshold = (names[r["split"]["featureIndex"]], r["split"]["leftCategoriesOrThreshold"][0]) if inner else (None, None)
        out.append((tree, node, node.bit_length() - 1, feature, threshold, r["rawCount"], label, r["prediction"], r["impurity"], r["gain"] if inner else None))
        if inner:
            ahead += [(tree, r["leftChild"], 2 * node), (tree, r["rightChild"], 2 * node + 1)]
    return spark.createDataFrame(out, NODE_SCHEMA)


def _named_nodes(spark: SparkSession, fitted: FittedModel) -> DataFrame:
    names = [n for name, width, kind in fitted.slots for n in ([name] if not kind else [f"{name}_{i}" for i in range(width)])] or fitted.features
    known = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "feature int, feature_name string")
    nodes = fitted.model.nodes().join(F.broadcast(known), "feature", "left").withColumn("predicted_value", F.col("prediction"))
    if fitted.labels:
        classes = spark.createDataFrame([(float(i), c) for i, c in enumerate(fitted.labels)], "prediction double, class string")
        nodes = nodes.join(F.broadcast(classes), "prediction", "left").drop("prediction").withColumnRenamed("class", "prediction")
    return nodes.select(*[F.col(f.split(" ")[0]).cast(f.split(" ")[1]) for f in NODE_SCHEMA.split(", ")])


def logistic_gradient(fitted: FittedModel, train: DataFrame, target: str, penalty: float) -> DataFrame:
    """``class, n, expected, largest_gradient`` of a fitted logistic model over its training rows.

    ``expected`` is the sum of the predicted probabilities of the class, at the optimum equal to its ``n`` rows, as intercepts
    carry no penalty.  ``largest_gradient`` is the largest slope, by any weight of the class, of the mean loss plus
    ``penalty / 2`` times the squared weights; at the optimum it vanishes.  The sums are made in the tasks; the driver gets
    none of them, only the model it has is joined to them.
    """
    spark = train.sparkSession
    scored = fitted.model.transform(training_vectors(train, target, fitted.features, fitted.labels))
    two = fitted.model.numClasses == 2
    weights = fitted.model.coefficientMatrix.toArray()
    vectors = scored.select(vector_to_array("_features").alias("x"), vector_to_array("probability").alias("p"), "_label")
    k, width = len(fitted.labels), weights.shape[1]

    def partial(batches):
        total, expected, n = np.zeros((k, width)), np.zeros(k), np.zeros(k, np.int64)
        for batch in batches:
            x, p = np.stack(batch["x"]), np.stack(batch["p"])
            own = np.eye(k)[batch["_label"].to_numpy().astype(int)]
            total += (p - own).T @ x
            expected += p.sum(axis=0)
            n += own.sum(axis=0).astype(np.int64)
        yield pd.DataFrame({"number": np.arange(k), "n": n, "expected": expected, "slopes": list(total)})

    parts = vectors.mapInPandas(partial, "number int, n long, expected double, slopes array<double>")
    # one short row per class and task
    sums = parts.groupBy("number").agg(
        F.sum("n").alias("n"), F.sum("expected").alias("expected"), *[F.sum(F.col("slopes")[i]).alias(f"s{i}") for i in range(width)])
    # with two classes there is one row of weights, for the second class; the slope by the first is its negative
    sign = [(-1.0, 0), (1.0, 0)] if two else [(1.0, i) for i in range(k)]
    known = spark.createDataFrame(
        [(i, fitted.labels[i], [float(sign[i][0] * w) for w in weights[sign[i][1]]]) for i in range(k)], "number int, class string, w array<double>")
    rows = F.sum("n").over(Window.partitionBy(F.lit(0)))
    slopes = F.array(*[F.abs(F.col(f"s{i}") / F.col("all") + F.lit(float(penalty)) * F.col("w")[i]) for i in range(width)])
    return sums.withColumn("all", rows).join(known, "number").select("class", "n", "expected", F.array_max(slopes).alias("largest_gradient"))
