"""Training of three models on a prepared table, with pyspark.ml."""

from __future__ import annotations

import math
import time
import uuid
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import NUMERICAL, as_text, col, column_class
from tabulon.operators import dictionary, trees
from tabulon.operators.evaluate import evaluate, rank_models
from tabulon.operators.split import SPLIT
from tabulon.session import ensure_checkpoint_dir, materialise

SEED = 42
# Default depths, the same for every table, as the nodes of all trees of a forest have to fit into one model.  ``max_depth`` sets
# another (30 at most).  A regression tree has no depth unless one is set: it grows until its leaves are pure.
TREE_DEPTH = 20
FOREST_DEPTH = 12
FEW_VALUES = 20


class ExperimentError(ValueError):
    pass


def split_scan(ready: DataFrame, target: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """``(train, test, feature names)``; on a table partitioned by ``__split__`` each side reads its part only."""
    if SPLIT not in ready.columns:
        raise ExperimentError(f"no column {SPLIT} tells train from test rows")
    if target not in ready.columns:
        raise ExperimentError(f"the table has no target column '{target}'")
    features = [c for c in ready.columns if c not in (SPLIT, target)]
    wanted = [col(c) for c in features] + [col(target)]
    return (
        ready.filter(F.col(SPLIT) == "train").select(*wanted),
        ready.filter(F.col(SPLIT) == "test").select(*wanted),
        features,
    )


def infer_problem_type(train: DataFrame, target: str) -> str:
    """Numbers with more than 20 distinct values mean regression, all else classification."""
    if column_class(train.schema[target].dataType) != NUMERICAL:
        return "classification"
    few = train.select(col(target)).filter(col(target).isNotNull()).distinct().limit(FEW_VALUES + 1).count() <= FEW_VALUES
    return "classification" if few else "regression"


class WholeTreeRegressor:
    """A regression tree without a bound on its depth or thresholds, as the estimators of Spark are asked for their settings."""

    def __init__(self, seed: int):
        self.seed = seed

    def settings(self) -> dict[str, str]:
        return {"maxDepth": "None", "minInstancesPerNode": "1", "impurity": "variance", "seed": str(self.seed)}


def settings_of(estimator) -> dict[str, str]:
    if isinstance(estimator, WholeTreeRegressor):
        return estimator.settings()
    return {p.name: str(v) for p, v in estimator.extractParamMap().items()}


def estimators(problem_type: str, train_rows: int, max_depth: int | None = None, trees: int = 100, seed: int = SEED) -> dict:
    """The three models per problem type, in the order of their priority."""
    columns = {"featuresCol": "_features", "labelCol": "_label", "predictionCol": "_prediction"}
    # cached node ids spare sending all grown trees to every task at every level
    common = {**columns, "maxBins": 256, "maxMemoryInMB": 1024, "cacheNodeIds": True, "seed": seed}
    tree = {**common, "maxDepth": TREE_DEPTH if max_depth is None else max_depth}
    forest = {**common, "maxDepth": FOREST_DEPTH if max_depth is None else max_depth, "numTrees": trees}
    if problem_type == "classification":
        return {
            "RandomForestClassifier": RandomForestClassifier(**forest, featureSubsetStrategy="sqrt", impurity="gini"),
            # one over the rows: an L2 penalty of weight 1 on the summed loss
            "LogisticRegression": LogisticRegression(
                **columns, regParam=1.0 / max(train_rows, 1), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-6
            ),
            "DecisionTreeClassifier": DecisionTreeClassifier(**tree, impurity="gini"),
        }
    if problem_type == "regression":
        return {
            "RandomForestRegressor": RandomForestRegressor(**forest, featureSubsetStrategy="all"),
            "LinearRegression": LinearRegression(**columns, regParam=0.0, elasticNetParam=0.0, maxIter=1000),
            "DecisionTreeRegressor": WholeTreeRegressor(seed) if max_depth is None else DecisionTreeRegressor(**tree),
        }
    raise ExperimentError(f"no models for problem type {problem_type}")


def assemble(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Feature columns to one vector; names are replaced by positions, as they may contain any character."""
    renamed = df.select(*[col(c).alias(f"f{i}") for i, c in enumerate(features)], *[col(c).alias(f"_keep_{c}") for c in keep])
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="_features").transform(renamed)
    return vectors.select("_features", *[F.col(f"`_keep_{c}`").alias(c) for c in keep])


Slots = tuple[str, int, str]  # a name, the entries of the assembled vector that it stands for, and the folder of their dictionary or ""


def slot_names(df: DataFrame, features: list[str]) -> list[Slots]:
    """What the entries of the assembled vector are: a name each, and for one-hot vectors their dictionary, whose values are not fetched.

    The entries of any other vector column are named by its attributes or numbered.
    """
    names: list[Slots] = []
    for c in features:
        about = df.schema[c]
        if not isinstance(about.dataType, VectorUDT):
            names.append((c, 1, ""))
            continue
        if made := dictionary.of_column(about):
            names.append((made.column, made.width, made.path))
            continue
        attributes = about.metadata.get("ml_attr", {})
        known = {a["idx"]: a["name"] for kind in attributes.get("attrs", {}).values() for a in kind if "name" in a}
        size = attributes.get("num_attrs")
        if size is None:
            row = df.select(col(c).alias("v")).filter("v is not null").first()
            size = row["v"].size if row else 0
        names += [(known.get(i, f"{c}_{i}"), 1, "") for i in range(size)]
    return names


def class_labels(train: DataFrame, target: str) -> list[str]:
    """Sorted target classes as text.  A fitted classifier holds at least a number per class, so their list is no larger."""
    found = train.filter(col(target).isNotNull()).select(as_text(train, target).alias("c")).distinct()
    labels = [r["c"] for r in found.collect()]
    numeric = column_class(train.schema[target].dataType) == NUMERICAL
    return sorted(labels, key=float) if numeric else sorted(labels)


@dataclass
class FittedModel:
    """A fitted model with what is needed to read its predictions."""

    name: str
    problem_type: str
    features: list[str]
    model: Model | trees.TreeModel
    target_type: str
    labels: list[str] = field(default_factory=list)
    slots: list[Slots] = field(default_factory=list)

    def predict(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns plus ``prediction`` in the type of the target."""
        scored = self.model.transform(assemble(df, self.features, keep or []))
        prediction = F.col("_prediction")
        if self.problem_type == "classification":
            scored = scored.join(_label_table(df, self.labels), F.col("_prediction") == F.col("_number"), "left")
            prediction = F.col("_class").cast(self.target_type)
        return scored.select(*[col(c) for c in keep or []], prediction.alias("prediction"))


BROADCAST_CLASSES = 100_000


def _label_table(df: DataFrame, labels: list[str]) -> DataFrame:
    """``_number, _class`` of all classes, broadcast unless they are very many: a shuffle would send all rows of a class to one task."""
    made = df.sparkSession.createDataFrame([(float(i), v) for i, v in enumerate(labels)], "_number double, _class string")
    return F.broadcast(made) if len(labels) <= BROADCAST_CLASSES else made


def with_label(train: DataFrame, target: str, labels: list[str]) -> DataFrame:
    """Add ``_label``: the number of the class, or the target itself without classes."""
    if not labels:
        return train.withColumn("_label", col(target).cast("double"))
    numbered = train.withColumn("_text", as_text(train, target)).join(_label_table(train, labels), F.col("_text") == F.col("_class"), "left")
    return numbered.withColumnRenamed("_number", "_label").drop("_text", "_class")


# What a task of a fit reads of the cached rows, and what a row takes there (measured): trees keep it as objects,
# with a weight per tree of a forest.
TASK_BYTES = 500_000_000
ROW_BYTES, TREE_BYTES, ENTRY_BYTES = 200, 13, 4


def spread(df: DataFrame, least: int = 1) -> DataFrame:
    """Use all cores, and ``least`` partitions or more, for the many passes of a fit or for predictions when the table has fewer."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, least)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def fit_partitions(rows: int, width: int, trees: int = 1) -> int:
    """Partitions of which each has about ``TASK_BYTES`` as the fit caches it: a task's share stays the same however long the table."""
    return -(-rows * (ROW_BYTES + ENTRY_BYTES * width + TREE_BYTES * trees) // TASK_BYTES)


def tree_spec(estimator, width: int, classes: int, max_depth: int | None) -> trees.Spec | None:
    """How ``operators/trees`` grows what the estimator describes; None for what Spark fits: other models, and single trees of a given depth."""
    if isinstance(estimator, WholeTreeRegressor):
        return trees.Spec(width, exact=True, seed=estimator.seed)
    if isinstance(estimator, (RandomForestClassifier, RandomForestRegressor)):
        subset = math.ceil(math.sqrt(width)) if estimator.getFeatureSubsetStrategy() == "sqrt" else 0
        return trees.Spec(width, classes, estimator.getNumTrees(), True, subset, estimator.getMaxDepth(), seed=estimator.getSeed())
    if isinstance(estimator, DecisionTreeClassifier) and max_depth is None:
        return trees.Spec(width, classes, depth=estimator.getMaxDepth(), seed=estimator.getSeed())
    return None


def fit_model(train: DataFrame, target: str, features: list[str], name: str, problem_type: str, train_rows: int,
              labels: list[str] | None = None, vectors: DataFrame | None = None, **options) -> FittedModel:
    """Fit one named model on training rows; ``vectors`` are the rows as ``training_vectors`` gives them."""
    labels = labels if labels is not None else (class_labels(train, target) if problem_type == "classification" else [])
    vectors = vectors if vectors is not None else training_vectors(train, target, features, labels)
    estimator = estimators(problem_type, train_rows, **options)[name]
    ensure_checkpoint_dir(train.sparkSession)
    slots = slot_names(train, features)
    width = sum(width for _, width, _ in slots)
    if spec := tree_spec(estimator, width, len(labels), options.get("max_depth")):
        model = trees.fit(spread(vectors), train_rows, spec)
    else:
        model = estimator.fit(spread(vectors, fit_partitions(train_rows, width)))
    return FittedModel(name, problem_type, features, model, train.schema[target].dataType.simpleString(), labels, slots)


def training_vectors(train: DataFrame, target: str, features: list[str], labels: list[str]) -> DataFrame:
    """``_features, _label`` of all training rows, in enough partitions for the many passes of a fit."""
    return spread(assemble(with_label(train, target, labels), features, ["_label"]))


RESULT_SCHEMA = T.StructType([
    T.StructField("experiment_id", T.StringType()),
    T.StructField("model_id", T.IntegerType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("problem_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("training_rows", T.LongType()),
    T.StructField("validation_rows", T.LongType()),
    T.StructField("feature_count", T.IntegerType()),
    T.StructField("training_duration", T.DoubleType()),
    T.StructField("hyperparameters", T.MapType(T.StringType(), T.StringType())),
    *[T.StructField(m, T.DoubleType()) for m in ("accuracy", "precision", "recall", "f1", "mae", "mse", "rmse", "r2")],
])


@dataclass
class Experiment:
    experiment_id: str
    problem_type: str
    target: str
    status: str
    error: str | None
    models: dict[str, FittedModel]
    results: DataFrame
    best_model: str | None
    best_metric: str | None
    best_score: float | None


def run_experiment(
    ready: DataFrame,
    target: str,
    problem_type: str | None = None,
    experiment_id: str | None = None,
    model_names: list[str] | None = None,
    **options,
) -> Experiment:
    """Train and measure all models; a failing model is recorded and does not stop the others."""
    spark = ready.sparkSession
    train, test, features = split_scan(ready, target)
    sizes = {r[SPLIT]: r["n"] for r in ready.groupBy(SPLIT).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_train, n_test = sizes.get("train", 0), sizes.get("test", 0)
    if n_train < 2:
        raise ExperimentError(f"{n_train} training rows are too few to fit a model")
    if n_test < 1:
        raise ExperimentError(f"{n_test} test rows are too few to measure a model")
    problem_type = problem_type or infer_problem_type(train, target)
    if problem_type not in ("classification", "regression"):
        raise ExperimentError(f"problem type {problem_type}: known are classification and regression")
    labels: list[str] = []
    if problem_type == "classification":
        labels = class_labels(train, target)
        if len(labels) < 2:
            raise ExperimentError(
                f"'{target}' has {len(labels)} class(es), a classifier needs two"
            )
    experiment_id = experiment_id or uuid.uuid4().hex
    rows, fitted, vectors = [], {}, None
    for i, (name, estimator) in enumerate(estimators(problem_type, n_train, **options).items()):
        if model_names and name not in model_names:
            continue
        started, error, scores = time.time(), None, {}
        settings = settings_of(estimator)
        try:
            if vectors is None:  # assembled once for all models
                vectors = materialise(training_vectors(train, target, features, labels), "vectors")
            model = fit_model(train, target, features, name, problem_type, n_train, labels, vectors, **options)
            predicted = model.predict(spread(test), keep=[target])
            scores = evaluate(predicted, problem_type, target, "prediction").first().asDict()
            fitted[name] = model
        except Exception as e:  # one model must not stop the others
            error = str(e)
        rows.append((
            experiment_id, i, name, problem_type, "failed" if error else "trained", error, n_train, n_test, len(features),
            time.time() - started, settings,
            *[scores.get(m) for m in ("accuracy", "precision", "recall", "f1", "mae", "mse", "rmse", "r2")],
        ))
    results = spark.createDataFrame(rows, RESULT_SCHEMA)
    if not fitted:
        return Experiment(experiment_id, problem_type, target, "failed", "No models trained successfully", {}, results, None, None, None)
    metric = "f1" if problem_type == "classification" else "r2"
    best = rank_models(results.filter("status = 'trained'"), problem_type).filter("rank = 1").first()
    return Experiment(
        experiment_id, problem_type, target, "completed", None, fitted, results, best["model_name"], metric, best[metric]
    )


def replay(ready: DataFrame, experiment: Experiment) -> DataFrame:
    """Recompute the metrics of the stored models on the held-out rows; failures are isolated, gaps are skipped."""
    _, test, _ = split_scan(ready, experiment.target)
    test = spread(test)
    metric = experiment.best_metric or ("f1" if experiment.problem_type == "classification" else "r2")
    rows = []
    for r in experiment.results.orderBy("model_id").collect():
        model = experiment.models.get(r["model_name"])
        if model is None:
            rows.append((r["experiment_id"], r["model_id"], r["model_name"], "skipped",
                         "no fitted model", metric, None, {}))
            continue
        try:
            predicted = model.predict(test, keep=[experiment.target])
            scores = evaluate(predicted, experiment.problem_type, experiment.target, "prediction").first().asDict()
            scores = {k: float(v) for k, v in scores.items() if k != "rows"}
            rows.append((r["experiment_id"], r["model_id"], r["model_name"], "completed", None, metric, scores.get(metric), scores))
        except Exception as e:
            rows.append((r["experiment_id"], r["model_id"], r["model_name"], "failed", str(e), metric, None, {}))
    schema = (
        "experiment_id string, model_id int, model_name string, evaluation_status string, error string, "
        "primary_metric string, primary_metric_value double, metrics map<string, double>"
    )
    return ready.sparkSession.createDataFrame(rows, schema)
