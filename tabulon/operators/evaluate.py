"""Metrics from one grouped pass over labels and predictions, model ranking and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.columns import col
from tabulon.operators.lookup import join_null_safe
from tabulon.operators.ranking import number_within

MAX_MATRIX_LABELS = 20

# Which model wins when the metrics are equal, best first.
MODEL_PRIORITY = [
    "RandomForestClassifier", "LogisticRegression", "DecisionTreeClassifier",
    "RandomForestRegressor", "LinearRegression", "DecisionTreeRegressor",
]

# The metrics a ranking may use and whether more is better.
HIGHER_IS_BETTER = {
    "f1": True, "accuracy": True, "precision": True, "recall": True,
    "r2": True, "mae": False, "mse": False, "rmse": False,
}
CLASSIFICATION_METRICS = ["accuracy", "precision", "recall", "f1"]
REGRESSION_METRICS = ["mae", "mse", "rmse", "r2"]


def label_counts(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Rows per actual and predicted label; every classification metric follows from this."""
    return df.groupBy(*[col(b) for b in by or []], col(label).cast("string").alias("actual"), col(prediction).cast("string").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; a zero denominator counts as 0."""
    keys = by or []
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    per_label = (
        label_counts(df, label, prediction, by)
        .select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, "s.label")
        .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.tp").alias("tp"))
    )
    support, predicted, tp = F.col("support"), F.col("predicted"), F.col("tp")
    n = F.sum("support")

    def weighted(metric: Column) -> Column:
        return F.sum(support * F.coalesce(metric, F.lit(0.0))) / n

    return per_label.groupBy(*keys).agg(
        n.alias("rows"),
        (F.sum("tp") / n).alias("accuracy"),
        weighted(F.try_divide(tp.cast("double"), predicted)).alias("precision"),
        weighted(F.try_divide(tp.cast("double"), support)).alias("recall"),
        weighted(F.try_divide(tp * 2.0, support + predicted)).alias("f1"),
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", max_labels: int = MAX_MATRIX_LABELS) -> DataFrame | None:
    """``(actual, predicted, n)`` for every pair of labels, zeros included; None above ``max_labels``."""
    counts = label_counts(df, label, prediction)
    found = counts.select(F.explode(F.array("actual", "predicted")).alias("label")).filter("label is not null").distinct()
    # one more than allowed is enough to know that there are too many
    labels = sorted(r["label"] for r in found.limit(max_labels + 1).collect())
    if len(labels) > max_labels:
        return None
    pairs = [(a, p) for a in labels for p in labels]
    grid = df.sparkSession.createDataFrame(pairs, "actual string, predicted string")
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """MAE, MSE, RMSE and R2 in one aggregate; a constant target gives R2 1 if exact, else 0."""
    y, e = col(label).cast("double"), col(label).cast("double") - col(prediction).cast("double")
    sums = df.groupBy(*[col(b) for b in by or []]).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.var_pop(y).alias("_var"),
        (F.min(y) == F.max(y)).alias("_constant"),
    )
    r2 = F.when(F.col("_constant"), F.when(F.col("mse") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide("mse", "_var"))
    return sums.select(*[col(b) for b in by or []], "rows", "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def evaluate(df: DataFrame, problem_type: str, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    if problem_type == "classification":
        return classification_metrics(df, label, prediction, by)
    return regression_metrics(df, label, prediction, by)


def resolve_primary_metric(problem_type: str, stored: str | None = None) -> str:
    """A stored metric that fits the problem type wins over the default."""
    allowed = CLASSIFICATION_METRICS if problem_type == "classification" else REGRESSION_METRICS
    if stored in allowed:
        return stored
    return "f1" if problem_type == "classification" else "r2"


def secondary_metric(problem_type: str) -> str:
    return "accuracy" if problem_type == "classification" else "rmse"


def model_priority(name: Column) -> Column:
    out = None
    for i, model in enumerate(MODEL_PRIORITY):
        out = F.when(name == model, i % 3) if out is None else out.when(name == model, i % 3)
    return out.otherwise(999)


def rank_models(
    models: DataFrame,
    problem_type: str,
    primary: str | None = None,
    by: list[str] | None = None,
    name: str = "model_name",
    tie_break: list[str] | None = None,
    single_task: int = 1_000_000,
    largest_group: int | None = None,
) -> DataFrame:
    """Add ``rank`` from 1, best first, per group: primary metric, second metric, model priority.

    ``largest_group`` spares counting the groups of ``models`` where their size is known.
    """
    first, second = resolve_primary_metric(problem_type, primary), secondary_metric(problem_type)

    def better(metric: str) -> Column:
        c = col(metric)
        return c.desc_nulls_last() if HIGHER_IS_BETTER[metric] else c.asc_nulls_last()

    order = [better(first), better(second), model_priority(col(name)).asc(), *[col(c).asc() for c in tie_break or [name]]]
    if by:
        numbered = number_within(models, by, order, "_position", largest_group, single_task)
    else:
        numbered = number_within(models.withColumn("_all", F.lit(1)), ["_all"], order, "_position", single_task=single_task).drop("_all")
    return numbered.withColumn("rank", (F.col("_position") + 1).cast("int")).drop("_position")


def best_models(models: DataFrame, problem_type: str, primary: str | None = None, by: list[str] | None = None, name: str = "model_name") -> DataFrame:
    """The rank 1 model per group; tasks keep one model per group before the shuffle."""
    first, second = resolve_primary_metric(problem_type, primary), secondary_metric(problem_type)

    def better(metric: str) -> Column:
        return col(metric).desc_nulls_last() if HIGHER_IS_BETTER[metric] else col(metric).asc_nulls_last()

    order = [better(first), better(second), model_priority(col(name)).asc()]
    window = Window.partitionBy(*[col(b) for b in by or []], *([] if by else [F.lit(1)])).orderBy(*order)
    return models.withColumn("_nth", F.row_number().over(window)).filter("_nth = 1").drop("_nth")


def latest_per_key(df: DataFrame, keys: list[str], created: str, tie_break: list[str]) -> DataFrame:
    """The newest row per key.  Spark keeps one row per key and task before the shuffle, so hot keys are no burden."""
    newest = Window.partitionBy(*[col(k) for k in keys]).orderBy(*[col(c).desc_nulls_last() for c in [created, *tie_break]])
    return df.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")


def compare_models(
    models: DataFrame,
    evaluations: DataFrame,
    problem_type: str,
    primary: str | None = None,
    by: list[str] | None = None,
    single_task: int = 1_000_000,
    stored_best: DataFrame | None = None,
) -> DataFrame:
    """Models with their latest evaluation, falling back to the metrics from training, ranked.

    ``models``: model_id, model_name, status, metric columns, and the ``by`` columns.
    ``evaluations``: evaluation_id, model_id, created_at, evaluation_status, metric columns.
    ``stored_best``: the ``by`` columns and best_model_id, where a best model has been stored; it keeps its
    flag whatever the ranks are.  Without one, the first rank is the best.
    """
    metrics = CLASSIFICATION_METRICS if problem_type == "classification" else REGRESSION_METRICS
    main = resolve_primary_metric(problem_type, primary)
    newest = latest_per_key(evaluations, ["model_id"], "created_at", ["evaluation_id"]).select(
        "model_id", "evaluation_id", "evaluation_status", *[col(m).alias(f"_eval_{m}") for m in metrics]
    )
    has_metrics = F.coalesce(*[F.col(f"_eval_{m}") for m in metrics]).isNotNull()
    joined = models.join(newest, "model_id", "left")
    merged = joined.select(
        *[col(c) for c in models.columns if c not in metrics and c != "status"],
        "evaluation_id",
        F.when(has_metrics, F.col("evaluation_status")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("evaluation_id").isNull(), F.lit("not_evaluated")).otherwise(F.col("evaluation_status")).alias("evaluation_status"),
        *[F.when(has_metrics, F.col(f"_eval_{m}")).otherwise(col(m)).alias(m) for m in metrics],
    )
    largest = None
    if by:  # every model has one row, so the groups can be counted before the join
        sizes = models.groupBy(*[col(b) for b in by]).agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    ranked = rank_models(merged, problem_type, main, by, tie_break=["model_id"], single_task=single_task, largest_group=largest)
    best = F.col("rank") == 1
    if stored_best is not None:
        ranked = join_null_safe(ranked, stored_best.select(*by, "best_model_id"), by, "left")
        best = F.coalesce(F.col("best_model_id") == F.col("model_id"), best)
    ranked = ranked.withColumn("is_best", best).drop("best_model_id")
    return ranked.select("*", F.lit(main).alias("primary_metric"), col(main).alias("primary_metric_value"))
