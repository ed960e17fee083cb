"""Reports as tables: findings and recommendations of any number of datasets or experiments in one run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.text import fixed
from tabulon.operators.evaluate import latest_per_key


def dataset_report(
    datasets: DataFrame,
    quality: DataFrame | None = None,
    cleaning: DataFrame | None = None,
    features: DataFrame | None = None,
    preparation: DataFrame | None = None,
    experiments: DataFrame | None = None,
    key: str = "dataset_id",
    created: str = "created_at",
) -> DataFrame:
    """One row per dataset: its size left-joined with whatever stage summaries exist.

    Of a summary with a ``created`` column the newest row per dataset counts (the largest of the other columns at
    a tie), others have one row per dataset.  Prefixed column names avoid clashes.
    """
    parts = {"quality": quality, "cleaning": cleaning, "features": features, "preparation": preparation, "experiment": experiments}
    out = datasets
    for prefix, part in parts.items():
        if part is None:
            continue
        if created in part.columns:
            part = latest_per_key(part, [key], created, [c for c in part.columns if c not in (key, created)])
        renamed = part.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in part.columns if c != key], F.lit(True).alias(f"has_{prefix}"))
        out = out.join(renamed, key, "left").withColumn(f"has_{prefix}", F.coalesce(f"has_{prefix}", F.lit(False)))
    return out


def _finding(condition: Column, order: int, category: str, title: str, value: Column, description: Column) -> Column:
    return F.when(
        condition,
        F.struct(
            F.lit(order).alias("finding_order"), F.lit(category).alias("category"), F.lit(title).alias("title"),
            value.cast("string").alias("value"), description.alias("description"),
        ),
    )


def _recommendation(condition: Column, order: int, priority: str, category: str, title: str, description: Column, action: str) -> Column:
    return F.when(
        condition,
        F.struct(
            F.lit(order).alias("recommendation_order"), F.lit(priority).alias("priority"), F.lit(category).alias("category"),
            F.lit(title).alias("title"), description.alias("description"), F.lit(action).alias("action"),
        ),
    )


def _fired(report: DataFrame, key: str, rules: list[Column]) -> DataFrame:
    hits = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return report.select(key, F.explode(hits).alias("r")).select(key, "r.*")


def _has(report: DataFrame, part: str) -> Column:
    return F.col(f"has_{part}") if f"has_{part}" in report.columns else F.lit(False)


def dataset_findings(report: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Findings of each dataset report; a rule whose stage is absent does not fire."""
    c = F.col
    rules = [
        _finding(
            F.lit(True), 0, "dataset", "Dataset Dimensions",
            F.format_string("%d rows × %d columns", c("total_rows"), c("total_columns")),
            F.concat(F.lit("The dataset contains "), F.format_number("total_rows", 0), F.lit(" rows and "), c("total_columns").cast("string"), F.lit(" columns.")),
        )
    ]
    if "has_quality" in report.columns:
        rules += [
            _finding(
                _has(report, "quality"), 1, "quality", "Overall Data Quality Score", c("quality_score"),
                F.format_string("Data quality assessment: %d%% with %d missing values.", c("quality_score"), c("quality_missing_count")),
            ),
            _finding(
                _has(report, "quality") & (c("quality_missing_percentage") > 0), 2, "data_issues", "Missing Values",
                F.format_string("%s%%", fixed(c("quality_missing_percentage"), 1)),
                F.format_string("Missing values detected in %d cells (%s%% of data).", c("quality_missing_count"), fixed(c("quality_missing_percentage"), 1)),
            ),
            _finding(
                _has(report, "quality") & (c("quality_duplicate_rows") > 0), 3, "data_issues", "Duplicate Rows", c("quality_duplicate_rows"),
                F.format_string("Found %d duplicate rows (%s%% of data).", c("quality_duplicate_rows"), fixed(c("quality_duplicate_percentage"), 1)),
            ),
        ]
    if "has_cleaning" in report.columns:
        removed = c("cleaning_rows_before") - c("cleaning_rows_after")
        rules.append(_finding(
            _has(report, "cleaning") & (removed != 0), 4, "dataset", "Data Cleaning Impact", removed,
            F.format_string("Cleaning operations removed %d rows and handled %d missing values.", removed, c("cleaning_missing_values_handled")),
        ))
    if "has_features" in report.columns:
        rules.append(_finding(
            _has(report, "features"), 5, "features", "Feature Engineering Summary",
            F.format_string("%d features", c("features_columns_after")),
            F.format_string(
                "Feature engineering added %d features and removed %d features. Final feature count: %d.",
                c("features_features_added"), c("features_features_removed"), c("features_columns_after"),
            ),
        ))
    return _fired(report, key, rules)


def dataset_recommendations(report: DataFrame, key: str = "dataset_id") -> DataFrame:
    c, rules = F.col, []
    if "has_quality" in report.columns:
        rules += [
            _recommendation(
                c("quality_score") < 70, 0, "high", "data_quality", "Low Data Quality Score",
                F.format_string("Data quality score is %d%%. This may impact model performance.", c("quality_score")),
                "Review and address data quality issues. Consider additional cleaning, imputation, or outlier handling.",
            ),
            _recommendation(
                c("quality_missing_percentage") > 30, 1, "high", "data_quality", "High Missing Value Rate",
                F.format_string("%s%% of values are missing.", fixed(c("quality_missing_percentage"), 1)),
                "Consider advanced imputation techniques, removing highly sparse columns, or feature engineering to handle missing values.",
            ),
            _recommendation(
                c("quality_duplicate_percentage") > 5, 2, "medium", "data_quality", "Duplicate Rows Detected",
                F.format_string("%s%% of rows are duplicates.", fixed(c("quality_duplicate_percentage"), 1)),
                "Review and remove or consolidate duplicate records based on business logic.",
            ),
        ]
    if "has_cleaning" in report.columns:
        rate = F.try_divide((c("cleaning_rows_before") - c("cleaning_rows_after")) * F.lit(100.0), c("cleaning_rows_before"))
        rules.append(_recommendation(
            rate > 20, 3, "medium", "preprocessing", "High Data Removal Rate",
            F.format_string("Cleaning removed %s%% of rows. This may result in insufficient data for modeling.", fixed(rate, 1)),
            "Review cleaning operations. Consider more conservative imputation strategies or selective filtering.",
        ))
    if "has_features" in report.columns:
        rules.append(_recommendation(
            c("features_columns_after") > 100, 4, "medium", "features", "High Feature Dimensionality",
            F.format_string("Dataset has %d features. This may cause overfitting.", c("features_columns_after")),
            "Consider feature selection, dimensionality reduction (PCA), or regularization techniques.",
        ))
    return _fired(report, key, rules)


def experiment_report(experiments: DataFrame, ranked: DataFrame, datasets: DataFrame | None = None, key: str = "experiment_id") -> DataFrame:
    """One row per experiment: number of models and algorithms, and the best model with its score.

    ``ranked`` is the output of a model ranking with ``rank``, ``model_name``,
    ``feature_count``, ``primary_metric`` and ``primary_metric_value``.  It should hold
    all models of an experiment, failed ones (without metrics, hence last) too: they count.
    """
    usable = (F.col("rank") == 1) & F.col("primary_metric_value").isNotNull()
    best = lambda c: F.max(F.when(usable, F.col(c)))
    models = ranked.groupBy(key).agg(
        F.count(F.lit(1)).alias("models_trained"),
        (F.min("model_name") == F.max("model_name")).alias("one_algorithm"),
        best("model_name").alias("best_model_name"),
        best("feature_count").alias("best_feature_count"),
        best("primary_metric").alias("best_metric"),
        best("primary_metric_value").alias("best_score"),
    )
    out = experiments.join(models, key, "left")
    if datasets is not None:
        out = out.join(datasets, "dataset_id", "left")
    return out.withColumn("models_trained", F.coalesce("models_trained", F.lit(0)))


def experiment_models(ranked: DataFrame, key: str = "experiment_id") -> DataFrame:
    """The ranked models of each experiment; models without a metric (failed ones) come last and are never the best."""
    best = (F.col("rank") == 1) & F.col("primary_metric_value").isNotNull()
    return ranked.select(key, "rank", "model_id", "model_name", "status", "primary_metric", "primary_metric_value", best.alias("is_best"))


def experiment_importances(models: DataFrame, importances: DataFrame, top: int = 10, key: str = "experiment_id") -> DataFrame:
    """The ``top`` most important features of each experiment's best model (ties by name).

    ``importances``: model_id, feature_name, importance_value, and ``key`` where model ids count within an experiment, as in
    the artefact that ``explain.save_importances`` writes.
    """
    best = models.filter("is_best").select(key, "model_id", "model_name")
    own = [key, "model_id"] if key in importances.columns else ["model_id"]
    order = Window.partitionBy(key).orderBy(F.col("importance_value").desc_nulls_last(), "feature_name")
    return (
        best.join(importances, own).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)
        .select(key, "model_name", "position", "feature_name", "importance_value")
    )


def experiment_findings(report: DataFrame, key: str = "experiment_id") -> DataFrame:
    c = F.col
    rows = F.format_number("total_rows", 0)
    return _fired(report, key, [
        _finding(
            F.lit(True), 0, "dataset", "Dataset Size", F.concat(rows, F.lit(" rows")),
            F.concat(F.lit("Experiment trained on "), rows, F.lit(" rows with "), c("total_columns").cast("string"), F.lit(" original columns.")),
        ),
        _finding(
            F.lit(True), 1, "model", "Models Trained", c("models_trained"),
            F.format_string("Total of %d models trained during this experiment.", c("models_trained")),
        ),
        _finding(
            c("best_model_name").isNotNull(), 2, "model", "Best Performing Model", c("best_model_name"),
            F.format_string("Best model: %s (%s) with %s=%s", c("best_model_name"), c("best_model_name"), c("best_metric"), fixed(c("best_score"), 4)),
        ),
        _finding(
            c("best_model_name").isNotNull(), 3, "features", "Feature Count", c("best_feature_count"),
            F.format_string("Best model trained with %d features.", c("best_feature_count")),
        ),
    ])


def experiment_recommendations(report: DataFrame, key: str = "experiment_id") -> DataFrame:
    c = F.col
    return _fired(report, key, [
        _recommendation(
            (c("best_metric") == "f1") & (c("best_score") < 0.7), 0, "high", "model", "Poor Model Performance",
            F.format_string("Best model F1 score is %s. Performance may be insufficient for production.", fixed(c("best_score"), 4)),
            "Consider more feature engineering, different algorithms, hyperparameter tuning, or collecting more data.",
        ),
        _recommendation(
            (c("best_metric") == "r2") & (c("best_score") < 0.6), 1, "high", "model", "Poor Model Performance (R²)",
            F.format_string("Best model R² score is %s. Model explains less than 60%% of variance.", fixed(c("best_score"), 4)),
            "Improve feature engineering, try different algorithms, or investigate data quality issues.",
        ),
        _recommendation(
            (c("models_trained") >= 2) & c("one_algorithm"), 2, "low", "model", "Limited Algorithm Diversity",
            F.format_string("All %d models use the same algorithm.", c("models_trained")),
            "Consider training with different algorithms to find the best approach for your problem.",
        ),
    ])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
