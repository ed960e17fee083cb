import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from tabulon.operators import explain, train, trees
from tabulon.sources import sinks

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    n = 3000
    made = pd.DataFrame({"key": range(n), "a": rng.normal(size=n).round(2), "b": rng.integers(0, 5, n).astype(float), "c": rng.random(n), "y": rng.integers(0, 3, n)})
    return spark.createDataFrame(made).repartition(3).localCheckpoint()


def predictions(fitted, df):
    return {r["key"]: r["prediction"] for r in fitted.predict(df, keep=["key"]).collect()}


def small_limits(monkeypatch):
    """Every tree goes through sums over all tasks, several nodes dealt to tasks, and both ways of growing there."""
    for name, value in (("TASK_ROWS", 400), ("LEAST_ROWS", 400), ("EXACT_ROWS", 400), ("FEW_ROWS", 60), ("CHUNK", 50), ("BLOCK_BYTES", 4000), ("GROUP_BYTES", 60_000)):
        monkeypatch.setattr(trees, name, value)


def test_classification_tree_is_that_of_spark(spark, numbers, monkeypatch):
    vectors = train.training_vectors(numbers, "y", FEATURES, ["0", "1", "2"])
    spark_tree = DecisionTreeClassifier(featuresCol="_features", labelCol="_label", predictionCol="_prediction", maxBins=256, maxDepth=train.TREE_DEPTH, seed=train.SEED)
    wanted = spark_tree.fit(vectors).transform(vectors).select("_prediction").collect()
    monkeypatch.setattr(train.DecisionTreeClassifier, "fit", None)  # its sums and rows took an executor's memory
    for limits in (lambda _: None, small_limits):
        limits(monkeypatch)
        fitted = train.fit_model(numbers, "y", FEATURES, "DecisionTreeClassifier", "classification", 3000)
        assert fitted.model.transform(vectors).select("_prediction").collect() == wanted
        nodes = explain.tree_nodes(spark, fitted)
        assert nodes.filter("threshold is null").agg(F.sum("rows")).first()[0] == nodes.filter("node = 1").first()["rows"] == 3000
        assert nodes.agg(F.max("depth")).first()[0] <= train.TREE_DEPTH and nodes.count() == nodes.select("node").distinct().count()


@pytest.mark.parametrize("name, target, kind", [("RandomForestClassifier", "y", "classification"), ("RandomForestRegressor", "a", "regression")])
def test_forest_is_the_same_however_its_nodes_are_dealt(spark, numbers, monkeypatch, name, target, kind):
    monkeypatch.setattr(getattr(train, name), "fit", None)  # a row took 1450 bytes
    used = [f for f in FEATURES if f != target]
    fit = lambda: train.fit_model(numbers, target, used, name, kind, 3000, trees=3, max_depth=6)
    whole = fit()
    wanted = predictions(whole, numbers)
    small_limits(monkeypatch)
    dealt = fit()
    assert predictions(dealt, numbers) == (pytest.approx(wanted) if kind == "regression" else wanted)
    assert dealt.model.stored().filter("unit >= 0").count() > 3 and whole.model.stored().filter("unit >= 0").count() == 3
    assert list(dealt.model.featureImportances) == pytest.approx(list(whole.model.featureImportances))
    nodes = explain.tree_nodes(spark, dealt)
    inner = nodes.filter("threshold is not null").count()
    assert nodes.count() == 2 * inner + 3 and nodes.agg(F.max("depth")).first()[0] <= 6


def test_forest_draws_rows_anew_for_each_tree():
    spec = trees.Spec(1, 2, 100, True)
    drawn = np.stack([trees.weights_of(spec, t, 0, 0, 50_000) for t in range(4)])
    assert drawn.mean() == pytest.approx(1, abs=0.01) and drawn.var() == pytest.approx(1, abs=0.03)
    assert abs(np.corrcoef(drawn[0], drawn[1])[0, 1]) < 0.02 and (drawn[2] == trees.weights_of(spec, 2, 0, 0, 50_000)).all()


def test_nodes_may_use_their_share_of_the_features():
    keys = trees.mix(np.arange(5000, dtype=np.uint64))
    may = trees.chosen_features(keys, trees.Spec(10, 2, subset=4))
    assert (may.sum(axis=1) == 4).all() and np.allclose(may.mean(axis=0), 0.4, atol=0.03)
    assert trees.chosen_features(keys, trees.Spec(10, 2)) is None


@pytest.mark.parametrize("limits", [lambda _: None, small_limits])
def test_regression_tree_grows_until_its_leaves_are_pure(spark, monkeypatch, tmp_path, limits):
    """A value that rises and falls 300 times along a key: 255 thresholds and 20 levels explained none of it."""
    limits(monkeypatch)
    df = spark.range(6000, numPartitions=3).selectExpr("id * 1.0D as x", "(id % 20) * (1 + id div 3000) * 1.0D as y")
    e = train.run_experiment(df.withColumn("__split__", F.expr("if(hash(x) % 5 = 0, 'test', 'train')")), "y", "regression", model_names=["DecisionTreeRegressor"])
    assert e.best_score > 0.4 and e.results.first()["hyperparameters"]["maxDepth"] == "None"
    fitted = train.fit_model(df, "y", ["x"], "DecisionTreeRegressor", "regression", 6000)
    nodes = explain.tree_nodes(spark, fitted)
    leaves = nodes.filter("threshold is null").agg(F.sum("rows"), F.max("impurity")).first()
    assert leaves[0] == 6000 and leaves[1] < 1e-9
    sinks.save_model(spark, fitted, f"{tmp_path}/m")
    for model in (fitted, sinks.load_model(spark, f"{tmp_path}/m")):
        assert model.predict(df, keep=["y"]).agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 1e-9


def test_equal_gains_and_thresholds_between_values(spark):
    """The exclusive or has no gain at its root, which the tree splits nevertheless; thresholds lie between neighbouring values."""
    rows = [(float(a), float(b), float(a ^ b)) for a in (0, 1) for b in (0, 1)] * 3
    df = spark.createDataFrame(rows, "a double, b double, y double")
    fitted = train.fit_model(df, "y", ["a", "b"], "DecisionTreeRegressor", "regression", 12)
    assert [(r["threshold"], r["rows"]) for r in explain.tree_nodes(spark, fitted).filter("threshold is not null").orderBy("node").collect()] == [(0.5, 12), (0.5, 6), (0.5, 6)]
    assert all(r["y"] == pytest.approx(r["prediction"]) for r in fitted.predict(df, keep=["y"]).collect())


def test_a_missing_model_is_refused(spark, numbers, tmp_path):
    fitted = train.fit_model(numbers, "y", FEATURES, "DecisionTreeClassifier", "classification", 3000)
    sinks.save_model(spark, fitted, f"{tmp_path}/m")
    (tmp_path / "m" / "model").rename(tmp_path / "elsewhere")
    with pytest.raises(sinks.ModelError):
        sinks.load_model(spark, f"{tmp_path}/m")


def test_labels_and_features_must_be_numbers(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None)], "x double, y double")
    with pytest.raises(Exception, match="labels must not be null"):
        train.fit_model(df, "y", ["x"], "DecisionTreeRegressor", "regression", 2)


def test_rows_of_a_class_are_not_sent_to_one_task(spark, numbers, monkeypatch):
    """Labels and predicted classes are looked up where the rows are, also with automatic broadcasts off."""
    monkeypatch.setattr(train, "spread", lambda df, least=1: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fitted = train.fit_model(numbers, "y", FEATURES, "DecisionTreeClassifier", "classification", 3000)
        for made in (train.training_vectors(numbers, "y", FEATURES, fitted.labels), fitted.predict(numbers, keep=["key"])):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
