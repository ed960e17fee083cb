import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import evaluate, explain, prepare, replay, score, train
from tabulon.operators.split import SPLIT
from tabulon.sources import sinks


@pytest.fixture(scope="module")
def classified(spark):
    rows = [(float(i), "A" if i % 2 else "B", int(i >= 30)) for i in range(60)]
    prepared = prepare.prepare(spark.createDataFrame(rows, "num double, cat string, target long"), "target")
    return prepared, train.run_experiment(prepared.data, "target", trees=10)


@pytest.fixture(scope="module")
def regressed(spark):
    rows = [(float(i), "AB"[i % 2], i * 10.0) for i in range(60)]
    prepared = prepare.prepare(spark.createDataFrame(rows, "num double, cat string, value double"), "value")
    return prepared, train.run_experiment(prepared.data, "value", trees=10)


def test_three_classifiers_on_separable_data(classified):
    _, e = classified
    r = e.results.orderBy("model_id").collect()
    assert [x["model_name"] for x in r] == ["RandomForestClassifier", "LogisticRegression", "DecisionTreeClassifier"]
    assert {x["status"] for x in r} == {"trained"} and {x["feature_count"] for x in r} == {3}
    assert max(x["f1"] for x in r) == 1.0 and e.best_score == 1.0 and e.status == "completed"
    assert r[0]["hyperparameters"]["numTrees"] == "10"


def test_three_regressors(regressed):
    _, e = regressed
    r = {x["model_name"]: x for x in e.results.collect()}
    assert len(r) == 3 and e.problem_type == "regression"
    assert e.best_model == "LinearRegression" and r["LinearRegression"]["r2"] == pytest.approx(1.0)
    assert e.best_score == max(x["r2"] for x in r.values())


def test_training_is_repeatable(regressed):
    prepared, e = regressed
    again = train.run_experiment(prepared.data, "value", trees=10)
    pick = lambda x: {r["model_name"]: r["r2"] for r in x.results.collect()}
    assert pick(again) == pytest.approx(pick(e))


def test_logistic_weights_are_the_penalised_optimum(spark):
    """Gradient of the summed loss plus half the squared weights vanishes at the fitted weights."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 1, 200) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y long")
    model = train.fit_model(df, "y", ["a", "b"], "LogisticRegression", "classification", 200).model
    w, b = model.coefficients.toArray(), model.intercept
    residual = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(x.T @ residual + w).max() < 0.05 and abs(residual.sum()) < 0.05


def test_multiclass_with_text_labels(spark):
    rows = [(float(i), ["low", "mid", "high"][i // 20]) for i in range(60)]
    prepared = prepare.prepare(spark.createDataFrame(rows, "x double, level string"), "level")
    e = train.run_experiment(prepared.data, "level", model_names=["DecisionTreeClassifier", "LogisticRegression"])
    predicted = e.models["DecisionTreeClassifier"].predict(prepared.data, keep=["level"])
    assert {r["prediction"] for r in predicted.collect()} <= {"low", "mid", "high"}
    assert e.best_score > 0.8


def test_problem_types(spark):
    df = spark.range(100).select((F.col("id") % 20).alias("few"), F.col("id").alias("many"), (F.col("id") > 5).alias("flag"), F.col("id").cast("string").alias("text"))
    assert [train.infer_problem_type(df, c) for c in df.columns] == ["classification", "regression", "classification", "classification"]


def test_guards(spark):
    df = spark.createDataFrame([("train", 1.0, 0)] * 4 + [("test", 1.0, 0)], f"{SPLIT} string, x double, y long")
    with pytest.raises(train.ExperimentError, match="1 class"):
        train.run_experiment(df, "y")
    with pytest.raises(train.ExperimentError, match="test rows"):
        train.run_experiment(df.filter(f"{SPLIT} = 'train'"), "y")
    with pytest.raises(train.ExperimentError, match="training rows"):
        train.run_experiment(df.filter(f"{SPLIT} = 'test'"), "y")
    with pytest.raises(train.ExperimentError, match="__split__"):
        train.run_experiment(df.drop(SPLIT), "y")
    with pytest.raises(train.ExperimentError, match="no target column"):
        train.run_experiment(df, "z")
    with pytest.raises(train.ExperimentError, match="problem type"):
        train.run_experiment(df, "y", "clustering")


def test_failures_are_isolated(spark, monkeypatch, classified):
    prepared, _ = classified
    real = train.fit_model

    def broken(tr, target, features, name, *rest, **options):
        if name.startswith("RandomForest"):
            raise RuntimeError("no trees today")
        return real(tr, target, features, name, *rest, **options)

    monkeypatch.setattr(train, "fit_model", broken)
    e = train.run_experiment(prepared.data, "target")
    r = {x["model_name"]: x for x in e.results.collect()}
    assert r["RandomForestClassifier"]["status"] == "failed" and r["RandomForestClassifier"]["error"] == "no trees today"
    assert e.status == "completed" and len(e.models) == 2
    replayed = {x["model_name"]: x["evaluation_status"] for x in train.replay(prepared.data, e).collect()}
    assert replayed == {"RandomForestClassifier": "skipped", "LogisticRegression": "completed", "DecisionTreeClassifier": "completed"}

    monkeypatch.setattr(train, "fit_model", lambda *a, **k: 1 / 0)
    e = train.run_experiment(prepared.data, "target")
    assert (e.status, e.best_model, e.error) == ("failed", None, "No models trained successfully")


def test_replay_equals_training(regressed):
    prepared, e = regressed
    trained = {r["model_name"]: r["r2"] for r in e.results.collect()}
    replayed = {r["model_name"]: r["primary_metric_value"] for r in train.replay(prepared.data, e).collect()}
    assert replayed == pytest.approx(trained)


def test_depth_is_the_same_for_every_table():
    for rows in (10, 10**9):
        made = train.estimators("classification", rows)
        assert made["DecisionTreeClassifier"].getMaxDepth() == train.TREE_DEPTH
        assert made["RandomForestClassifier"].getMaxDepth() == train.FOREST_DEPTH
        assert train.estimators("regression", rows, max_depth=5)["DecisionTreeRegressor"].getMaxDepth() == 5


# -- importance -------------------------------------------------------------


def test_importances(spark, classified, regressed):
    for fitted in classified[1].models.values():
        table = explain.feature_importance(spark, fitted).orderBy("rank").collect()
        assert [r["rank"] for r in table] == [1, 2, 3] and table[0]["feature_name"] == "num"
        assert sum(r["normalized_importance"] for r in table) == pytest.approx(1.0)
    linear = explain.feature_importance(spark, regressed[1].models["LinearRegression"])
    assert linear.first()["importance_type"] == "linear"


def test_importance_names_next_to_a_vector_column(spark):
    rows = [(float(i % 7), f"w{i % 6}", "AB"[(i // 6) % 2], (i // 6) % 2) for i in range(240)]
    df = spark.createDataFrame(rows, "num double, awide string, bcat string, target long")
    prepared = prepare.prepare(df, "target", one_hot={"awide": "vector"})
    tr, _, names = train.split_scan(prepared.data, "target")
    fitted = train.fit_model(tr, "target", names, "DecisionTreeClassifier", "classification", 190)
    table = explain.feature_importance(spark, fitted).orderBy("rank").collect()
    assert table[0]["feature_name"] in ("bcat_A", "bcat_B") and table[0]["normalized_importance"] == pytest.approx(1.0)
    assert {r["feature_name"] for r in table} == {"num", "bcat_A", "bcat_B", *[f"awide_w{i}" for i in range(6)]}


def test_null_inputs_are_in_the_log(spark, classified):
    prepared, e = classified
    rows = spark.createDataFrame([(None, "B"), (float("nan"), "A")], "num double, cat string")
    records = score.log_records(rows, prepared.parameters, e.models["LogisticRegression"], "exp1").collect()
    assert '{"num":null,"cat":"B"}' in {r["input_data"] for r in records}


def test_importance_names_and_zero_total(spark):
    rows = explain.importance_table(spark, [0.0, 0.0], ["a"], "tree").orderBy("rank").collect()
    assert [(r["feature_name"], r["normalized_importance"]) for r in rows] == [("a", 0.0), ("Feature_1", 0.0)]


def test_importance_not_available(spark):
    assert explain.feature_importance(spark, train.FittedModel("x", "regression", [], object(), "double")) is None


# -- scoring ----------------------------------------------------------------


def test_scoring_equals_the_model(spark, classified, tmp_path):
    prepared, e = classified
    path = str(tmp_path)
    sinks.save_parameters(spark, prepared.parameters, f"{path}/p")
    sinks.save_model(spark, e.models["DecisionTreeClassifier"], f"{path}/m")
    parameters, model = sinks.load_parameters(spark, f"{path}/p"), sinks.load_model(spark, f"{path}/m")
    rows = spark.createDataFrame([(10.0, "B"), (50.0, "A"), (None, None)], "num double, cat string")
    got = score.score_batch(rows, parameters, model, keep=["num"]).collect()
    assert parameters == prepared.parameters
    assert {r["num"]: r["prediction"] for r in got if r["num"]} == {10.0: 0, 50.0: 1} and len(got) == 3


def test_scoring_accepts_numbers_as_text(spark, classified):
    prepared, e = classified
    rows = spark.createDataFrame([("10", "B"), ("50.0", "A")], "num string, cat string")
    got = score.score_batch(rows, prepared.parameters, e.models["LogisticRegression"])
    assert sorted(r["prediction"] for r in got.collect()) == [0, 1]


@pytest.mark.parametrize("rows, schema, message", [
    ([("x", "A")], "num string, cat string", "num"),
    ([(1.0,)], "num double", "not given.*cat"),
    ([(1.0, "A", 1)], "num double, cat string, target long", "predicts"),
    ([(1.0, "A", 1)], "num double, cat string, extra long", "extra"),
])
def test_refused_inputs(spark, classified, rows, schema, message):
    prepared, e = classified
    with pytest.raises(score.PredictionError, match=message):
        score.score_batch(spark.createDataFrame(rows, schema), prepared.parameters, e.models["LogisticRegression"])


def test_prediction_log_and_history(spark, classified, tmp_path):
    prepared, e = classified
    rows = spark.createDataFrame([(10.0, "B"), (50.0, "A")], "num double, cat string")
    for name in ("LogisticRegression", "DecisionTreeClassifier", "LogisticRegression"):
        score.append_log(score.log_records(rows, prepared.parameters, e.models[name], "exp1"), f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    assert log.count() == 6 and log.filter("input_data = '{\"num\":10.0,\"cat\":\"B\"}'").count() == 3
    totals = {r["model_name"]: r["total"] for r in score.history(log, ["model_name"]).collect()}
    assert totals == {"LogisticRegression": 4, "DecisionTreeClassifier": 2}


def test_repeated_batch_leaves_one_copy(spark, classified, tmp_path):
    prepared, e = classified
    rows = spark.createDataFrame([(10.0, "B"), (50.0, "A")], "num double, cat string")
    path = f"{tmp_path}/log"
    for name, experiment, batch in [("LogisticRegression", "01", "1e5"), ("LogisticRegression", "01", "2"), ("DecisionTreeClassifier", "01", "1e5"), ("LogisticRegression", "02", "2")]:
        score.append_log(score.log_records(rows, prepared.parameters, e.models[name], experiment, batch), path)
    log = [(r["experiment_id"], r["batch_id"], r["model_name"]) for r in score.read_log(spark, path).collect()]
    want = [("01", "1e5", "DecisionTreeClassifier"), ("01", "2", "LogisticRegression"), ("02", "2", "LogisticRegression")]
    assert sorted(log) == sorted(want * 2)  # ids stay texts, the repeated batch was replaced as a whole


def test_only_trained_models_predict(spark, classified, tmp_path):
    _, e = classified
    sinks.save_model(spark, e.models["LogisticRegression"], f"{tmp_path}/m")
    assert score.load_trained(spark, e.results, "LogisticRegression", f"{tmp_path}/m").features == e.models["LogisticRegression"].features
    failed = e.results.withColumn("status", F.lit("failed"))
    for results, name, message in [(failed, "LogisticRegression", "failed"), (e.results, "Other", "not part")]:
        with pytest.raises(score.PredictionError, match=message):
            score.load_trained(spark, results, name, f"{tmp_path}/m")


def test_replay_stores_the_best_with_the_evaluations(spark, regressed, tmp_path):
    prepared, e = regressed
    paths = {}
    for name in ("LinearRegression", "DecisionTreeRegressor"):
        paths[name] = f"{tmp_path}/{name}"
        sinks.save_model(spark, e.models[name], paths[name])
    log = f"{tmp_path}/log"
    runs = [replay.replay_stored(prepared.data, "value", e.results, paths, "regression", log) for _ in range(2)]
    assert {r.best_model for r in runs} == {"LinearRegression"}
    rows = [(r["model_name"], r["evaluation_status"], r["is_best"]) for r in replay.read_evaluations(spark, log).collect()]
    assert sorted(rows) == [("DecisionTreeRegressor", "completed", False), ("LinearRegression", "completed", True), ("RandomForestRegressor", "skipped", False)]
    best = replay.stored_best(spark, log).collect()
    assert [(r["experiment_id"], r["best_model_id"]) for r in best] == [(e.experiment_id, 1)]
    # without the winner another one is stored, and nothing of the earlier run is left
    paths["LinearRegression"] = f"{tmp_path}/nowhere"
    assert replay.replay_stored(prepared.data, "value", e.results, paths, "regression", log).best_model == "DecisionTreeRegressor"
    assert [r["best_model_id"] for r in replay.stored_best(spark, log).collect()] == [2]
    assert replay.read_evaluations(spark, log).count() == 3


def test_importances_are_stored_per_model(spark, regressed, tmp_path):
    _, e = regressed
    for _ in range(2):
        explain.save_importances(spark, e, f"{tmp_path}/i")
    rows = explain.read_importances(spark, f"{tmp_path}/i").collect()
    assert {(r["experiment_id"], r["model_id"]) for r in rows} == {(e.experiment_id, i) for i in range(3)} and len(rows) == 9
    for i in range(3):
        mine = sorted((r for r in rows if r["model_id"] == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3] and sum(r["normalized_importance"] for r in mine) == pytest.approx(1.0)


# -- metrics ----------------------------------------------------------------


def brute_metrics(pairs):
    labels = {x for p in pairs for x in p}
    out = dict.fromkeys(("precision", "recall", "f1"), 0.0)
    for c in labels:
        tp = sum(a == p == c for a, p in pairs)
        support, predicted = sum(a == c for a, _ in pairs), sum(p == c for _, p in pairs)
        out["precision"] += support * (tp / predicted if predicted else 0)
        out["recall"] += support * (tp / support if support else 0)
        out["f1"] += support * 2 * tp / (support + predicted)
    return {k: v / len(pairs) for k, v in out.items()} | {"accuracy": sum(a == p for a, p in pairs) / len(pairs)}


def test_classification_metrics_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    pairs = [(str(a), str(b)) for a, b in zip(rng.integers(0, 4, 200), rng.integers(1, 6, 200))]
    got = evaluate.classification_metrics(spark.createDataFrame(pairs, "label string, prediction string")).first().asDict()
    want = brute_metrics(pairs)
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_confusion_matrix(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "label string, prediction string")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion_matrix(df).collect()}
    assert len(cells) == 9 and cells["a", "b"] == 1 and cells["c", "c"] == 0
    many = spark.range(30).selectExpr("cast(id as string) as label", "'0' as prediction")
    assert evaluate.confusion_matrix(many) is None


def test_r2_of_a_constant_target(spark):
    df = spark.createDataFrame([("x", 2.0, 2.0), ("x", 2.0, 2.0), ("y", 2.0, 3.0), ("y", 2.0, 2.0)], "g string, label double, prediction double")
    assert {r["g"]: r["r2"] for r in evaluate.regression_metrics(df, by=["g"]).collect()} == {"x": 1.0, "y": 0.0}


MODELS = "experiment string, model_name string, f1 double, accuracy double, precision double, recall double"


def test_ties_go_to_the_forest(spark):
    rows = [("e", n, 0.9, 0.9, 0.9, 0.9) for n in ("DecisionTreeClassifier", "LogisticRegression", "RandomForestClassifier")]
    models = spark.createDataFrame(rows, MODELS)
    ranked = evaluate.rank_models(models, "classification", by=["experiment"])
    assert [r["model_name"] for r in ranked.orderBy("rank").collect()] == ["RandomForestClassifier", "LogisticRegression", "DecisionTreeClassifier"]
    assert evaluate.best_models(models, "classification", by=["experiment"]).first()["model_name"] == "RandomForestClassifier"


def test_error_metrics_rank_ascending(spark):
    rows = [("LinearRegression", 0.5, 3.0), ("RandomForestRegressor", 0.4, 1.0), ("DecisionTreeRegressor", None, None)]
    models = spark.createDataFrame(rows, "model_name string, r2 double, rmse double")
    order = lambda m: [r["model_name"][0] for r in evaluate.rank_models(models, "regression", m).orderBy("rank").collect()]
    assert order(None) == ["L", "R", "D"] and order("rmse") == ["R", "L", "D"] and order("f1") == ["L", "R", "D"]


def test_comparison_falls_back_to_training_metrics(spark):
    models = spark.createDataFrame(
        [(1, "LogisticRegression", "trained", 0.7, 0.7, 0.7, 0.7), (2, "RandomForestClassifier", "trained", 0.6, 0.6, 0.6, 0.6)],
        "model_id int, model_name string, status string, f1 double, accuracy double, precision double, recall double",
    )
    evaluations = spark.createDataFrame(
        [(10, 2, 1, "completed", 0.1, 0.1, 0.1, 0.1), (11, 2, 2, "completed", 0.8, 0.8, 0.8, 0.8)],
        "evaluation_id int, model_id int, created_at int, evaluation_status string, f1 double, accuracy double, precision double, recall double",
    )
    rows = evaluate.compare_models(models, evaluations, "classification").orderBy("rank").collect()
    assert [(r["model_id"], r["evaluation_status"], r["primary_metric_value"], r["is_best"]) for r in rows] == [
        (2, "completed", 0.8, True), (1, "not_evaluated", 0.7, False)
    ]


def test_tree_nodes_are_the_splits(spark):
    rows = [(float(i % 4), float(i % 3), "abc"[(i % 4 > 1) + (i % 4 > 2)]) for i in range(120)]
    df = spark.createDataFrame(rows, "x double, y double, target string")
    fitted = train.fit_model(df, "target", ["x", "y"], "DecisionTreeClassifier", "classification", 120, max_depth=3)
    got = {r["node"]: r for r in explain.tree_nodes(spark, fitted).collect()}
    assert sorted(got) == [1, 2, 3, 6, 7]
    assert [(got[n]["feature_name"], got[n]["threshold"], got[n]["rows"]) for n in (1, 3)] == [("x", 1.5, 120), ("x", 2.5, 60)]
    assert [(got[n]["prediction"], got[n]["rows"], got[n]["depth"]) for n in (2, 6, 7)] == [("a", 60, 1), ("b", 30, 2), ("c", 30, 2)]


def test_tree_nodes_of_forests_and_other_models(spark, regressed):
    models = regressed[1].models
    nodes = explain.tree_nodes(spark, models["RandomForestRegressor"])
    assert {r["tree"] for r in nodes.collect()} == set(range(10))
    inner = nodes.filter("threshold is not null").count()
    assert nodes.count() == 2 * inner + 10  # every split has two children
    assert explain.tree_nodes(spark, models["LinearRegression"]).count() == 0


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_gradient_vanishes_at_the_optimum_only(spark, classes):
    rng = np.random.default_rng(classes)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.0, -0.5] + rng.normal(0, 1, 300) > 0).astype(int) + (0 if classes == 2 else (x[:, 1] > 0.7))
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y long").repartition(3)
    fitted = train.fit_model(df, "y", ["a", "b"], "LogisticRegression", "classification", 300)
    rows = {r["class"]: r for r in explain.logistic_gradient(fitted, df, "y", 1 / 300).collect()}
    assert {c: r["n"] for c, r in rows.items()} == {str(c): int((y == c).sum()) for c in range(classes)}
    assert all(r["expected"] == pytest.approx(r["n"], abs=0.1) and r["largest_gradient"] < 1e-3 for r in rows.values())
    # another penalty has another optimum, and the difference is that of the penalties times the largest weight
    other = {r["class"]: r["largest_gradient"] for r in explain.logistic_gradient(fitted, df, "y", 1 / 30).collect()}
    largest = np.abs(fitted.model.coefficientMatrix.toArray()).max(axis=1)
    want = dict(zip("012", [largest[0]] * 2 if classes == 2 else largest))
    assert other == pytest.approx({c: want[c] * (1 / 30 - 1 / 300) for c in other}, rel=0.02)


def test_tasks_of_a_fit_stay_bounded(spark, monkeypatch):
    assert train.fit_partitions(150, 4) == 1
    for rows in (10_000_000, 60_000_000):
        assert rows * 1450 / train.fit_partitions(rows, 10, trees=100) < 600_000_000
    seen = []
    monkeypatch.setattr(train, "TASK_BYTES", 4000)
    real = train.DecisionTreeRegressor.fit
    monkeypatch.setattr(train.DecisionTreeRegressor, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or real(self, df))
    df = spark.range(400).selectExpr("id * 1.0D as x", "id % 7 * 1.0D as y")
    train.fit_model(df, "y", ["x"], "DecisionTreeRegressor", "regression", 400, max_depth=2)
    assert seen == [train.fit_partitions(400, 1)] and seen[0] > 8


def test_predictions_of_an_experiment_use_all_cores(spark, monkeypatch):
    seen = []
    real = train.FittedModel.predict
    monkeypatch.setattr(train.FittedModel, "predict", lambda self, df, keep=None: seen.append(df.rdd.getNumPartitions()) or real(self, df, keep))
    ready = spark.range(100).selectExpr("id * 1.0D as x", "id * 2.0D as y", "if(id % 5 = 0, 'test', 'train') as __split__").coalesce(1)
    experiment = train.run_experiment(ready, "y", "regression", model_names=["LinearRegression"])
    train.replay(ready, experiment)
    assert seen == [spark.sparkContext.defaultParallelism] * 2
