import hashlib
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabulon.operators import dictionary, prepare, split
from tabulon.operators.split import SPLIT, Cut, allocate, find_cuts, train_test_split
from tabulon.sources import sinks


def sides(df, key="id"):
    return {r[key]: r[SPLIT] for r in df.collect()}


def brute_split(ids, wanted, seed=42):
    ranked = sorted(ids, key=lambda i: hashlib.md5(f"{i}:{seed}".encode()).hexdigest())
    return set(ranked[:wanted])


@pytest.mark.parametrize("n, size", [(4, 0.2), (15, 0.2), (997, 0.3), (1000, 0.5)])
def test_split_is_exact_and_equals_brute_force(spark, n, size):
    df = spark.range(n).repartition(5)
    r = train_test_split(df, size, key=["id"])
    test = {k for k, v in sides(r.data).items() if v == "test"}
    assert len(test) == r.test_rows == math.ceil(size * n) and test == brute_split(range(n), len(test))


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(500)
    assert sides(train_test_split(df.repartition(1)).data) == sides(train_test_split(df.repartition(7)).data)


def test_seed_changes_the_split(spark):
    df = spark.range(200)
    assert sides(train_test_split(df, seed=1).data) != sides(train_test_split(df, seed=2).data)


def test_stratified_split(spark):
    df = spark.range(303).withColumn("c", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 101 == 1, "rare").otherwise("b"))
    r = train_test_split(df, 0.2, key=["id"], target="c")
    sizes = {x["c"]: x["count"] for x in df.groupBy("c").count().collect()}
    got = {x["c"]: x["count"] for x in r.data.filter(f"{SPLIT} = 'test'").groupBy("c").count().collect()}
    assert r.stratified and got == {c: q for c, q in allocate(sizes, r.test_rows).items() if q}


def test_numeric_boolean_and_thin_targets_are_not_stratified(spark):
    df = spark.range(20).select("id", (F.col("id") % 2).alias("n"), (F.col("id") % 2 == 0).alias("b"),
                                F.concat(F.lit("v"), F.col("id").cast("string")).alias("u"), F.lit("x").alias("one"))
    for target in ("n", "b", "u", "one"):
        assert not train_test_split(df, target=target).stratified
        assert not split.stratifiable(df, target)


def test_more_classes_than_test_rows_is_noted(spark):
    df = spark.range(20).withColumn("c", F.concat(F.lit("v"), (F.col("id") % 10).cast("string")))
    r = train_test_split(df, 0.1, target="c")
    assert not r.stratified and "classes" in r.note


@pytest.mark.parametrize("tie_rows", [1_000_000, 3])
def test_equal_rows_are_split_exactly(spark, monkeypatch, tie_rows):
    """A third of the table is one row, so the boundary can fall into its copies."""
    monkeypatch.setattr(split, "TIE_ROWS", tie_rows)
    for seed in range(4):
        df = spark.createDataFrame([("same", 0)] * 200 + [(f"v{i}", i) for i in range(100)], "s string, i int").repartition(4)
        r = train_test_split(df, 0.3, seed=seed)
        rows = r.data.groupBy(SPLIT).count().collect()
        assert {x[SPLIT]: x["count"] for x in rows} == {"test": 90, "train": 210}
    all_same = spark.createDataFrame([("same",)] * 50, "s string").repartition(3)
    assert train_test_split(all_same, 0.2).data.filter(f"{SPLIT} = 'test'").count() == 10


def test_stratified_ties(spark, monkeypatch):
    monkeypatch.setattr(split, "TIE_ROWS", 2)
    df = spark.createDataFrame([("a",)] * 40 + [("b",)] * 60, "c string").repartition(3)
    r = train_test_split(df, 0.25, target="c")
    got = {x["c"]: x["count"] for x in r.data.filter(f"{SPLIT} = 'test'").groupBy("c").count().collect()}
    assert r.stratified and got == {"a": 10, "b": 15}


def test_many_classes_use_a_join(spark, monkeypatch):
    monkeypatch.setattr(split, "CASE_CLASSES", 1)
    df = spark.range(300).withColumn("c", F.concat(F.lit("v"), (F.col("id") % 7).cast("string")))
    few = sides(train_test_split(df, key=["id"], target="c").data)
    monkeypatch.setattr(split, "CASE_CLASSES", 64)
    assert few == sides(train_test_split(df, key=["id"], target="c").data)


def test_cuts_are_narrowed_over_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(split, "PREFIX_GROUPS", 16)
    hashed = spark.range(500).select(F.lit("").alias("_class"), F.md5(F.col("id").cast("string")).alias("_h"))
    cut = find_cuts(hashed, {"": 123})[""]
    assert hashed.filter(F.col("_h") < cut.bound).count() == 123
    assert find_cuts(hashed, {"": 0})[""] == Cut("")


def test_allocation_by_largest_remainder():
    assert allocate({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0}
    assert allocate({"a": 50, "b": 30, "c": 20}, 20) == {"a": 10, "b": 6, "c": 4}


# -- preparation ------------------------------------------------------------


@pytest.fixture
def twenty(spark):
    return spark.createDataFrame([(float(i * 10), "A" if i % 2 else "B", i % 2) for i in range(1, 21)], "num double, cat string, target long")


def test_prepared_table(twenty):
    p = prepare.prepare(twenty, "target")
    assert p.data.columns == [SPLIT, "num", "cat_A", "cat_B", "target"]
    s = p.stats.first()
    assert (s["rows_before"], s["train_rows"], s["test_rows"], s["processed_feature_count"]) == (20, 16, 4, 3)
    train = np.array([r["num"] for r in p.data.filter(f"{SPLIT} = 'train'").collect()])
    assert abs(train.mean()) < 1e-9 and abs(train.std() - 1) < 1e-6


def test_no_leakage(spark, twenty):
    """Changing test rows does not change what was learned."""
    tagged = train_test_split(twenty, 0.2, target="target")
    train = tagged.data.filter(f"{SPLIT} = 'train'")
    learned = prepare.fit(train, "target")
    assert prepare.prepare(twenty, "target").parameters.numeric == learned.numeric


def test_missing_values_are_filled(spark):
    rows = [(None if i == 3 else float(i), None if i == 5 else "AB"[i % 2], i % 2) for i in range(20)]
    p = prepare.prepare(spark.createDataFrame(rows, "num double, cat string, target long"), "target")
    assert p.data.filter(" or ".join(f"`{c}` is null" for c in p.data.columns)).count() == 0


def test_unknown_category_is_all_zeros(spark, twenty):
    p = prepare.prepare(twenty, "target").parameters
    new = spark.createDataFrame([(5.0, "C")], "num double, cat string")
    row = prepare.transform(new, p).first()
    assert (row["cat_A"], row["cat_B"]) == (0.0, 0.0)


def test_wide_category_becomes_a_sparse_vector(spark):
    rows = [(float(i), f"v{i % 12}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "num double, cat string, target long")
    dense, wide = prepare.prepare(df, "target"), prepare.prepare(df, "target", one_hot={"cat": "vector"})
    assert wide.parameters.feature_names == ["num", "cat_onehot"]
    new = spark.createDataFrame([(1.0, "v3"), (2.0, "unseen")], "num double, cat string")
    got = [r[0] for r in prepare.transform(new, wide.parameters).select(vector_to_array("cat_onehot")).collect()]
    want = [[r[f"cat_{v}"] for v in dense.parameters.categorical[0].categories] for r in prepare.transform(new, dense.parameters).collect()]
    assert got == want and sum(got[1]) == 0


def test_dictionary_values_stay_off_the_driver(spark, tmp_path, monkeypatch):
    rows = [(None if i % 50 == 7 else f"name {i % 4000}", i % 2) for i in range(12000)]
    df = spark.createDataFrame(rows, "cat string, target long")
    taken = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: taken.append(collect(self)) or taken[-1])
    fitted = prepare.fit(df, "target", one_hot="vector")
    sinks.save_parameters(spark, fitted, str(tmp_path / "p"))
    loaded = sinks.load_parameters(spark, str(tmp_path / "p"))
    made = prepare.transform(df.limit(5), loaded)
    assert max(map(len, taken)) < 10
    monkeypatch.undo()
    p = loaded.categorical[0]
    known = sorted({v for v, _ in rows if v})
    assert [(r["value"], r["slot"]) for r in p.dictionary.table(spark).orderBy("slot").collect()] == [(v, i) for i, v in enumerate(known)]
    assert p.width == len(known) and p.dictionary.total == sum(v is not None for v, _ in rows) and p.mode == known[0]
    # the schema names the dictionary, not its values
    assert len(made.schema["cat_onehot"].json()) < 1000
    got = [(v.size, list(v.indices), list(v.values)) for v, in made.collect()]
    assert got == [(len(known), [known.index(v or known[0])], [1.0]) for v, _ in rows[:5]]


def test_dictionaries_of_many_values_are_numbered_by_ranges(spark):
    values = [f"v{i:05d}" for i in range(3000)] * 2 + ["hot"] * 500
    df = spark.createDataFrame([(v,) for v in values], "cat string").repartition(7)
    counted = dictionary.count_values(df, ["cat"])
    small, large = (dictionary.build(counted, ["cat", "none"], n)["cat"].table(spark).collect() for n in (10**6, 100))
    assert sorted(map(tuple, small)) == sorted(map(tuple, large)) and len(large) == 3001
    assert ("hot", 0, 500) in map(tuple, large)


def test_too_many_columns_are_refused_before_values_are_fetched(spark):
    df = spark.createDataFrame([(f"v{i}", i % 2) for i in range(300)], "cat string, target long")
    with pytest.raises(prepare.PreparationError, match="300 values"):
        prepare.fit(df, "target", most_columns=299)
    assert len(prepare.fit(df, "target", most_columns=300).feature_names) == 300
    assert prepare.fit(df, "target", one_hot="vector", most_columns=1).feature_names == ["cat_onehot"]


def test_layout_follows_the_argument_alone(spark):
    df = spark.createDataFrame([(f"v{i}", i % 2) for i in range(1500)], "cat string, target long")
    p = prepare.fit(df, "target")
    assert len(p.feature_names) == 1500 and p.feature_names[0] == "cat_v0"
    with pytest.raises(prepare.PreparationError, match="layout"):
        prepare.fit(df, "target", one_hot="dense")


def test_long_categories_as_a_sparse_vector(spark):
    rows = [(("x" * 300) + str(i % 3), i % 2) for i in range(30)]
    p = prepare.prepare(spark.createDataFrame(rows, "cat string, target long"), "target", one_hot="vector")
    assert p.parameters.feature_names == ["cat_onehot"] and p.parameters.categorical[0].width == 3
    hot = p.data.select(vector_to_array("cat_onehot").alias("v")).select(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).collect()
    assert [r[0] for r in hot] == [1.0] * 30


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(5.0, i % 2) for i in range(10)], "x double, target long")
    assert prepare.prepare(df, "target").parameters.numeric[0].scale == 1.0


def test_column_without_training_values_is_dropped(spark):
    df = spark.createDataFrame([(None, float(i), i % 2) for i in range(10)], "gone double, x double, target long")
    p = prepare.prepare(df, "target")
    assert p.data.columns == [SPLIT, "x", "target"]
    assert "feature_dropped" in {r["operation"] for r in p.operations.collect()}


def test_booleans_and_dates_are_numbers(spark):
    df = spark.sql("select id % 2 = 0 as b, date'2024-01-01' + cast(id as int) as d, cast(id as double) as target from range(10)")
    assert prepare.feature_classes(df, "target") == (["b", "d"], [])
    assert prepare.prepare(df, "target").data.columns == [SPLIT, "b", "d", "target"]


@pytest.mark.parametrize("rows, target, size, message", [
    ([(1.0, 1)] * 6, "nope", 0.2, "no target column"),
    ([(1.0, None)] * 6, "target", 0.2, "no value at all"),
    ([(1.0, 1)] * 3, "target", 0.2, "3 rows, a split needs 4"),
    ([(1.0, 1)] * 3 + [(2.0, None)] * 4, "target", 0.2, "3 rows with a target"),
    ([(1.0, 1)] * 9, "target", 0.9, "test share"),
])
def test_refused_requests(spark, rows, target, size, message):
    with pytest.raises(prepare.PreparationError, match=message):
        prepare.prepare(spark.createDataFrame(rows, "x double, target long"), target, size)


def test_null_targets_are_dropped(spark):
    df = spark.createDataFrame([(float(i), None if i < 2 else "yn"[i % 2]) for i in range(12)], "x double, target string")
    s = prepare.prepare(df, "target").stats.first()
    assert (s["rows_before"], s["rows_after"]) == (12, 10)


def test_many_classes_are_stratified_in_a_table(spark):
    rows = [(i, f"c{i % 37}" if i % 5 else "hot") for i in range(600)]
    df = spark.createDataFrame(rows, "k long, y string")
    small = split.train_test_split(df, key=["k"], target="y")
    large = split.train_test_split(df, key=["k"], target="y", driver_classes=3)
    side = lambda r: {(x["k"], x[SPLIT]) for x in r.data.collect()}
    assert small.stratified and large.stratified and large.note is None
    assert side(small) == side(large) and sum(s == "test" for _, s in side(large)) == large.test_rows


def test_not_a_number_and_odd_spellings(spark):
    df = spark.createDataFrame([(float("nan") if i == 3 else float(i), i % 2) for i in range(12)], "x double, target long")
    p = prepare.prepare(df, "target").parameters
    new = spark.createDataFrame([("nan",), ("12d",), ("1f",), (" 7 ",), (None,)], "x string")
    got = [r["x"] for r in prepare.transform(new, p).collect()]
    assert got[0] == got[1] == got[2] == got[4] != got[3] and all(v == v for v in got)
