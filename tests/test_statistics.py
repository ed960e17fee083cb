"""Quantiles, value counts and numbering against brute force, also on the paths for large data."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.operators import counts
from tabulon.operators.correlation import correlation_table
from tabulon.operators.lookup import lookup
from tabulon.operators.quantiles import approximate_quantiles, exact_quantiles
from tabulon.operators.ranking import number_in_order, number_rows, number_within

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def samples():
    rng = np.random.default_rng(5)
    heavy = np.concatenate([rng.normal(size=500), [1e300, -1e300, 1e-300, 0.0, -0.0]])
    return {
        "uniform": rng.uniform(-5, 5, 997),
        "hot": np.concatenate([np.full(400, 3.25), rng.normal(size=600)]),
        "heavy": heavy,
        "few": np.array([2.0, 1.0]),
        "one": np.array([7.5]),
        "ties": rng.integers(0, 4, 1000).astype(float),
        "close": 1.0 + rng.integers(0, 50, 800) * 2.0**-52,
    }


@pytest.mark.parametrize("finish_rows", [100_000, 20, 0])
def test_quantiles_equal_numpy(spark, finish_rows):
    data = samples()
    width = max(map(len, data.values()))
    padded = {k: [float(v) for v in x] + [None] * (width - len(x)) for k, x in data.items()}
    padded["none"] = [None] * width
    df = spark.createDataFrame(list(zip(*padded.values())), ", ".join(f"{k} double" for k in padded)).repartition(5)
    got = exact_quantiles(df, {k: PROBS for k in padded}, finish_rows=finish_rows)
    for k, x in data.items():
        np.testing.assert_allclose(got[k], np.quantile(x, PROBS), rtol=1e-12, atol=1e-300)
    assert got["none"] == [None] * len(PROBS)


def test_quantiles_do_not_depend_on_partitioning(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    probs = {"l_extendedprice": [0.25, 0.5, 0.75], "l_quantity": [0.5]}
    assert exact_quantiles(df.repartition(1), probs) == exact_quantiles(df.repartition(7), probs)


def test_quantiles_bring_only_wanted_buckets_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, y = rng.lognormal(0, 8, 20000), rng.normal(size=20000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(6)
    taken = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: taken.append(collect(self)) or taken[-1])
    for finish_rows in (100_000, 0):
        got = exact_quantiles(df, {"x": [0.25, 0.5], "y": [0.5]}, finish_rows=finish_rows)
        np.testing.assert_allclose([*got["x"], *got["y"]], [*np.quantile(x, [0.25, 0.5]), np.median(y)], rtol=1e-12)
    assert len(taken) >= 4 and max(map(len, taken)) <= 2 * 3  # two ranks for each of three quantiles


def test_quantiles_skip_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert exact_quantiles(df, {"x": [0.5]}) == {"x": [2.0]}


def test_approximate_quantiles_are_near(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    exact = exact_quantiles(df, {"l_extendedprice": [0.5]})["l_extendedprice"][0]
    near = approximate_quantiles(df, {"l_extendedprice": [0.5]})["l_extendedprice"][0]
    assert abs(near - exact) / exact < 0.02


def ranked(rows, k):
    """Top values by plain counting: count descending, then the value itself."""
    counted = {}
    for v in rows:
        if v is not None:
            counted[v] = counted.get(v, 0) + 1
    best = sorted(counted.items(), key=lambda x: (-x[1], x[0].encode()))[:k]
    return [(i + 1, v, n) for i, (v, n) in enumerate(best)]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_top_long_texts_tie_by_their_whole_value(spark, k):
    start = "é" * 64
    rows = [start, start + "b", start + "a", start + "b" * 500, "short", "short", start + "a", start + "c" * 9, None, "", start[:63], start + "b"] * 4 + [start + "ab" * 40] * 8
    df = spark.createDataFrame([(v, i % 5, f"{v}x" if v else None) for i, v in enumerate(rows)], "a string, i int, b string").repartition(4)
    got = {}
    for r in counts.top_values(df, ["a", "i", "b"], k).collect():
        got.setdefault(r["column"], []).append((r["rank"], r["value"], r["n"]))
    want = {"a": rows, "i": [str(i % 5) for i in range(len(rows))], "b": [f"{v}x" if v else None for v in rows]}
    assert {c: sorted(v) for c, v in got.items()} == {c: ranked(v, k) for c, v in want.items()}
    assert counts.modes(df, ["a", "b"]) == {c: ranked(want[c], 1)[0][1] for c in "ab"}


def test_long_texts_are_ranked_by_keys_of_bounded_size(spark):
    df = spark.createDataFrame([("x" * 5000 + str(i % 3),) for i in range(30)], "s string")
    keys = counts.ranked_keys(df, ["s"], 2)
    assert max(len(r["key"]) for r in keys.collect()) == 128
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    # the text itself is only read below the exchange, to make the key
    above = plan[: plan.index("Exchange hashpartitioning(place")]
    assert "sha2" not in above and "Scan" not in above


def test_distinct_rows_tell_nulls_apart(spark):
    rows = [(None, "a"), ("a", None), ("a", None), (None, None), ("a", "a")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert counts.distinct_row_count(df).first().asDict() == {"row_count": 5, "distinct_count": 4, "duplicate_count": 1}


def test_distinct_rows_fold_negative_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert counts.distinct_row_count(df).first()["distinct_count"] == 1


def test_distinct_rows_of_nested_columns(spark):
    df = spark.sql("select array(1, 2) as a, map('k', id % 2) as m from range(6)")
    assert counts.distinct_row_count(df).first()["distinct_count"] == 2


def test_cardinalities_over_types(spark):
    long_text = "x" * 500
    rows = [(1, 0.0, "a", True), (2, -0.0, long_text, None), (2, 1.5, long_text, True), (None, None, None, None)]
    df = spark.createDataFrame(rows, "i long, d double, s string, b boolean")
    got = {r["column"]: (r["distinct_count"], r["top_count"], r["non_null_count"]) for r in counts.cardinalities(df, df.columns).collect()}
    assert got == {"i": (2, 2, 3), "d": (2, 2, 3), "s": (2, 2, 3), "b": (1, 2, 2)}


def test_top_values_and_mode_break_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("b",), ("a",), (None,)], "s string")
    top = [(r["rank"], r["value"], r["n"]) for r in counts.top_values(df, ["s"], 2).orderBy("rank").collect()]
    assert top == [(1, "a", 2), (2, "b", 2)]
    assert counts.modes(df, ["s"]) == {"s": "a"}


def test_numbering_of_ranges_equals_one_window(spark):
    df = spark.createDataFrame([(f"v{i:04d}",) for i in np.random.default_rng(1).permutation(500)], "value string").repartition(6)
    small = {tuple(r) for r in number_in_order(df, ["value"], "k", 500).collect()}
    large = {tuple(r) for r in number_in_order(df, ["value"], "k", 500, single_task=10).collect()}
    assert small == large == {(f"v{i:04d}", i) for i in range(500)}


def test_numbering_within_a_hot_group(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else f"g{i % 20}", int(v), i) for i, v in enumerate(rng.integers(0, 50, 900))]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(5)
    order = [F.col("v").desc(), F.col("id").asc()]
    small = {tuple(r) for r in number_within(df, ["g"], order, "k").collect()}
    large = {tuple(r) for r in number_within(df, ["g"], order, "k", single_task=10).collect()}
    assert small == large


def test_numbering_within_null_groups(spark):
    rows = [(None if i % 2 else "a", i) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, v int")
    order = [F.col("v").asc()]
    assert {tuple(r) for r in number_within(df, ["g"], order, "k").collect()} == {
        tuple(r) for r in number_within(df, ["g"], order, "k", single_task=5).collect()
    }


def test_number_rows_is_gapless(spark):
    got = number_rows(spark.range(100).repartition(7).filter("id % 3 = 0"), "k").collect()
    assert sorted(r["k"] for r in got) == list(range(34))


def test_lookup_with_hot_values_equals_broadcast(spark):
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"v{i % 60}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, s string")
    table = df.filter("s is not null").groupBy(F.col("s").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.length("value") + F.col("n"))
    facts = table.agg(F.count(F.lit(1)), F.sum("n")).first()
    few = {tuple(r) for r in lookup(df, F.col("s"), table, ["code"], facts[0], facts[1]).collect()}
    many = {tuple(r) for r in lookup(df, F.col("s"), table, ["code"], facts[0], facts[1], broadcast_values=1).collect()}
    assert len(few) == 3000 and few == many


def test_lookup_salts_are_join_keys(spark):
    """The shuffle join must partition by the salt too, or a hot value lands in one task."""
    df = spark.range(10).selectExpr("id", "cast(id as string) as s")
    table = df.groupBy(F.col("s").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.lit(1))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = lookup(df, F.col("s"), table, ["code"], 10, 10, broadcast_values=1)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert re.search(r"hashpartitioning\(_key#\d+, _salt#", plan)


def test_correlations_equal_pandas(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(1e6, 1, 300)
    pdf = pd.DataFrame({"a": a, "b": a * 2 + rng.normal(0, 1, 300), "c": rng.normal(size=300), "flat": 4.0, "d": rng.integers(0, 9, 300)})
    pdf.loc[::7, "b"] = None
    pdf.loc[::5, "c"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, flat double, d long").repartition(4)
    got = {(r["column_a"], r["column_b"]): r["corr"] for r in correlation_table(df).collect()}
    want = pdf.corr()
    assert len(got) == 6 and not any("flat" in k for k in got)
    for (x, y), r in got.items():
        assert r == pytest.approx(want.loc[x, y], abs=1e-9)


def test_correlation_is_undefined_where_shared_rows_are_constant(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (2.0, 7.0), (2.0, 9.0)], "a double, b double")
    assert correlation_table(df).collect() == []
