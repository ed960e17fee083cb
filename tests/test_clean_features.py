import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import clean, features, selection
from tabulon.operators.correlation import StrongPairs, strong_pairs


def log_of(result):
    return [(r["operation"], r["column"], r["affected_rows"]) for r in result.operations.orderBy("step").collect()]


# -- cleaning ---------------------------------------------------------------


def test_median_imputation(spark):
    r = clean.clean(spark.createDataFrame([(10.0,), (20.0,), (None,), (30.0,)], "age double"))
    assert log_of(r) == [("median_imputation", "age", 1), ("duplicate_removal", None, 1)]
    assert r.operations.first()["replacement_value"] == "20.0"


def test_mode_imputation(spark):
    ports = ["Oslo", None, "Riga", "Riga", None, "Turku", "Riga"]
    r = clean.clean(spark.createDataFrame(list(enumerate(ports)), "ship long, port string"))
    assert r.operations.first()["replacement_value"] == "Riga"
    assert {tuple(x) for x in r.data.collect()} == {(i, p or "Riga") for i, p in enumerate(ports)}


def test_mode_tie_takes_the_smallest(spark):
    r = clean.clean(spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id long, c string"))
    assert r.operations.first()["replacement_value"] == "a"


def test_blanks_then_mode(spark):
    r = clean.clean(spark.createDataFrame([("", 1), ("  \t", 2), ("Bob", 3)], "name string, age long"))
    assert log_of(r) == [("empty_string_as_missing", "name", 2), ("mode_imputation", "name", 2)]
    assert {x["name"] for x in r.data.collect()} == {"Bob"}


def test_duplicates_removed(spark):
    r = clean.clean(spark.createDataFrame([(1, "a"), (2, "b"), (1, "a"), (3, "c")], "id long, name string"))
    s = r.stats.first()
    assert (s["rows_before"], s["rows_after"], s["duplicates_removed"]) == (4, 3, 1) and r.data.count() == 3


def test_imputation_can_make_duplicates(spark):
    r = clean.clean(spark.createDataFrame([(1.0, "x"), (None, "x"), (1.0, None)], "a double, b string"))
    assert r.stats.first()["rows_after"] == 1 == r.data.count()


def test_unresolved_column_and_total(spark):
    df = spark.createDataFrame([(None, None, True), (None, 4, None), (None, 6, True)], "empty string, n int, flag boolean")
    r = clean.clean(df)
    assert ("missing_values_unresolved", "empty", 3) in log_of(r)
    assert r.stats.first()["missing_values_handled"] == 2
    assert {x["n"] for x in r.data.collect()} == {5.0, 4.0, 6.0}


def test_nothing_to_do(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x long, y string")
    r = clean.clean(df)
    assert log_of(r) == [] and r.data.count() == 2


def test_empty_table(spark):
    r = clean.clean(spark.createDataFrame([], "x double, y string"))
    assert log_of(r) == [] and r.stats.first()["rows_after"] == 0


def test_dates_are_imputed_with_their_mode(spark):
    df = spark.sql("select * from values (1, timestamp_ntz'2024-01-02'), (2, timestamp_ntz'2024-01-02'), (3, null) as t(i, d)")
    assert {str(r["d"]) for r in clean.clean(df).data.collect()} == {"2024-01-02 00:00:00"}


# -- features ---------------------------------------------------------------


def values(df, name, by):
    return [r[name] for r in df.orderBy(by).collect()]


def test_dates(spark):
    df = spark.sql("select * from values (1, timestamp_ntz'2023-12-30'), (2, timestamp_ntz'2024-02-29'), (3, timestamp_ntz'2024-03-04') as t(id, sailed)")
    out, made = features.datetime_features(df, ["sailed"])
    assert len(made["sailed"]) == 7
    assert values(out, "sailed_year", "id") == [2023, 2024, 2024] and values(out, "sailed_month", "id") == [12, 2, 3]
    assert values(out, "sailed_day_of_week", "id") == [5, 3, 0] and values(out, "sailed_is_weekend", "id") == [1, 0, 0]
    assert values(out, "sailed_days_since_reference", "id") == [0, 61, 65]


def test_null_date_is_no_weekend(spark):
    df = spark.sql("select * from values (1, timestamp_ntz'2024-01-13 23:00'), (2, timestamp_ntz'2024-01-15 01:00'), (3, null) as t(id, d)")
    out, _ = features.datetime_features(df, ["d"])
    assert values(out, "d_is_weekend", "id") == [1, 0, 0] and values(out, "d_year", "id")[2] is None
    assert values(out, "d_days_since_reference", "id") == [0, 1, None]


def test_unparseable_dates_have_no_reference(spark):
    df = spark.createDataFrame([("soon",), (None,)], "d string")
    _, made = features.datetime_features(df, ["d"])
    assert len(made["d"]) == 6


def test_text(spark):
    df = spark.createDataFrame([(1, "Two GREY herons, one pond"), (2, "no-one; at all?"), (3, ""), (4, None), (5, "Ünï_cødé, ça va!")], "id int, t string")
    out, _ = features.text_features(df, ["t"])
    assert values(out, "t_word_count", "id") == [5, 3, 0, 0, 3]
    assert values(out, "t_char_count", "id") == [25, 15, 0, 0, 16]
    assert values(out, "t_avg_word_length", "id")[:4] == [pytest.approx(21 / 5), pytest.approx(13 / 3), 0.0, 0.0]
    assert values(out, "t_uppercase_count", "id") == [5, 0, 0, 0, 0]
    assert values(out, "t_punctuation_count", "id") == [1, 3, 0, 0, 2]


def test_numbers(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 4.0), (4, -1.0), (5, None)], "id int, x double")
    out, _ = features.numeric_features(df, ["x"])
    assert values(out, "x_squared", "id") == [4.0, 9.0, 16.0, 1.0, None]
    assert values(out, "x_cubed", "id") == [8.0, 27.0, 64.0, -1.0, None]
    assert values(out, "x_log", "id") == [pytest.approx(math.log1p(v)) for v in (2, 3, 4, 0, 0)]
    assert values(out, "x_sqrt", "id")[2:] == [2.0, 0.0, 0.0]


def test_interactions(spark):
    df = spark.createDataFrame([(-3.0, 1.5), (0.5, -0.25), (7.0, -3.5), (10.0, -5.0)], "draft double, trim double")
    out, made = features.interaction_features(df, ["trim", "draft"])
    assert values(out, "draft_x_trim", "draft") == [-4.5, -0.125, -24.5, -50.0] and values(out, "draft_div_trim", "draft") == [-2.0] * 4
    assert list(made)[0][:2] == ("draft", "trim")


def test_ratio_with_zero_and_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 4.0), (3.0, 6.0), (None, 8.0)], "a double, b double")
    out, _ = features.interaction_features(df, ["a", "b"], threshold=0.0)
    assert values(out, "a_div_b", "b") == [0.0, 0.5, 0.5, 0.0]


def test_uncorrelated_pairs_are_skipped(spark):
    df = spark.range(100).select(F.sin(F.col("id") * 1.7).alias("a"), F.cos(F.col("id") * 2.9).alias("b"))
    assert features.interaction_features(df, ["a", "b"], threshold=0.9)[1] == {}


def test_encodings(spark):
    flags = ["NO", "LV", None, "FI", "LV", "LV", "NO", None, "LV", "FI"]
    df = spark.createDataFrame(list(enumerate(flags)), "id int, flag string")
    out, _ = features.categorical_features(df, ["flag"])
    share = {"NO": 0.25, "LV": 0.5, "FI": 0.25, None: 0.0}
    assert values(out, "flag_freq", "id") == [share[f] for f in flags]
    assert values(out, "flag_label", "id") == [{"FI": 0, "LV": 1, "NO": 2, None: -1}[f] for f in flags]
    first_seen, _ = features.categorical_features(df, ["flag"], order_by="id")
    assert values(first_seen, "flag_label", "id") == [{"NO": 0, "LV": 1, "FI": 2, None: -1}[f] for f in flags]


def test_encodings_with_many_values_equal_those_with_few(spark):
    rows = [(i, None if i % 13 == 0 else "hot" if i % 3 == 0 else f"v{i % 97}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, c string")
    few, _ = features.categorical_features(df, ["c"])
    many, _ = features.categorical_features(df, ["c"], broadcast_values=3, single_task=3)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()}


def test_long_values_are_encoded_by_digest(spark):
    long_a, long_b = "x" * 300 + "a", "x" * 300 + "b"
    df = spark.createDataFrame([(1, long_b), (2, long_a), (3, long_b), (4, "short")], "id int, c string")
    for limit in (100, 1):
        out, _ = features.categorical_features(df, ["c"], broadcast_values=limit)
        assert values(out, "c_label", "id") == [2, 1, 2, 0] and values(out, "c_freq", "id") == [0.5, 0.25, 0.5, 0.25]


def test_classification(spark):
    rows = [(i, f"2024-01-{i + 1:02d}", str(2000 + i), "ab"[i % 2], f"free text {i}", i % 2 == 0, None) for i in range(10)]
    df = spark.createDataFrame(rows, "n int, day string, year string, cat string, text string, flag boolean, empty string")
    c = features.classify(df)
    assert c.datetime == ["day"] and c.numeric == ["n"] and c.categorical == ["cat"]
    assert c.text == ["year", "text", "empty"] and c.other == ["flag"]


def test_classification_with_formats(spark):
    df = spark.createDataFrame([("15/01/2024",), ("20/06/2024",), ("x",), ("01/02/2024",), ("02/02/2024",)], "d string")
    assert features.classify(df).text == ["d"]
    assert features.classify(df, formats=["dd/MM/yyyy"]).datetime == ["d"]


# -- selection --------------------------------------------------------------


def test_correlated_column_goes(spark):
    df = spark.range(24).select(
        (F.col("id") * 3.0).alias("miles"), (F.col("id") * 5.5 + F.sin("id")).alias("hours"), F.cos(F.col("id") * 2.0).alias("swell"))
    s = selection.select_features(df)
    assert len({"miles", "hours"} & set(s.data.columns)) == 1 and "swell" in s.data.columns


def test_variance_and_missing_filters(spark):
    df = spark.range(20).select(F.lit(5.0).alias("constant"), F.col("id").cast("double").alias("varying"),
                                F.when(F.col("id") < 2, F.col("id")).alias("mostly_missing"))
    assert selection.select_features(df).data.columns == ["varying"]
    assert selection.select_features(df, protect=["constant"]).data.columns == ["constant", "varying"]


def test_greedy_walk_keeps_comparing_after_a_loss():
    """The first column loses to the second and still removes the third."""
    pairs = {("a", "b"): 0.99, ("a", "c"): 0.99, ("b", "c"): 0.1}
    assert selection.correlated_to_remove(["a", "b", "c"], pairs, {"a": 2.0, "b": 3.0, "c": 1.0}) == ["a", "c"]


def walk(cols, pairs, variances):
    """The elimination as two plain loops over a dictionary of pairs."""
    gone = set()
    for i, a in enumerate(cols):
        if a in gone:
            continue
        for b in cols[i + 1 :]:
            if (a, b) in pairs and b not in gone and None not in (variances[a], variances[b]):
                gone.add(b if variances[a] >= variances[b] else a)
    return [c for c in cols if c in gone]


def test_elimination_equals_two_plain_loops():
    rng = np.random.default_rng(3)
    for n, share in [(2, 1.0), (9, 0.4), (40, 0.1), (40, 0.9)] * 5:
        cols = [f"c{i}" for i in range(n)]
        pairs = {(a, b): 0.99 for i, a in enumerate(cols) for b in cols[i + 1 :] if rng.random() < share}
        variances = {c: None if rng.random() < 0.1 else float(rng.integers(0, 5)) for c in cols}
        assert selection.correlated_to_remove(cols, pairs, variances) == walk(cols, pairs, variances)


def test_elimination_of_five_thousand_columns():
    cols = [f"c{i}" for i in range(5000)]
    first, second = np.triu_indices(5000, k=1)
    pairs = StrongPairs(cols, first.astype(np.int32), second.astype(np.int32), np.full(len(first), 0.99))
    assert selection.eliminate(pairs, {c: float(i) for i, c in enumerate(cols)}) == cols[:-1]
    assert selection.eliminate(pairs, dict.fromkeys(cols, 1.0)) == cols[1:]


def test_strong_pairs_come_as_numbers_in_column_order(spark):
    df = spark.range(60).select(F.col("id").cast("double").alias("z"), F.lit(1.0).alias("constant"), (F.col("id") * 2.0).alias("a"),
                                F.sin(F.col("id") * 1.0).alias("m"), F.when(F.col("id") % 7 > 0, F.col("id") * -1.0).alias("n"))
    found = strong_pairs(df, df.columns, F.abs("corr") > 0.95)
    assert [(a, b, round(r, 9)) for a, b, r in found] == [("z", "a", 1.0), ("z", "n", -1.0), ("a", "n", -1.0)]
    assert list(strong_pairs(df, ["constant", "m"], F.abs("corr") > 0.1)) == []


def test_whole_stage(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    r = features.engineer(df, protect=["doc_id"])
    s = r.stats.first()
    assert s["columns_after"] == len(r.data.columns) and "doc_id" in r.data.columns
    assert s["features_added"] - s["features_removed"] == len(r.new_features)
    assert r.data.count() == df.count()


def test_whole_stage_on_an_empty_table(spark):
    r = features.engineer(spark.createDataFrame([], "a double"))
    assert r.stats.first()["rows_after"] == 0 and r.data.count() == 0


def test_columns_with_special_characters(spark):
    df = spark.createDataFrame([(1.0, "a b"), (2.0, "c d"), (3.0, "a b"), (4.0, "a b")], "`x.1` double, `my col` string")
    assert "my col_label" in features.engineer(df).new_features
