import pytest
from pyspark.sql import functions as F

from tabulon.functions.columns import fold_nan
from tabulon.operators import profile, quality
from tabulon.operators.stats import collect_stats


@pytest.fixture
def six_rows(spark):
    rows = [(1, "A", "2023-01-01"), (2, "A", "2023-01-02"), (3, "B", None), (4, "A", "2023-01-04"), (5, "C", "2023-01-05"), (100, "A", "2023-01-06")]
    return spark.createDataFrame(rows, "num long, cat string, dt string")


def by_name(df):
    return {r["column_name"]: r for r in df.collect()}


def test_profile_of_six_rows(six_rows):
    table, columns = profile.profile(six_rows)
    c = by_name(columns)
    assert (c["num"]["min_value"], c["num"]["max_value"], c["num"]["outlier_count"]) == (1.0, 100.0, 1)
    assert (c["num"]["q1"], c["num"]["median"], c["num"]["q3"]) == (2.25, 3.5, 4.75)
    assert c["cat"]["top_values"][0] == "A" and c["cat"]["top_value_counts"][0] == 4
    assert c["cat"]["top_value_percentages"][0] == pytest.approx(400 / 6)
    assert c["dt"]["data_type"] == "categorical" and c["dt"]["null_count"] == 1
    t = table.first()
    assert (t["row_count"], t["column_count"], t["duplicate_row_count"], t["missing_cells"]) == (6, 3, 0, 1)
    assert (t["numerical_columns"], t["categorical_columns"]) == (1, 2)


def test_profile_does_not_depend_on_partitioning(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    rows = [sorted(map(str, profile.column_profile(df.repartition(n)).drop("mean", "variance", "stddev").collect())) for n in (1, 7)]
    assert rows[0] == rows[1]


def test_profile_of_one_row_has_no_deviation(spark):
    c = by_name(profile.column_profile(spark.createDataFrame([(3.0,)], "x double")))["x"]
    assert (c["stddev"], c["variance"], c["median"]) == (None, None, 3.0)


def test_profile_of_an_empty_table(spark):
    table, columns = profile.profile(spark.createDataFrame([], "x double, s string"))
    assert table.first()["duplicate_row_percentage"] == 0.0
    assert all(r["null_percentage"] == 0.0 and r["unique_count"] == 0 for r in columns.collect())


def test_nan_counts_as_missing_and_infinities_are_not_reported(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "x double")
    c = by_name(profile.column_profile(df))["x"]
    assert (c["null_count"], c["max_value"], c["min_value"], c["mean"]) == (2, None, 1.0, None)


def test_booleans_dates_and_nested_columns(spark):
    df = spark.sql("select id % 2 = 0 as b, date'2024-01-01' + cast(id as int) as d, array(id) as a from range(4)")
    c = by_name(profile.column_profile(df))
    assert c["b"]["data_type"] == "boolean" and c["b"]["unique_count"] == 2
    assert (c["d"]["min_date"], c["d"]["max_date"]) == ("2024-01-01", "2024-01-04")
    assert c["a"]["unique_count"] == 4


def test_approximate_profile(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    near = by_name(profile.column_profile(df, {"distinct", "quantiles"}, approximate=True))["l_partkey"]
    exact = by_name(profile.column_profile(df, {"distinct", "quantiles"}))["l_partkey"]
    assert abs(near["unique_count"] / exact["unique_count"] - 1) < 0.1


def test_wide_tables_are_aggregated_in_chunks(spark):
    df = spark.range(10).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(70)])
    stats = collect_stats(df, {"moments", "negatives"})
    assert [c.min_value for c in stats.columns] == [float(i) for i in range(70)]


# -- quality ----------------------------------------------------------------


def kinds(df):
    return [r["issue_type"] for r in quality.find_issues(df).orderBy("issue_order").collect()]


def report(df):
    parts = quality.analyze_quality(df)
    return parts, parts["summary"].first(), parts["score"].first()["quality_score"]


def test_clean_table_scores_99(spark):
    parts, summary, score = report(spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id long, value long"))
    assert score == 99 and summary["potential_identifiers"] == 1


def test_perfect_table(spark):
    assert report(spark.createDataFrame([(1,), (2,), (3,)], "val long"))[2] == 100


def test_missing_share_over_all_cells(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a"), (5, "b")], "col1 long, col2 string")
    _, summary, _ = report(df)
    assert summary["missing_percentage"] == pytest.approx(10.0)
    issue = quality.find_issues(df).filter("issue_type = 'missing_values'").first()
    assert issue["severity"] == "medium" and issue["description"] == "Column has 1 missing values (20.00%)."


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "col1 long, col2 string")
    first = quality.find_issues(df).orderBy("issue_order").first()
    assert (first["issue_type"], first["severity"], first["column_name"]) == ("duplicate_rows", "high", None)


def test_constant_and_near_constant(spark):
    assert "constant_column" in kinds(spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "id long, status string"))
    df = spark.createDataFrame([("A",)] * 100 + [("B",)], "col string")
    assert "near_constant_column" in kinds(df) and report(df)[1]["constant_columns"] == 1


def test_cardinality_outliers_and_suspicious(spark):
    assert report(spark.createDataFrame([(f"t{i}",) for i in range(20)], "text string"))[1]["high_cardinality_columns"] == 1
    assert report(spark.createDataFrame([(10,), (12,), (11,), (10,), (11,), (1000,)], "val long"))[1]["outlier_columns"] == 1
    df = spark.createDataFrame([(10, "hi"), (-5, " ")], "price long, text string")
    assert report(df)[1]["suspicious_columns"] == 2


def test_no_outliers_without_a_spread(spark):
    df = spark.createDataFrame([(5,)] * 9 + [(900,)], "val long")
    assert "numeric_outliers" not in kinds(df)
    assert by_name(profile.column_profile(df))["val"]["outlier_count"] == 1


def test_all_null_column_only_counts_as_missing(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "x long, paid_id string")
    assert kinds(df) == ["missing_values"]


def test_empty_table(spark):
    parts, summary, score = report(spark.createDataFrame([], "x long, y string"))
    assert score == 0 and summary["missing_percentage"] == 100.0
    assert [(r["issue_type"], r["severity"]) for r in parts["issues"].collect()] == [("empty_dataset", "high")]
    assert parts["recommendations"].count() == 1


def test_unicode_blanks(spark):
    df = spark.createDataFrame([("  ",), ("",), ("a",)], "text string")
    issue = quality.find_issues(df).filter("issue_type = 'suspicious_values'").first()
    assert issue["metric_value"] == 2.0


def test_many_tables_in_one_run(spark, sf):
    stats = quality.quality_stats(spark.read.parquet(f"{sf}/nation.parquet"), "nation").unionByName(
        quality.quality_stats(spark.read.parquet(f"{sf}/region.parquet"), "region")
    )
    scores = quality.quality_score(stats, quality.issues_from_stats(stats)).collect()
    assert {r["table_name"] for r in scores} == {"nation", "region"}


def test_fold_nan_keeps_other_columns(spark):
    df = spark.createDataFrame([(float("nan"), "a")], "`x.y` double, s string")
    assert fold_nan(df).collect()[0][0] is None
