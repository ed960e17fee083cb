"""The registered queries: every operator on whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.columns import NUMERICAL, col, columns_of, fold_nan, safe_double
from tabulon.operators import clean, counts, evaluate, explain, features, prepare, profile, quality, replay, report, runlog, score, selection, split, train
from tabulon.operators.quantiles import exact_quantiles
from tabulon.plans.views import table, view
from tabulon.session import stage_dir
from tabulon.sources import infer, readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

TARGET = "o_orderstatus"
KEY = ["o_orderkey"]
LANGUAGE_LETTERS = "ñüèé"
LINE_FEATURES = ["l_quantity", "l_linenumber", "l_discount", "l_tax"]


def register(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and dates as text, so that two engines can be compared cell by cell."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append(F.round(col(name), digits).alias(name))
        elif kind in ("timestamp", "timestamp_ntz", "date"):
            out.append(col(name).cast("string").alias(name))
        else:
            out.append(col(name))
    return df.select(*out)


# -- sources ----------------------------------------------------------------


@register
def parquet_scan(spark, sf):
    """What a filter leaves of a table: the filter reaches the scan."""
    lines = readers.read_parquet(spark, f"{sf}/lineitem.parquet", where=[("l_quantity", ">", 45.0)])
    return rounded(lines.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"))


@register
def parquet_scan_all(spark, sf):
    return rounded(readers.read_parquet(spark, f"{sf}/lineitem.parquet"))


@register
def json_scan(spark, sf):
    """The dirty orders as JSON, read by the extension of the path: numbers, truth values and gaps."""
    path = f"{stage_dir(spark, 'json')}/{uuid.uuid4().hex}.json"
    view(spark, sf, "orders_dirty").write.option("ignoreNullFields", False).json(path)
    return rounded(readers.read_file(spark, path).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "is_big", "mostly_missing"))


@register
def shape(spark, sf):
    rows = readers.require_data(table(spark, sf, "lineitem"))
    n_columns = len(rows.columns)
    return rows.agg(F.count(F.lit(1)).alias("row_count"), F.lit(n_columns).cast("bigint").alias("column_count"))


@register
def split_scan(spark, sf):
    """The held-out rows, read back from a table that is partitioned by side."""
    tagged = split.train_test_split(supervised(spark, sf), key=KEY, target=TARGET).data
    path = sinks.write_stage(tagged.select(split.SPLIT, "o_orderkey", TARGET), stage_dir(spark, "split_scan"), "tagged")
    _, test, _ = train.split_scan(spark.read.parquet(path), TARGET)
    return test.select("o_orderkey", TARGET)


def _csv_orders(spark, sf) -> str:
    """The dirty orders written as delimited text."""
    return sinks.write_stage(view(spark, sf, "orders_dirty"), stage_dir(spark, "csv"), "orders", "csv")


@register
def csv_scan(spark, sf):
    return rounded(readers.read_csv(spark, _csv_orders(spark, sf)))


@register
def read_dispatch(spark, sf):
    return readers.read_file(spark, _csv_orders(spark, sf)).agg(
        F.count(F.lit(1)).alias("row_count"), F.count("o_totalprice").alias("prices"), F.sum("o_orderkey").alias("key_sum")
    )


@register
def na_fold(spark, sf):
    texts = view(spark, sf, "raw_inputs").withColumn("amount", F.when(F.col("amount") == "unknown", "N/A").otherwise(F.col("amount")))
    return infer.fold_na_columns(texts)


@register
def type_inference(spark, sf):
    """Inferred type and number of values per text column."""
    texts = view(spark, sf, "raw_inputs")
    types = infer.infer_types(texts)
    typed = infer.apply_types(texts, types)
    return (
        counts.value_counts(typed, typed.columns).groupBy("column").agg(F.sum("n").alias("value_count"))
        .select(F.col("column").alias("column_name"), _lookup_literal(types, F.col("column")).alias("inferred_type"), "value_count")
    )


def _lookup_literal(mapping: dict[str, str], key):
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[key]


# -- profile ----------------------------------------------------------------


@register
def profile_table(spark, sf):
    return profile.table_profile(table(spark, sf, "lineitem")).select(
        "row_count", F.col("column_count").cast("bigint").alias("column_count"), "duplicate_row_count",
        F.round("duplicate_row_percentage", 6).alias("duplicate_row_percentage"), "missing_cells",
        *[F.col(c).cast("bigint").alias(c) for c in ("numerical_columns", "categorical_columns", "datetime_columns", "boolean_columns")],
    )


def _columns(spark, sf, source, groups, *names):
    df = view(spark, sf, source) if source != "lineitem" else table(spark, sf, source)
    return rounded(profile.column_profile(df, groups).select("column_name", *names))


@register
def profile_types(spark, sf):
    return _columns(spark, sf, "orders_dirty", set(), "data_type", "non_null_count")


@register
def profile_bytes(spark, sf):
    return _columns(spark, sf, "lineitem", {"bytes"}, "memory_bytes")


@register
def profile_nulls(spark, sf):
    return _columns(spark, sf, "orders_dirty", set(), "null_count", "non_null_count", "null_percentage")


@register
def profile_missing_total(spark, sf):
    return _columns(spark, sf, "orders_dirty", set(), "null_count").agg(F.sum("null_count").alias("missing_cells"))


@register
def profile_distinct(spark, sf):
    return _columns(spark, sf, "orders_dirty", {"distinct"}, "unique_count", "unique_percentage")


@register
def profile_duplicates(spark, sf):
    parts = []
    for name in ("order_flags", "document_texts"):
        found = counts.distinct_row_count(fold_nan(view(spark, sf, name)))
        parts.append(found.select(F.lit(name).alias("table_name"), "*", F.round(profile.percent("duplicate_count"), 6).alias("duplicate_percentage")))
    return parts[0].unionByName(parts[1])


@register
def profile_quantiles(spark, sf):
    lines = _columns(spark, sf, "lineitem", {"quantiles"}, "q1", "median", "q3", "iqr").filter("q1 is not null")
    events = rounded(profile.column_profile(table(spark, sf, "events").select("value"), {"quantiles"}).select("column_name", "q1", "median", "q3", "iqr"))
    return lines.unionByName(events)


@register
def profile_numeric(spark, sf):
    names = ("min_value", "max_value", "mean", "median", "stddev", "variance")
    df = profile.column_profile(table(spark, sf, "lineitem"), {"moments", "quantiles"}).filter("data_type = 'numerical'")
    return df.select("column_name", *[F.round(n, 3).alias(n) for n in names])


@register
def profile_outliers(spark, sf):
    names = ("outlier_count", "outlier_percentage", "lower_bound", "upper_bound")
    lines = _columns(spark, sf, "lineitem", {"outliers"}, *names).filter("lower_bound is not null")
    events = rounded(profile.column_profile(table(spark, sf, "events").select("value"), {"outliers"}).select("column_name", *names))
    return lines.unionByName(events)


@register
def profile_top_values(spark, sf):
    parts = []
    for name, cols in (("events", ["event_type", "props"]), ("part", ["p_brand", "p_type", "p_name"])):
        df = table(spark, sf, name).select(*cols)
        top = counts.top_values(df, cols)
        rows = df.count()
        parts.append(top.select("column", "rank", "value", "n", F.round(F.col("n") * 100.0 / rows, 6).alias("percentage")))
    return parts[0].unionByName(parts[1]).withColumnRenamed("column", "column_name")


@register
def profile_datetime(spark, sf):
    parts = []
    for source in (table(spark, sf, "events"), view(spark, sf, "orders_dirty")):
        parts.append(profile.column_profile(source, {"dates"}).filter("data_type = 'datetime'").select("column_name", "min_date", "max_date"))
    return parts[0].unionByName(parts[1])


@register
def profile_safe_float(spark, sf):
    """NaN and infinities as null, on values some of which were made so."""
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).when(F.col("event_id") % 11 == 0, F.lit(float("nan")))
    value = value.when(F.col("event_id") % 13 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return rounded(table(spark, sf, "events").select("event_id", safe_double(value).alias("safe_value")))


@register
def profile_columns(spark, sf):
    """The whole column profile of the line items."""
    out = profile.column_profile(table(spark, sf, "lineitem"))
    return out.select("column_name", "data_type", "null_count", "unique_count", F.round("median", 3).alias("median"),
                      F.round("mean", 3).alias("mean"), "outlier_count", "min_date", F.element_at("top_values", 1).alias("top_value"))


# -- quality ----------------------------------------------------------------

QUALITY_SOURCES = ("orders_dirty", "customer_balance", "document_quality", "order_flags")


def _quality_stats(spark, sf, groups=quality.QUALITY_GROUPS) -> DataFrame:
    return quality.quality_stats_of({s: view(spark, sf, s) for s in QUALITY_SOURCES}, groups)


def _issues(spark, sf, groups, *kinds) -> DataFrame:
    found = quality.issues_from_stats(_quality_stats(spark, sf, set(groups)))
    if kinds:
        found = found.filter(F.col("issue_type").isin(*kinds))
    return rounded(found.select("table_name", "issue_type", "severity", "column_name", "metric_value"))


@register
def quality_duplicates(spark, sf):
    return _issues(spark, sf, {"duplicates"}, "duplicate_rows")


@register
def quality_missing(spark, sf):
    return _issues(spark, sf, set(), "missing_values")


@register
def quality_constant(spark, sf):
    return _issues(spark, sf, {"distinct"}, "constant_column", "near_constant_column")


@register
def quality_outliers(spark, sf):
    return _issues(spark, sf, {"outliers"}, "numeric_outliers")


@register
def quality_negatives(spark, sf):
    return _issues(spark, sf, {"negatives"}, "suspicious_values")


@register
def quality_cardinality(spark, sf):
    return _issues(spark, sf, {"distinct"}, "high_cardinality")


@register
def quality_blank_strings(spark, sf):
    return _issues(spark, sf, {"blanks"}, "suspicious_values")


@register
def quality_identifiers(spark, sf):
    return _issues(spark, sf, {"distinct"}, "potential_identifier")


@register
def quality_issues(spark, sf):
    """Every fired rule of all tables, with its text."""
    found = quality.issues_from_stats(_quality_stats(spark, sf))
    return rounded(found.select("table_name", "issue_type", "severity", "column_name", "metric_value", "description"))


@register
def quality_score(spark, sf):
    s = _quality_stats(spark, sf)
    return quality.quality_score(s, quality.issues_from_stats(s))


@register
def quality_empty(spark, sf):
    """The whole report on tables without a row: one issue, the worst score, all cells missing."""
    parts = []
    for name in ("orders", "documents"):
        r = quality.analyze_quality(table(spark, sf, name).filter("1 = 0"), name)
        parts.append(r["issues"].join(r["score"], "table_name").join(r["summary"], "table_name").join(r["recommendations"].drop("first_order"), ["table_name", "issue_type"]))
    return report.union_all(parts).select("table_name", "issue_type", "severity", "column_name", "quality_score", "quality_band", "missing_percentage", "recommendation_text")


@register
def quality_recommendations(spark, sf):
    s = _quality_stats(spark, sf)
    return quality.recommendations(quality.issues_from_stats(s)).select("table_name", "issue_type", "recommendation_text")


@register
def quality_summary(spark, sf):
    s = _quality_stats(spark, sf)
    return rounded(quality.quality_summary(s, quality.issues_from_stats(s)))


@register
def quality_by_severity(spark, sf):
    return quality.severity_counts(quality.issues_from_stats(_quality_stats(spark, sf)))


# -- cleaning ---------------------------------------------------------------


@register
def clean_blank_to_null(spark, sf):
    return clean.blanks_to_null(view(spark, sf, "orders_dirty")).select("o_orderkey", "o_orderpriority", "near_const")


def _filled(spark, sf, *names) -> DataFrame:
    """Only the wanted columns are read and imputed."""
    return rounded(clean.imputed(view(spark, sf, "orders_dirty").select("o_orderkey", *names))[0])


@register
def clean_median_impute(spark, sf):
    return _filled(spark, sf, "o_totalprice", "mostly_missing")


@register
def clean_mode_impute(spark, sf):
    return _filled(spark, sf, "o_orderpriority", "o_orderdate", "o_orderstatus", "is_big")


def _clean_log(spark, sf, source="orders_dirty") -> DataFrame:
    return clean.clean(view(spark, sf, source)).operations


@register
def clean_unresolved(spark, sf):
    return _clean_log(spark, sf).filter("operation = 'missing_values_unresolved'").select("operation", F.col("column").alias("column_name"), "affected_rows")


@register
def clean_missing_total(spark, sf):
    df = fold_nan(view(spark, sf, "orders_dirty"))
    n, missing, _ = clean.missing_and_blank_counts(df)
    handled = sum(m for m in missing.values() if m < n)
    return spark.createDataFrame([(handled,)], "missing_values_handled long")


@register
def clean_dedupe(spark, sf):
    flags = clean.remove_duplicates(view(spark, sf, "order_flags")).select(F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("row_text"))
    return flags.unionByName(clean.remove_duplicates(view(spark, sf, "document_texts")).select(F.col("text").alias("row_text")))


@register
def clean_table(spark, sf):
    return rounded(clean.clean(view(spark, sf, "orders_categories")).data)


@register
def clean_stats(spark, sf):
    return clean.clean(view(spark, sf, "orders_categories")).stats.select(
        "rows_before", "rows_after", F.col("columns_before").cast("bigint").alias("columns_before"),
        F.col("columns_after").cast("bigint").alias("columns_after"), "missing_values_handled", "duplicates_removed",
    )


@register
def clean_log(spark, sf):
    """The operation log of the whole cleaning stage."""
    return _clean_log(spark, sf, "orders_categories").select("operation", F.col("column").alias("column_name"), "affected_rows", "strategy")


# -- features ---------------------------------------------------------------


@register
def fe_detect_datetime(spark, sf):
    df = view(spark, sf, "event_texts")
    rates = features.date_rates(df)
    frame = spark.createDataFrame(list(rates.items()), "column_name string, parse_rate double")
    return rounded(frame.withColumn("is_datetime", F.col("parse_rate") >= features.DATE_RATE))


@register
def fe_detect_categorical(spark, sf):
    parts = []
    for name, cols in (("part", ["p_name", "p_brand", "p_type"]), ("documents", ["text", "lang", "source"])):
        parts.append(counts.cardinalities(table(spark, sf, name), cols))
    judged = [(r["column"], r["distinct_count"], r["non_null_count"], features.is_categorical(r["distinct_count"], r["non_null_count"]))
              for r in parts[0].unionByName(parts[1]).collect()]  # a row per column
    return spark.createDataFrame(judged, "column_name string, distinct_count long, non_null_count long, is_categorical boolean")


@register
def fe_classify(spark, sf):
    parts = []
    for df in (view(spark, sf, "event_texts"), table(spark, sf, "part"), view(spark, sf, "orders_dirty").select("is_big", "o_orderdate", "near_const")):
        parts.append(features.classify(df).frame(df))
    return report.union_all(parts)


@register
def fe_datetime(spark, sf):
    df, made = features.datetime_features(table(spark, sf, "events"), ["ts"])
    return df.select("event_id", *[F.col(c).cast("bigint").alias(c) for c in made["ts"][:6]])


@register
def fe_days_since_min(spark, sf):
    df, _ = features.datetime_features(table(spark, sf, "events"), ["ts"])
    return df.select("event_id", "ts_days_since_reference")


@register
def fe_text(spark, sf):
    df, made = features.text_features(table(spark, sf, "documents"), ["text"])
    ints = [c for c in made["text"] if c != "text_avg_word_length"]
    return df.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ints], F.round("text_avg_word_length", 6).alias("text_avg_word_length"))


@register
def fe_numeric(spark, sf):
    a, made_a = features.numeric_features(view(spark, sf, "orders_dirty"), ["o_totalprice"])
    b, made_b = features.numeric_features(table(spark, sf, "customer"), ["c_acctbal"])
    names = ["x_squared", "x_cubed", "x_log", "x_sqrt"]
    a = a.select(F.col("o_orderkey").alias("row_id"), F.lit("orders").alias("source"), *[F.col(c).alias(n) for c, n in zip(made_a["o_totalprice"], names)])
    b = b.select(F.col("c_custkey").alias("row_id"), F.lit("customer").alias("source"), *[F.col(c).alias(n) for c, n in zip(made_b["c_acctbal"], names)])
    return a.unionByName(b).withColumns({"x_log": F.round("x_log", 6), "x_sqrt": F.round("x_sqrt", 6)})


@register
def fe_corr_pairs(spark, sf):
    """Correlated pairs of the parts and of the derived columns next to them."""
    df = view(spark, sf, "part_squares").drop("p_brand")
    return rounded(features.correlated_pairs(df, df.columns))


@register
def fe_interactions(spark, sf):
    df, _ = features.interaction_features(table(spark, sf, "part"), ["p_partkey", "p_size", "p_retailprice"])
    made = [c for c in df.columns if "_x_" in c or "_div_" in c]
    return rounded(df.select("p_partkey", *made))


@register
def fe_freq_encode(spark, sf):
    df, _ = features.categorical_features(view(spark, sf, "orders_dirty").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])
    return rounded(df.select("o_orderkey", "o_orderpriority_freq"))


@register
def fe_label_encode(spark, sf):
    df, _ = features.categorical_features(view(spark, sf, "orders_dirty").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])
    return df.select("o_orderkey", "o_orderpriority_label")


def _kept(spark, df) -> DataFrame:
    """The columns a selection kept, with how many values each holds."""
    kept = df.agg(*[F.count(col(c)).alias(c) for c in df.columns])
    return kept.unpivot([], df.columns, "column_name", "value_count")


@register
def fe_select_missing(spark, sf):
    df = view(spark, sf, "orders_dirty")
    _, shares = selection.missing_shares(df)
    return _kept(spark, df.select(*[c for c in df.columns if shares[c] <= selection.MAX_MISSING]))


@register
def fe_select_variance(spark, sf):
    df = view(spark, sf, "part_squares")
    numeric = [c for c in df.columns if c != "p_brand"]
    low = {c for c, m in selection.column_moments(df, numeric).items() if m["variance"] is not None and m["variance"] < selection.MIN_VARIANCE}
    return _kept(spark, df.select(*[c for c in df.columns if c not in low]))


@register
def fe_select_correlation(spark, sf):
    return _kept(spark, selection.select_features(view(spark, sf, "part_squares")).data)


@register
def fe_table(spark, sf):
    """The whole feature stage on the dirty orders."""
    return rounded(features.engineer(view(spark, sf, "orders_dirty"), protect=["o_orderkey"]).data)


@register
def fe_log(spark, sf):
    return features.engineer(table(spark, sf, "documents")).operations.select("operation", F.col("column").alias("column_name"), "strategy", "detail")


@register
def fe_table_kept(spark, sf):
    """The whole feature stage over the documents: which columns are left, how many values each holds, and their range."""
    made = features.engineer(table(spark, sf, "documents")).data
    numeric = set(columns_of(made, NUMERICAL))
    bounds = [f(col(c).cast("double")).alias(f"{n}:{c}") for c in made.columns if c in numeric for n, f in (("min", F.min), ("max", F.max))]
    row = made.agg(*[F.count(col(c)).alias(c) for c in made.columns], *bounds).first().asDict()
    kept = [(c, row[c], row.get(f"min:{c}"), row.get(f"max:{c}")) for c in made.columns]
    return rounded(spark.createDataFrame(kept, "column_name string, value_count long, min_value double, max_value double"), 4)


# -- preparation ------------------------------------------------------------


def supervised(spark, sf) -> DataFrame:
    return prepare.drop_null_target(fold_nan(view(spark, sf, "orders_dirty")), TARGET)


def _tagged(spark, sf, *cols) -> DataFrame:
    """Split rows, reduced to the wanted columns."""
    df = supervised(spark, sf).select("o_orderkey", TARGET, *[c for c in cols if c != TARGET])
    return split.train_test_split(df, key=KEY, target=TARGET).data


@register
def prep_drop_null_target(spark, sf):
    return supervised(spark, sf).select("o_orderkey", TARGET)


@register
def prep_classify(spark, sf):
    df = supervised(spark, sf)
    numeric, categorical = prepare.feature_classes(df, TARGET)
    filled = df.agg(*[F.count(col(c)).alias(c) for c in numeric + categorical]).unpivot([], numeric + categorical, "column_name", "value_count")
    kinds = {c: "numeric" for c in numeric} | {c: "categorical" for c in categorical}
    return filled.withColumn("feature_class", _lookup_literal(kinds, F.col("column_name")))


@register
def prep_class_counts(spark, sf):
    df = supervised(spark, sf)
    return split.class_counts(df, TARGET).select(F.col("class").alias("class_name"), "n")


@register
def prep_split(spark, sf):
    df = supervised(spark, sf).select("o_orderkey")
    return split.train_test_split(df, key=KEY).data.select("o_orderkey", F.col(split.SPLIT).alias("side"))


@register
def prep_split_stratified(spark, sf):
    return _tagged(spark, sf).select("o_orderkey", TARGET, F.col(split.SPLIT).alias("side"))


def _train(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col(split.SPLIT) == "train")


@register
def prep_impute_numeric(spark, sf):
    tagged = _tagged(spark, sf, "o_totalprice", "mostly_missing")
    cols = ["o_totalprice", "mostly_missing"]
    medians = exact_quantiles(_train(tagged), {c: [0.5] for c in cols})
    return rounded(tagged.select("o_orderkey", *[F.coalesce(F.col(c), F.lit(medians[c][0])).alias(c) for c in cols]))


@register
def prep_scale(spark, sf):
    cols = ["o_totalprice", "o_custkey", "is_big"]
    tagged = _tagged(spark, sf, *cols)
    learned = prepare.fit_numeric(_train(tagged), cols)
    return rounded(tagged.select("o_orderkey", *[prepare.scaled(tagged, p).alias(p.column) for p in learned]))


@register
def prep_impute_categorical(spark, sf):
    tagged = _tagged(spark, sf, "o_orderpriority")
    learned = prepare.fit_categorical(_train(tagged), ["o_orderpriority"])[0]
    return tagged.select("o_orderkey", prepare.filled_category(tagged, learned).alias("o_orderpriority"))


@register
def prep_one_hot(spark, sf):
    tagged = _tagged(spark, sf, "near_const", "const_col")
    learned = prepare.fit_categorical(_train(tagged), ["near_const", "const_col"])
    p = prepare.Parameters(TARGET, [], learned)
    return prepare.transform(tagged, p, keep=["o_orderkey"])


@register
def prep_one_hot_vector(spark, sf):
    """Customer names as one sparse vector, by a dictionary that is learned from four fifths of them, stored and loaded."""
    customers = table(spark, sf, "customer").withColumn("side", F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("train"))
    fitted = prepare.fit(customers.filter("side = 'train'").select("c_name", "c_acctbal"), "c_acctbal", one_hot="vector")
    path = f"{stage_dir(spark, 'parameters')}/{uuid.uuid4().hex}"
    sinks.save_parameters(spark, fitted, path)
    made = prepare.transform(customers, sinks.load_parameters(spark, path), keep=["c_custkey", "side"])
    parts = made.withColumn("v", F.unwrap_udt("c_name_onehot"))
    return parts.select("c_custkey", "side", F.col("v.size").cast("bigint").alias("width"), F.size("v.indices").cast("bigint").alias("ones"),
                        F.get("v.indices", F.lit(0)).cast("bigint").alias("slot"))


@register
def prep_ml_ready(spark, sf):
    """Every column of the dirty orders, prepared."""
    ready = prepare.prepare(view(spark, sf, "orders_dirty"), TARGET, key=KEY).data
    return rounded(ready.withColumnRenamed(split.SPLIT, "side"), 5)


@register
def prep_stats(spark, sf):
    stats = prepare.prepare(view(spark, sf, "orders_dirty"), TARGET, key=KEY).stats
    return stats.select(*[F.col(c).cast("bigint").alias(c) for c in prepare.STATS_SCHEMA.fieldNames()])


@register
def sink_roundtrip(spark, sf):
    """The dirty orders as a stage table, read back."""
    path = sinks.write_stage(view(spark, sf, "orders_dirty"), stage_dir(spark, "sinks"), "orders")
    return rounded(spark.read.parquet(path))


@register
def parameter_roundtrip(spark, sf):
    """Numeric parameters of all parts, stored and loaded."""
    fitted = prepare.fit(table(spark, sf, "part").select("p_size", "p_retailprice", "p_brand"), "p_brand")
    path = f"{stage_dir(spark, 'parameters')}/{uuid.uuid4().hex}"
    sinks.save_parameters(spark, fitted, path)
    rows = [(p.column, float(p.median), float(p.mean), float(p.scale)) for p in sinks.load_parameters(spark, path).numeric]
    return rounded(spark.createDataFrame(rows, "column_name string, median double, mean double, scale double"), 4)


@register
def prep_refusals(spark, sf):
    """Which requests for a preparation are refused, and the sizes of the one that is not."""
    orders = view(spark, sf, "orders_dirty")
    cases = {
        "valid": (orders, TARGET, 0.2), "unknown_target": (orders, "nowhere", 0.2), "empty_target": (orders, "all_null", 0.2),
        "share_too_large": (orders, TARGET, 0.9), "too_few_rows": (orders.limit(3), "o_orderkey", 0.2),
    }
    out = []
    for name, (df, target, share) in cases.items():
        try:
            out.append((name, False, *prepare.validate(df, target, share)))
        except prepare.PreparationError:
            out.append((name, True, None, None))
    return spark.createDataFrame(out, "case_name string, refused boolean, row_count long, supervised_rows long")


@register
def train_refusals(spark, sf):
    """Which prepared tables are refused for training."""
    tagged = supervised(spark, sf).select(F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train").alias(split.SPLIT), "o_custkey", TARGET)
    cases = {
        "no_split": tagged.drop(split.SPLIT), "no_test_rows": tagged.filter(F.col(split.SPLIT) == "train"), "no_target": tagged.drop(TARGET),
        "no_train_rows": tagged.filter(F.col(split.SPLIT) == "test"), "one_class": tagged.withColumn(TARGET, F.lit("P")),
    }
    out = []
    for name, df in cases.items():
        try:
            train.run_experiment(df, TARGET, model_names=["DecisionTreeClassifier"])
            out.append((name, False, df.count()))
        except train.ExperimentError:
            out.append((name, True, df.count()))
    return spark.createDataFrame(out, "case_name string, refused boolean, row_count long")


# -- training, scoring, explanation -----------------------------------------


def _prepared_orders(spark, sf) -> prepare.PreparedData:
    df = view(spark, sf, "orders_dirty").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "is_big", "near_const", TARGET)
    return prepare.prepare(df, TARGET, key=KEY)


def _prepared_parts(spark, sf) -> prepare.PreparedData:
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice")
    return prepare.prepare(df, "p_retailprice", key=["p_partkey"])


def _stored(spark, prepared: prepare.PreparedData) -> DataFrame:
    """Training reads the written table, as its many passes should not repeat the preparation."""
    return spark.read.parquet(sinks.write_stage(prepared.data, stage_dir(spark, "ml_ready"), "ml_ready"))


def _results(experiment: train.Experiment) -> DataFrame:
    return experiment.results.select(
        "model_name", "problem_type", "status", "training_rows", "validation_rows", "feature_count",
        "accuracy", "precision", "recall", "f1", "mae", "mse", "rmse", "r2",
    )


@register
def train_problem_type(spark, sf):
    df = table(spark, sf, "part")
    cols = ["p_partkey", "p_size", "p_retailprice", "p_brand"]
    kinds = {c: train.infer_problem_type(df, c) for c in cols}
    return counts.cardinalities(df, cols).select(
        F.col("column").alias("target"), "distinct_count", _lookup_literal(kinds, F.col("column")).alias("problem_type")
    )


def _one_model(spark, prepared, target, name) -> tuple[DataFrame, train.FittedModel, DataFrame]:
    """Sizes and outcome of a training, the model, and the stored table."""
    ready = _stored(spark, prepared)
    experiment = train.run_experiment(ready, target, model_names=[name])
    facts = experiment.results.select("model_name", "problem_type", "status", "training_rows", "validation_rows", "feature_count",
                                      (F.col("r2") > 0).alias("better_than_mean"))
    return facts, experiment.models[name], ready


def _root_and_leaves(nodes: DataFrame) -> DataFrame:
    """What holds for every tree whatever its splits: all rows at the root, its impurity, and as many in the leaves together."""
    root, leaf = F.col("depth") == 0, F.col("threshold").isNull()
    return nodes.agg(
        F.max(F.when(root, F.col("rows"))).alias("root_rows"), F.max(F.when(root, F.col("impurity"))).alias("root_impurity"),
        F.sum(F.when(leaf, F.col("rows"))).alias("leaf_rows"))


@register
def train_logistic(spark, sf):
    """Three-class weights over the prepared orders: the equations that hold at the optimum, per class."""
    prepared = _prepared_orders(spark, sf)
    facts, fitted, ready = _one_model(spark, prepared, TARGET, "LogisticRegression")
    rows, _, _ = train.split_scan(ready, TARGET)
    checked = explain.logistic_gradient(fitted, rows, TARGET, 1.0 / prepared.split.train_rows)
    balanced = F.abs(F.col("expected") - F.col("n")) <= 0.001 * F.col("n")
    return checked.crossJoin(F.broadcast(facts)).select(
        "model_name", "status", "training_rows", "validation_rows", "feature_count", "class", "n", balanced.alias("balanced"),
        (F.col("largest_gradient") < 0.001).alias("gradient_vanishes"))


@register
def train_logistic_weights(spark, sf):
    """Does a document hold an accent, by the logarithm of its length: intercept and slope at the penalised optimum."""
    docs = table(spark, sf, "documents").select(F.log1p(F.length(F.coalesce("text", F.lit(""))).cast("double")).alias("size"),
                                                F.coalesce(F.col("text").contains("é"), F.lit(False)).cast("int").alias("accent"))
    rows = docs.count()
    model = train.fit_model(docs, "accent", ["size"], "LogisticRegression", "classification", rows).model
    return rounded(spark.createDataFrame([(rows, float(model.intercept), float(model.coefficients[0]))], "training_rows long, intercept double, slope double"), 2)


@register
def train_tree_cls(spark, sf):
    facts, fitted, _ = _one_model(spark, _prepared_orders(spark, sf), TARGET, "DecisionTreeClassifier")
    return rounded(facts.drop("better_than_mean").crossJoin(F.broadcast(_root_and_leaves(explain.tree_nodes(spark, fitted)))))


@register
def train_forest_cls(spark, sf):
    facts, fitted, _ = _one_model(spark, _prepared_orders(spark, sf), TARGET, "RandomForestClassifier")
    return facts.drop("better_than_mean").crossJoin(F.broadcast(_forest_facts(explain.tree_nodes(spark, fitted))))


def _forest_facts(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.countDistinct("tree").alias("trees"), (F.max("depth") <= train.FOREST_DEPTH).alias("within_depth"),
                     F.countDistinct(F.when(F.col("threshold").isNotNull(), F.col("tree"))).alias("trees_that_split"))


@register
def train_tree_levels_cls(spark, sf):
    """The language of all documents by some letters: two levels of a tree, node by node."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf, "documents").select("lang", *[text.contains(c).cast("double").alias(f"has_{i}") for i, c in enumerate(LANGUAGE_LETTERS)])
    fitted = train.fit_model(docs, "lang", [c for c in docs.columns if c != "lang"], "DecisionTreeClassifier", "classification", docs.count(), max_depth=2)
    return rounded(explain.tree_nodes(spark, fitted).select("node", "feature_name", "threshold", "rows", "prediction"))


@register
def train_tree_levels_reg(spark, sf):
    """The price of all order lines by quantity, line number, discount and tax: two levels of a tree, node by node."""
    df = table(spark, sf, "lineitem").select("l_extendedprice", *LINE_FEATURES)
    fitted = train.fit_model(df, "l_extendedprice", LINE_FEATURES, "DecisionTreeRegressor", "regression", df.count(), max_depth=2)
    return rounded(explain.tree_nodes(spark, fitted).select("node", "feature_name", "threshold", "rows", F.col("predicted_value").alias("prediction")), 3)


@register
def train_linear(spark, sf):
    """Least squares of price on key over all parts."""
    df = table(spark, sf, "part").select(F.col("p_partkey").cast("double").alias("p_partkey"), "p_retailprice")
    rows = df.count()
    fitted = train.fit_model(df, "p_retailprice", ["p_partkey"], "LinearRegression", "regression", rows)
    model = fitted.model
    return rounded(spark.createDataFrame([(rows, float(model.coefficients[0]), float(model.intercept))], "training_rows long, slope double, intercept double"), 4)


def _size_model(spark, sf) -> tuple[DataFrame, train.FittedModel]:
    df = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    fitted = train.fit_model(df.drop("p_partkey"), "p_retailprice", ["p_size"], "LinearRegression", "regression", df.count())
    return df, fitted


@register
def score_linear(spark, sf):
    """Predictions of the least-squares line of price on size, which SQL can compute."""
    df, fitted = _size_model(spark, sf)
    return rounded(fitted.predict(df, keep=["p_partkey"]), 3)


@register
def replay_linear(spark, sf):
    """The stored line measured on all parts after reloading it."""
    df, fitted = _size_model(spark, sf)
    path = f"{stage_dir(spark, 'models')}/{uuid.uuid4().hex}"
    sinks.save_model(spark, fitted, path)
    predicted = sinks.load_model(spark, path).predict(df, keep=["p_retailprice"])
    scores = evaluate.regression_metrics(predicted, "p_retailprice", "prediction")
    return rounded(scores.select(F.lit(fitted.name).alias("model_name"), F.lit("completed").alias("evaluation_status"), "r2", "rows"))


PART_INPUTS = ["p_partkey", "p_size"]


def _linear_parts(spark, sf, experiment_id: str) -> tuple[DataFrame, train.Experiment]:
    """Prices of all parts by key and size: the table with its sides, and an experiment with the least-squares plane."""
    side = F.when(F.col("p_partkey") % 5 == 0, "test").otherwise("train")
    ready = table(spark, sf, "part").select(side.alias(split.SPLIT), *[col(c).cast("double").alias(c) for c in PART_INPUTS], "p_retailprice")
    return ready, train.run_experiment(ready, "p_retailprice", "regression", experiment_id, ["LinearRegression"])


@register
def replay_stored_linear(spark, sf):
    """A stored plane measured again, twice: the log holds one copy of its evaluations and of the best model."""
    ready, experiment = _linear_parts(spark, sf, "007")
    folder = f"{stage_dir(spark, 'models')}/{uuid.uuid4().hex}"
    sinks.save_model(spark, experiment.models["LinearRegression"], f"{folder}/linear")
    for _ in range(2):
        replay.replay_stored(ready, "p_retailprice", experiment.results, {"LinearRegression": f"{folder}/linear"}, "regression", f"{folder}/log")
    best = replay.stored_best(spark, f"{folder}/log")
    return rounded(replay.read_evaluations(spark, f"{folder}/log").join(best, "experiment_id").select(
        "experiment_id", "model_name", "evaluation_status", "primary_metric", "r2", "rmse", (F.col("model_id") == F.col("best_model_id")).alias("is_best")), 4)


@register
def report_trained_importances(spark, sf):
    """What the report says about models that are fitted here: importances written per model, of the best one per experiment."""
    path = f"{stage_dir(spark, 'importances')}/{uuid.uuid4().hex}"
    side = F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train")
    lines = table(spark, sf, "lineitem").select(side.alias(split.SPLIT), "l_quantity", "l_discount", "l_extendedprice")
    experiments = [_linear_parts(spark, sf, "parts")[1], train.run_experiment(lines, "l_extendedprice", "regression", "lines", ["LinearRegression"])]
    for experiment in [*experiments, experiments[0]]:  # writing one again changes nothing
        explain.save_importances(spark, experiment, path)
    results = report.union_all([e.results for e in experiments]).withColumns({"primary_metric": F.lit("r2"), "primary_metric_value": F.col("r2")})
    models = report.experiment_models(evaluate.rank_models(results, "regression", by=["experiment_id"]))
    shares = explain.read_importances(spark, path).select("experiment_id", "feature_name", "normalized_importance", "rank")
    shown = report.experiment_importances(models, explain.read_importances(spark, path)).join(shares, ["experiment_id", "feature_name"])
    return rounded(shown.select("experiment_id", "model_name", F.col("position").cast("bigint").alias("position"), "feature_name", "importance_value",
                                "normalized_importance", F.col("rank").cast("bigint").alias("rank")), 4)


def _plane(spark, sf) -> tuple[DataFrame, prepare.Parameters, train.FittedModel]:
    """Parts as inputs, the parameters learned from them, and the least-squares plane over the scaled columns."""
    parts = table(spark, sf, "part").select(*PART_INPUTS, "p_retailprice")
    learned = prepare.fit(parts, "p_retailprice")
    ready = prepare.transform(parts, learned, keep=["p_retailprice"])
    fitted = train.fit_model(ready, "p_retailprice", learned.feature_names, "LinearRegression", "regression", parts.count())
    return parts.drop("p_retailprice"), learned, fitted


@register
def score_batch_linear(spark, sf):
    """All parts scored from raw inputs: checks, stored parameters, model."""
    inputs, learned, fitted = _plane(spark, sf)
    raw = inputs.withColumn("p_size", F.col("p_size").cast("string")).withColumn("part", F.col("p_partkey"))
    return rounded(score.score_batch(raw, learned, fitted, keep=["part"]), 3)


@register
def score_log_linear(spark, sf):
    """The same batch logged twice and another once: inputs and predictions as the log holds them."""
    inputs, learned, fitted = _plane(spark, sf)
    path = stage_dir(spark, f"prediction_log_{uuid.uuid4().hex}")
    for batch in ("0001", "12e3", "0001"):
        score.append_log(score.log_records(inputs, learned, fitted, "007", batch), path)
    return rounded(score.read_log(spark, path).select("experiment_id", "batch_id", "model_name", "model_type", "input_data", F.col("prediction").cast("double").alias("prediction")), 3)


@register
def explain_slopes(spark, sf):
    _, fitted = _size_model(spark, sf)
    return rounded(explain.feature_importance(spark, fitted).drop("rank"))


@register
def train_stump(spark, sf):
    """A regression tree of one level: the best split of price by quantity."""
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    rows = df.count()
    fitted = train.fit_model(df, "l_extendedprice", ["l_quantity"], "DecisionTreeRegressor", "regression", rows, max_depth=1)
    low, high = df.filter("l_quantity <= 1").limit(1), df.orderBy(F.desc("l_quantity")).limit(1)
    means = [fitted.predict(side, keep=["l_quantity"]).first()["prediction"] for side in (low, high)]
    root = fitted.model._java_obj.rootNode()
    row = (float(root.split().threshold()), float(means[0]), float(means[1]), rows)
    return spark.createDataFrame([row], "threshold double, left_mean double, right_mean double, rows long").transform(lambda d: rounded(d, 3))


@register
def train_tree_reg(spark, sf):
    facts, fitted, _ = _one_model(spark, _prepared_parts(spark, sf), "p_retailprice", "DecisionTreeRegressor")
    return rounded(facts.crossJoin(F.broadcast(_root_and_leaves(explain.tree_nodes(spark, fitted)))), 3)


@register
def train_forest_reg(spark, sf):
    facts, fitted, _ = _one_model(spark, _prepared_parts(spark, sf), "p_retailprice", "RandomForestRegressor")
    return facts.crossJoin(F.broadcast(_forest_facts(explain.tree_nodes(spark, fitted))))


@register
def train_all(spark, sf):
    """Three regressors on the prepared parts, ranked: every rank once, the best with the largest r2, all better than the mean."""
    experiment = train.run_experiment(_stored(spark, _prepared_parts(spark, sf)), "p_retailprice", "regression")
    ranked = evaluate.rank_models(experiment.results, "regression")
    most, first = ranked.agg(F.max("r2"), F.max(F.when(F.col("rank") == 1, F.col("r2")))).first()
    return ranked.select("model_name", "problem_type", "status", "training_rows", "validation_rows", "feature_count", (F.col("r2") > 0).alias("better_than_mean"),
                         F.lit(most == first).alias("best_leads"), F.lit(ranked.select("rank").distinct().count()).cast("bigint").alias("ranks"))


@register
def eval_replay(spark, sf):
    """Stored models measured again: reloaded, written back, and the same as after training."""
    ready = _stored(spark, _prepared_parts(spark, sf))
    experiment = train.run_experiment(ready, "p_retailprice", "regression", "replayed")
    folder, paths = f"{stage_dir(spark, 'models')}/{uuid.uuid4().hex}", {}
    for name, fitted in experiment.models.items():
        paths[name] = f"{folder}/{name}"
        sinks.save_model(spark, fitted, paths[name])
    again = replay.replay_stored(ready, "p_retailprice", experiment.results, paths, "regression", f"{folder}/evaluations")
    before = experiment.results.select("model_name", F.col("r2").alias("trained_r2"))
    same = F.abs(F.col("primary_metric_value") - F.col("trained_r2")) < 1e-9
    best = again.evaluations.filter("is_best").count()
    return again.evaluations.join(before, "model_name").select(
        "model_name", "evaluation_status", "primary_metric", same.alias("as_trained"), F.lit(best).cast("bigint").alias("best_models")
    )


def _scored_orders(spark, sf, name="LogisticRegression"):
    prepared = _prepared_orders(spark, sf)
    ready = _stored(spark, prepared)
    tr, _, names = train.split_scan(ready, TARGET)
    fitted = train.fit_model(tr, TARGET, names, name, "classification", prepared.split.train_rows)
    inputs = view(spark, sf, "orders_dirty").select(*prepared.parameters.input_columns)
    return prepared, fitted, inputs


@register
def score_batch(spark, sf):
    prepared, fitted, inputs = _scored_orders(spark, sf, "DecisionTreeClassifier")
    return score.score_batch(inputs, prepared.parameters, fitted, keep=["o_orderkey"])


@register
def score_type_check(spark, sf):
    return score.type_violations(view(spark, sf, "raw_inputs"), ["amount", "customer", "plain"])


@register
def score_log(spark, sf):
    prepared, fitted, inputs = _scored_orders(spark, sf)
    path = stage_dir(spark, f"prediction_log_{uuid.uuid4().hex}")
    score.append_log(score.log_records(inputs, prepared.parameters, fitted, "orders"), path)
    return spark.read.parquet(path).select("experiment_id", "model_name", "model_type", "input_data", "prediction")


@register
def score_history(spark, sf):
    return score.history(view(spark, sf, "runs").select("dataset_id", "run_id", "created_at", "stage"), ["dataset_id"], tie_break=["run_id"]).select(
        "dataset_id", "run_id", F.col("created_at").cast("string").alias("created_at"), "total"
    )


@register
def explain_tree_levels(spark, sf):
    """Importances of a tree of two levels over all order lines: impurity that each feature removes, as shares."""
    df = table(spark, sf, "lineitem").select("l_extendedprice", *LINE_FEATURES)
    fitted = train.fit_model(df, "l_extendedprice", LINE_FEATURES, "DecisionTreeRegressor", "regression", df.count(), max_depth=2)
    return rounded(explain.feature_importance(spark, fitted).drop("rank"), 4)


@register
def explain_tree(spark, sf):
    prepared = _prepared_parts(spark, sf)
    tr, _, names = train.split_scan(_stored(spark, prepared), "p_retailprice")
    fitted = train.fit_model(tr, "p_retailprice", names, "DecisionTreeRegressor", "regression", prepared.split.train_rows)
    return explain.feature_importance(spark, fitted)


@register
def explain_linear(spark, sf):
    _, fitted, _ = _scored_orders(spark, sf)
    return explain.feature_importance(spark, fitted)


# -- evaluation -------------------------------------------------------------


def _classified(spark, sf, metric) -> DataFrame:
    return rounded(evaluate.classification_metrics(view(spark, sf, "predictions")).select("rows", metric))


@register
def eval_accuracy(spark, sf):
    return _classified(spark, sf, "accuracy")


@register
def eval_precision(spark, sf):
    return _classified(spark, sf, "precision")


@register
def eval_recall(spark, sf):
    return _classified(spark, sf, "recall")


@register
def eval_f1(spark, sf):
    return _classified(spark, sf, "f1")


@register
def eval_confusion(spark, sf):
    return evaluate.confusion_matrix(view(spark, sf, "predictions"))


@register
def eval_regression(spark, sf):
    m = evaluate.regression_metrics(view(spark, sf, "predictions"), "y_true", "y_pred")
    return m.select("rows", *[F.round(c, 3).alias(c) for c in ("mae", "mse", "rmse")])


@register
def eval_r2(spark, sf):
    return rounded(evaluate.regression_metrics(view(spark, sf, "predictions"), "y_true", "y_pred", by=["label"]).select("label", "r2"))


@register
def eval_rank(spark, sf):
    models = view(spark, sf, "trained_models").filter("status = 'trained'")
    ranked = evaluate.rank_models(models, "classification", by=["experiment_id"], tie_break=["model_id"])
    return ranked.select("experiment_id", "model_id", "model_name", F.round("f1", 6).alias("f1"), F.col("rank").cast("bigint").alias("rank"))


@register
def eval_latest(spark, sf):
    newest = evaluate.latest_per_key(view(spark, sf, "model_evaluations"), ["model_id"], "created_at", ["evaluation_id"])
    return newest.select("model_id", "evaluation_id", "evaluation_status")


@register
def eval_compare(spark, sf):
    ranked = evaluate.compare_models(
        view(spark, sf, "trained_models").drop("created_at"), view(spark, sf, "model_evaluations"), "classification", by=["experiment_id"],
        stored_best=view(spark, sf, "stored_best"),
    )
    return rounded(ranked.select(
        "experiment_id", "model_id", "model_name", "status", "evaluation_status", F.col("rank").cast("bigint").alias("rank"), "primary_metric_value", "is_best"
    ))


# -- reports and run log ----------------------------------------------------


def _dataset_report(spark, sf) -> DataFrame:
    v = lambda name: view(spark, sf, name)
    return report.dataset_report(v("dataset_sizes"), v("dataset_quality"), v("dataset_cleaning"), v("dataset_features"))


@register
def report_dataset(spark, sf):
    return rounded(_dataset_report(spark, sf))


@register
def report_findings(spark, sf):
    return report.dataset_findings(_dataset_report(spark, sf))


@register
def report_recommendations(spark, sf):
    return report.dataset_recommendations(_dataset_report(spark, sf))


@register
def report_newest(spark, sf):
    """Preparation and last experiment of each dataset, the newest run of several."""
    v = lambda name: view(spark, sf, name)
    return rounded(report.dataset_report(v("dataset_sizes"), preparation=v("dataset_preparation"), experiments=v("dataset_experiments")))


def _ranked_models(spark, sf) -> DataFrame:
    # failed models count, but have no metrics
    known = F.col("status") == "trained"
    models = view(spark, sf, "trained_models").withColumns({c: F.when(known, F.col(c)) for c in ("f1", "accuracy")})
    ranked = evaluate.rank_models(models, "classification", by=["experiment_id"], tie_break=["model_id"])
    return ranked.select("*", F.lit("f1").alias("primary_metric"), F.col("f1").alias("primary_metric_value"))


@register
def report_experiment_models(spark, sf):
    return rounded(report.experiment_models(_ranked_models(spark, sf)).withColumn("rank", F.col("rank").cast("bigint")))


@register
def report_experiment_importances(spark, sf):
    models = report.experiment_models(_ranked_models(spark, sf))
    return rounded(report.experiment_importances(models, view(spark, sf, "model_importances"), top=2).withColumn("position", F.col("position").cast("bigint")))


def _experiment_report(spark, sf) -> DataFrame:
    ranked = _ranked_models(spark, sf)
    experiments = table(spark, sf, "orders").select(F.col("o_orderkey").alias("experiment_id"), F.col("o_custkey").alias("dataset_id"))
    return report.experiment_report(experiments, ranked, view(spark, sf, "dataset_sizes"))


@register
def report_experiment(spark, sf):
    r = _experiment_report(spark, sf)
    return rounded(r.select("experiment_id", "dataset_id", "models_trained", "best_model_name", "best_feature_count", "best_score", "total_rows"))


@register
def report_experiment_findings(spark, sf):
    return report.experiment_findings(_experiment_report(spark, sf))


@register
def report_experiment_recommendations(spark, sf):
    return report.experiment_recommendations(_experiment_report(spark, sf))


@register
def log_latest(spark, sf):
    newest = runlog.latest_artifact(view(spark, sf, "runs"), ["dataset_id", "stage"], "created_at", ["run_id"])
    return rounded(newest.select("dataset_id", "stage", "run_id", "created_at"))


@register
def log_fallback(spark, sf):
    return runlog.stage_source(view(spark, sf, "runs"), "dataset_id", "stage", "created_at", "run_id", ["purchase", "signup", "view"])


@register
def log_history(spark, sf):
    placed = runlog.history(view(spark, sf, "runs"), ["dataset_id"], "created_at", ["run_id"])
    return placed.select("dataset_id", "run_id", "position", "total")
