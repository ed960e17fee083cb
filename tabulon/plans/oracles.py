"""Checking SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

from tabulon.plans.views import with_views

BLANK = r"regexp_matches({c}, '^[\s\p{{Z}}\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}]*$')"
SPACE = r"\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}"

# (column, class) of the inputs the statistics are checked on
LINEITEM = [
    ("l_orderkey", "numerical"), ("l_partkey", "numerical"), ("l_suppkey", "numerical"), ("l_linenumber", "numerical"),
    ("l_quantity", "numerical"), ("l_extendedprice", "numerical"), ("l_discount", "numerical"), ("l_tax", "numerical"),
    ("l_returnflag", "categorical"), ("l_linestatus", "categorical"), ("l_shipdate", "datetime"),
]
ORDERS_DIRTY = [
    ("o_orderkey", "numerical"), ("o_custkey", "numerical"), ("o_totalprice", "numerical"), ("o_orderpriority", "categorical"),
    ("o_orderdate", "datetime"), ("o_orderstatus", "categorical"), ("is_big", "boolean"), ("near_const", "categorical"),
    ("const_col", "categorical"), ("mostly_missing", "numerical"), ("all_null", "numerical"),
]
# The recommendation per issue type.
RECOMMENDATION_TEXTS = {
    "missing_values": "Consider imputing or removing missing values depending on the column's role and missingness rate.",
    "duplicate_rows": "Review duplicate records and remove them if they represent repeated observations.",
    "constant_column": "Consider removing this column because it contains no useful variation.",
    "near_constant_column": "Consider whether the slight variation in this column is meaningful or if it can be dropped.",
    "numeric_outliers": "Review extreme values and determine whether they are legitimate observations or potential data-entry errors.",
    "high_cardinality": "Consider grouping infrequent categories or applying target encoding for predictive modeling.",
    "suspicious_values": "Investigate anomalous values (e.g. negative prices, empty strings) as they likely indicate data entry errors.",
    "potential_identifier": "Review whether this column should be excluded from model training because it may uniquely identify records.",
    "empty_dataset": "Upload a valid dataset with data.",
}
QUALITY_INPUTS = {
    "orders_dirty": ORDERS_DIRTY,
    "customer_balance": [("c_custkey", "numerical"), ("c_name", "categorical"), ("balance", "numerical"), ("c_mktsegment", "categorical")],
    "document_quality": [("doc_id", "numerical"), ("text", "categorical"), ("lang", "categorical"), ("source", "categorical"), ("n_chars", "numerical")],
    "order_flags": [("o_orderstatus", "categorical"), ("o_orderpriority", "categorical")],
}
NUMERIC_LINES = [c for c, k in LINEITEM if k == "numerical"]


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def per_column(template: str, columns, source: str) -> str:
    return union(template.format(c=c, kind=k, source=source) for c, k in columns)


# -- profile ----------------------------------------------------------------

TYPE_CASE = (
    "CASE WHEN any_value(typeof({c})) IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') THEN 'numerical' "
    "WHEN any_value(typeof({c})) IN ('DATE', 'TIMESTAMP') THEN 'datetime' WHEN any_value(typeof({c})) = 'BOOLEAN' THEN 'boolean' ELSE 'categorical' END"
)
QUANTILES = (
    "SELECT '{c}' AS column_name, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, "
    "round(quantile_cont({c}, 0.75), 6) AS q3, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr FROM {source}"
)
NUMBERS = (
    "SELECT '{c}' AS column_name, round(CAST(min({c}) AS DOUBLE), 3) AS min_value, round(CAST(max({c}) AS DOUBLE), 3) AS max_value, "
    "round(avg({c}), 3) AS mean, round(quantile_cont({c}, 0.5), 3) AS median, round(stddev_samp({c}), 3) AS stddev, round(var_samp({c}), 3) AS variance FROM {source}"
)
OUTLIERS = (
    "SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outlier_count, "
    "round(count(*) FILTER (WHERE {c} < lo OR {c} > hi) * 100.0 / count(*), 6) AS outlier_percentage, round(min(lo), 6) AS lower_bound, round(min(hi), 6) AS upper_bound "
    "FROM {source}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}))"
)


def top_values(table: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, rank, value, n, round(n * 100.0 / (SELECT count(*) FROM {table}), 6) AS percentage FROM "
        f"(SELECT {c} AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10"
    )


def profile_sql() -> dict[str, str]:
    dates = "SELECT '{c}' AS column_name, CAST(min({c}) AS VARCHAR) AS min_date, CAST(max({c}) AS VARCHAR) AS max_date FROM {source}"
    lines_full = union(
        f"SELECT '{c}' AS column_name, '{k}' AS data_type, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, "
        + (f"round(quantile_cont({c}, 0.5), 3)" if k == "numerical" else "CAST(NULL AS DOUBLE)") + " AS median, "
        + (f"round(avg({c}), 3)" if k == "numerical" else "CAST(NULL AS DOUBLE)") + " AS mean, "
        + (f"(SELECT outlier_count FROM ({OUTLIERS.format(c=c, source='lineitem')}))" if k == "numerical" else "CAST(NULL AS BIGINT)") + " AS outlier_count, "
        + (f"CAST(min({c}) AS VARCHAR)" if k == "datetime" else "CAST(NULL AS VARCHAR)") + " AS min_date, "
        + (f"(SELECT value FROM ({top_values('lineitem', c)}) WHERE rank = 1)" if k == "categorical" else "CAST(NULL AS VARCHAR)") + " AS top_value FROM lineitem"
        for c, k in LINEITEM
    )
    kinds = [k for _, k in LINEITEM]
    return {
        "profile_table": f"""
            SELECT count(*) AS row_count, CAST({len(kinds)} AS BIGINT) AS column_count,
                   count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_row_count,
                   round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem))) * 100.0 / count(*), 6) AS duplicate_row_percentage,
                   CAST({' + '.join(f'count(*) - count({c})' for c, _ in LINEITEM)} AS BIGINT) AS missing_cells,
                   CAST({kinds.count('numerical')} AS BIGINT) AS numerical_columns, CAST({kinds.count('categorical')} AS BIGINT) AS categorical_columns,
                   CAST({kinds.count('datetime')} AS BIGINT) AS datetime_columns, CAST({kinds.count('boolean')} AS BIGINT) AS boolean_columns
            FROM lineitem""",
        "profile_types": with_views(per_column("SELECT '{c}' AS column_name, " + TYPE_CASE + " AS data_type, count({c}) AS non_null_count FROM {source}", [(c, k) for c, k in ORDERS_DIRTY if c != "all_null"], "v_orders_dirty")
                                    + "\nUNION ALL SELECT 'all_null', 'numerical', count(all_null) FROM v_orders_dirty", "orders_dirty"),
        "profile_bytes": union(
            f"SELECT '{c}' AS column_name, CAST(" + ("count(*) * 4" if c == "l_linenumber" else f"sum(strlen({c}))" if k == "categorical" else "count(*) * 8") + " AS BIGINT) AS memory_bytes FROM lineitem"
            for c, k in LINEITEM
        ),
        "profile_nulls": with_views(per_column(
            "SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, count({c}) AS non_null_count, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_percentage FROM {source}",
            ORDERS_DIRTY, "v_orders_dirty"), "orders_dirty"),
        "profile_missing_total": with_views(
            "SELECT CAST(sum(n) AS BIGINT) AS missing_cells FROM (" + per_column("SELECT count(*) - count({c}) AS n FROM {source}", ORDERS_DIRTY, "v_orders_dirty") + ")", "orders_dirty"),
        "profile_distinct": with_views(per_column(
            "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) * 100.0 / count(*), 6) AS unique_percentage FROM {source}",
            ORDERS_DIRTY, "v_orders_dirty"), "orders_dirty"),
        "profile_duplicates": with_views(union(
            f"SELECT '{n}' AS table_name, count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT * FROM v_{n})) AS distinct_count, "
            f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v_{n})) AS duplicate_count, "
            f"round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v_{n}))) * 100.0 / count(*), 6) AS duplicate_percentage FROM v_{n}"
            for n in ("order_flags", "document_texts")), "order_flags", "document_texts"),
        "profile_quantiles": union([QUANTILES.format(c=c, source="lineitem") for c in NUMERIC_LINES] + [QUANTILES.format(c="value", source="events")]),
        "profile_numeric": union(NUMBERS.format(c=c, source="lineitem") for c in NUMERIC_LINES),
        "profile_outliers": union([OUTLIERS.format(c=c, source="lineitem") for c in NUMERIC_LINES] + [OUTLIERS.format(c="value", source="events")]),
        "profile_top_values": union([top_values("events", c) for c in ("event_type", "props")] + [top_values("part", c) for c in ("p_brand", "p_type", "p_name")]),
        "profile_datetime": with_views(union([dates.format(c="ts", source="events"), dates.format(c="o_orderdate", source="v_orders_dirty")]), "orders_dirty"),
        "profile_safe_float": "SELECT event_id, round(CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END, 6) AS safe_value FROM events",
        "profile_columns": lines_full,
    }


# -- quality ----------------------------------------------------------------


def column_facts() -> str:
    """One row of statistics per column of every quality input."""
    parts = []
    for table, columns in QUALITY_INPUTS.items():
        v = f"v_{table}"
        for i, (c, k) in enumerate(columns):
            number = k == "numerical"
            quart = f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {v})"
            parts.append(
                f"SELECT '{table}' AS table_name, {i} AS position, '{c}' AS column_name, '{k}' AS kind, count(*) AS n_rows, count({c}) AS filled, "
                f"(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {v})) FROM {v}) AS duplicates, "
                f"count(DISTINCT {c}) AS uniques, (SELECT max(n) FROM (SELECT count(*) AS n FROM {v} WHERE {c} IS NOT NULL GROUP BY {c})) AS top_n, "
                + (f"(SELECT q3 - q1 FROM {quart})" if number else "CAST(NULL AS DOUBLE)") + " AS iqr, "
                + (f"(SELECT count(*) FROM {v}, {quart} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))" if number else "0") + " AS outliers, "
                + (f"count(*) FILTER (WHERE {c} < 0)" if number else "0") + " AS negatives, "
                + (f"count(*) FILTER (WHERE {BLANK.format(c=c)})" if k == "categorical" else "0") + f" AS blanks FROM {v}"
            )
    return union(parts)


ISSUES = """
facts AS (%s),
pct AS (SELECT *, (n_rows - filled) * 100.0 / n_rows AS missing_pct, duplicates * 100.0 / n_rows AS dup_pct,
               outliers * 100.0 / n_rows AS outlier_pct, top_n * 1.0 / nullif(filled, 0) AS top_share FROM facts),
issues AS (
  SELECT table_name, -1 AS ord, 'duplicate_rows' AS issue_type, CASE WHEN dup_pct > 20 THEN 'high' WHEN dup_pct > 5 THEN 'medium' ELSE 'low' END AS severity,
         CAST(NULL AS VARCHAR) AS column_name, CAST(dup_pct AS DOUBLE) AS metric_value,
         printf('Dataset has %%d duplicate rows (%%.2f%%%%).', duplicates, dup_pct) AS description FROM pct WHERE position = 0 AND duplicates > 0
  UNION ALL SELECT table_name, position * 10 + 1, 'missing_values', CASE WHEN missing_pct > 20 THEN 'high' WHEN missing_pct > 5 THEN 'medium' ELSE 'low' END, column_name,
         CAST(missing_pct AS DOUBLE), printf('Column has %%d missing values (%%.2f%%%%).', n_rows - filled, missing_pct) FROM pct WHERE filled < n_rows
  UNION ALL SELECT table_name, position * 10 + 2, 'constant_column', 'high', column_name, 1.0, 'Column has only 1 unique value.' FROM pct WHERE uniques = 1
  UNION ALL SELECT table_name, position * 10 + 2, 'near_constant_column', 'medium', column_name, CAST(top_share AS DOUBLE), 'Column is near-constant (>99%% same value).' FROM pct WHERE uniques > 1 AND top_share > 0.99
  UNION ALL SELECT table_name, position * 10 + 3, 'numeric_outliers', CASE WHEN outlier_pct > 10 THEN 'high' WHEN outlier_pct > 5 THEN 'medium' ELSE 'low' END, column_name,
         CAST(outlier_pct AS DOUBLE), printf('Column has %%d IQR outliers (%%.2f%%%%).', outliers, outlier_pct) FROM pct WHERE iqr > 0 AND outliers > 0
  UNION ALL SELECT table_name, position * 10 + 4, 'suspicious_values', 'high', column_name, CAST(negatives AS DOUBLE), printf('Found %%d negative values in a likely quantity column.', negatives)
         FROM pct WHERE negatives > 0 AND regexp_matches(lower(column_name), 'qty|quantity|amount|count|price|balance')
  UNION ALL SELECT table_name, position * 10 + 5, 'high_cardinality', 'low', column_name, CAST(uniques AS DOUBLE), printf('Categorical column has very high cardinality (%%d unique).', uniques)
         FROM pct WHERE kind = 'categorical' AND uniques > 10 AND uniques * 1.0 / filled > 0.5
  UNION ALL SELECT table_name, position * 10 + 6, 'suspicious_values', 'medium', column_name, CAST(blanks AS DOUBLE), printf('Found %%d empty or whitespace-only strings.', blanks) FROM pct WHERE blanks > 0
  UNION ALL SELECT table_name, position * 10 + 7, 'potential_identifier', 'low', column_name, CAST(uniques AS DOUBLE),
         'Column appears to be an identifier (name contains ''id''/''uuid'' or is a fully unique string column).'
         FROM pct WHERE filled > 0 AND (contains(lower(column_name), 'id') OR (kind = 'categorical' AND uniques = filled AND uniques > 1))
)
"""


def quality_query(select: str) -> str:
    return with_views("WITH " + ISSUES % column_facts() + select, *QUALITY_INPUTS)


def quality_sql() -> dict[str, str]:
    plain = "SELECT table_name, issue_type, severity, column_name, round(metric_value, 6) AS metric_value FROM issues WHERE "
    texts = union("SELECT '{}' AS issue_type, '{}' AS recommendation_text".format(k, v.replace("'", "''")) for k, v in RECOMMENDATION_TEXTS.items())
    score = "greatest(0, 100 - coalesce(sum(CASE severity WHEN 'high' THEN 5 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END), 0))"

    def found(*kinds):
        names = ", ".join(f"'{k}'" for k in kinds)
        return f"(SELECT count(*) FROM issues WHERE issues.table_name = t.table_name AND issue_type IN ({names}))"

    return {
        "quality_duplicates": quality_query(plain + "issue_type = 'duplicate_rows'"),
        "quality_missing": quality_query(plain + "issue_type = 'missing_values'"),
        "quality_constant": quality_query(plain + "issue_type IN ('constant_column', 'near_constant_column')"),
        "quality_outliers": quality_query(plain + "issue_type = 'numeric_outliers'"),
        "quality_negatives": quality_query(plain + "issue_type = 'suspicious_values' AND severity = 'high'"),
        "quality_cardinality": quality_query(plain + "issue_type = 'high_cardinality'"),
        "quality_blank_strings": quality_query(plain + "issue_type = 'suspicious_values' AND severity = 'medium'"),
        "quality_identifiers": quality_query(plain + "issue_type = 'potential_identifier'"),
        "quality_issues": quality_query("SELECT table_name, issue_type, severity, column_name, round(metric_value, 6) AS metric_value, description FROM issues"),
        "quality_score": quality_query(
            f"SELECT table_name, CAST(score AS INTEGER) AS quality_score, CASE WHEN score >= 80 THEN 'Good' WHEN score >= 50 THEN 'Needs attention' ELSE 'Poor' END AS quality_band "
            f"FROM (SELECT t.table_name, {score} AS score FROM (SELECT DISTINCT table_name FROM facts) AS t LEFT JOIN issues USING (table_name) GROUP BY t.table_name)"),
        "quality_empty": "SELECT unnest(['orders', 'documents']) AS table_name, 'empty_dataset' AS issue_type, 'high' AS severity, CAST(NULL AS VARCHAR) AS column_name, 0 AS quality_score, "
            f"'Poor' AS quality_band, 100.0::DOUBLE AS missing_percentage, '{RECOMMENDATION_TEXTS['empty_dataset']}' AS recommendation_text",
        "quality_recommendations": quality_query(f"SELECT DISTINCT table_name, issue_type, recommendation_text FROM issues JOIN ({texts}) AS r USING (issue_type)"),
        "quality_summary": quality_query(
            "SELECT t.table_name, round(sum(n_rows - filled) * 100.0 / sum(n_rows), 6) AS missing_percentage, round(max(dup_pct), 6) AS duplicate_percentage, "
            f"{found('constant_column', 'near_constant_column')} AS constant_columns, {found('high_cardinality')} AS high_cardinality_columns, "
            f"{found('numeric_outliers')} AS outlier_columns, {found('suspicious_values')} AS suspicious_columns, {found('potential_identifier')} AS potential_identifiers "
            "FROM pct AS t GROUP BY t.table_name"),
        "quality_by_severity": quality_query("SELECT table_name, severity, count(*) AS issue_count FROM issues GROUP BY table_name, severity"),
    }


# -- cleaning ---------------------------------------------------------------

FOLDED = f"CASE WHEN {BLANK.format(c='o_orderpriority')} THEN NULL ELSE o_orderpriority END"


def mode_of(c: str, source: str) -> str:
    return f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def cleaning_sql() -> dict[str, str]:
    folded = f"folded AS (SELECT * REPLACE ({FOLDED} AS o_orderpriority) FROM v_orders_dirty)"
    categories = f"folded AS (SELECT * REPLACE ({FOLDED} AS o_orderpriority) FROM v_orders_categories)"
    filled = (
        "filled AS (SELECT " + ", ".join(f"coalesce({c}, {mode_of(c, 'folded')}) AS {c}" for c in ("o_orderpriority", "o_orderstatus", "is_big"))
        + ", round(coalesce(bucket, (SELECT median(bucket) FROM folded)), 6) AS bucket FROM folded)"
    )
    gaps = " + ".join(f"(count(*) - count({c}))" for c in ("o_orderpriority", "o_orderstatus", "is_big", "bucket"))
    dropped = "(SELECT count(*) FROM filled) - (SELECT count(*) FROM (SELECT DISTINCT * FROM filled))"
    return {
        "clean_blank_to_null": with_views(f"SELECT o_orderkey, {FOLDED} AS o_orderpriority, near_const FROM v_orders_dirty", "orders_dirty"),
        "clean_median_impute": with_views(
            "SELECT o_orderkey, " + ", ".join(f"round(coalesce({c}, (SELECT median({c}) FROM v_orders_dirty)), 6) AS {c}" for c in ("o_totalprice", "mostly_missing")) + " FROM v_orders_dirty", "orders_dirty"),
        "clean_mode_impute": with_views(
            f"WITH {folded} SELECT o_orderkey, coalesce(o_orderpriority, {mode_of('o_orderpriority', 'folded')}) AS o_orderpriority, "
            f"CAST(coalesce(o_orderdate, {mode_of('o_orderdate', 'folded')}) AS VARCHAR) AS o_orderdate, coalesce(o_orderstatus, {mode_of('o_orderstatus', 'folded')}) AS o_orderstatus, "
            f"coalesce(is_big, {mode_of('is_big', 'folded')}) AS is_big FROM folded", "orders_dirty"),
        "clean_unresolved": with_views(
            f"WITH {folded} SELECT * FROM (" + union(f"SELECT 'missing_values_unresolved' AS operation, '{c}' AS column_name, count(*) - count({c}) AS affected_rows FROM folded HAVING count({c}) = 0" for c, _ in ORDERS_DIRTY) + ")", "orders_dirty"),
        "clean_missing_total": with_views(
            f"WITH {folded} SELECT CAST(sum(n) AS BIGINT) AS missing_values_handled FROM (" + union(f"SELECT CASE WHEN count({c}) > 0 THEN count(*) - count({c}) ELSE 0 END AS n FROM folded" for c, _ in ORDERS_DIRTY) + ")", "orders_dirty"),
        "clean_dedupe": "SELECT DISTINCT o_orderstatus || '|' || o_orderpriority AS row_text FROM orders UNION ALL SELECT DISTINCT text FROM documents",
        "clean_table": with_views(f"WITH {categories}, {filled} SELECT DISTINCT * FROM filled", "orders_categories"),
        "clean_stats": with_views(
            f"WITH {categories}, {filled} SELECT count(*) AS rows_before, count(*) - ({dropped}) AS rows_after, CAST(4 AS BIGINT) AS columns_before, CAST(4 AS BIGINT) AS columns_after, "
            f"CAST({gaps} AS BIGINT) AS missing_values_handled, {dropped} AS duplicates_removed FROM folded", "orders_categories"),
        "clean_log": with_views(
            f"WITH {categories}, {filled} SELECT 'empty_string_as_missing' AS operation, 'o_orderpriority' AS column_name, count(*) AS affected_rows, 'treat_as_missing' AS strategy FROM v_orders_categories WHERE {BLANK.format(c='o_orderpriority')} "
            + "".join(f"UNION ALL SELECT 'mode_imputation', '{c}', count(*) - count({c}), 'mode' FROM folded " for c in ("o_orderpriority", "o_orderstatus", "is_big"))
            + "UNION ALL SELECT 'median_imputation', 'bucket', count(*) - count(bucket), 'median' FROM folded "
            + f"UNION ALL SELECT 'duplicate_removal', NULL, {dropped}, 'keep_first'", "orders_categories"),
    }


# -- features ---------------------------------------------------------------


def greedy_walk(columns: list[str], source: str, others: list[str], before: str = "", least: str = "-1") -> str:
    """Selection by correlation as a recursion over the pairs in column order; columns of less variance than ``least`` are gone before.

    Ends in ``left_over``: what is kept, and ``gone``: what the walk removed.
    """
    pairs, k = [], 0
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            pairs.append(
                f"SELECT {k} AS k, '{a}' AS a, '{b}' AS b, {'true' if b == columns[i + 1] else 'false'} AS opens, "
                f"coalesce(abs(corr({a}, {b})) > 0.95 AND var_samp({a}) >= {least} AND var_samp({b}) >= {least}, false) AS near, "
                f"CASE WHEN var_samp({a}) >= var_samp({b}) THEN '{b}' ELSE '{a}' END AS loser FROM {source}"
            )
            k += 1
    kept = union([f"SELECT '{c}' AS column_name FROM {source} HAVING coalesce(var_samp({c}), 0) >= {least}" for c in columns] + [f"SELECT '{c}'" for c in others])
    return f"""WITH RECURSIVE {before} pairs AS ({union(pairs)}),
        walk AS (SELECT -1 AS k, CAST([] AS VARCHAR[]) AS gone, true AS active
                 UNION ALL
                 SELECT k, CASE WHEN active AND near AND NOT list_contains(gone, b) THEN list_append(gone, loser) ELSE gone END, active
                 FROM (SELECT p.k, p.b, p.near, p.loser, w.gone, CASE WHEN p.opens THEN NOT list_contains(w.gone, p.a) ELSE w.active END AS active
                       FROM walk AS w JOIN pairs AS p ON p.k = w.k + 1)),
        gone AS (SELECT list_distinct(gone) AS gone FROM walk ORDER BY k DESC LIMIT 1),
        left_over AS (SELECT column_name FROM ({kept}), gone WHERE NOT list_contains(gone, column_name))
    """


# the documents with all their derived columns, and the numeric ones in column order
ENGINEERED_NUMBERS = ["doc_id", "n_chars", *[f"text_{x}" for x in ("word_count", "char_count", "avg_word_length", "uppercase_count", "lowercase_count", "punctuation_count")],
                      *[f"{c}_{x}" for c in ("doc_id", "n_chars") for x in ("squared", "cubed", "log", "sqrt")], "lang_freq", "lang_label", "source_freq", "source_label"]


def engineered() -> str:
    tokens = f"list_filter(regexp_split_to_array(coalesce(text, ''), '[{SPACE}]+'), lambda w: w <> '')"
    strip = lambda kept: f"length(regexp_replace(coalesce(text, ''), '{kept}', '', 'g'))"
    numbers = ", ".join(
        f"CAST({c} AS DOUBLE) * {c} AS {c}_squared, CAST({c} AS DOUBLE) * {c} * {c} AS {c}_cubed, ln(1 + greatest(coalesce({c}, 0), 0)) AS {c}_log, "
        f"sqrt(greatest(coalesce({c}, 0), 0)) AS {c}_sqrt" for c in ("doc_id", "n_chars"))
    codes = ", ".join(f"coalesce({c}_codes.freq, 0) AS {c}_freq, coalesce({c}_codes.label, -1) AS {c}_label" for c in ("lang", "source"))
    tables = ", ".join(f"{c}_codes AS (SELECT {c} AS value, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS freq, row_number() OVER (ORDER BY {c}) - 1 AS label "
                       f"FROM documents WHERE {c} IS NOT NULL GROUP BY {c})" for c in ("lang", "source"))
    marks = rf"[\p{{L}}\p{{N}}_{SPACE}]"
    return f"""{tables}, derived AS MATERIALIZED (
        SELECT doc_id, text, lang, source, n_chars, len({tokens}) AS text_word_count, length(coalesce(text, '')) AS text_char_count,
               coalesce(list_avg(list_transform({tokens}, lambda w: length(w))), 0.0) AS text_avg_word_length,
               {strip('[^A-Z]')} AS text_uppercase_count, {strip('[^a-z]')} AS text_lowercase_count, {strip(marks)} AS text_punctuation_count,
               {numbers}, {codes}
        FROM documents LEFT JOIN lang_codes ON lang = lang_codes.value LEFT JOIN source_codes ON source = source_codes.value),"""


def features_sql() -> dict[str, str]:
    rate = "count(CASE WHEN regexp_matches({c}, '^\\s*\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({c} AS TIMESTAMP) END) * 1.0 / count({c})"
    share = "count(DISTINCT {c}) * 1.0 / count({c})"
    kind = "CASE WHEN " + rate + " >= 0.8 THEN 'datetime' WHEN count(DISTINCT {c}) <= 1 OR " + share + " <= 0.5 THEN 'categorical' ELSE 'text' END"
    part_pairs = ["p_partkey", "p_retailprice", "p_size"]
    squares = sorted(["p_partkey", "p_size", "p_retailprice", "p_size_sq", "p_retail_twice", "flat", "sparse"])
    pairs = [(a, b) for i, a in enumerate(squares) for b in squares[i + 1 :]]
    r = "CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"
    chars = f"[{SPACE}]+"
    number = (
        "SELECT {id} AS row_id, '{src}' AS source, {c} * {c} AS x_squared, {c} * {c} * {c} AS x_cubed, "
        "round(ln(1 + greatest(coalesce({c}, 0), 0)), 6) AS x_log, round(sqrt(greatest(coalesce({c}, 0), 0)), 6) AS x_sqrt FROM {t}"
    )
    kept_squares = ["p_partkey", "p_size", "p_retailprice", "p_size_sq", "p_retail_twice", "flat", "sparse", "p_brand"]
    interaction = ", ".join(
        f"round({a} * {b}, 6) AS {a}_x_{b}, round(coalesce({a} / nullif({b}, 0), 0), 6) AS {a}_div_{b}" for a, b in [("CAST(p_partkey AS DOUBLE)", "p_retailprice")]
    ).replace("AS CAST(p_partkey AS DOUBLE)", "AS p_partkey")
    return {
        "fe_detect_datetime": with_views(union(
            f"SELECT '{c}' AS column_name, round({rate.format(c=c)}, 6) AS parse_rate, {rate.format(c=c)} >= 0.8 AS is_datetime FROM v_event_texts" for c in ("ts_text", "event_type", "props", "id_text")), "event_texts"),
        "fe_detect_categorical": union(
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, count({c}) AS non_null_count, (count(DISTINCT {c}) <= 1 OR {share.format(c=c)} <= 0.5) AS is_categorical FROM {t}"
            for t, cs in (("part", ("p_name", "p_brand", "p_type")), ("documents", ("text", "lang", "source"))) for c in cs),
        "fe_classify": with_views(union(
            [f"SELECT '{c}' AS column_name, {kind.format(c=c)} AS feature_class FROM v_event_texts" for c in ("ts_text", "event_type", "props", "id_text")]
            + [f"SELECT '{c}' AS column_name, {kind.format(c=c)} AS feature_class FROM part" for c in ("p_name", "p_brand", "p_type")]
            + [f"SELECT '{c}' AS column_name, {kind.format(c=c)} AS feature_class FROM v_orders_dirty" for c in ("near_const",)]
            + [f"SELECT '{c}', CASE WHEN count({c}) >= 0 THEN 'numeric' END FROM part" for c in ("p_partkey", "p_size", "p_retailprice")]
            + [f"SELECT '{c}', 'numeric' FROM events HAVING count({c}) >= 0" for c in ("event_id", "value")]
            + ["SELECT 'is_big', 'other' FROM v_orders_dirty HAVING count(is_big) >= 0", "SELECT 'o_orderdate', 'datetime' FROM v_orders_dirty HAVING count(o_orderdate) >= 0"]), "event_texts", "orders_dirty"),
        "fe_datetime": "SELECT event_id, year(ts) AS ts_year, month(ts) AS ts_month, day(ts) AS ts_day, isodow(ts) - 1 AS ts_day_of_week, quarter(ts) AS ts_quarter, "
                       "CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS ts_is_weekend FROM events",
        "fe_days_since_min": "SELECT event_id, CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 86400000000) AS BIGINT) AS ts_days_since_reference FROM events",
        "fe_text": f"""
            SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{chars}'), lambda w: w <> '')) AS BIGINT) AS text_word_count, length(text) AS text_char_count,
                   CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS text_uppercase_count, CAST(length(regexp_replace(text, '[^a-z]', '', 'g')) AS BIGINT) AS text_lowercase_count,
                   CAST(length(regexp_replace(text, '[\\p{{L}}\\p{{N}}_{SPACE}]', '', 'g')) AS BIGINT) AS text_punctuation_count,
                   round(coalesce(list_avg(list_transform(list_filter(regexp_split_to_array(text, '{chars}'), lambda w: w <> ''), lambda w: length(w))), 0.0), 6) AS text_avg_word_length
            FROM documents""",
        "fe_numeric": with_views(union([number.format(id="o_orderkey", src="orders", c="o_totalprice", t="v_orders_dirty"), number.format(id="c_custkey", src="customer", c="c_acctbal", t="customer")]), "orders_dirty"),
        "fe_corr_pairs": with_views(
            "SELECT column_a, column_b, round(corr, 6) AS corr FROM (" + union(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r.format(a=a, b=b)} AS corr FROM v_part_squares" for a, b in pairs) + ") WHERE abs(corr) >= 0.3", "part_squares"),
        "fe_interactions": f"SELECT p_partkey, {interaction} FROM part",
        "fe_freq_encode": with_views(
            "SELECT o_orderkey, round(coalesce(n * 1.0 / (SELECT count(o_orderpriority) FROM v_orders_dirty), 0.0), 6) AS o_orderpriority_freq FROM v_orders_dirty "
            "LEFT JOIN (SELECT o_orderpriority, count(*) AS n FROM v_orders_dirty GROUP BY o_orderpriority) USING (o_orderpriority)", "orders_dirty"),
        "fe_label_encode": with_views(
            "SELECT o_orderkey, coalesce(label, -1) AS o_orderpriority_label FROM v_orders_dirty LEFT JOIN "
            "(SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS label FROM (SELECT DISTINCT o_orderpriority FROM v_orders_dirty WHERE o_orderpriority IS NOT NULL)) USING (o_orderpriority)", "orders_dirty"),
        "fe_select_missing": with_views("SELECT * FROM (" + per_column("SELECT '{c}' AS column_name, count({c}) AS value_count FROM {source} HAVING (count(*) - count({c})) * 1.0 / count(*) <= 0.5", ORDERS_DIRTY, "v_orders_dirty") + ")", "orders_dirty"),
        "fe_select_variance": with_views(
            "SELECT * FROM (" + union(f"SELECT '{c}' AS column_name, count({c}) AS value_count FROM v_part_squares" + (f" HAVING NOT coalesce(var_samp({c}) < 0.01, false)" if c != "p_brand" else "") for c in kept_squares) + ")", "part_squares"),
        "fe_select_correlation": with_views(
            greedy_walk(["p_partkey", "p_size", "p_retailprice", "p_size_sq", "p_retail_twice"], "v_part_squares", ["p_brand"])
            + "SELECT column_name, value_count FROM left_over JOIN (" + union(f"SELECT '{c}' AS column_name, count({c}) AS value_count FROM v_part_squares" for c in
              ("p_partkey", "p_size", "p_retailprice", "p_size_sq", "p_retail_twice", "p_brand")) + ") USING (column_name)", "part_squares"),
        "fe_table_kept": greedy_walk(ENGINEERED_NUMBERS, "derived", ["text", "lang", "source"], engineered(), "0.01")
            + "SELECT column_name, value_count, min_value, max_value FROM left_over JOIN (" + union(
                [f"SELECT '{c}' AS column_name, count({c}) AS value_count, round(CAST(min({c}) AS DOUBLE), 4) AS min_value, round(CAST(max({c}) AS DOUBLE), 4) AS max_value FROM derived" for c in ENGINEERED_NUMBERS]
                + [f"SELECT '{c}', count({c}), NULL, NULL FROM derived" for c in ("text", "lang", "source")]) + ") USING (column_name)",
        "fe_log": greedy_walk(ENGINEERED_NUMBERS, "derived", ["text", "lang", "source"], engineered(), "0.01") + ", n AS (SELECT len(gone) AS alike, "
            + f"{len(ENGINEERED_NUMBERS) + 3} - (SELECT count(*) FROM left_over) - len(gone) AS steady FROM gone) "
            "SELECT 'text_features' AS operation, 'text' AS column_name, 'statistical_extraction' AS strategy, 'Extracted 6 text features from ''text''.' AS detail "
            "UNION ALL SELECT 'numeric_transformation', c, 'polynomial_log_sqrt', 'Created 4 numeric features from ''' || c || '''.' FROM (SELECT unnest(['doc_id', 'n_chars']) AS c) "
            "UNION ALL SELECT 'categorical_encoding', c, 'frequency_label_encoding', 'Created frequency and label encoding features for ''' || c || '''.' FROM (SELECT unnest(['lang', 'source']) AS c) "
            "UNION ALL SELECT 'variance_threshold', NULL, 'remove_low_variance', 'Removed ' || steady || ' columns with variance < 0.01.' FROM n WHERE steady > 0 "
            "UNION ALL SELECT 'correlation_filter', NULL, 'remove_high_correlation', 'Removed ' || alike || ' highly correlated columns (>0.95).' FROM n WHERE alike > 0",
    }


# -- preparation ------------------------------------------------------------

SUPERVISED = "base AS (SELECT * FROM v_orders_dirty WHERE o_orderstatus IS NOT NULL)"
HASH = "md5(concat_ws(':', CAST(o_orderkey AS VARCHAR), '42'))"
TAGGED = f"""{SUPERVISED},
sizes AS (SELECT o_orderstatus AS cls, count(*) AS n, (SELECT count(*) FROM base) AS total, CAST(ceil(0.2 * (SELECT count(*) FROM base)) AS BIGINT) AS wanted FROM base GROUP BY o_orderstatus),
quota AS (SELECT cls, (wanted * n) // total + CASE WHEN row_number() OVER (ORDER BY (wanted * n) % total DESC, cls) <= wanted - sum((wanted * n) // total) OVER () THEN 1 ELSE 0 END AS take FROM sizes),
tagged AS (SELECT b.*, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASH}) <= take THEN 'test' ELSE 'train' END AS side FROM base AS b JOIN quota ON cls = o_orderstatus),
train AS (SELECT * FROM tagged WHERE side = 'train')"""


def scaled(c: str, alias: str) -> str:
    filled = f"coalesce({c}, (SELECT median({c}) FROM train))"
    return f"round(({filled} - (SELECT avg({filled}) FROM train)) / (SELECT coalesce(nullif(stddev_pop({filled}), 0), 1) FROM train), 6) AS {alias}"


def preparation_sql() -> dict[str, str]:
    def v(sql):
        return with_views(f"WITH {TAGGED} {sql}", "orders_dirty")

    one_hot = ", ".join(f"CAST(CASE WHEN {c} = '{x}' THEN 1 ELSE 0 END AS DOUBLE) AS {c}_{x}" for c, x in (("near_const", "rare"), ("near_const", "usual"), ("const_col", "x")))
    numeric = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "is_big", "mostly_missing", "all_null"]
    categorical = ["o_orderpriority", "near_const", "const_col"]
    return {
        "prep_drop_null_target": with_views(f"WITH {SUPERVISED} SELECT o_orderkey, o_orderstatus FROM base", "orders_dirty"),
        "prep_classify": with_views(f"WITH {SUPERVISED} " + union(
            f"SELECT '{c}' AS column_name, count({c}) AS value_count, '{k}' AS feature_class FROM base" for k, cs in (("numeric", numeric), ("categorical", categorical)) for c in cs), "orders_dirty"),
        "prep_class_counts": with_views(f"WITH {SUPERVISED} SELECT o_orderstatus AS class_name, count(*) AS n FROM base GROUP BY o_orderstatus", "orders_dirty"),
        "prep_split": with_views(
            f"WITH {SUPERVISED} SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {HASH}) <= ceil(0.2 * (SELECT count(*) FROM base)) THEN 'test' ELSE 'train' END AS side FROM base", "orders_dirty"),
        "prep_split_stratified": v("SELECT o_orderkey, o_orderstatus, side FROM tagged"),
        "split_scan": v("SELECT o_orderkey, o_orderstatus FROM tagged WHERE side = 'test'"),
        "prep_impute_numeric": v("SELECT o_orderkey, " + ", ".join(f"round(coalesce({c}, (SELECT median({c}) FROM train)), 6) AS {c}" for c in ("o_totalprice", "mostly_missing")) + " FROM tagged"),
        "prep_scale": v(f"SELECT o_orderkey, {scaled('o_totalprice', 'o_totalprice')}, {scaled('o_custkey', 'o_custkey')}, {scaled('CAST(is_big AS INTEGER)', 'is_big')} FROM tagged"),
        "prep_impute_categorical": v(f"SELECT o_orderkey, coalesce(o_orderpriority, {mode_of('o_orderpriority', 'train')}) AS o_orderpriority FROM tagged"),
        "prep_one_hot_vector": """
WITH tagged AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS side FROM customer),
known AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS slot FROM (SELECT DISTINCT c_name FROM tagged WHERE side = 'train' AND c_name IS NOT NULL)),
usual AS (SELECT c_name FROM tagged WHERE side = 'train' GROUP BY c_name ORDER BY count(*) DESC, c_name LIMIT 1)
SELECT c_custkey, side, (SELECT count(*) FROM known) AS width, CAST(CASE WHEN slot IS NULL THEN 0 ELSE 1 END AS BIGINT) AS ones, slot
FROM (SELECT c_custkey, side, coalesce(c_name, (SELECT c_name FROM usual)) AS c_name FROM tagged) t LEFT JOIN known USING (c_name)""",
        "prep_one_hot": v(f"SELECT o_orderkey, {one_hot} FROM tagged"),
        "prep_ml_ready": v("SELECT side, o_orderstatus, " + ", ".join(
            [scaled(e, c).replace(", 6) AS", ", 5) AS") for c, e in (
                ("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey"), ("o_totalprice", "o_totalprice"), ("o_orderdate", "epoch(o_orderdate)"),
                ("is_big", "CAST(is_big AS INTEGER)"), ("mostly_missing", "mostly_missing"))]
            + [f"CAST(CASE WHEN coalesce({c}, {mode_of(c, 'train')}) = '{x}' THEN 1 ELSE 0 END AS DOUBLE) AS \"{c}_{x}\"" for c, values in (
                ("o_orderpriority", ["  ", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]), ("near_const", ["rare", "usual"]), ("const_col", ["x"]))
               for x in values]) + " FROM tagged"),
        "prep_stats": v("SELECT (SELECT count(*) FROM v_orders_dirty) AS rows_before, count(*) AS rows_after, count(*) FILTER (WHERE side = 'train') AS train_rows, count(*) FILTER (WHERE side = 'test') AS test_rows, "
                        "CAST(10 AS BIGINT) AS original_feature_count, CAST(15 AS BIGINT) AS processed_feature_count, CAST(7 AS BIGINT) AS numeric_column_count, CAST(3 AS BIGINT) AS categorical_column_count FROM tagged"),
    }


# -- models, evaluation, reports, run log -----------------------------------

LABELS = """matrix AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM v_predictions GROUP BY label, prediction),
names AS (SELECT actual AS name FROM matrix UNION SELECT predicted FROM matrix),
per_label AS (SELECT name, coalesce((SELECT sum(n) FROM matrix WHERE actual = name), 0) AS support, coalesce((SELECT sum(n) FROM matrix WHERE predicted = name), 0) AS predicted,
                     coalesce((SELECT sum(n) FROM matrix WHERE actual = name AND predicted = name), 0) AS tp FROM names)"""
PRIORITY = "CASE model_name WHEN 'RandomForestClassifier' THEN 0 WHEN 'LogisticRegression' THEN 1 WHEN 'DecisionTreeClassifier' THEN 2 ELSE 999 END"
RANKED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY f1 DESC NULLS LAST, accuracy DESC NULLS LAST, {PRIORITY}, model_id) AS rank FROM v_trained_models WHERE status = 'trained')"""
EXPERIMENTS = RANKED + """,
best AS (SELECT * FROM ranked WHERE rank = 1),
per_experiment AS (SELECT experiment_id, count(*) AS models_trained, count(DISTINCT model_name) = 1 AS one_algorithm FROM v_trained_models GROUP BY experiment_id),
report AS (SELECT o_orderkey AS experiment_id, o_custkey AS dataset_id, coalesce(models_trained, 0) AS models_trained, one_algorithm, model_name AS best_model_name,
                  feature_count AS best_feature_count, f1 AS best_score, total_rows, total_columns
           FROM orders LEFT JOIN per_experiment ON per_experiment.experiment_id = o_orderkey LEFT JOIN best ON best.experiment_id = o_orderkey LEFT JOIN v_dataset_sizes ON v_dataset_sizes.dataset_id = o_custkey)"""
ALL_RANKED = f"""shown AS (SELECT *, CASE WHEN status = 'trained' THEN f1 END AS shown, CASE WHEN status = 'trained' THEN accuracy END AS second FROM v_trained_models),
all_ranked AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY shown DESC NULLS LAST, second DESC NULLS LAST, {PRIORITY}, model_id) AS rank FROM shown)"""
REPORT_VIEWS = ("dataset_sizes", "dataset_quality", "dataset_cleaning", "dataset_features")
REPORT = "v_dataset_sizes AS s LEFT JOIN v_dataset_quality AS q USING (dataset_id) LEFT JOIN v_dataset_cleaning AS c USING (dataset_id) LEFT JOIN v_dataset_features AS f USING (dataset_id)"


LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

# the best split of price by quantity into two parts, by exhaustive search over the distinct quantities
STUMP = """
WITH v AS (SELECT l_quantity AS x, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY l_quantity),
c AS (SELECT x, lead(x) OVER (ORDER BY x) AS next, sum(n) OVER (ORDER BY x) AS ln, sum(s) OVER (ORDER BY x) AS ls, sum(n) OVER () AS n, sum(s) OVER () AS s FROM v),
best AS (SELECT *, row_number() OVER (ORDER BY ls * ls / ln + (s - ls) * (s - ls) / (n - ln) DESC, x) AS nth FROM c WHERE next IS NOT NULL)
SELECT round((x + next) / 2, 6) AS threshold, round(ls / ln, 3) AS left_mean, round((s - ls) / (n - ln), 3) AS right_mean, CAST(n AS BIGINT) AS rows FROM best WHERE nth = 1"""


def two_levels(rows: str, features: list[str], statistics: list[str], impurity, prediction: str) -> str:
    """A tree of two levels by exhaustive search: all midpoints of all features, ties to the earlier feature and the smaller value.

    ``rows`` selects ``y`` and the features, ``statistics`` are aggregates of y, ``impurity`` an expression over them (the first
    is the number of rows), ``prediction`` an aggregate.  Leaves of equal prediction are one leaf.
    """
    names = [f"a{i}" for i in range(len(statistics))]
    running = ", ".join(f"sum({a}) OVER w AS l_{a}, sum({a}) OVER (PARTITION BY node, f) AS t_{a}" for a in names)
    of = lambda side: impurity([f"(l_{a})" if side == "l" else f"(t_{a})" if side == "t" else f"(t_{a} - l_{a})" for a in names])
    gain = f"{of('t')} - l_a0 / CAST(t_a0 AS DOUBLE) * {of('l')} - (t_a0 - l_a0) / CAST(t_a0 AS DOUBLE) * {of('r')}"
    steps = [f"""r AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM ({rows})),
cells AS MATERIALIZED (SELECT id, y, unnest([{', '.join(f"CAST({f} AS DOUBLE)" for f in features)}]) AS x, unnest(range({len(features)})) AS f FROM r),
n0 AS (SELECT id, 1 AS node FROM r)"""]
    for level in (0, 1):
        steps.append(f"""hist{level} AS (SELECT node, f, x, {', '.join(f'{e} AS {a}' for e, a in zip(statistics, names))} FROM cells JOIN n{level} USING (id) GROUP BY node, f, x),
cum{level} AS (SELECT node, f, x, lead(x) OVER (PARTITION BY node, f ORDER BY x) AS nx, {running} FROM hist{level} WINDOW w AS (PARTITION BY node, f ORDER BY x)),
best{level} AS (SELECT node, f, (x + nx) / 2 AS t FROM (SELECT node, f, x, nx, {gain} AS gain FROM cum{level} WHERE nx IS NOT NULL)
  WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, x) = 1),
n{level + 1} AS (SELECT id, 2 * b.node + CASE WHEN x > t THEN 1 ELSE 0 END AS node FROM n{level} n JOIN best{level} b ON n.node = b.node JOIN cells USING (id) WHERE cells.f = b.f)""")
    steps.append(f"""facts AS (SELECT node, count(*) AS rows, {prediction} AS prediction FROM (FROM n0 UNION ALL FROM n1 UNION ALL FROM n2) JOIN r USING (id) GROUP BY node),
splits AS (SELECT b.* FROM (FROM best0 UNION ALL FROM best1) b LEFT JOIN facts x ON x.node = 2 * b.node LEFT JOIN facts y ON y.node = 2 * b.node + 1
  WHERE b.node = 1 OR x.prediction <> y.prediction)""")
    listed = "[" + ", ".join(f"'{f}'" for f in features) + "]"
    return "WITH " + ",\n".join(steps) + f"""
SELECT n.node, {listed}[s.f + 1] AS feature_name, round(t, 6) AS threshold, rows, prediction
FROM facts n LEFT JOIN splits s ON n.node = s.node WHERE n.node = 1 OR n.node // 2 IN (SELECT node FROM splits)"""


def newton(rows: str, steps: int = 12) -> str:
    """Intercept and slope of y in 0, 1 by x at the optimum of the summed loss plus half the squared slope, by Newton's method."""
    out = [f"r AS (SELECT CAST(x AS DOUBLE) AS x, y, count(*) AS n FROM ({rows}) GROUP BY ALL)", "s0 AS (SELECT CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS w)"]
    for i in range(steps):
        out.append(f"""g{i} AS (SELECT any_value(b) AS b, any_value(w) AS w, sum(n * (p - y)) AS g0, sum(n * (p - y) * x) + any_value(w) AS g1,
  sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * x) AS h01, sum(n * p * (1 - p) * x * x) + 1 AS h11 FROM (SELECT r.*, b, w, 1 / (1 + exp(-b - w * x)) AS p FROM r, s{i})),
s{i + 1} AS (SELECT b - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b, w - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS w FROM g{i})""")
    return "WITH " + ",\n".join(out) + f" SELECT (SELECT CAST(sum(n) AS BIGINT) FROM r) AS training_rows, round(b, 2) AS intercept, round(w, 2) AS slope FROM s{steps}"


# sizes of the prepared orders: four numbers, and a column per priority and per flag that the training rows have
ORDER_SIZES = ("(SELECT count(*) FROM train) AS training_rows, (SELECT count(*) FROM tagged WHERE side = 'test') AS validation_rows, "
               "CAST((SELECT 4 + count(DISTINCT o_orderpriority) + count(DISTINCT near_const) FROM train) AS INTEGER) AS feature_count")
PARTS = """WITH ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', CAST(p_partkey AS VARCHAR), '42'))) > ceil(0.2 * (SELECT count(*) FROM part)) AS train FROM part),
train AS (SELECT * FROM ranked WHERE train)"""
PART_SIZES = ("(SELECT count(*) FROM train) AS training_rows, (SELECT count(*) FROM ranked WHERE NOT train) AS validation_rows, "
              "CAST((SELECT 2 + count(DISTINCT p_brand) + count(DISTINCT p_type) FROM train) AS INTEGER) AS feature_count")
FOREST = "CAST(100 AS BIGINT) AS trees, true AS within_depth, CAST(100 AS BIGINT) AS trees_that_split"


def plane(source: str, y: str, a: str, b: str, train: str = "true") -> str:
    """Least squares of y by two columns over the training rows: ``ca, cb, c0``."""
    return f"""(SELECT (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ca, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS cb,
  my - ma * (sbb * say - sab * sby) / (saa * sbb - sab * sab) - mb * (saa * sby - sab * say) / (saa * sbb - sab * sab) AS c0
FROM (SELECT var_pop({a}) AS saa, var_pop({b}) AS sbb, covar_pop({a}, {b}) AS sab, covar_pop({a}, {y}) AS say, covar_pop({b}, {y}) AS sby,
  avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my FROM {source} WHERE {train}))"""


def tree_importances(features: list[str]) -> str:
    """Shares of the features in what two levels of splits take from the sum of squares."""
    tree = two_levels("SELECT l_extendedprice AS y, " + ", ".join(features) + " FROM lineitem", features, ["count(*)", "sum(y)", "sum(y * y)"],
                      lambda a: f"(({a[2]} - {a[1]} * {a[1]} / {a[0]}) / {a[0]})", "avg(y)")
    gain = "(t_a2 - t_a1 * t_a1 / t_a0) / t_a0 - (l_a2 - l_a1 * l_a1 / l_a0) / t_a0 - ((t_a2 - l_a2) - (t_a1 - l_a1) * (t_a1 - l_a1) / (t_a0 - l_a0)) / t_a0"
    removed = union(f"SELECT node, f, t_a0 * ({gain}) AS removed FROM cum{i} c JOIN best{i} b USING (node, f) WHERE (c.x + c.nx) / 2 = b.t" for i in (0, 1))
    head = tree[: tree.rindex("\nSELECT n.node")]
    listed = "[" + ", ".join(f"'{f}'" for f in features) + "]"
    return head + f""", taken AS (SELECT f, sum(removed) AS removed FROM ({removed}) SEMI JOIN splits USING (node) GROUP BY f)
SELECT {listed}[i + 1] AS feature_name, round(coalesce(removed / (SELECT sum(removed) FROM taken), 0), 4) AS importance_value,
       round(coalesce(removed / (SELECT sum(removed) FROM taken), 0), 4) AS normalized_importance, 'tree' AS importance_type
FROM (SELECT unnest(range({len(features)})) AS i) LEFT JOIN taken ON f = i"""


def linear_sql() -> dict[str, str]:
    parts = plane("part", "p_retailprice", "p_partkey", "p_size", "p_partkey % 5 <> 0")
    lines = plane("lineitem", "l_extendedprice", "l_quantity", "l_discount", "l_orderkey % 5 <> 0")
    everything = plane("part", "p_retailprice", "p_partkey", "p_size")
    predicted = "ca * p_partkey + cb * p_size + c0"
    weights = union(f"SELECT '{e}' AS experiment_id, unnest(['{a}', '{b}']) AS feature_name, unnest([abs(ca), abs(cb)]) AS v FROM {p}" for e, a, b, p in (
        ("parts", "p_partkey", "p_size", parts), ("lines", "l_quantity", "l_discount", lines)))
    return {
        "replay_stored_linear": "SELECT '007' AS experiment_id, 'LinearRegression' AS model_name, 'completed' AS evaluation_status, 'r2' AS primary_metric, "
            f"round(1 - avg(e * e) / var_pop(y), 4) AS r2, round(sqrt(avg(e * e)), 4) AS rmse, true AS is_best FROM (SELECT p_retailprice AS y, p_retailprice - ({predicted}) AS e FROM part, {parts} WHERE p_partkey % 5 = 0)",
        "report_trained_importances": "SELECT experiment_id, 'LinearRegression' AS model_name, row_number() OVER w AS position, feature_name, round(v, 4) AS importance_value, "
            f"round(v / sum(v) OVER (PARTITION BY experiment_id), 4) AS normalized_importance, row_number() OVER w AS rank FROM ({weights}) WINDOW w AS (PARTITION BY experiment_id ORDER BY v DESC)",
        "score_batch_linear": f"SELECT p_partkey AS part, round({predicted}, 3) AS prediction FROM part, {everything}",
        "score_log_linear": "SELECT '007' AS experiment_id, unnest(['0001', '12e3']) AS batch_id, 'LinearRegression' AS model_name, 'regression' AS model_type, "
            f"'{{\"p_partkey\":' || p_partkey || ',\"p_size\":' || p_size || '}}' AS input_data, round({predicted}, 3) AS prediction FROM part, {everything}",
    }


def training_sql() -> dict[str, str]:
    def v(sql):
        return with_views(f"WITH {TAGGED} {sql}", "orders_dirty")

    gini = lambda a: f"(1 - ({' + '.join(f'{c} * {c}' for c in a[1:])}) / (CAST({a[0]} AS DOUBLE) * {a[0]}))"
    variance = lambda a: f"(({a[2]} - {a[1]} * {a[1]} / {a[0]}) / {a[0]})"
    letters = ", ".join(f"CASE WHEN contains(coalesce(text, ''), '{c}') THEN 1 ELSE 0 END AS has_{i}" for i, c in enumerate("ñüèé"))
    named = "'{}' AS model_name, '{}' AS problem_type, 'trained' AS status, "
    root = "round(1 - sum((n / s) * (n / s)), 6) AS root_impurity FROM (SELECT count(*) AS n, CAST((SELECT count(*) FROM train) AS DOUBLE) AS s FROM train GROUP BY o_orderstatus)"
    return {
        "train_logistic": v(f"SELECT 'LogisticRegression' AS model_name, 'trained' AS status, {ORDER_SIZES}, o_orderstatus AS class, count(*) AS n, true AS balanced, true AS gradient_vanishes "
                            "FROM train GROUP BY o_orderstatus"),
        "train_logistic_weights": newton("SELECT ln(1 + length(coalesce(text, ''))) AS x, CASE WHEN contains(coalesce(text, ''), 'é') THEN 1 ELSE 0 END AS y FROM documents"),
        "train_tree_cls": v(f"SELECT {named.format('DecisionTreeClassifier', 'classification')}{ORDER_SIZES}, (SELECT count(*) FROM train) AS root_rows, (SELECT count(*) FROM train) AS leaf_rows, {root}"),
        "train_forest_cls": v(f"SELECT {named.format('RandomForestClassifier', 'classification')}{ORDER_SIZES}, {FOREST}"),
        "train_tree_reg": f"{PARTS} SELECT {named.format('DecisionTreeRegressor', 'regression')}{PART_SIZES}, true AS better_than_mean, count(*) AS root_rows, count(*) AS leaf_rows, "
                          "round(var_pop(p_retailprice), 3) AS root_impurity FROM train",
        "train_all": f"{PARTS} SELECT unnest(['RandomForestRegressor', 'LinearRegression', 'DecisionTreeRegressor']) AS model_name, 'regression' AS problem_type, 'trained' AS status, "
                     f"{PART_SIZES}, true AS better_than_mean, true AS best_leads, CAST(3 AS BIGINT) AS ranks",
        "eval_replay": "SELECT unnest(['RandomForestRegressor', 'LinearRegression', 'DecisionTreeRegressor']) AS model_name, 'completed' AS evaluation_status, 'r2' AS primary_metric, "
                       "count(*) > 0 AS as_trained, CAST(1 AS BIGINT) AS best_models FROM part",
        "explain_tree_levels": tree_importances(["l_quantity", "l_linenumber", "l_discount", "l_tax"]),
        "train_forest_reg": f"{PARTS} SELECT {named.format('RandomForestRegressor', 'regression')}{PART_SIZES}, true AS better_than_mean, {FOREST}",
        "train_tree_levels_cls": two_levels(
            f"SELECT lang AS y, {letters} FROM documents", [f"has_{i}" for i in range(4)],
            ["count(*)", *[f"count(*) FILTER (WHERE y = '{c}')" for c in ("de", "en", "es", "fr")]], gini, "mode(y ORDER BY y)"),
        "train_tree_levels_reg": "SELECT * REPLACE (round(prediction, 3) AS prediction, round(threshold, 3) AS threshold) FROM (" + two_levels(
            "SELECT l_extendedprice AS y, l_quantity, l_linenumber, l_discount, l_tax FROM lineitem", ["l_quantity", "l_linenumber", "l_discount", "l_tax"],
            ["count(*)", "sum(y)", "sum(y * y)"], variance, "avg(y)") + ")",
    }


def evaluation_sql() -> dict[str, str]:
    def weighted(metric):
        return with_views(f"WITH {LABELS} SELECT CAST(sum(support) AS BIGINT) AS rows, round(sum(support * coalesce({metric[1]}, 0)) / sum(support), 6) AS \"{metric[0]}\" FROM per_label", "predictions")

    latest = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY created_at DESC, evaluation_id DESC) AS rn FROM v_model_evaluations) WHERE rn = 1)"
    ev_metrics = "coalesce(e.accuracy, e.\"precision\", e.recall, e.f1) IS NOT NULL"
    return {
        "train_problem_type": union(
            [f"SELECT '{c}' AS target, count(DISTINCT {c}) AS distinct_count, CASE WHEN count(DISTINCT {c}) <= 20 THEN 'classification' ELSE 'regression' END AS problem_type FROM part" for c in ("p_partkey", "p_size", "p_retailprice")]
            + ["SELECT 'p_brand', count(DISTINCT p_brand), 'classification' FROM part"]),
        "json_scan": with_views("SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice, o_orderpriority, o_orderstatus, is_big, round(mostly_missing, 6) AS mostly_missing FROM v_orders_dirty", "orders_dirty"),
        "sink_roundtrip": with_views("SELECT * REPLACE (round(o_totalprice, 6) AS o_totalprice, round(mostly_missing, 6) AS mostly_missing, CAST(o_orderdate AS VARCHAR) AS o_orderdate) FROM v_orders_dirty", "orders_dirty"),
        "parameter_roundtrip": union(f"SELECT '{c}' AS column_name, round(median({c}), 4) AS median, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS scale FROM part" for c in ("p_size", "p_retailprice")),
        "prep_refusals": with_views(
            "SELECT 'valid' AS case_name, false AS refused, count(*) AS row_count, count(o_orderstatus) AS supervised_rows FROM v_orders_dirty "
            "UNION ALL SELECT unnest(['unknown_target', 'empty_target', 'share_too_large', 'too_few_rows']), true, NULL, NULL", "orders_dirty"),
        "train_refusals": with_views(
            "WITH t AS (SELECT o_orderkey % 5 = 0 AS test FROM v_orders_dirty WHERE o_orderstatus IS NOT NULL) SELECT unnest(['no_split', 'no_target', 'one_class']) AS case_name, true AS refused, (SELECT count(*) FROM t) AS row_count "
            "UNION ALL SELECT 'no_test_rows', true, count(*) FILTER (NOT test) FROM t UNION ALL SELECT 'no_train_rows', true, count(*) FILTER (test) FROM t", "orders_dirty"),
        "score_linear": "SELECT p_partkey, round(regr_slope(p_retailprice, p_size) OVER () * p_size + regr_intercept(p_retailprice, p_size) OVER (), 3) AS prediction FROM part",
        "replay_linear": "SELECT 'LinearRegression' AS model_name, 'completed' AS evaluation_status, round(regr_r2(p_retailprice, p_size), 6) AS r2, count(*) AS rows FROM part",
        "explain_slopes": "SELECT 'p_size' AS feature_name, round(abs(regr_slope(p_retailprice, p_size)), 6) AS importance_value, CAST(1 AS DOUBLE) AS normalized_importance, 'linear' AS importance_type FROM part",
        "train_stump": STUMP,
        "train_linear": "SELECT count(*) AS training_rows, round(regr_slope(p_retailprice, p_partkey), 4) AS slope, round(regr_intercept(p_retailprice, p_partkey), 4) AS intercept FROM part",
        "eval_accuracy": with_views("SELECT count(*) AS rows, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM v_predictions", "predictions"),
        "eval_precision": weighted(("precision", "tp / nullif(predicted, 0)")),
        "eval_recall": weighted(("recall", "tp / nullif(support, 0)")),
        "eval_f1": weighted(("f1", "2.0 * tp / nullif(support + predicted, 0)")),
        "eval_confusion": with_views(f"WITH {LABELS} SELECT a.name AS actual, p.name AS predicted, coalesce((SELECT n FROM matrix WHERE actual = a.name AND predicted = p.name), 0) AS n FROM names AS a, names AS p", "predictions"),
        "eval_regression": with_views(
            "SELECT count(*) AS rows, round(avg(abs(y_true - y_pred)), 3) AS mae, round(avg((y_true - y_pred) * (y_true - y_pred)), 3) AS mse, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 3) AS rmse FROM v_predictions", "predictions"),
        "eval_r2": with_views(
            "SELECT label, round(1 - sum((y_true - y_pred) * (y_true - y_pred)) / sum((y_true - m) * (y_true - m)), 6) AS r2 FROM v_predictions JOIN (SELECT label, avg(y_true) AS m FROM v_predictions GROUP BY label) USING (label) GROUP BY label", "predictions"),
        "eval_rank": with_views(f"WITH {RANKED} SELECT experiment_id, model_id, model_name, round(f1, 6) AS f1, rank FROM ranked", "trained_models"),
        "eval_latest": with_views(f"SELECT model_id, evaluation_id, evaluation_status FROM {latest}", "model_evaluations"),
        "eval_compare": with_views(
            f"WITH merged AS (SELECT m.experiment_id, m.model_id, m.model_name, CASE WHEN {ev_metrics} THEN e.evaluation_status ELSE m.status END AS status, coalesce(e.evaluation_status, 'not_evaluated') AS evaluation_status, "
            f"CASE WHEN {ev_metrics} THEN e.f1 ELSE m.f1 END AS f1, CASE WHEN {ev_metrics} THEN e.accuracy ELSE m.accuracy END AS accuracy FROM v_trained_models AS m LEFT JOIN {latest} AS e USING (model_id)) "
            f"SELECT experiment_id, model_id, model_name, status, evaluation_status, rank, round(f1, 6) AS primary_metric_value, coalesce(best_model_id = model_id, rank = 1) AS is_best FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY f1 DESC NULLS LAST, accuracy DESC NULLS LAST, {PRIORITY}, model_id) AS rank FROM merged) LEFT JOIN v_stored_best USING (experiment_id)", "trained_models", "model_evaluations", "stored_best"),
        "score_type_check": with_views(union(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NOT NULL AND try_cast({c} AS DOUBLE) IS NULL) AS bad_rows FROM v_raw_inputs" for c in ("amount", "customer", "plain")), "raw_inputs"),
        "score_history": with_views("SELECT dataset_id, run_id, CAST(created_at AS VARCHAR) AS created_at, count(*) OVER (PARTITION BY dataset_id) AS total FROM v_runs", "runs"),
    }


def report_sql() -> dict[str, str]:
    def rule(condition, columns):
        return f"SELECT dataset_id, {columns} FROM {REPORT} WHERE {condition}"

    def exp(condition, columns):
        return f"SELECT experiment_id, {columns} FROM report WHERE {condition}"

    removal = "(c.rows_before - c.rows_after) * 100.0 / c.rows_before"
    findings = union([
        rule("true", "0 AS finding_order, 'dataset' AS category, 'Dataset Dimensions' AS title, printf('%d rows × %d columns', total_rows, total_columns) AS value, format('The dataset contains {:,} rows and {} columns.', total_rows, total_columns) AS description"),
        rule("q.score IS NOT NULL", "1, 'quality', 'Overall Data Quality Score', CAST(q.score AS VARCHAR), printf('Data quality assessment: %d%% with %d missing values.', q.score, q.missing_count)"),
        rule("q.missing_percentage > 0", "2, 'data_issues', 'Missing Values', printf('%.1f%%', q.missing_percentage), printf('Missing values detected in %d cells (%.1f%% of data).', q.missing_count, q.missing_percentage)"),
        rule("q.duplicate_rows > 0", "3, 'data_issues', 'Duplicate Rows', CAST(q.duplicate_rows AS VARCHAR), printf('Found %d duplicate rows (%.1f%% of data).', q.duplicate_rows, q.duplicate_percentage)"),
        rule("c.rows_before <> c.rows_after", "4, 'dataset', 'Data Cleaning Impact', CAST(c.rows_before - c.rows_after AS VARCHAR), printf('Cleaning operations removed %d rows and handled %d missing values.', c.rows_before - c.rows_after, c.missing_values_handled)"),
        rule("f.columns_after IS NOT NULL", "5, 'features', 'Feature Engineering Summary', printf('%d features', f.columns_after), printf('Feature engineering added %d features and removed %d features. Final feature count: %d.', f.features_added, f.features_removed, f.columns_after)"),
    ])
    recommendations = union([
        rule("q.score < 70", "0 AS recommendation_order, 'high' AS priority, 'data_quality' AS category, 'Low Data Quality Score' AS title, printf('Data quality score is %d%%. This may impact model performance.', q.score) AS description, 'Review and address data quality issues. Consider additional cleaning, imputation, or outlier handling.' AS action"),
        rule("q.missing_percentage > 30", "1, 'high', 'data_quality', 'High Missing Value Rate', printf('%.1f%% of values are missing.', q.missing_percentage), 'Consider advanced imputation techniques, removing highly sparse columns, or feature engineering to handle missing values.'"),
        rule("q.duplicate_percentage > 5", "2, 'medium', 'data_quality', 'Duplicate Rows Detected', printf('%.1f%% of rows are duplicates.', q.duplicate_percentage), 'Review and remove or consolidate duplicate records based on business logic.'"),
        rule(f"{removal} > 20", f"3, 'medium', 'preprocessing', 'High Data Removal Rate', printf('Cleaning removed %.1f%% of rows. This may result in insufficient data for modeling.', {removal}), 'Review cleaning operations. Consider more conservative imputation strategies or selective filtering.'"),
        rule("f.columns_after > 100", "4, 'medium', 'features', 'High Feature Dimensionality', printf('Dataset has %d features. This may cause overfitting.', f.columns_after), 'Consider feature selection, dimensionality reduction (PCA), or regularization techniques.'"),
    ])
    exp_findings = union([
        exp("true", "0 AS finding_order, 'dataset' AS category, 'Dataset Size' AS title, format('{:,} rows', total_rows) AS value, format('Experiment trained on {:,} rows with {} original columns.', total_rows, total_columns) AS description"),
        exp("true", "1, 'model', 'Models Trained', CAST(models_trained AS VARCHAR), printf('Total of %d models trained during this experiment.', models_trained)"),
        exp("best_model_name IS NOT NULL", "2, 'model', 'Best Performing Model', best_model_name, printf('Best model: %s (%s) with f1=%.4f', best_model_name, best_model_name, best_score)"),
        exp("best_model_name IS NOT NULL", "3, 'features', 'Feature Count', CAST(best_feature_count AS VARCHAR), printf('Best model trained with %d features.', best_feature_count)"),
    ])
    exp_recs = union([
        exp("best_score < 0.7", "0 AS recommendation_order, 'high' AS priority, 'model' AS category, 'Poor Model Performance' AS title, printf('Best model F1 score is %.4f. Performance may be insufficient for production.', best_score) AS description, 'Consider more feature engineering, different algorithms, hyperparameter tuning, or collecting more data.' AS action"),
        exp("models_trained >= 2 AND one_algorithm", "2, 'low', 'model', 'Limited Algorithm Diversity', printf('All %d models use the same algorithm.', models_trained), 'Consider training with different algorithms to find the best approach for your problem.'"),
    ])
    return {
        "report_dataset": with_views(
            "SELECT dataset_id, total_rows, total_columns, q.score AS quality_score, q.missing_count AS quality_missing_count, round(q.missing_percentage, 6) AS quality_missing_percentage, q.duplicate_rows AS quality_duplicate_rows, "
            "round(q.duplicate_percentage, 6) AS quality_duplicate_percentage, q.score IS NOT NULL AS has_quality, c.rows_before AS cleaning_rows_before, c.rows_after AS cleaning_rows_after, c.missing_values_handled AS cleaning_missing_values_handled, "
            f"c.rows_before IS NOT NULL AS has_cleaning, f.columns_after AS features_columns_after, f.features_added AS features_features_added, f.features_removed AS features_features_removed, f.columns_after IS NOT NULL AS has_features FROM {REPORT}", *REPORT_VIEWS),
        "report_findings": with_views(findings, *REPORT_VIEWS),
        "report_recommendations": with_views(recommendations, *REPORT_VIEWS),
        "report_newest": with_views(
            "SELECT s.dataset_id, total_rows, total_columns, p.run_id AS preparation_run_id, CAST(p.created_at AS VARCHAR) AS preparation_created_at, p.train_rows AS preparation_train_rows, p.test_rows AS preparation_test_rows, p.run_id IS NOT NULL AS has_preparation, "
            "e.run_id AS experiment_run_id, CAST(e.created_at AS VARCHAR) AS experiment_created_at, round(e.best_score, 6) AS experiment_best_score, e.run_id IS NOT NULL AS has_experiment FROM v_dataset_sizes AS s "
            + " ".join(f"LEFT JOIN (SELECT * FROM v_{v} QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, run_id DESC) = 1) AS {a} ON {a}.dataset_id = s.dataset_id" for v, a in (("dataset_preparation", "p"), ("dataset_experiments", "e"))),
            "dataset_sizes", "dataset_preparation", "dataset_experiments"),
        "report_experiment_models": with_views(f"WITH {ALL_RANKED} SELECT experiment_id, rank, model_id, model_name, status, 'f1' AS primary_metric, round(shown, 6) AS primary_metric_value, rank = 1 AND shown IS NOT NULL AS is_best FROM all_ranked", "trained_models"),
        "report_experiment_importances": with_views(
            f"WITH {ALL_RANKED}, i AS (SELECT experiment_id, model_name, feature_name, importance_value, row_number() OVER (PARTITION BY experiment_id ORDER BY importance_value DESC, feature_name) AS position "
            "FROM all_ranked JOIN v_model_importances USING (model_id) WHERE rank = 1 AND shown IS NOT NULL) SELECT experiment_id, model_name, position, feature_name, round(importance_value, 6) AS importance_value FROM i WHERE position <= 2",
            "trained_models", "model_importances"),
        "report_experiment": with_views(f"WITH {EXPERIMENTS} SELECT experiment_id, dataset_id, models_trained, best_model_name, best_feature_count, round(best_score, 6) AS best_score, total_rows FROM report", "trained_models", "dataset_sizes"),
        "report_experiment_findings": with_views(f"WITH {EXPERIMENTS} {exp_findings}", "trained_models", "dataset_sizes"),
        "report_experiment_recommendations": with_views(f"WITH {EXPERIMENTS} {exp_recs}", "trained_models", "dataset_sizes"),
        "log_latest": with_views(
            "SELECT dataset_id, stage, run_id, CAST(created_at AS VARCHAR) AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, stage ORDER BY created_at DESC, run_id DESC) AS rn FROM v_runs) WHERE rn = 1", "runs"),
        "log_fallback": with_views(
            "SELECT d.dataset_id, CASE WHEN p.run_id IS NOT NULL THEN 'purchase' WHEN s.run_id IS NOT NULL THEN 'signup' WHEN w.run_id IS NOT NULL THEN 'view' END AS source_stage, coalesce(p.run_id, s.run_id, w.run_id) AS source_run "
            "FROM (SELECT DISTINCT dataset_id FROM v_runs) AS d "
            + " ".join(f"LEFT JOIN (SELECT dataset_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, run_id DESC) AS rn FROM v_runs WHERE stage = '{stage}') WHERE rn = 1) AS {a} ON {a}.dataset_id = d.dataset_id"
                       for stage, a in (("purchase", "p"), ("signup", "s"), ("view", "w"))), "runs"),
        "log_history": with_views("SELECT dataset_id, run_id, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, run_id DESC) - 1 AS position, count(*) OVER (PARTITION BY dataset_id) AS total FROM v_runs", "runs"),
    }


def source_sql() -> dict[str, str]:
    return {
        "parquet_scan_all": "SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") else f"CAST({c} AS VARCHAR) AS {c}" if c.endswith("date") else c for c in LINE_COLUMNS) + " FROM lineitem",
        "parquet_scan": "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 6) AS l_extendedprice, CAST(l_shipdate AS VARCHAR) AS l_shipdate FROM lineitem WHERE l_quantity > 45",
        "shape": "SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count FROM lineitem",
        "csv_scan": with_views(
            "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice, o_orderpriority, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') AS o_orderdate, o_orderstatus, "
            "CASE WHEN is_big THEN 'true' WHEN NOT is_big THEN 'false' END AS is_big, near_const, const_col, round(mostly_missing, 6) AS mostly_missing, all_null FROM v_orders_dirty", "orders_dirty"),
        "read_dispatch": with_views("SELECT count(*) AS row_count, count(o_totalprice) AS prices, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM v_orders_dirty", "orders_dirty"),
        "na_fold": with_views("SELECT CASE WHEN amount = 'unknown' THEN NULL ELSE amount END AS amount, customer, plain FROM v_raw_inputs", "raw_inputs"),
        "type_inference": with_views(
            "SELECT 'amount' AS column_name, CASE WHEN count(amount) = count(try_cast(amount AS DOUBLE)) THEN 'double' ELSE 'string' END AS inferred_type, count(amount) AS value_count FROM v_raw_inputs "
            "UNION ALL SELECT 'customer', CASE WHEN count(customer) = count(try_cast(customer AS DOUBLE)) THEN 'double' ELSE 'string' END, count(customer) FROM v_raw_inputs "
            "UNION ALL SELECT 'plain', CASE WHEN count(plain) = count(*) AND count(plain) = count(try_cast(plain AS BIGINT)) THEN 'bigint' ELSE 'string' END, count(plain) FROM v_raw_inputs", "raw_inputs"),
    }


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in (source_sql, profile_sql, quality_sql, cleaning_sql, features_sql, preparation_sql, training_sql, linear_sql, evaluation_sql, report_sql):
        out.update(part())
    return out
