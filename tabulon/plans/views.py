"""Derived inputs: SQL text that both engines read, over the registered tables.

The tables hold no nulls, so ``orders_dirty`` adds nulls, blanks, a boolean, a
constant, a nearly constant, a sparse and an empty column.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "orders_dirty": """
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL
                    WHEN o_orderkey % 17 = 0 THEN '  ' ELSE o_orderpriority END AS o_orderpriority,
               CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate,
               CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
               CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_totalprice > 250000 END AS is_big,
               CASE WHEN o_orderkey % 500 = 0 THEN 'rare' ELSE 'usual' END AS near_const,
               'x' AS const_col,
               CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS mostly_missing,
               CAST(NULL AS DOUBLE) AS all_null
        FROM orders""",
    "orders_categories": """
        SELECT CASE WHEN o_orderkey % 13 = 0 THEN NULL
                    WHEN o_orderkey % 17 = 0 THEN '  ' ELSE o_orderpriority END AS o_orderpriority,
               CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
               CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_totalprice > 250000 END AS is_big,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 40 AS DOUBLE) END AS bucket
        FROM orders""",
    "customer_balance": "SELECT c_custkey, c_name, c_acctbal AS balance, c_mktsegment FROM customer",
    "order_flags": "SELECT o_orderstatus, o_orderpriority FROM orders",
    "document_texts": "SELECT text FROM documents",
    "document_quality": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "event_texts": """
        SELECT event_id, CAST(ts AS VARCHAR(40)) AS ts_text, event_type, props, CAST(event_id AS VARCHAR(20)) AS id_text, value
        FROM events""",
    "predictions": """
        SELECT l_orderkey, l_linenumber, l_returnflag AS label,
               CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 'A' ELSE l_returnflag END AS prediction,
               l_extendedprice AS y_true,
               l_extendedprice * (CAST(1 AS DOUBLE) + CAST(l_orderkey % 7 - 3 AS DOUBLE) / CAST(100 AS DOUBLE)) AS y_pred
        FROM lineitem""",
    "runs": """
        SELECT event_id AS run_id, user_id AS dataset_id, event_type AS stage, ts AS created_at, value AS score
        FROM events""",
    "part_squares": """
        SELECT p_partkey, p_size, p_retailprice,
               CAST(p_size AS DOUBLE) * p_size AS p_size_sq,
               p_retailprice * CAST(2 AS DOUBLE) AS p_retail_twice,
               CAST(1 AS DOUBLE) AS flat,
               CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS sparse,
               p_brand
        FROM part""",
    "raw_inputs": """
        SELECT CASE WHEN o_orderkey % 31 = 0 THEN 'unknown' WHEN o_orderkey % 37 = 0 THEN NULL
                    ELSE CAST(o_orderkey AS VARCHAR(20)) END AS amount,
               CASE WHEN o_custkey % 41 = 0 THEN 'n.a.' ELSE CAST(o_custkey AS VARCHAR(20)) END AS customer,
               CAST(o_custkey AS VARCHAR(20)) AS plain
        FROM orders""",
    # experiments of a dataset: three candidate models, their scores taken from the line items of an order
    "trained_models": """
        SELECT l_orderkey * 10 + l_linenumber AS model_id, l_orderkey AS experiment_id,
               CASE l_linenumber % 3 WHEN 0 THEN 'RandomForestClassifier' WHEN 1 THEN 'LogisticRegression'
                                     ELSE 'DecisionTreeClassifier' END AS model_name,
               CASE WHEN l_linenumber = 7 THEN 'failed' ELSE 'trained' END AS status,
               CAST(l_quantity AS BIGINT) AS feature_count,
               l_discount * CAST(10 AS DOUBLE) AS f1,
               l_tax * CAST(10 AS DOUBLE) AS accuracy,
               l_tax * CAST(5 AS DOUBLE) AS "precision",
               l_tax * CAST(8 AS DOUBLE) AS recall,
               l_shipdate AS created_at
        FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount,
                     max(l_tax) AS l_tax, max(l_shipdate) AS l_shipdate
              FROM lineitem GROUP BY l_orderkey, l_linenumber) AS lines""",
    "model_evaluations": """
        SELECT l_orderkey * 1000000 + l_suppkey AS evaluation_id,
               l_orderkey * 10 + l_linenumber AS model_id,
               l_shipdate AS created_at,
               CASE WHEN l_linenumber = 6 THEN 'failed' ELSE 'completed' END AS evaluation_status,
               CASE WHEN l_linenumber <> 6 THEN l_discount * CAST(9 AS DOUBLE) END AS f1,
               CASE WHEN l_linenumber <> 6 THEN l_tax * CAST(9 AS DOUBLE) END AS accuracy,
               CASE WHEN l_linenumber <> 6 THEN l_tax * CAST(4 AS DOUBLE) END AS "precision",
               CASE WHEN l_linenumber <> 6 THEN l_tax * CAST(7 AS DOUBLE) END AS recall
        FROM (SELECT l_orderkey, l_linenumber, l_suppkey, max(l_discount) AS l_discount, max(l_tax) AS l_tax,
                     max(l_shipdate) AS l_shipdate
              FROM lineitem GROUP BY l_orderkey, l_linenumber, l_suppkey HAVING max(l_quantity) > 30) AS lines""",
    # one "dataset" per customer: its orders are the rows; not every dataset went through every stage
    "dataset_sizes": """
        SELECT o_custkey AS dataset_id, CAST(count(*) * 1000 AS BIGINT) AS total_rows, CAST(11 AS BIGINT) AS total_columns
        FROM orders GROUP BY o_custkey""",
    "dataset_quality": """
        SELECT o_custkey AS dataset_id,
               CAST(100 - 5 * sum(CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) - 8 * sum(CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS score,
               CAST(sum(CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) + sum(CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing_count,
               CAST(sum(CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) + sum(CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END) AS DOUBLE)
                   * CAST(100 AS DOUBLE) / CAST(count(*) * 2 AS DOUBLE) AS missing_percentage,
               CAST(count(*) - count(DISTINCT o_orderpriority) AS BIGINT) AS duplicate_rows,
               CAST(count(*) - count(DISTINCT o_orderpriority) AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(count(*) AS DOUBLE) AS duplicate_percentage
        FROM orders GROUP BY o_custkey HAVING min(o_totalprice) < 100000""",
    "dataset_cleaning": """
        SELECT o_custkey AS dataset_id, CAST(count(*) AS BIGINT) AS rows_before,
               CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS rows_after,
               CAST(sum(CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing_values_handled
        FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 300000""",
    # several runs of a stage per dataset, some on one day
    "dataset_preparation": """
        SELECT o_custkey AS dataset_id, o_orderkey AS run_id, o_orderdate AS created_at, o_orderkey * 8 AS train_rows, o_orderkey * 2 AS test_rows
        FROM orders WHERE o_orderkey % 2 = 0""",
    "dataset_experiments": """
        SELECT o_custkey AS dataset_id, o_orderkey AS run_id, o_orderdate AS created_at, o_totalprice / CAST(1000000 AS DOUBLE) AS best_score
        FROM orders WHERE o_orderkey % 3 = 0""",
    "stored_best": "SELECT o_orderkey AS experiment_id, o_orderkey * 10 + 1 AS best_model_id FROM orders WHERE o_orderkey % 4 = 0",
    "model_importances": """
        SELECT l_orderkey * 10 + l_linenumber AS model_id, 'amount' AS feature_name, max(l_quantity) AS importance_value FROM lineitem GROUP BY l_orderkey, l_linenumber
        UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'rate', max(l_discount) * CAST(300 AS DOUBLE) FROM lineitem GROUP BY l_orderkey, l_linenumber
        UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'duty', max(l_discount) * CAST(300 AS DOUBLE) FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "dataset_features": """
        SELECT o_custkey AS dataset_id, CAST(count(*) * 9 AS BIGINT) AS columns_after,
               CAST(count(*) * 4 AS BIGINT) AS features_added, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS features_removed
        FROM orders GROUP BY o_custkey HAVING count(*) > 6""",
}

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame; its base tables become temporary views of this session."""
    text = VIEWS[name]
    words = set(text.replace(",", " ").replace("(", " ").replace(")", " ").split())
    for t in TABLES:
        if t in words:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text.replace('"precision"', "`precision`"))


def with_views(sql: str, *names: str) -> str:
    """The same inputs as common table expressions in front of a checking query."""
    ctes = ",\n".join(f"v_{n} AS ({VIEWS[n]})" for n in names)
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.lstrip().startswith(start):
            return f"{start}{ctes},\n{sql.lstrip()[len(start):]}"
    return f"WITH {ctes}\n{sql}"
