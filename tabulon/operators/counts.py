"""Value counts over many columns in one shuffle, and what follows from them.

Columns are unpivoted by kind of key (long, double, text) and counted with one
``groupBy`` each; map-side partial aggregation reduces a hot value to one row per
task, so a value that holds a third of the table does no harm.
Distinct counts, top values, modes and encodings are read off the counted table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import COMPACT_ABOVE, as_text, col, compact_text, row_hashes
from tabulon.session import materialise

WHOLE, DIGEST, ORDERED = "whole", "digest", "ordered"


def ordered_key(text: Column) -> Column:
    """Long texts as their beginning and a digest: of bounded size, told apart, and in the order of the texts by their beginning."""
    return F.when(F.length(text) > COMPACT_ABOVE, F.concat(F.substring(text, 1, COMPACT_ABOVE), F.sha2(text, 256))).otherwise(text)


def _key_of(df: DataFrame, name: str, texts: str) -> tuple[str, Column]:
    """The kind of key a column is counted by and the key: numbers are not formatted to be counted."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.IntegralType):
        return "k_long", col(name).cast("bigint")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # + 0.0 folds -0.0 into 0.0
        return "k_double", col(name).cast("double") + F.lit(0.0)
    text = as_text(df, name)
    return "k_text", {WHOLE: lambda t: t, DIGEST: compact_text, ORDERED: ordered_key}[texts](text)


KEY_TYPES = {"k_long": "bigint", "k_double": "double", "k_text": "string"}


def value_counts(df: DataFrame, cols: list[str], texts: str = WHOLE) -> DataFrame:
    """``(column, k_long, k_double, k_text, n)``: one row per column and distinct non-null value.

    Where only identity matters, or identity and order, ``texts`` asks for long texts as digests or ordered keys, so that
    they are not shuffled whole.
    Each kind of key is counted by itself over its own columns, so every column is read once.
    """
    families: dict[str, list[tuple[str, Column]]] = {}
    for c in cols:
        kind, key = _key_of(df, c, texts)
        families.setdefault(kind, []).append((c, key))
    parts = []
    for kind, members in families.items():
        places = [str(i) for i in range(len(members))]
        long_form = df.select(*[key.alias(p) for p, (_, key) in zip(places, members)]).unpivot([], places, "place", "key")
        names = F.array(*[F.lit(c) for c, _ in members])
        counted = long_form.filter("key is not null").groupBy("place", "key").agg(F.count(F.lit(1)).alias("n"))
        keys = [(F.col("key") if k == kind else F.lit(None).cast(t)).alias(k) for k, t in KEY_TYPES.items()]
        parts.append(counted.select(names[F.col("place").cast("int")].alias("column"), *keys, "n"))
    return reduce(DataFrame.unionByName, parts)


def value_text() -> Column:
    """The counted value as text, whatever its type."""
    return F.coalesce(F.col("k_text"), F.col("k_long").cast("string"), F.col("k_double").cast("string"))


def cardinalities(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, distinct_count, top_count, non_null_count)``; columns without values are absent."""
    return (
        value_counts(df, cols, DIGEST)
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("distinct_count"),
            F.max("n").alias("top_count"),
            F.sum("n").alias("non_null_count"),
        )
    )


def ranked_keys(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """``(column, key, n)``: the keys that can be among the k most frequent values per column, ties by value.

    Ranks go by count and by the beginning of a text; texts that are equal in both share a rank and are all kept.  The
    ``rank <= k`` filter is pushed below the shuffle by Spark as a partial group limit, so each task sends few rows per column.
    """
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.substring("key", 1, COMPACT_ABOVE).asc())
    counted = value_counts(df, cols, ORDERED).select("column", value_text().alias("key"), "n")
    return counted.withColumn("rank", F.rank().over(order)).filter(F.col("rank") <= k).drop("rank")


def _whole_texts(df: DataFrame, cols: list[str], keys: DataFrame) -> DataFrame:
    """``(column, key, text)`` of long texts, by a second read of those columns; only wanted texts leave a task, each once."""
    places = [str(i) for i in range(len(cols))]
    names = F.array(*[F.lit(c) for c in cols])
    long_form = df.select(*[as_text(df, c).alias(p) for p, c in zip(places, cols)]).unpivot([], places, "place", "text")
    keyed = long_form.filter(F.length("text") > COMPACT_ABOVE).select(names[F.col("place").cast("int")].alias("column"), ordered_key(F.col("text")).alias("key"), "text")
    # all texts of a key are alike; a set keeps one of them per task in a hash table
    return keyed.join(keys, ["column", "key"], "left_semi").groupBy("column", "key").agg(F.collect_set("text")[0].alias("text"))


def top_values(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """``(column, rank, value, n)``: the k most frequent values per column, ties by value.

    Values are counted and ranked by keys of bounded size; the texts of long winners are fetched afterwards.
    """
    winners = materialise(ranked_keys(df, cols, k), "top_keys")
    is_long = F.length("key") > COMPACT_ABOVE
    long_columns = [r["column"] for r in winners.filter(is_long).select("column").distinct().collect()]
    named = winners.withColumn("value", F.col("key"))
    if long_columns:
        texts = _whole_texts(df, [c for c in cols if c in long_columns], winners.filter(is_long).select("column", "key"))
        named = winners.join(texts, ["column", "key"], "left").withColumn("value", F.coalesce("text", "key"))
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
    return (
        named.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("column", F.col("rank").cast("int").alias("rank"), "value", "n")
    )


def modes(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Most frequent value per column as text, the smallest one on ties."""
    if not cols:
        return {}
    return {r["column"]: r["value"] for r in top_values(df, cols, 1).collect()}


def approximate_cardinalities(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """HyperLogLog++ distinct counts: one scan and no shuffle of values, for when ~2 % error is enough."""
    row = df.agg(*[F.approx_count_distinct(as_text(df, c)).alias(str(i)) for i, c in enumerate(cols)]).first()
    return {c: int(row[i]) for i, c in enumerate(cols)}


def distinct_row_count(df: DataFrame) -> DataFrame:
    """One row ``(row_count, distinct_count, duplicate_count)`` over full rows."""
    if not df.columns:
        return df.agg(F.count(F.lit(1)).alias("row_count")).selectExpr(
            "row_count", "cast(0 as bigint) as distinct_count", "row_count as duplicate_count"
        )
    per_row = df.select(*row_hashes(df)).groupBy("row_hash_a", "row_hash_b").agg(F.count(F.lit(1)).alias("n"))
    return per_row.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_count"),
    ).withColumn("duplicate_count", F.col("row_count") - F.col("distinct_count"))
