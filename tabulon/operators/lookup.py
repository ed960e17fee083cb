"""Left lookup of a per-value table that survives hot values and many values.

Few values (checked): one broadcast join.  Many values: values that hold more
than a hundred-thousandth of the rows - there can be at most a hundred thousand -
are looked up by broadcast, and their rows are spread by a salt in the shuffle
join that serves all others, so no task receives a hot value's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import col, compact_text, row_hashes

BROADCAST_VALUES = 100_000
HOT_SHARE = 0.00001
SPREAD = 1024


def lookup(
    df: DataFrame,
    key: Column,
    table: DataFrame,
    payload: list[str],
    value_count: int,
    total: int,
    broadcast_values: int = BROADCAST_VALUES,
) -> DataFrame:
    """Add the ``payload`` columns of ``table(value, n, payload...)`` to ``df`` by ``key = value``.

    ``value_count`` is the number of rows of ``table``, ``total`` the sum of its ``n``.
    """
    # compact keys bound the size of what is broadcast by the number of values
    keyed = df.withColumn("_key", compact_text(key))
    table = table.withColumn("value", compact_text(F.col("value")))
    slim = table.select(F.col("value").alias("_value"), *payload)
    if value_count <= broadcast_values:
        return keyed.join(F.broadcast(slim), F.col("_key") == F.col("_value"), "left").drop("_key", "_value")

    threshold = F.lit(max(1.0, total * HOT_SHARE))
    hot = table.filter(F.col("n") > threshold).select(
        F.col("value").alias("_hot_value"), *[F.col(p).alias(f"_hot_{p}") for p in payload]
    )
    # the slot is a hash, not a constant: an equality with a constant would leave the join keys
    cold = table.filter(F.col("n") <= threshold).select(
        F.col("value").alias("_value"), F.pmod(F.xxhash64("value"), F.lit(SPREAD)).alias("_slot"), *payload
    )
    # at most 1 / HOT_SHARE rows
    marked = keyed.join(F.broadcast(hot), F.col("_key") == F.col("_hot_value"), "left")
    settled = F.col("_hot_value").isNotNull() | F.col("_key").isNull()
    others = [col(c) for c in df.columns]
    # Settled rows get slots no value has.  The salt is a hash of the row, so a repeated
    # task sends its rows to the same places; copies of one row are left to AQE.
    salt = F.when(settled, F.pmod(row_hashes(df)[0], F.lit(SPREAD)) + SPREAD).otherwise(F.pmod(F.xxhash64("_key"), F.lit(SPREAD)))
    joined = marked.withColumn("_salt", salt).join(cold, (F.col("_key") == F.col("_value")) & (F.col("_salt") == F.col("_slot")), "left")
    return joined.select(*others, *[F.coalesce(F.col(f"_hot_{p}"), F.col(p)).alias(p) for p in payload])


def join_null_safe(df: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Add the other columns of ``per_key`` by equal keys, where null equals null."""
    renamed = per_key.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[col(c) for c in per_key.columns if c not in keys])
    same = [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(renamed, same, how).drop(*[f"_k{i}" for i in range(len(keys))])
