"""Pairwise-complete Pearson correlations of all numeric columns in one scan.

k columns have k(k-1)/2 pairs.  Each task turns its Arrow batches into k x k
matrix products (sums over the rows where both columns have a value); the
partial sums of all tasks are added up by ``groupBy``.  Values are centred by the
column mean first, so the sums stay accurate for large values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import NUMERICAL, as_double, columns_of
from tabulon.operators.stats import aggregate_in_chunks
from tabulon.session import ship_package

# how many partial rows all tasks together may send
PARTIAL_ROWS = 1_000_000_000
PARTIAL_SCHEMA = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"


def _partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for batch in batches:
        x = batch.to_numpy(dtype=float, na_value=np.nan)
        present = (~np.isnan(x)).astype(float)
        x = np.nan_to_num(x, nan=0.0)
        square = x * x
        part = np.stack([present.T @ present, x.T @ present, square.T @ present, x.T @ x])
        total = part if total is None else total + part
    if total is None:
        return
    n, s, ss, sxy = total
    i, j = np.triu_indices(n.shape[0], k=1)
    yield pd.DataFrame({
        "i": i.astype("int32"), "j": j.astype("int32"), "n": n[i, j], "sx": s[i, j], "sy": s[j, i],
        "sxx": ss[i, j], "syy": ss[j, i], "sxy": sxy[i, j],
    })


def column_moments(df: DataFrame, cols: list[str]) -> dict[str, dict[str, float | None]]:
    """Mean, sample variance, smallest and largest value per column in one scan."""
    expressions = {}
    for i, c in enumerate(cols):
        x = as_double(df, c)
        expressions[f"mean:{i}"] = F.avg(x)
        expressions[f"variance:{i}"] = F.var_samp(x)
        expressions[f"min:{i}"] = F.min(x)
        expressions[f"max:{i}"] = F.max(x)
    row = aggregate_in_chunks(df, expressions) if expressions else {}
    return {c: {k: row[f"{k}:{i}"] for k in ("mean", "variance", "min", "max")} for i, c in enumerate(cols)}


@dataclass
class StrongPairs:
    """Pairs of columns by their places, first before second, in order: 16 bytes a pair."""

    columns: list[str]
    first: np.ndarray
    second: np.ndarray
    corr: np.ndarray

    @staticmethod
    def of(columns: list[str], first, second, corr) -> StrongPairs:
        first, second = np.asarray(first, np.int32), np.asarray(second, np.int32)
        order = np.lexsort((second, first))
        return StrongPairs(columns, first[order], second[order], np.asarray(corr, np.float64)[order])

    def __iter__(self) -> Iterator[tuple[str, str, float]]:
        for i, j, r in zip(self.first, self.second, self.corr):
            yield self.columns[i], self.columns[j], float(r)


def strong_pairs(df: DataFrame, cols: list[str], wanted: Column, moments: dict | None = None) -> StrongPairs:
    """The pairs whose ``corr`` is ``wanted``, filtered on the executors and fetched as columns of numbers."""
    found = correlations(df, cols, moments).filter(wanted).toArrow()
    return StrongPairs.of(cols, *(found.column(c).to_numpy() for c in ("i", "j", "corr")))


def correlation_table(df: DataFrame, cols: list[str] | None = None, moments: dict | None = None) -> DataFrame:
    """``(column_a, column_b, corr)`` for every pair in column order; undefined pairs are left out."""
    cols = cols if cols is not None else columns_of(df, NUMERICAL)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, corr double")
    names = F.array(*[F.lit(c) for c in cols])
    return correlations(df, cols, moments).select(names[F.col("i")].alias("column_a"), names[F.col("j")].alias("column_b"), "corr")


def correlations(df: DataFrame, cols: list[str], moments: dict | None = None) -> DataFrame:
    """``(i, j, corr)`` for every defined pair, columns by their places in ``cols``."""
    spark = df.sparkSession
    moments = moments or column_moments(df, cols)
    varying = [c for c in cols if moments[c]["min"] is not None and moments[c]["min"] != moments[c]["max"]]
    if len(varying) < 2:
        return spark.createDataFrame([], "i int, j int, corr double")
    at = {c: i for i, c in enumerate(cols)}
    place = [at[c] for c in varying]
    centred = df.select(
        *[(as_double(df, c) - F.lit(float(moments[c]["mean"]))).alias(str(i)) for i, c in enumerate(varying)]
    )
    # every task sends one row per pair: wide tables are read by fewer, longer tasks
    tasks = max(spark.sparkContext.defaultParallelism, 2 * PARTIAL_ROWS // len(varying) ** 2)
    ship_package(spark)
    sums = (
        centred.coalesce(tasks)
        .mapInPandas(_partial_sums, PARTIAL_SCHEMA)
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    )
    n = F.col("n")
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    var_x = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    var_y = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    # rounding can leave a tiny non-zero variance where the shared rows are constant
    steady = (var_x > F.col("sxx") * 1e-14) & (var_y > F.col("syy") * 1e-14)
    r = F.when(steady & (n > 1), F.try_divide(cov, F.sqrt(var_x) * F.sqrt(var_y)))
    places = F.array(*[F.lit(p) for p in place])
    return (
        sums.select(places[F.col("i")].alias("i"), places[F.col("j")].alias("j"), r.alias("corr"))
        .filter("corr is not null")
        .withColumn("corr", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "corr")))
    )
