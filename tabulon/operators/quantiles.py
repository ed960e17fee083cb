"""Exact interpolated quantiles of many columns without a sort and without a big group.

The built-in exact ``percentile`` keeps every distinct value of a column in one
task.  Here each pass counts rows per bucket instead: the first pass uses
logarithmic buckets (256 per power of two, so outliers cannot spoil them), later
passes split only the buckets that hold a wanted rank.  Buckets carry their exact
smallest and largest value; a bucket with one value, for instance a hot value that
fills a third of the table, is an answer at once.  When the wanted buckets hold
few rows, every distinct value becomes a bucket.  Typical tables need two passes.

Buckets stay on the executors: running sums over a column's buckets in order tell
which of them holds a wanted rank, and only those reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tabulon.functions.columns import as_double

BUCKETS_PER_OCTAVE = 256
LINEAR_BUCKETS = 4096
FINISH_ROWS = 100_000


@dataclass(frozen=True)
class Bracket:
    """A value range of one column: ``below`` rows are smaller, ``rows`` lie inside."""

    column: str
    low: float
    high: float
    below: int
    rows: int


def _log_bucket(x: Column) -> Column:
    """A bucket number that never decreases as x grows."""
    magnitude = F.abs(x)
    octave = F.floor(F.log2(magnitude))
    step = F.floor((magnitude / F.pow(F.lit(2.0), octave) - 1) * BUCKETS_PER_OCTAVE)
    number = (octave + 1100) * BUCKETS_PER_OCTAVE + step
    limit = F.lit(10_000_000)
    infinite = magnitude == F.lit(float("inf"))
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * F.when(infinite, limit).otherwise(number)).cast("bigint")


def _count_buckets(long_form: DataFrame, *keys: str) -> DataFrame:
    return long_form.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"))


def _holding(buckets: DataFrame, group: str, wanted: DataFrame, ranks: Column) -> list[Row]:
    """``grp, rank, n, below, rows, low, high`` of the bucket that holds each wanted rank.

    ``ranks`` is an array over the columns of ``wanted`` (a row per group) and ``n``, the number of rows of the group.  A group has a bounded
    number of buckets, whatever the number of rows; the driver receives one row per rank.
    """
    whole = Window.partitionBy(group)
    before = whole.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    summed = buckets.withColumns({"below": F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long")), "n": F.sum("rows").over(whole)})
    ranked = summed.join(F.broadcast(wanted), group).withColumn("rank", F.explode(ranks))
    hit = (F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("rows"))
    return ranked.filter(hit).select(F.col(group).alias("grp"), "rank", "n", "below", "rows", "low", "high").distinct().collect()


def _long_form(df: DataFrame, cols: list[str]) -> DataFrame:
    places = [str(i) for i in range(len(cols))]
    values = df.select(*[as_double(df, c).alias(p) for p, c in zip(places, cols)])
    return values.unpivot([], places, "c", "x").filter(F.col("x").isNotNull() & ~F.isnan("x"))


def _inside(df: DataFrame, brackets: list[Bracket]) -> DataFrame:
    """Rows inside any bracket as ``(b, low, high, x)``; brackets of a column do not overlap."""
    any_hit, entries = F.lit(False), []
    for i, b in enumerate(brackets):
        x = as_double(df, b.column)
        hit = x.between(F.lit(b.low), F.lit(b.high))
        any_hit = any_hit | hit
        entries.append(F.when(hit, F.struct(F.lit(i).alias("b"), F.lit(b.low).alias("low"), F.lit(b.high).alias("high"), x.alias("x"))))
    hits = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return df.filter(any_hit).select(F.explode(hits).alias("e")).select("e.*")


def _settle(column: str, held: list[Row], offset: int, found: dict) -> list[Bracket]:
    """Answer the ranks that fall on a bucket edge and return brackets for the others."""
    narrowed = []
    for r in held:
        start, rank = offset + r["below"], offset + r["rank"]
        if r["rank"] == r["below"] or r["low"] == r["high"]:
            found[column, rank] = r["low"]
        elif r["rank"] == r["below"] + r["rows"] - 1:
            found[column, rank] = r["high"]
        else:
            bracket = Bracket(column, r["low"], r["high"], start, r["rows"])
            if bracket not in narrowed:
                narrowed.append(bracket)
    return narrowed


def _rank_of(p: float, n: int) -> tuple[int, int, float]:
    position = p * (n - 1)
    low = math.floor(position)
    return low, min(low + 1, n - 1), position - low


def exact_quantiles(
    df: DataFrame, probs: dict[str, list[float]], finish_rows: int = FINISH_ROWS
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles ``{column: [value per probability]}``; None without values."""
    cols = list(probs)
    if not cols:
        return {}
    spark = df.sparkSession
    log_form = _long_form(df, cols).select(F.col("c").cast("int").alias("c"), _log_bucket(F.col("x")).alias("bucket"), "x")
    counted = _count_buckets(log_form, "c", "bucket")
    # ranks follow from the number of values, which only the executors know as yet
    shares = spark.createDataFrame([(i, [float(p) for p in probs[c]]) for i, c in enumerate(cols)], "c int, shares array<double>")
    low = lambda p: F.floor(p * (F.col("n") - 1))
    ranks = F.array_distinct(F.flatten(F.transform("shares", lambda p: F.array(low(p), F.least(low(p) + 1, F.col("n") - 1)))))
    sizes: dict[str, int] = dict.fromkeys(cols, 0)
    found: dict[tuple[str, int], float] = {}
    per_column: dict[str, list[Row]] = {c: [] for c in cols}
    for r in _holding(counted, "c", shares, ranks):
        per_column[cols[r["grp"]]].append(r)
        sizes[cols[r["grp"]]] = r["n"]
    wanted = {c: {r["rank"] for r in per_column[c]} for c in cols}
    open_brackets = [b for c in cols for b in _settle(c, per_column[c], 0, found)]

    while open_brackets:
        rows = _inside(df, open_brackets)
        if sum(b.rows for b in open_brackets) <= finish_rows:
            # few rows are left: every distinct value is a bucket of its own
            counted = _count_buckets(rows, "b", "x")
        else:
            # low and high share sign and octave, so the difference is finite and not zero
            place = F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * LINEAR_BUCKETS)
            counted = _count_buckets(rows.select("b", place.alias("place"), "x"), "b", "place")
        inner = [(i, [r - b.below for r in sorted(wanted[b.column]) if b.below <= r < b.below + b.rows]) for i, b in enumerate(open_brackets)]
        held = _holding(counted, "b", spark.createDataFrame(inner, "b int, inner array<bigint>"), F.col("inner"))
        narrowed = []
        for i, b in enumerate(open_brackets):
            narrowed += _settle(b.column, [r for r in held if r["grp"] == i], b.below, found)
        open_brackets = narrowed

    out: dict[str, list[float | None]] = {}
    for c in cols:
        values: list[float | None] = []
        for p in probs[c]:
            if not sizes[c]:
                values.append(None)
                continue
            low, high, t = _rank_of(p, sizes[c])
            a, b = found[c, low], found[c, high]
            values.append(a if t == 0 or a == b else a + (b - a) * t)
        out[c] = values
    return out


def approximate_quantiles(df: DataFrame, probs: dict[str, list[float]], accuracy: int = 1000) -> dict[str, list[float | None]]:
    """Sketch-based quantiles in one scan, for when a rank error of 1/accuracy is enough."""
    cols = list(probs)
    if not cols:
        return {}
    row = df.agg(
        *[F.percentile_approx(as_double(df, c), list(map(float, probs[c])), accuracy).alias(str(i)) for i, c in enumerate(cols)]
    ).first()
    return {c: list(row[i]) if row[i] is not None else [None] * len(probs[c]) for i, c in enumerate(cols)}
