"""The shared statistics of a table: one scalar pass, one count shuffle, a few quantile passes.

Only what a caller asks for is computed.  The outcome is one small record per
column, so everything built on it (profile, quality rules, cleaning and feature
decisions) is independent of the number of rows.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import CATEGORICAL, DATETIME, NUMERICAL, as_double, as_text, col, column_class, fixed_width
from tabulon.functions.text import is_blank
from tabulon.operators.counts import approximate_cardinalities, cardinalities, distinct_row_count, top_values
from tabulon.operators.quantiles import approximate_quantiles, exact_quantiles
from tabulon.session import run_together

# Wider aggregates exceed what the JVM compiles to machine code and get several times slower.
EXPRESSIONS_PER_PASS = 48


@dataclass
class ColumnStats:
    name: str
    position: int
    data_type: str
    dtype: str
    row_count: int = 0
    null_count: int = 0
    distinct_count: int | None = None
    top_count: int | None = None
    negative_count: int = 0
    blank_count: int = 0
    value_bytes: int = 0
    min_value: float | None = None
    max_value: float | None = None
    mean: float | None = None
    stddev: float | None = None
    variance: float | None = None
    q1: float | None = None
    median: float | None = None
    q3: float | None = None
    outlier_count: int | None = None
    lower_bound: float | None = None
    upper_bound: float | None = None
    min_date: str | None = None
    max_date: str | None = None
    top: list[tuple[str, int]] = field(default_factory=list)

    @property
    def non_null_count(self) -> int:
        return self.row_count - self.null_count

    @property
    def iqr(self) -> float | None:
        return None if self.q1 is None else self.q3 - self.q1


@dataclass
class TableStats:
    row_count: int
    columns: list[ColumnStats]
    distinct_rows: int | None = None

    @property
    def duplicate_count(self) -> int | None:
        return None if self.distinct_rows is None else self.row_count - self.distinct_rows

    def column(self, name: str) -> ColumnStats:
        return next(c for c in self.columns if c.name == name)


def _finite(value: float | None) -> float | None:
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return None
    return float(value)


def aggregate_in_chunks(df: DataFrame, expressions: dict[str, Column]) -> dict[str, object]:
    """Evaluate many global aggregates named ``stat:column``, about ``EXPRESSIONS_PER_PASS`` per job.

    A column's expressions stay together, so the jobs read disjoint columns and
    the table is read once in total.
    """
    chunks: list[list[str]] = []
    for _, names in itertools.groupby(expressions, key=lambda n: n.rpartition(":")[2]):
        mine = list(names)
        if chunks and len(chunks[-1]) + len(mine) <= EXPRESSIONS_PER_PASS:
            chunks[-1].extend(mine)
        else:
            chunks.append(mine)
    rows = run_together(*[partial(_one_row, df, {n: expressions[n] for n in chunk}) for chunk in chunks])
    return {name: value for row in rows for name, value in row.items()}


def _one_row(df: DataFrame, expressions: dict[str, Column]) -> dict[str, object]:
    return df.agg(*[e.alias(n) for n, e in expressions.items()]).first().asDict()


def _scalar_expressions(df: DataFrame, groups: set[str]) -> dict[str, Column]:
    expressions: dict[str, Column] = {"rows": F.count(F.lit(1))}
    for i, f in enumerate(df.schema.fields):
        c, kind = col(f.name), column_class(f.dataType)
        expressions[f"null_count:{i}"] = F.count_if(c.isNull())
        if "bytes" in groups and fixed_width(f.dataType) is None:
            expressions[f"value_bytes:{i}"] = F.sum(F.octet_length(as_text(df, f.name)).cast("bigint"))
        if kind == NUMERICAL:
            x = as_double(df, f.name)
            if "moments" in groups:
                expressions[f"min_value:{i}"] = F.min(x)
                expressions[f"max_value:{i}"] = F.max(x)
                expressions[f"mean:{i}"] = F.avg(x)
                expressions[f"variance:{i}"] = F.var_samp(x)
            if "negatives" in groups:
                expressions[f"negative_count:{i}"] = F.count_if(c < 0)
        elif kind == DATETIME and "dates" in groups:
            expressions[f"min_date:{i}"] = F.min(c).cast("string")
            expressions[f"max_date:{i}"] = F.max(c).cast("string")
        elif kind == CATEGORICAL and "blanks" in groups and isinstance(f.dataType, T.StringType):
            expressions[f"blank_count:{i}"] = F.count_if(is_blank(c))
    return expressions


SCALAR_GROUPS = frozenset({"moments", "negatives", "dates", "blanks", "bytes"})
ALL_GROUPS = SCALAR_GROUPS | {"distinct", "duplicates", "quantiles", "outliers", "top"}


def collect_stats(
    df: DataFrame,
    groups: set[str] | frozenset[str] = ALL_GROUPS,
    top_k: int = 10,
    approximate: bool = False,
    text_columns: list[str] | None = None,
) -> TableStats:
    """Compute the asked ``groups`` of statistics for every column of ``df``.

    ``approximate=True`` uses sketches for quantiles and distinct counts; columns
    named in ``text_columns`` are always counted by sketch and have no top values.
    """
    groups = set(groups)
    fields = df.schema.fields
    sketched = set(text_columns or [])
    columns = [
        ColumnStats(f.name, i, column_class(f.dataType), f.dataType.simpleString()) for i, f in enumerate(fields)
    ]

    names = [c.name for c in columns]
    categorical = [c.name for c in columns if c.data_type == CATEGORICAL and c.name not in sketched]
    roughly = names if approximate else [n for n in names if n in sketched]
    exactly = [n for n in names if n not in roughly]
    probs = {c.name: [0.25, 0.5, 0.75] for c in columns if c.data_type == NUMERICAL}
    quantiles = approximate_quantiles if approximate else exact_quantiles

    # None of these needs another's result.
    wanted = {"scalars": lambda: aggregate_in_chunks(df, _scalar_expressions(df, groups))}
    if "distinct" in groups and exactly:
        wanted["distinct"] = lambda: cardinalities(df, exactly).collect()
    if "distinct" in groups and roughly:
        wanted["roughly"] = lambda: approximate_cardinalities(df, roughly)
    if "duplicates" in groups:
        wanted["duplicates"] = lambda: int(distinct_row_count(df).first()["distinct_count"])
    if "top" in groups and categorical:
        wanted["top"] = lambda: top_values(df, categorical, top_k).collect()
    if groups & {"quantiles", "outliers"} and probs:
        wanted["quantiles"] = lambda: quantiles(df, probs)
    found = dict(zip(wanted, run_together(*wanted.values())))

    scalars = found["scalars"]
    row_count = int(scalars.pop("rows"))
    for c in columns:
        c.row_count = row_count
        width = fixed_width(fields[c.position].dataType)
        if width is not None:
            c.value_bytes = width * row_count
    for key, value in scalars.items():
        stat, i = key.split(":")
        target = columns[int(i)]
        if stat.endswith(("_count", "_bytes")):
            setattr(target, stat, int(value or 0))
        elif stat.endswith("_date"):
            setattr(target, stat, value)
        else:
            setattr(target, stat, _finite(value))
            if stat == "variance" and target.variance is not None:
                target.stddev = math.sqrt(target.variance)

    table = TableStats(row_count, columns, found.get("duplicates"))
    by_name = {c.name: c for c in columns}
    if "distinct" in groups:
        for c in columns:
            c.distinct_count = 0
        for name, n in found.get("roughly", {}).items():
            by_name[name].distinct_count = n
        for r in found.get("distinct", []):
            by_name[r["column"]].distinct_count, by_name[r["column"]].top_count = r["distinct_count"], r["top_count"]
    for r in sorted(found.get("top", []), key=lambda r: (r["column"], r["rank"])):
        by_name[r["column"]].top.append((r["value"], r["n"]))
    for name, quarters in found.get("quantiles", {}).items():
        target = by_name[name]
        target.q1, target.median, target.q3 = map(_finite, quarters)
        if target.q1 is None or target.q3 is None:
            target.q1 = target.q3 = None
    if "outliers" in groups:
        _count_outliers(df, table)
    return table


def _count_outliers(df: DataFrame, table: TableStats) -> None:
    """Bounds are literals by now; the count is one more conditional aggregate."""
    expressions = {}
    for c in table.columns:
        if c.q1 is None:
            continue
        c.lower_bound = c.q1 - 1.5 * c.iqr
        c.upper_bound = c.q3 + 1.5 * c.iqr
        x = as_double(df, c.name)
        expressions[str(c.position)] = F.count_if((x < F.lit(c.lower_bound)) | (x > F.lit(c.upper_bound)))
    if expressions:
        for i, n in aggregate_in_chunks(df, expressions).items():
            table.columns[int(i)].outlier_count = int(n)
