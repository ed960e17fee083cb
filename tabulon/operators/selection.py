"""Feature selection: missing share, variance, mutual correlation."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import NUMERICAL, col, columns_of
from tabulon.operators.correlation import StrongPairs, column_moments, strong_pairs
from tabulon.operators.stats import aggregate_in_chunks
from tabulon.session import run_together

MAX_MISSING = 0.5
MIN_VARIANCE = 0.01
MAX_CORR = 0.95


@dataclass
class Selection:
    data: DataFrame
    row_count: int
    removed: list[str] = field(default_factory=list)
    log: list[tuple[str, str, str]] = field(default_factory=list)


def missing_shares(df: DataFrame) -> tuple[int, dict[str, float]]:
    expressions = {"rows": F.count(F.lit(1))}
    expressions.update({str(i): F.count_if(col(c).isNull()) for i, c in enumerate(df.columns)})
    row = aggregate_in_chunks(df, expressions)
    n = int(row["rows"])
    return n, {c: row[str(i)] / n if n else 0.0 for i, c in enumerate(df.columns)}


def eliminate(pairs: StrongPairs, variances: dict[str, float | None]) -> list[str]:
    """Walk the columns in order; of a too similar pair the one with less variance goes.

    A column that loses to a later one keeps comparing for the rest of its turn.  Only the partners of a column are looked
    at, which lie together in the sorted pairs, so memory and time follow the number of strong pairs.
    """
    cols = pairs.columns
    variance = np.array([np.nan if variances[c] is None else variances[c] for c in cols], dtype=float)
    gone = np.zeros(len(cols), dtype=bool)
    edges = np.searchsorted(pairs.first, np.arange(len(cols) + 1))
    for i in np.flatnonzero(np.diff(edges)):
        if gone[i] or np.isnan(variance[i]):
            continue
        partners = pairs.second[edges[i] : edges[i + 1]]
        partners = partners[~gone[partners] & ~np.isnan(variance[partners])]
        weaker = variance[i] >= variance[partners]
        gone[partners[weaker]] = True
        gone[i] = not weaker.all()
    return [c for c, g in zip(cols, gone) if g]


def correlated_to_remove(cols: list[str], pairs: dict[tuple[str, str], float], variances: dict[str, float | None], limit: float = MAX_CORR) -> list[str]:
    """``eliminate`` for pairs given by name."""
    place = {c: i for i, c in enumerate(cols)}
    strong = [(place[a], place[b], r) for (a, b), r in pairs.items() if abs(r) > limit]
    return eliminate(StrongPairs.of(cols, *zip(*strong)), variances) if strong else []


def select_features(df: DataFrame, protect: list[str] | None = None) -> Selection:
    """Drop sparse, then nearly constant, then mutually correlated columns."""
    keep = set(protect or [])
    numeric = columns_of(df, NUMERICAL)
    (n, missing), moments = run_together(lambda: missing_shares(df), lambda: column_moments(df, numeric))
    result = Selection(df, n)
    if n == 0:
        return result

    def drop(names: list[str], operation: str, strategy: str, detail: str) -> None:
        names = [c for c in names if c not in keep]
        if names:
            gone = set(names)
            result.data = result.data.select(*[col(c) for c in result.data.columns if c not in gone])
            result.removed.extend(names)
            result.log.append((operation, strategy, detail.format(len(names))))

    drop([c for c in df.columns if missing[c] > MAX_MISSING], "missing_value_filter", "remove_gt_50_pct_missing",
         "Removed {} columns with >50% missing values.")
    numeric = columns_of(result.data, NUMERICAL)
    if n == 1 or not numeric:
        return result
    variances = {c: moments[c]["variance"] for c in numeric}
    drop([c for c in numeric if variances[c] is not None and variances[c] < MIN_VARIANCE], "variance_threshold",
         "remove_low_variance", "Removed {} columns with variance < 0.01.")
    numeric = columns_of(result.data, NUMERICAL)
    if len(numeric) >= 2:
        drop(eliminate(strong_pairs(result.data, numeric, F.abs("corr") > MAX_CORR, moments), variances), "correlation_filter", "remove_high_correlation",
             "Removed {} highly correlated columns (>0.95).")
    return result
