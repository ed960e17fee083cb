"""Exact train/test split by content hash, the same on any partitioning.

Every row gets an md5 over its key columns and a seed; the test set is the wanted
number of smallest hashes (per class when stratified).  The boundary hash is found
by counting rows per hash prefix, so nothing is sorted: the split itself is a
comparison with a literal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.columns import as_text, col, column_class, row_hashes, BOOLEAN, NUMERICAL
from tabulon.operators.ranking import number_in_order, number_rows, number_within

SPLIT = "__split__"
DRIVER_CLASSES = 100_000  # quotas of more classes stay in a table
PREFIX_GROUPS = 1_000_000
CASE_CLASSES = 64
TIE_ROWS = 1_000_000
AFTER_HEX = "g"  # sorts behind every hexadecimal digit


@dataclass
class Cut:
    """Hashes below ``bound`` are test rows, and ``tie_take`` of the rows equal to ``tie_hash``."""

    bound: str
    tie_hash: str | None = None
    tie_take: int = 0
    tie_rows: int = 0


def split_hash(df: DataFrame, key: list[str] | None, seed: int) -> Column:
    names = key or df.columns
    return F.md5(F.concat_ws(":", *[as_text(df, c) for c in names], F.lit(str(seed))))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(as_text(df, target).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def stratifiable(df: DataFrame, target: str, counts: DataFrame | None = None) -> bool:
    """Numeric and boolean targets never; others if there are several classes of two rows or more."""
    if column_class(df.schema[target].dataType) in (NUMERICAL, BOOLEAN):
        return False
    counts = counts if counts is not None else class_counts(df, target)
    row = counts.agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest")).first()
    return row["classes"] > 1 and row["smallest"] >= 2


def allocate(sizes: dict[str, int], test_rows: int) -> dict[str, int]:
    """Test rows per class by largest remainder, ties in class order; integer arithmetic only."""
    total = sum(sizes.values())
    quota = {c: test_rows * n // total for c, n in sizes.items()}
    by_remainder = sorted(sizes, key=lambda c: (-(test_rows * sizes[c] % total), c))
    for c in by_remainder[: test_rows - sum(quota.values())]:
        quota[c] += 1
    return quota


def _class_matches(column: Column, names: list[str], values: dict[str, Column]) -> Column:
    out = None
    for c in names:
        out = F.when(column == F.lit(c), values[c]) if out is None else out.when(column == F.lit(c), values[c])
    return out


def find_cuts(hashed: DataFrame, quotas: dict[str, int]) -> dict[str, Cut]:
    """Narrow the hash prefix of each class until it holds exactly the wanted number of rows.

    ``hashed`` has ``_class`` and ``_h``.  Every round collects at most
    ``PREFIX_GROUPS`` prefix counts and divides the open rows by 16 to 65536.
    """
    spark = hashed.sparkSession
    width = max(1, min(4, int(math.log(PREFIX_GROUPS / max(1, len(quotas)), 16))))
    cuts = {c: Cut("") for c, q in quotas.items() if q == 0}
    open_classes = {c: ("", q) for c, q in quotas.items() if q > 0}
    length = 0
    while open_classes:
        prefix = F.substring("_h", 1, length)
        if length == 0:
            rows = hashed
        else:
            wanted = [(c, p) for c, (p, _) in open_classes.items()]
            frame = spark.createDataFrame(wanted, "_class string, _prefix string")
            rows = hashed.withColumn("_prefix", prefix).join(F.broadcast(frame), ["_class", "_prefix"])
        length = min(32, length + width)
        counted = rows.groupBy("_class", F.substring("_h", 1, length).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        per_class: dict[str, list] = {c: [] for c in open_classes}
        for r in counted.collect():
            if r["_class"] in per_class:
                per_class[r["_class"]].append((r["p"], r["n"]))
        still_open = {}
        for c, (_, remaining) in open_classes.items():
            for p, n in sorted(per_class[c]):
                if n < remaining:
                    remaining -= n
                elif n == remaining:
                    cuts[c] = Cut(p + AFTER_HEX)
                    break
                elif length == 32:
                    cuts[c] = Cut(p, p, remaining, n)
                    break
                else:
                    still_open[c] = (p, remaining)
                    break
        open_classes = still_open
    return cuts


def _split_ties(ties: DataFrame, cuts: dict[str, Cut], columns: list[str]) -> DataFrame:
    """Rows that share the boundary hash: take the wanted number of them, whichever copies."""
    biggest = max(c.tie_rows for c in cuts.values())
    pieces = []
    if biggest <= TIE_ROWS:
        take = _class_matches(F.col("_class"), list(cuts), {c: F.lit(k.tie_take) for c, k in cuts.items()})
        rank = F.row_number().over(Window.partitionBy("_class").orderBy("_ra", "_rb"))
        return ties.withColumn(SPLIT, F.when(rank <= take, "test").otherwise("train")).select(SPLIT, *[col(c) for c in columns])
    for c, cut in cuts.items():
        numbered = number_rows(ties.filter(F.col("_class") == F.lit(c)), "_rank")
        pieces.append(numbered.withColumn(SPLIT, F.when(F.col("_rank") < cut.tie_take, "test").otherwise("train")))
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out.select(SPLIT, *[col(c) for c in columns])


@dataclass
class SplitResult:
    data: DataFrame
    stratified: bool
    test_rows: int
    train_rows: int
    note: str | None = None


def _split_many_classes(df: DataFrame, row_hash: Column, label: Column, counts: DataFrame, classes: int, n: int, test_rows: int) -> SplitResult:
    """The same stratified split with the quotas in a table: rows are numbered within their class by hash."""
    exact = F.col("n").cast("decimal(38,0)") * F.lit(test_rows)
    shares = counts.select("class", "n", F.floor(exact / F.lit(n)).cast("long").alias("quota"))
    shares = shares.withColumn("left", (exact - F.col("quota").cast("decimal(38,0)") * F.lit(n)).cast("decimal(38,0)")).withColumn("order", -F.col("left"))
    facts = shares.agg(F.sum("quota").alias("given"), F.max("n").alias("largest")).first()
    placed = number_in_order(shares, ["order", "class"], "place", classes)
    quotas = placed.select(F.col("class").alias("_quota_class"), (F.col("quota") + (F.col("place") < test_rows - facts["given"]).cast("long")).alias("_quota"))
    a, b = row_hashes(df)
    hashed = df.withColumns({"_h": row_hash, "_class": label, "_ra": a, "_rb": b})
    numbered = number_within(hashed, ["_class"], [F.col("_h"), F.col("_ra"), F.col("_rb")], "_rank", facts["largest"])
    tagged = numbered.join(quotas, F.col("_class") == F.col("_quota_class"))
    side = F.when(F.col("_rank") < F.col("_quota"), "test").otherwise("train").alias(SPLIT)
    return SplitResult(tagged.select(side, *[col(c) for c in df.columns]), True, test_rows, n - test_rows)


def train_test_split(
    df: DataFrame,
    test_size: float = 0.20,
    seed: int = 42,
    key: list[str] | None = None,
    target: str | None = None,
    row_count: int | None = None,
    driver_classes: int = DRIVER_CLASSES,
) -> SplitResult:
    """Tag every row ``train`` or ``test`` in ``__split__``; exactly ``ceil(test_size * n)`` are test.

    ``key`` should identify a row; without it the whole row is hashed.  With
    ``target`` the split is stratified if the target allows it.
    """
    n = row_count if row_count is not None else df.count()
    test_rows = math.ceil(test_size * n)
    sizes, note = {"": n}, None
    stratified = False
    if target is not None and column_class(df.schema[target].dataType) not in (NUMERICAL, BOOLEAN):
        counts = class_counts(df, target)
        facts = counts.agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest")).first()
        if facts["classes"] > 1 and facts["smallest"] >= 2:
            if facts["classes"] > min(test_rows, n - test_rows):
                note = "fewer test or train rows than classes: split without stratification"
            elif facts["classes"] > driver_classes:
                return _split_many_classes(df, split_hash(df, key, seed), as_text(df, target), counts, int(facts["classes"]), n, test_rows)
            else:
                sizes = {r["class"]: r["n"] for r in counts.collect()}
                stratified = True
    label = as_text(df, target) if stratified else F.lit("")
    hashed = df.withColumns({"_h": split_hash(df, key, seed), "_class": label})
    cuts = find_cuts(hashed.select("_class", "_h"), allocate(sizes, test_rows))

    if len(cuts) <= CASE_CLASSES:
        bound = _class_matches(F.col("_class"), list(cuts), {c: F.lit(k.bound) for c, k in cuts.items()})
        tagged = hashed.withColumn("_bound", bound)
    else:
        # at most DRIVER_CLASSES rows
        frame = df.sparkSession.createDataFrame([(c, k.bound) for c, k in cuts.items()], "_class string, _bound string")
        tagged = hashed.join(F.broadcast(frame), "_class", "left")
    split = F.when(F.col("_h") < F.col("_bound"), "test").otherwise("train").alias(SPLIT)
    ties = {c: k for c, k in cuts.items() if k.tie_hash is not None}
    if not ties:
        data = tagged.select(split, *[col(c) for c in df.columns])
    else:
        tie_pairs = df.sparkSession.createDataFrame([(c, k.tie_hash) for c, k in ties.items()], "_class string, _h string")
        a, b = row_hashes(df)
        tie_rows = tagged.join(F.broadcast(tie_pairs), ["_class", "_h"], "left_semi").withColumns({"_ra": a, "_rb": b})
        others = tagged.join(F.broadcast(tie_pairs), ["_class", "_h"], "left_anti").select(split, *[col(c) for c in df.columns])
        data = others.unionByName(_split_ties(tie_rows, ties, df.columns))
    return SplitResult(data, stratified, test_rows, n - test_rows, note)
