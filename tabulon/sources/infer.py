"""NA-token folding and type inference over columns that were read as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import col

# Texts that mean "missing" in a delimited file.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

INTEGER = r"^\s*[+-]?\d+\s*$"
FLOAT = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|Inf|INF|infinity|Infinity)\s*$"
# The spellings that make a column boolean.
BOOLEANS = ["True", "False", "TRUE", "FALSE", "true", "false"]


def fold_na(c: Column) -> Column:
    """NA tokens become null; anything else, blanks included, stays."""
    return F.when(~c.isin(NA_TOKENS), c)


def fold_na_columns(df: DataFrame) -> DataFrame:
    strings = {n for n, t in df.dtypes if t == "string"}
    return df.select(*[fold_na(col(c)).alias(c) if c in strings else col(c) for c in df.columns])


def _as_integer(c: Column) -> Column:
    return F.when(c.rlike(INTEGER), F.trim(c).try_cast("bigint"))


def _as_float(c: Column) -> Column:
    return F.when(c.rlike(FLOAT), F.trim(c).try_cast("double"))


def number_of_text(c: Column) -> Column:
    """The number a text spells, null for anything else (a cast alone would take "12d" or "1f")."""
    return F.when(c.rlike(INTEGER) | c.rlike(FLOAT), F.trim(c).try_cast("double"))


# what all values of a column so far have in common, a bit each
WHOLE, NUMBER, TRUTH, NO_GAP, NO_VALUE = 1, 2, 4, 8, 16
BITS = 5
COLUMNS_PER_MASK = 12  # of five bits each, in a long


def _mask(v: Column) -> Column:
    """The bits of one value; a gap agrees with every type."""
    bit = lambda test, number: F.when(test, F.lit(number)).otherwise(F.lit(0))
    kinds = bit(_as_integer(v).isNotNull(), WHOLE).bitwiseOR(bit(_as_float(v).isNotNull(), NUMBER)).bitwiseOR(bit(v.isin(BOOLEANS), TRUTH))
    return F.when(v.isNull(), F.lit(WHOLE | NUMBER | TRUTH | NO_VALUE)).otherwise(kinds.bitwiseOR(F.lit(NO_GAP))).cast("bigint")


def type_of_mask(mask: int) -> str:
    if mask & NO_VALUE:
        return "double"
    if mask & WHOLE and mask & NO_GAP:
        return "bigint"
    if mask & NUMBER:
        return "double"
    return "boolean" if mask & TRUTH and mask & NO_GAP else "string"


def type_masks(df: DataFrame) -> DataFrame:
    """One row of longs, each with the common bits of twelve columns.

    Masks of rows, tasks or files merge by a bitwise and, so one aggregate over the source, which is parsed once however
    many columns it has, decides all types.
    """
    # one function over an array: written out for every column, the test would exceed what Spark compiles
    values = F.array(*[col(c).cast("string") for c in df.columns])
    each = df.select(F.transform(values, lambda v: _mask(fold_na(v))).alias("masks"))
    packed = []
    for low in range(0, len(df.columns), COLUMNS_PER_MASK):
        part = F.lit(0).cast("bigint")
        for place in range(min(COLUMNS_PER_MASK, len(df.columns) - low)):
            part = part.bitwiseOR(F.shiftleft(F.get("masks", F.lit(low + place)), place * BITS))
        packed.append(part.alias(f"m{low // COLUMNS_PER_MASK}"))
    masks = each.select(*packed)
    return masks.agg(*[F.bit_and(m).alias(m) for m in masks.columns])


def infer_types(df: DataFrame) -> dict[str, str]:
    """``bigint``, ``double``, ``boolean`` or ``string`` per text column, from one aggregate over all rows.

    Whole numbers next to gaps become double, booleans next to gaps stay text,
    a column without values is double; dates stay text.
    """
    if not df.columns:
        return {}
    masks = type_masks(df).first()
    if masks[0] is None:  # no rows at all
        return dict.fromkeys(df.columns, "double")
    place = lambda i: masks[i // COLUMNS_PER_MASK] >> i % COLUMNS_PER_MASK * BITS
    return {c: type_of_mask(place(i) & 31) for i, c in enumerate(df.columns)}


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    out = []
    for c in df.columns:
        v = fold_na(col(c).cast("string"))
        if types[c] == "bigint":
            v = _as_integer(v)
        elif types[c] == "double":
            v = _as_float(v)
        elif types[c] == "boolean":
            v = F.when(v.isNotNull(), F.lower(v) == "true")
        out.append(v.alias(c))
    return df.select(*out)


def infer(df: DataFrame) -> DataFrame:
    """Fold NA tokens and type all text columns."""
    return apply_types(df, infer_types(df))
