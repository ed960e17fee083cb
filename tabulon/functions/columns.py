"""Column classes and column-level helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERICAL = "numerical"
DATETIME = "datetime"
BOOLEAN = "boolean"
CATEGORICAL = "categorical"


def column_class(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERICAL
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    return CATEGORICAL


def columns_of(df: DataFrame, *classes: str) -> list[str]:
    return [f.name for f in df.schema.fields if column_class(f.dataType) in classes]


def col(name: str) -> Column:
    """A column reference that survives dots and other special characters in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold_nan(df: DataFrame) -> DataFrame:
    """Make NaN a plain null, so that one notion of "missing" is left."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns]
    )


def safe_double(c: Column) -> Column:
    """NaN and infinities become null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def as_text(df: DataFrame, name: str) -> Column:
    """String form of any column; nested values become JSON."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col(name))
    if isinstance(dtype, T.BinaryType):
        return F.hex(col(name))
    return col(name).cast("string")


COMPACT_ABOVE = 64


def compact_text(text: Column) -> Column:
    """Long texts as a digest: enough to tell values apart, and of bounded size."""
    return F.when(F.length(text) > COMPACT_ABOVE, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


def as_double(df: DataFrame, name: str) -> Column:
    """Numbers and booleans as doubles, dates and timestamps as epoch seconds."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        return F.unix_micros(col(name).cast("timestamp")) / F.lit(1e6)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col(name)) / F.lit(1e6)
    return col(name).cast("double")


def fixed_width(dtype: T.DataType) -> int | None:
    """Bytes per value for fixed-width types, None for variable-width ones."""
    widths = {
        T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4,
        T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8,
    }
    if isinstance(dtype, T.DecimalType):
        return 8 if dtype.precision <= 18 else 16
    return widths.get(type(dtype))


def row_hashes(df: DataFrame, cols: list[str] | None = None) -> list[Column]:
    """Two independently seeded 64-bit hashes over all columns of a row.

    Used as a 128-bit row identity, so that counting distinct rows shuffles 16
    bytes per row and not the row.  The hash functions skip nulls, therefore the
    null pattern is hashed too; they already treat 0.0 and -0.0 as equal.
    """
    names = cols or df.columns
    parts, nulls = [], []
    for name in names:
        nested = isinstance(df.schema[name].dataType, (T.MapType, T.ArrayType, T.StructType))
        parts.append(as_text(df, name) if nested else col(name))
        nulls.append(F.when(col(name).isNull(), F.lit("1")).otherwise(F.lit("0")))
    pattern = F.concat(*nulls)
    return [
        F.xxhash64(pattern, *parts).alias("row_hash_a"),
        F.xxhash64(F.lit(7919), *parts, pattern).alias("row_hash_b"),
    ]
