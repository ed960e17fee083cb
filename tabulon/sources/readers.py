"""Reading tables by file extension."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import col, fold_nan
from tabulon.sources.infer import fold_na_columns, infer


class IngestionError(ValueError):
    pass


_MALFORMED = "_malformed_record"


def _refuse_surplus(df: DataFrame, width: int) -> DataFrame:
    """Fail on a record with more fields than the header; one with fewer is filled with nulls."""
    record = F.regexp_replace(_MALFORMED, r'"([^"]|"")*"', "")
    fields = F.length(record) - F.length(F.replace(record, F.lit(","), F.lit(""))) + 1
    # naming the first field also keeps a count from reading the malformed records alone, which Spark refuses
    first = F.coalesce(col(df.columns[0]), F.lit(""))
    refused = F.raise_error(F.concat(F.lit(f"a record has more than {width} fields, at "), first, F.lit(": "), F.col(_MALFORMED)))
    return df.filter(F.when(fields > width, refused).otherwise(F.lit(True))).drop(_MALFORMED)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """Header row, comma, doubled quotes.  Without a schema all rows decide the types.

    A record with too many fields is an error.  Line breaks inside quotes belong to the value; a caller who knows that
    there are none sets ``multi_line`` to False, which lets Spark split large files.
    """
    reader = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).option("inferSchema", False)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _MALFORMED).option("columnPruning", False)
    )
    names = schema.fieldNames() if schema is not None else reader.csv(path).columns
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _MALFORMED]])
    rows = _refuse_surplus(reader.schema(text).csv(path), len(names))
    # an empty nullValue would also swallow blanks; tokens are folded afterwards
    if schema is None:
        return infer(rows)
    return fold_na_columns(rows).select(*[col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return fold_nan(reader.json(path))


COMPARISONS = {
    "=": Column.__eq__, "<>": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__,
}


def read_parquet(spark: SparkSession, path: str, where: list[tuple[str, str, object]] | None = None) -> DataFrame:
    """A Parquet table with NaN as null.

    ``where`` holds comparisons ``(column, operator, value)`` that all have to hold.  They are applied to the stored
    columns, so they reach the scan; a filter on the result would sit on the folded ones and not.
    """
    rows = spark.read.parquet(path)
    for name, operator, value in where or []:
        rows = rows.filter(COMPARISONS[operator](col(name), F.lit(value)))
        if isinstance(rows.schema[name].dataType, (T.DoubleType, T.FloatType)):
            rows = rows.filter(~F.isnan(col(name)))  # NaN would count as the largest number
    return fold_nan(rows)


def read_xlsx(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    from tabulon.sources.workbook import read_workbooks

    return read_workbooks(spark, path, schema)


READERS = {".csv": read_csv, ".json": read_json, ".parquet": read_parquet, ".xlsx": read_xlsx}


def read_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a file, folder or glob by its lower-cased extension."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    reader = READERS.get(extension)
    if reader is None:
        raise IngestionError(f"no reader for files ending in {extension}")
    try:
        return reader(spark, path, **options)
    except IngestionError:
        raise
    except Exception as e:
        raise IngestionError(f"cannot read {path}: {e}") from e


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def require_data(df: DataFrame) -> DataFrame:
    """Refuse a table without rows or columns; looks at one row only."""
    if not df.columns or df.isEmpty():
        raise IngestionError("the table has no rows or no columns")
    return df
