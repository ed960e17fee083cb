"""Value dictionaries: the distinct values of a text column as a stored table ``value, slot, n``.

A dictionary never passes through the driver, which knows its folder, its number of values, the number of counted rows and
the most frequent value.  Slots count from 0 in value order.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.operators.counts import value_counts, value_text
from tabulon.operators.lookup import lookup
from tabulon.operators.ranking import SINGLE_TASK_VALUES, number_in_order
from tabulon.session import materialise, stage_dir

SCHEMA = "value string, slot bigint, n bigint"
METADATA = "dictionary"


@dataclass(frozen=True)
class Dictionary:
    column: str
    path: str
    width: int
    total: int

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(self.path)

    def save(self, spark: SparkSession, path: str) -> Dictionary:
        """Copy the table to ``path``, for instance next to the parameters that need it."""
        self.table(spark).write.mode("errorifexists").parquet(path)
        return Dictionary(self.column, path, self.width, self.total)

    def most_frequent(self, spark: SparkSession) -> str:
        """The mode, the smallest value on ties."""
        return self.table(spark).orderBy(F.desc("n"), "value").limit(1).first()["value"]


@dataclass
class CountedValues:
    """``table``: ``column, value, n`` of all columns, counted once and written; sizes per column that has any value."""

    table: DataFrame
    sizes: dict[str, tuple[int, int]]

    def of(self, columns: list[str]) -> DataFrame:
        return self.table.filter(F.col("column").isin(columns))


def count_values(df: DataFrame, cols: list[str]) -> CountedValues:
    """Distinct values of all columns in one pass.  The driver gets one row per column."""
    counted = materialise(value_counts(df, cols).select("column", value_text().alias("value"), "n"), "values")
    sizes = counted.groupBy("column").agg(F.count(F.lit(1)).alias("width"), F.sum("n").alias("total")).collect()
    return CountedValues(counted, {r["column"]: (r["width"], r["total"]) for r in sizes})


def build(counted: CountedValues, cols: list[str], single_task: int = SINGLE_TASK_VALUES) -> dict[str, Dictionary]:
    """Number the values of each column and write its dictionary; columns without values have none."""
    out = {}
    for c in cols:
        if c not in counted.sizes:
            continue
        width, total = counted.sizes[c]
        path = stage_dir(counted.table.sparkSession, f"dictionary-{uuid.uuid4().hex}")
        numbered = number_in_order(counted.of([c]).select("value", "n"), ["value"], "slot", width, single_task)
        numbered.select("value", "slot", "n").write.parquet(path)
        out[c] = Dictionary(c, path, width, total)
    return out


def _unit_vector(slot: Column, width: int) -> Column:
    """A sparse vector with a one at ``slot``, all zeros where it is null, made by built-in functions alone."""
    from pyspark.ml.linalg import VectorUDT

    place = F.coalesce(slot.cast("string"), F.lit(""))
    one = F.when(slot.isNotNull(), F.lit("1.0")).otherwise(F.lit(""))
    text = F.concat(F.lit(f'{{"v":{{"type":0,"size":{width},"indices":['), place, F.lit('],"values":['), one, F.lit("]}}"))
    return F.from_json(text, T.StructType([T.StructField("v", VectorUDT())]))["v"]


def one_hot_vector(df: DataFrame, value: Column, dictionary: Dictionary, name: str) -> DataFrame:
    """Add ``name``: the sparse one-hot vector of ``value``; values that the dictionary lacks give the zero vector.

    The column's metadata holds its size and where the dictionary is, not the values.
    """
    spark = df.sparkSession
    placed = lookup(df, value, dictionary.table(spark), ["slot"], dictionary.width, dictionary.total)
    made = placed.withColumn(name, _unit_vector(F.col("slot"), dictionary.width)).drop("slot")
    about = {"ml_attr": {"num_attrs": dictionary.width}, METADATA: {"path": dictionary.path, "column": dictionary.column, "total": dictionary.total}}
    return made.withMetadata(name, about)


def of_column(field: T.StructField) -> Dictionary | None:
    """The dictionary that a vector column was made with, by its metadata."""
    known = (field.metadata or {}).get(METADATA)
    return Dictionary(known["column"], known["path"], field.metadata["ml_attr"]["num_attrs"], known["total"]) if known else None
