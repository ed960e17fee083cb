"""Helpers shared by the operators: reading tables, cutting lineage, shipping the package, broadcasting bounded values."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.session import ensure_checkpoint_dir, materialise as written, ship_package, stage_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared checkpoint folder: later plans start from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


BATCH_ROWS = 1000  # texts are long: batches of Spark's default size would hold tens of megabytes twice over


def prepare_workers(spark: SparkSession) -> None:
    """This package on the workers, and Arrow batches of moderate size unless the session sets their size itself."""
    ship_package(spark)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":
        spark.conf.set(size, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system: workers are used again and again, and share a limit with their executor."""
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no GNU C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def whole_numbers(df: DataFrame, but: Iterable[str] = ()) -> list[str]:
    """The integer columns of ``df``."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType) and f.name not in set(but)]


def in_python(df: DataFrame, function, schema: str, exact: Iterable[str] = ()) -> DataFrame:
    """``mapInPandas`` on prepared workers.

    ``exact`` names integer columns that ``function`` only hands through.  They travel as text: beside a null, pandas would
    make them doubles, which alters numbers above 2**53.
    """
    prepare_workers(df.sparkSession)
    exact = set(exact)
    if exact:
        named = lambda c: F.col(f"`{c}`")
        wanted = T.StructType.fromDDL(schema)
        as_text = T.StructType([T.StructField(f.name, T.StringType() if f.name in exact else f.dataType) for f in wanted])
        texts = df.select(*[named(c).cast("string").alias(c) if c in exact else named(c) for c in df.columns])
        made = in_python(texts, function, as_text)
        return made.select(*[named(f.name).cast(f.dataType).alias(f.name) if f.name in exact else named(f.name) for f in wanted])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInPandas(run, schema)


def per_group(function):
    """A function of one group that gives memory back after each."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        try:
            return function(group)
        finally:
            give_back()

    return run


def per_pair(function):
    """A function of two cogroups that gives memory back after each."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        try:
            return function(left, right)
        finally:
            give_back()

    return run


PIECES = 16


def in_pieces(counts: np.ndarray) -> pd.DataFrame:
    """An array of counters (a multiple of 64 of them, so that it divides) as rows ``piece, counts``; pieces of zeros are left out."""
    parts = counts.astype("<u4").reshape(PIECES, -1)
    used = np.flatnonzero(parts.any(axis=1))
    return pd.DataFrame({"piece": used.astype(np.int32), "counts": [zstandard.compress(np.ascontiguousarray(parts[i].view(np.uint8).reshape(-1, 4).T).tobytes(), 1) for i in used]})


def sum_pieces(df: DataFrame, size: int) -> np.ndarray:
    """Add up the arrays that tasks sent in pieces: running sums in the tasks, one row per piece to the driver.

    The driver gets 32-bit floats, which is enough for frequencies.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.piece, batch.counts):
                flat = np.frombuffer(zstandard.decompress(counts), np.uint8).reshape(4, -1)
                part = np.ascontiguousarray(flat.T).view("<u4").reshape(-1).astype(np.int64)
                total[piece] = total[piece] + part if piece in total else part
        yield pd.DataFrame({"piece": list(total), "counts": [v.astype(np.float32).tobytes() for v in total.values()]}).astype({"piece": "int32"})

    out = np.zeros(size, dtype=np.float32)
    step = size // PIECES
    for r in in_python(df.repartition(PIECES, "piece"), add, "piece int, counts binary").collect():
        out[r["piece"] * step : (r["piece"] + 1) * step] = np.frombuffer(r["counts"], np.float32)
    return out


class BucketedTables:
    """Written tables of one run with the same buckets by the same column, so that joining or cogrouping them moves nothing.

    There are as many buckets as the session has shuffle tasks; what a task holds at a time is a row or a group, not a bucket.
    """

    def __init__(self, spark: SparkSession, column: str):
        self.spark, self.column, self.names = spark, column, []
        self.buckets = min(50_000, shuffle_tasks(spark))

    def write(self, df: DataFrame, kind: str) -> DataFrame:
        name = f"{kind}_{uuid.uuid4().hex}"
        rows = df.write.bucketBy(self.buckets, self.column).sortBy(self.column).format("parquet")
        rows.option("path", stage_dir(self.spark, name)).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def forget(self) -> None:
        """Take the names out of the catalog; the files stay until the session's intermediates are cleared."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names.clear()


def shuffle_tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


BUCKET_BYTES = 4_000_000


@dataclass(frozen=True)
class Deal:
    """How packed rows about a given number of bytes of text are dealt out: buckets of a few megabytes of text, tasks of a few buckets.

    Both follow the data; where there is little, there are as many as the session has shuffle tasks.
    """

    buckets: int
    tasks: int

    @staticmethod
    def of(spark: SparkSession, n_bytes: int) -> Deal:
        least = shuffle_tasks(spark)
        return Deal(max(least, -(-n_bytes // BUCKET_BYTES)), max(least, -(-n_bytes // (4 * BUCKET_BYTES))))

    def by(self, df: DataFrame, key: str) -> DataFrame:
        return df.repartition(self.tasks, key)


def texts(column: pd.Series) -> list[str]:
    """Texts of an Arrow batch, null as empty."""
    return ["" if t is None or t is pd.NA or t != t else t for t in column.tolist()]


def pack_strings(values: Iterable[str]) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes of all values and the offsets of each (n + 1 numbers).

    An unpaired surrogate cannot be stored in a text column, so plain UTF-8 is enough.
    """
    parts = [v.encode("utf-8", "surrogatepass") for v in values]
    ends = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return b"".join(parts), ends


def slices(batches: Iterator[pd.DataFrame], column: str, most_bytes: int) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches so that the texts of a piece have about ``most_bytes`` characters; a longer text is a piece alone."""
    for batch in batches:
        if not len(batch):
            continue
        sizes = np.array([len(t) if isinstance(t, str) else 0 for t in batch[column]], dtype=np.int64)
        piece = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // max(1, most_bytes)
        for _, part in batch.groupby(piece, sort=True):
            yield part

