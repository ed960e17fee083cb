"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Enough to keep a cluster busy through the tails of independent jobs.
JOBS_AT_ONCE = 8

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "tabulon", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark, with a checkpoint folder of its own if none is set; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tabulon-ckpt-"))
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per context.

    The driver sends its own copy, so nothing needs to be installed on the executors.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tabulon_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tabulon-pkg-"), "tabulon.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._tabulon_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, which the session names in ``spark.checkpoint.dir``.

    There is no fallback: a folder of one machine would be lost with it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return sc.getCheckpointDir()


_written: list[str] = []


def stage_dir(spark: SparkSession, name: str) -> str:
    """A folder for written stage tables below the shared checkpoint folder."""
    path = os.path.join(ensure_checkpoint_dir(spark), name)
    _written.append(path)
    return path


def clear_intermediates(spark: SparkSession) -> None:
    """Remove the tables that this session wrote below the checkpoint folder; results that were not written elsewhere are lost."""
    for path in _written:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    _written.clear()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder below the checkpoint folder and read it back.

    For tables that several jobs read: the plan runs once, and later reads take only the columns they need.
    """
    spark = df.sparkSession
    path = stage_dir(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_together(*actions: Callable[[], object]) -> list:
    """Submit independent Spark actions at the same time and return their results in order."""
    if len(actions) < 2:
        return [a() for a in actions]
    session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    # job groups and tags of the caller apply to its threads too
    inherit = inheritable_thread_target(session)
    if inherit is session:  # threads are not pinned, there is nothing to inherit
        inherit = lambda action: action
    with ThreadPoolExecutor(max_workers=min(JOBS_AT_ONCE, len(actions))) as pool:
        return [f.result() for f in [pool.submit(inherit(a)) for a in actions]]
