"""Session set-up and lineage cutting."""

from __future__ import annotations

import os
import pathlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = str(pathlib.Path(__file__).resolve().parents[1])  # where workers find the package if it is not installed


def build_session(app: str = "strandlab", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.executorEnv.PYTHONPATH", os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")])))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost together with its executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        current = sc.getCheckpointDir()
        if current is not None:
            return current
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="strandlab-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path for an intermediate table inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/strandlab/{name}-{uuid.uuid4().hex}"


#: The setting by which Spark deletes the shuffle files of a plan as soon as the plan has run.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_open = threading.local()  # the scopes of ``scratch`` that a thread is in, innermost last: folder of each table -> session


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The result survives executors and has no lineage.  Unlike a checkpointed RDD it
    has a known size, so a small model is broadcast by Spark's own size rule and a
    large one is not; the data side is not shuffled for a model join.  The shuffle
    files of its plan, which nothing reads again, go with the write: else they stay
    until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    for tables in getattr(_open, "scopes", [])[-1:]:
        tables[path] = spark
    was = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if was is None else spark.conf.set(SHUFFLES_GO, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` returned; nothing may read them, or a plan made of them, after that."""
    for table in tables:
        for scope in getattr(_open, "scopes", []):
            scope.pop(table._folder, None)
        _delete(table.sparkSession, table._folder)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``cut`` writes in this scope are deleted when it ends, but for those that the given function has taken.

    These belong to the scope around it, if there is one.  A plan that is left at the end may read no other table.
    """
    scopes = _open.__dict__.setdefault("scopes", [])
    tables: dict[str, SparkSession] = {}
    scopes.append(tables)

    def keep(table: DataFrame) -> DataFrame:
        spark = tables.pop(table._folder)
        for outer in scopes[:-1][-1:]:
            outer[table._folder] = spark
        return table

    try:
        yield keep
    finally:
        scopes.pop()
        for path, spark in tables.items():
            _delete(spark, path)


#: The setting that bounds the bytes of an Arrow batch, Spark's own value of it, and ours for rows with whole texts.
BATCH_BYTES, SPARK_BYTES, TEXT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """While it holds, tasks hand texts to Python in batches of about ``TEXT_BYTES``; then the setting is as before.

    By Spark's own value a batch of long texts has up to 64 MB, and an executor holds several for each of its cores, in
    its JVM and in its Python workers.  A value that the session chose itself is kept.  The setting counts when a plan is
    run, so what is made under it has to be written there.
    """
    if spark.conf.get(BATCH_BYTES, SPARK_BYTES) != SPARK_BYTES:
        yield
        return
    spark.conf.set(BATCH_BYTES, TEXT_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES)
