"""Writing an intermediate result where every executor can read it again."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Row, SparkSession

# Deletes the shuffle files of a query as it ends, and not when the driver collects its plan.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Folder of each written table.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """Folder the session names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own; on
    a cluster a machine-local folder would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="nearset-")


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here leave no shuffle files; the session's setting comes back."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: later steps that use the table several times neither
    recompute it nor depend on the executors that produced it, and what was shuffled
    for it is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _folders[table] = path
    return table


def is_written(df: DataFrame) -> bool:
    """Whether ``df`` is a table of ``write_once``."""
    return df in _folders


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``write_once`` that nothing will read again."""
    for table in tables:
        spark, path = table.sparkSession, _folders.pop(table)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def only_row(df: DataFrame) -> Row | None:
    """First row of a small result, for which nothing that was shuffled is left."""
    with freed_shuffles(df.sparkSession):
        return df.first()
