"""Cutting lineage: write a table to the shared folder and read it back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def staging_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder.

    On a cluster each machine would write to its own disk and rows would go missing, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pagequill-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once. Readers of the copy get column pruning and survive lost executors."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/stage-{uuid.uuid4().hex}"
    held = _STAGED.get()
    if held is not None:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged_until_end(spark: SparkSession) -> Iterator[None]:
    """Remove what is staged inside, also after a fault. Results built inside are to be written before the end."""
    token = _STAGED.set([])
    try:
        yield
    finally:
        paths = _STAGED.get() or []
        _STAGED.reset(token)
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table's folder, on whatever file system it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
