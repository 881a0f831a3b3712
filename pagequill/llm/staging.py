"""Lineage is cut by writing tables to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="llm-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet and read it back, so later jobs neither recompute it nor depend on its executors."""
    path = f"{shared_root(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_path = path  # type: ignore[attr-defined]
    return staged


def discard(*staged: DataFrame) -> None:
    """Remove staged tables that nothing will read again.

    Spark removes the shuffle files of ended jobs when the driver collects what named them. That is asked for here, so
    that a long chain of staged steps holds the files of its last ones and not of all.
    """
    for df in staged:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
    if staged:
        staged[0].sparkSession._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each Spark context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="llm-")) / "llm-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in [package / "__init__.py", *sorted((package / "llm").glob("*.py"))]:
            out.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(str(archive))
    context._llm_shipped = True
