"""Readers and writers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import strip
from ..operators.running import carry
from .staging import remove

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
NOTE_ROW = "page_id bigint, path string, action string, content string, run bigint"
# Folder of the rows that say which runs are complete.
MANIFEST = "manifest"
IMAGE_ROW = "page_id bigint, src_abs string, filename string, width int, path string, run bigint"

# Line ends beside the line feed and carriage return that the text reader knows.
_LINE_ENDS = r"[\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def read_url_list(spark: SparkSession, path: str, extra_urls: Iterable[str] = ()) -> DataFrame:
    """(seq, url) of a text file: trimmed, without blanks and ``#`` lines, given URLs first.

    The file is read in splits. Rows are numbered inside each split and the split
    counts are added up, so ``seq`` is dense and no task sees the whole list.
    """
    given = list(extra_urls)
    split = ["file", "start"]
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line_no"),
        "value",
    )
    urls = (
        lines.select(*split, "line_no", F.posexplode(F.split("value", _LINE_ENDS, -1)).alias("part", "text"))
        .withColumn("url", strip(F.col("text")))
        .filter((F.col("url") != "") & ~F.col("url").startswith("#"))
    )
    here = F.row_number().over(Window.partitionBy(*split).orderBy("line_no", "part"))
    counts = urls.groupBy(*split).agg(F.count("*").alias("_sum")).withColumn("all", F.lit(0))
    place = F.struct(*split)
    before = carry(counts.withColumn("place", place), ["all"], "place").select(*split, "_before")
    numbered = (
        urls.withColumn("here", here)
        .join(before, split)
        .select((F.col("here") + F.col("_before") + len(given) - 1).cast("bigint").alias("seq"), "url")
    )
    first = spark.createDataFrame(list(enumerate(given)), "seq bigint, url string")
    return first.unionByName(numbered)


def write_notes(notes: DataFrame, out: str, run: int, images: DataFrame | None = None) -> None:
    """Write the notes that have a path, and the attachment plan, as run ``run``; writing a run again replaces it.

    Every batch needs a number of its own, and its names a catalogue of the runs before it: ``clip_run`` does both.

    Notes, catalogue and plan become visible together: a run counts from the moment its row in the manifest is there,
    which is written last and taken back first. A run that was cut off in between leaves readers at the runs before.
    Runs are never changed by later ones: for a path written more than once
    ``read_notes`` takes the last run, and inside a run the final request.
    """
    spark = notes.sparkSession
    remove(spark, f"{out}/{MANIFEST}/run={run}")
    if images is not None:
        images.select("page_id", "src_abs", "filename", "width", "path").write.mode("overwrite").parquet(f"{out}/images/run={run}")
    else:
        remove(spark, f"{out}/images/run={run}")
    kept = notes.filter(F.col("path").isNotNull() & F.col("final"))
    kept.select("page_id", "path", "action", "content").write.mode("overwrite").parquet(f"{out}/run={run}")
    spark.range(run, run + 1, 1, 1).toDF("number").write.mode("overwrite").parquet(f"{out}/{MANIFEST}/run={run}")


def _runs(spark: SparkSession, out: str, row: str = NOTE_ROW, folder: str = "", before_run: int | None = None) -> DataFrame:
    """Rows of the committed runs. Only a table that is not there yet is empty; any other fault is an error."""
    rows = _read(spark, f"{out}{folder}", row)
    done = _read(spark, f"{out}/{MANIFEST}", "number bigint, run bigint").select(F.col("number").alias("run"))
    if before_run is not None:
        rows, done = rows.filter(F.col("run") < before_run), done.filter(F.col("run") < before_run)
    return rows.join(done, "run", "left_semi").select(*rows.columns)


def _read(spark: SparkSession, base: str, row: str) -> DataFrame:
    try:
        return spark.read.schema(row).option("basePath", base).parquet(f"{base}/run=*")
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], row)


def read_catalogue(spark: SparkSession, out: str, before_run: int | None = None) -> DataFrame:
    """Paths written so far; with ``before_run`` only those of earlier runs."""
    return _runs(spark, out, before_run=before_run).select("path").distinct()


def read_notes(spark: SparkSession, out: str) -> DataFrame:
    """The current note under each path. The last run of a path is found on its two columns; texts are not grouped."""
    runs = _runs(spark, out)
    last = runs.groupBy("path").agg(F.max("run").alias("run"))
    return runs.join(last, ["path", "run"], "left_semi").select("path", "page_id", "action", "content")


def read_images(spark: SparkSession, out: str, before_run: int | None = None) -> DataFrame:
    """File names of images planned so far; with ``before_run`` only those of earlier runs."""
    return _runs(spark, out, IMAGE_ROW, "/images", before_run).select("filename").distinct()
