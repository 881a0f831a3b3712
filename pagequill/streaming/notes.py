"""New page files become notes as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.clip import ClipOptions, clip_run
from ..sources.tables import PAGES


def stream_notes(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    options: ClipOptions,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Turn every page file not seen yet into notes, then stop.

    Names of notes and images are resolved against what earlier batches wrote. A batch is one run of the
    output table; a batch that is tried again replaces its own run and sees only the
    runs before it, so a lost attempt leaves nothing behind.
    """
    reader = spark.readStream.schema(PAGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write_batch(batch: DataFrame, run: int) -> None:
        clip_run(batch, options, out_dir, run)

    return (
        reader.parquet(in_dir)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
