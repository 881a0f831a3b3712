"""The bounded sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("long").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, y)``: at most ``rows`` labelled texts, those of the smallest id hashes, so that the choice is stable.

    A row labelled more than once has the mean of its labels; null labels and ids do not count. Of rows with the same
    id one text is taken.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id")  # the limit bounds it
    return found.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
