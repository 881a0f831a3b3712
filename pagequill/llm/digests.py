"""Exact dedup against a persistent index of digests, with DataFrame and SQL functions alone.

The index is a table of Parquet files, bucketed and sorted by digest, in one partition for each run. New rows meet it in
a sort-merge anti-join that moves no index row; the digests that are new are appended as the partition of their run.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequill.llm.staging import shared_root, stage

# A digest on more than one row in this many is joined by broadcast: there are at most that many such digests.
HEAVY = 1000
WHITE = r"[\x20\x09-\x0D]+"
ENTRY = "digest BINARY, keep_id BIGINT, keep_row BIGINT, n_rows BIGINT"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


@dataclass(frozen=True)
class DigestIndex:
    """Digests of all texts seen, under ``path`` on a file system that all executors share.

    The number of buckets is fixed for the life of an index: choose it so that one bucket of one run fits a task.
    Each run owns the partition ``run=N``, so a run that is repeated replaces what it wrote and finds the same rows new.
    """

    path: str
    buckets: int

    def read(self, spark: SparkSession, before: int, create: int | None = None) -> DataFrame:
        """``(digest, keep_id, keep_row, n_rows, run)`` of the runs under ``before``, known to Spark as bucketed."""
        name = f"llm_digests_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({ENTRY}, run BIGINT) USING parquet PARTITIONED BY (run) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        if create is not None:  # makes the folder of a new index
            spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION (run = {create})")
        spark.catalog.recoverPartitions(name)
        return spark.table(name).where(F.col("run") < before)

    def append(self, entries: DataFrame, run: int) -> None:
        """Write ``entries``, dealt by digest, as the partition of ``run``: one sorted file for each bucket."""
        spark = entries.sparkSession
        name = f"llm_digests_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{run}"
        dealt = entries.write.mode("overwrite").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        dealt.option("path", f"{self.path}/run={run}").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # a table outside the warehouse: the files stay


def new_index(spark: SparkSession, name: str) -> DigestIndex:
    """An index in the shared folder, with as many buckets as the session has shuffle partitions."""
    return DigestIndex(f"{shared_root(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions")))


def _judged(rows: DataFrame, index: DigestIndex, run: int) -> DataFrame:
    """``rows`` (digest, row, id, n_chars, ...), staged, with ``keep_id, group_size, kept``."""
    spark = rows.sparkSession
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    groups = stage(rows.groupBy("digest").agg(best, F.count("*").alias("n_rows")))
    dealt = groups.repartition(index.buckets, "digest")
    known = index.read(spark, run, create=run).select("digest")
    fresh = dealt.join(known.hint("merge"), "digest", "left_anti")
    index.append(fresh.select("digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n_rows"), run)

    entry = index.read(spark, run + 1).withColumnRenamed("n_rows", "indexed")
    earlier = F.col("run") < run
    verdicts = dealt.join(entry.hint("merge"), "digest").select(
        "digest",
        "n_rows",
        "keep_id",
        F.when(~earlier, F.col("keep_row")).alias("keep_row"),
        (F.col("n_rows") + F.when(earlier, F.col("indexed")).otherwise(0)).alias("group_size"),
    )
    verdicts = stage(verdicts)
    is_heavy = F.col("n_rows") * HEAVY > rows.count()
    heavy = verdicts.where(is_heavy).drop("n_rows")
    met = rows.join(F.broadcast(heavy), "digest", "left")  # at most HEAVY rows
    light = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    light = light.join(verdicts.where(~is_heavy).drop("n_rows").hint("merge"), "digest")
    both = met.where("group_size is not null").unionByName(light)
    return both.withColumn("kept", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))).drop("keep_row")


def deduplicate(docs: DataFrame, index: DigestIndex, run: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id, keep_id, group_size, kept, text_sha256``; new texts enter the index.

    Texts are equal if they are the same after white space is deleted. Of equal texts the row with the most code points
    stays, then the smallest id, null ids last; of rows that tie in both exactly one stays. A text that an earlier run
    holds loses to it whatever its length. ``group_size`` counts equal rows of ``docs``, and those of the run that brought
    the text into the index. Null and empty texts are equal. Other columns of ``docs`` do not matter, whatever their names.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.length(F.coalesce(text.cast("string"), F.lit(""))).cast("long").alias("n_chars"),
        F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
    )
    judged = _judged(stage(rows), index, run)
    return judged.select("id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def first_copies(docs: DataFrame, index: DigestIndex, run: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the rules are those of ``deduplicate``."""
    text = F.col(text_col)
    rows = stage(
        docs.select(
            F.struct("*").alias("whole"),
            F.col(id_col).cast("long").alias("id"),
            F.monotonically_increasing_id().alias("row"),
            F.length(F.coalesce(text.cast("string"), F.lit(""))).cast("long").alias("n_chars"),
            F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
        )
    )
    stay = _judged(rows.drop("whole"), index, run).where("kept").select("row")
    return rows.select("row", "whole").join(stay, "row", "left_semi").select("whole.*")
