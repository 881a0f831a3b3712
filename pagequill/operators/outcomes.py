"""Statuses, exit codes and the batch summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import is_blank

# Exit code of each way a page can end.
EXIT_CODES = {
    "not_found": ("skip", 4),
    "server_error": ("error", 5),
    "timeout": ("error", 3),
    "network_error": ("error", 2),
    "invalid_url": ("error", 2),
    "no_article": ("skip", 6),
    "write_failed": ("error", 7),
    "failed": ("error", 1),
    "blank": ("skip", 0),
    "exists": ("skip", 0),
}


def drop_empty(articles: DataFrame) -> DataFrame:
    """Add ``status``: an article whose Markdown is blank is skipped."""
    return articles.withColumn("status", F.when(is_blank(F.coalesce("markdown", F.lit(""))), "skip").otherwise("success"))


def classify(ending: Column) -> tuple[Column, Column]:
    status = code = None
    for name, (text, number) in EXIT_CODES.items():
        status = (F if status is None else status).when(ending == name, F.lit(text))
        code = (F if code is None else code).when(ending == name, F.lit(number))
    return status.otherwise("success").alias("status"), code.otherwise(0).alias("exit_code")


def classify_outcomes(results: DataFrame) -> DataFrame:
    """Add ``status`` (success, error, skip) and ``exit_code`` to rows with an ``ending``.

    ``ending`` is how far a page came: one of ``EXIT_CODES``, or anything else for success.
    """
    return results.select("*", *classify(F.coalesce("ending", F.lit(""))))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: counts per status and the last non-zero exit code in ``seq`` order."""
    code = F.when(F.col("exit_code") != 0, F.col("exit_code"))
    at = F.when(F.col("exit_code") != 0, F.col("seq"))
    return results.agg(
        F.count_if(F.col("status") == "success").alias("ok"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "skip").alias("skipped"),
        F.coalesce(F.max_by(code, at), F.lit(0)).alias("exit_code"),
    )
