"""Note texts: the line table, the rewriting chain, composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.core import cached_column, each_numbered, lines_of
from ..functions.frontmatter import frontmatter as frontmatter_struct
from ..functions.frontmatter import frontmatter_yaml


def note_lines(notes: DataFrame) -> DataFrame:
    """(doc_id, markdown) -> (doc_id, line_no, line), line numbers from 0."""
    return each_numbered(notes, lines_of(F.col("markdown")), "line_no", "line", "doc_id")


def join_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) -> (doc_id, markdown); one note's lines per group."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("doc_id").agg(
        F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("markdown")
    )


def convert(
    notes: DataFrame, link_format: str = "wikilink", block_ids: bool = False, base: str | None = "url"
) -> DataFrame:
    """Run every rewriting step over ``markdown``, one projection per step and no shuffle."""
    for number in range(len(md.convert_steps(None, link_format, block_ids)) + bool(base)):
        notes = notes.withColumn("markdown", _step_column(number, link_format, block_ids, base))
    return notes


@cached_column
def _step_column(number: int, link_format: str, block_ids: bool, base: str | None) -> Column:
    steps = md.convert_steps(F.col(base) if base else None, link_format, block_ids)
    return steps[number](F.col("markdown"))


def with_frontmatter(articles: DataFrame, as_of: str) -> DataFrame:
    """Add ``frontmatter`` to rows with ``url`` and a ``meta`` struct."""
    meta = F.col("meta")
    props = frontmatter_struct(
        meta["title"], F.col("url"), meta["author"], meta["date"], meta["tags"], meta["og_title"],
        meta["description"], as_of,
    )
    return articles.withColumn("frontmatter", props)


def with_yaml(notes: DataFrame) -> DataFrame:
    return notes.withColumn("frontmatter_yaml", _yaml_column())


@cached_column
def _yaml_column() -> Column:
    return frontmatter_yaml(F.col("frontmatter"))


def compose_notes(notes: DataFrame, include_frontmatter: bool = True) -> DataFrame:
    """Add ``content``: YAML block, blank line, Markdown; or the Markdown alone."""
    if not include_frontmatter:
        return notes.withColumn("content", F.col("markdown"))
    yaml = F.coalesce("frontmatter_yaml", F.lit(""))
    return notes.withColumn(
        "content",
        F.when(yaml != "", F.concat(yaml, F.lit("\n\n"), F.col("markdown"))).otherwise(F.col("markdown")),
    )
