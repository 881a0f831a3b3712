"""The whole way from pages to named notes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import cached_column, is_blank
from ..functions.text import note_name
from ..operators.blocks import render, with_article
from ..operators.fetchlog import decode_pages, last_attempts, validate_urls
from ..operators.media import embed_images, image_array, plan_attachments
from ..operators.metadata import with_metadata
from ..operators.naming import CONFLICT_MODES, assign_note_paths
from ..operators.notes import compose_notes, convert, with_frontmatter, with_yaml
from ..operators.outcomes import classify
from ..operators.running import join_by_block, range_of
from ..sources.staging import stage, staged_until_end
from ..sources.tables import read_catalogue, read_images, write_notes

IMAGE_MODES = ("link", "download", "skip")


@dataclass(frozen=True)
class ClipOptions:
    as_of: str
    include_frontmatter: bool = True
    images: str = "link"
    images_dir: str = "attachments"
    link_format: str = "wikilink"
    conflict: str = "suffix"
    date_prefix: bool = False
    block_ids: bool = False
    max_host_repeat: int | None = None

    def __post_init__(self) -> None:
        if self.images not in IMAGE_MODES:
            raise ValueError(f"unknown image mode: {self.images}")
        if self.conflict not in CONFLICT_MODES:
            raise ValueError(f"unknown conflict mode: {self.conflict}")


def articles(pages: DataFrame, options: ClipOptions) -> DataFrame:
    """Pages -> (page_id, url, meta, markdown, images): narrow, no shuffle."""
    described = with_metadata(pages)
    columns = ["page_id", "url", "meta", render(options.images != "skip").alias("markdown")]
    if options.images == "download":
        described = described.withColumn("images", image_array())
        columns.append("images")
    return with_article(described, options.max_host_repeat).select(*columns)


def attach(
    found: DataFrame, options: ClipOptions, existing: DataFrame | None, responses: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Embed planned images, or those of them that ``responses`` say were saved; returns the notes and the attachment plan."""
    found = stage(found)
    shown = found.filter(~is_blank(F.col("markdown")))
    images = shown.select("page_id", "url", F.explode("images").alias("i")).select("page_id", "url", "i.*")
    plan = stage(plan_attachments(images, existing, options.conflict, responses))
    notes = embed_images(found.withColumn("has_images", F.size("images") > 0), plan)
    return notes.drop("images", "has_images"), plan


def finish(found: DataFrame, options: ClipOptions) -> DataFrame:
    """Rewrite texts and add names and properties: narrow, no shuffle."""
    empty = is_blank(F.col("markdown"))
    notes = convert(found.withColumn("blank", empty), options.link_format, options.block_ids)
    return with_yaml(with_frontmatter(notes, options.as_of)).withColumn("name", _name_column(options.date_prefix))


@cached_column
def _name_column(date_prefix: bool) -> Column:
    title = F.coalesce(F.nullif(F.col("meta")["title"], F.lit("")), F.lit("untitled"))
    return note_name(title, F.col("url"), F.col("meta")["date"], date_prefix)


def clip_pages(
    pages: DataFrame,
    options: ClipOptions,
    catalogue: DataFrame | None = None,
    existing_images: DataFrame | None = None,
    image_responses: DataFrame | None = None,
) -> DataFrame:
    """Pages (page_id, url, html) -> one note row per page; ``page_id`` is the input order.

    ``existing_images`` (filename) are the files in the attachments folder, and ``image_responses`` says how fetching
    the images ended (see ``plan_attachments``); both count with ``images="download"`` alone.
    """
    return clip_with_images(pages, options, catalogue, existing_images, image_responses)[0]


# Where a request ends: by the operator that decides about it.
_STAGES = {
    "invalid_url": "url", "not_found": "fetch", "server_error": "fetch", "timeout": "fetch", "network_error": "fetch",
    "blank": "article", "exists": "path", "saved": "note",
}


def clip_responses(
    urls: DataFrame,
    attempts: DataFrame,
    options: ClipOptions,
    catalogue: DataFrame | None = None,
    existing_images: DataFrame | None = None,
    image_responses: DataFrame | None = None,
    max_attempts: int = 3,
) -> DataFrame:
    """Requested URLs (seq, url) and what fetching them gave -> one row per request, however it ended.

    ``attempts`` (url, seq, status_code, failure, content_type, body) logs every try; url and seq name one. A URL that
    is not valid, was never tried, or whose deciding attempt failed has no note; all others are decoded and clipped in
    the order of ``seq``, which is unique. A URL asked for more than once gives a note for each request. A request without a path has no content. ``ending`` says
    how far a request came (``saved`` or one of the exit codes' names), ``stage`` which step decided, and ``attempts``
    how many tries were made; ``status`` and ``exit_code`` follow, as ``batch_summary`` reads them.

    Small columns decide first. A body then crosses one exchange, by URL and attempt; requests for a URL arrive there as
    lists, one for each range of ``seq``, so one asked for by a third of all rows is spread over the ranges.
    """
    asked = validate_urls(urls.select(F.col("seq").cast("bigint").alias("seq"), "url"))
    asked = stage(asked)
    asked = asked.withColumn("range", ranges if (ranges := range_of(asked, "seq")) is not None else F.lit(0).cast("bigint"))
    ends = last_attempts(attempts, max_attempts).select("url", F.col("seq").alias("try"), "outcome", "attempts")
    met = join_by_block(asked, ends, ["url"], "range")
    fetched = F.coalesce("outcome", F.lit("network_error"))
    ending = F.when(~F.col("valid"), F.lit("invalid_url")).when(fetched != "success", fetched)
    tries = F.when(F.col("valid"), F.coalesce("attempts", F.lit(0))).otherwise(0).cast("bigint")
    routed = stage(met.select("seq", "url", "range", "try", ending.alias("ending"), tries.alias("attempts")))

    good = routed.filter(F.col("ending").isNull())
    lists = good.groupBy("url", "try", "range").agg(F.collect_list(F.struct("seq", "attempts")).alias("requests"))
    bodies = attempts.select("url", F.col("seq").alias("try"), "content_type", F.coalesce("body", F.lit(b"")).alias("body"))
    pages = decode_pages(lists.join(bodies, ["url", "try"])).select(F.explode("requests").alias("request"), "url", "html")
    pages = pages.select(F.col("request.seq").alias("page_id"), "url", "html")
    notes = clip_pages(pages, options, catalogue, existing_images, image_responses)

    path = F.when(F.col("status") == "success", F.lit("saved")).when(F.col("action") == "skip", F.lit("exists")).otherwise(F.lit("blank"))
    kept = notes.withColumnRenamed("page_id", "seq").withColumn("ending", path)
    kept = kept.withColumn("content", F.when(F.col("path").isNotNull(), F.col("content")))
    kept = kept.join(good.select("seq", "attempts"), "seq")
    lost = routed.filter(F.col("ending").isNotNull()).drop("range", "try")
    lost = lost.withColumn("final", F.lit(False)).select("*", *classify(F.col("ending")))
    both = kept.unionByName(lost, allowMissingColumns=True)
    steps = F.create_map(*[F.lit(x) for pair in _STAGES.items() for x in pair])
    return both.withColumn("stage", steps[F.col("ending")])


def clip_run(
    pages: DataFrame,
    options: ClipOptions,
    out: str,
    run: int,
    existing_images: DataFrame | None = None,
    image_responses: DataFrame | None = None,
) -> None:
    """Clip a batch and write it as run ``run`` of the notes under ``out``, named against the runs before it.

    The attachment plan of the run goes to ``out/images``, so that later runs give out other file names; files that lie
    in the attachments folder without a run are given as ``existing_images`` (filename). Notes and plan become visible
    together, and what was staged on the way is removed.
    """
    spark = pages.sparkSession
    with staged_until_end(spark):
        images = None
        if options.images == "download":
            images = read_images(spark, out, before_run=run)
            if existing_images is not None:
                images = images.unionByName(existing_images.select("filename")).distinct()
        catalogue = read_catalogue(spark, out, before_run=run)
        notes, plan = clip_with_images(pages, options, catalogue, images, image_responses)
        write_notes(notes, out, run, plan)


def clip_with_images(
    pages: DataFrame,
    options: ClipOptions,
    catalogue: DataFrame | None,
    existing_images: DataFrame | None,
    image_responses: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """The notes, and with ``images="download"`` the plan (page_id, src_abs, filename, width, path) of what to fetch.

    Texts are computed once and staged; naming then reads two small columns of the
    staged table, and its result joins the texts.
    """
    found, plan = articles(pages, options), None
    if options.images == "download":
        found, plan = attach(found, options, existing_images, image_responses)
        plan = plan.withColumn("path", F.concat(F.lit(options.images_dir.rstrip("/") + "/"), "filename"))
    notes = stage(finish(found, options))
    wanted = notes.filter(~F.col("blank")).select(F.col("page_id").alias("seq"), "name")
    paths = assign_note_paths(wanted, catalogue, options.conflict).select(
        F.col("seq").alias("page_id"), "path", "action", "final"
    )
    named = notes.join(paths, "page_id", "left")
    ending = F.when(F.col("blank"), F.lit("blank")).when(F.col("action") == "skip", F.lit("exists")).otherwise("")
    composed = compose_notes(named, options.include_frontmatter)
    result = composed.select(
        "page_id",
        "url",
        F.coalesce(F.nullif(F.col("meta")["title"], F.lit("")), F.lit("Untitled")).alias("title"),
        "markdown",
        "frontmatter",
        F.when(F.lit(options.include_frontmatter), F.col("frontmatter_yaml")).otherwise("").alias("frontmatter_yaml"),
        "path",
        "action",
        F.coalesce("final", F.lit(False)).alias("final"),
        "content",
        *classify(ending),
    )
    return result, plan
