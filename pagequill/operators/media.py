"""Images and links of pages, attachment planning, and image embeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import cached_column, each, let, rewrite_matches, starts_with_any, strip, tidy
from ..functions.entities import decode_entities
from ..functions.html import attr_first, attr_last, attributes, is_open
from ..functions.markdown import ABSOLUTE_PREFIXES, IMG_TAG, LINK, link_parts
from ..functions.text import image_name
from ..functions.urls import is_blocked_host, resolve_url, url_host
from ..sources.staging import stage
from .blocks import image_source
from .fetchlog import accept_image_responses
from .naming import IMAGE_NAME_PARTS, assign_names, split_name
from .running import join_by_block, range_of
from .tokens import with_tokens


@cached_column
def image_array(column: str = "tokens") -> Column:
    """ARRAY<STRUCT<pos, src, alt, width, height>>; a repeated attribute keeps its last value."""
    tokens = F.col(column)
    found = F.filter(
        F.transform(tokens, lambda t, i: F.when(is_open(t, "img"), F.struct(i.alias("pos"), t["raw"].alias("raw")))),
        lambda x: x.isNotNull(),
    )
    parsed = F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), attributes(x["raw"]).alias("a")))

    def number(attrs: Column, name: str) -> Column:
        value = attr_last(attrs, name)
        return F.when(value.rlike("^[0-9]+$"), value.try_cast("int"))

    images = F.transform(
        parsed,
        lambda x: F.struct(
            x["pos"].alias("pos"),
            image_source(x["a"]).alias("src"),
            F.coalesce(attr_last(x["a"], "alt"), F.lit("")).alias("alt"),
            number(x["a"], "width").alias("width"),
            number(x["a"], "height").alias("height"),
        ),
    )
    return F.filter(images, lambda x: x["src"] != "")


def page_images(pages: DataFrame) -> DataFrame:
    """One row per image of a page."""
    return (
        each(with_tokens(pages), image_array(), "image", "page_id", "url")
        .select("page_id", "url", "image.*")
    )


def link_class(href: Column) -> Column:
    return (
        F.when(starts_with_any(href, ("http://", "https://")), F.lit("external"))
        .when(href.startswith("mailto:"), F.lit("mailto"))
        .when(href.startswith("#"), F.lit("fragment"))
        .when(href.startswith("data:"), F.lit("data"))
        .otherwise("other")
    )


@cached_column
def link_array(column: str = "tokens") -> Column:
    """ARRAY<STRUCT<pos, text, href>>; an anchor ends at its close or at the next anchor."""

    def cut(tokens: Column) -> Column:
        marks = F.filter(
            F.transform(
                tokens,
                lambda t, i: F.when(
                    t["tag"] == "a",
                    F.struct(i.alias("pos"), (t["kind"] == "open").alias("opens"), t["raw"].alias("raw")),
                ),
            ),
            lambda m: m.isNotNull(),
        )

        def anchor(mark: Column, after: Column) -> Column:
            stop = F.coalesce(after["pos"], F.size(tokens))
            inside = F.slice(tokens, mark["pos"] + 2, stop - mark["pos"] - 1)
            texts = F.transform(F.filter(inside, lambda t: t["kind"] == "text"), lambda t: decode_entities(t["raw"]))
            return F.when(
                mark["opens"],
                F.struct(
                    mark["pos"].alias("pos"),
                    tidy(F.array_join(texts, "")).alias("text"),
                    attr_first(attributes(mark["raw"]), "href").alias("href"),
                ),
            )

        return let(
            marks,
            lambda m: F.zip_with(m, F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0))), anchor),
        )

    return F.filter(let(F.col(column), cut), lambda x: x["href"].isNotNull())


def page_links(pages: DataFrame) -> DataFrame:
    """Edge table of a page's links: text, raw and absolute target, class."""
    href = F.col("link")["href"]
    return (
        each(with_tokens(pages), link_array(), "link", "page_id", "url")
        .select(
            "page_id",
            F.col("link")["pos"].alias("pos"),
            F.col("link")["text"].alias("text"),
            href.alias("href"),
            F.when(starts_with_any(href, ABSOLUTE_PREFIXES), href)
            .otherwise(resolve_url(F.col("url"), href))
            .alias("abs_href"),
            link_class(href).alias("link_class"),
        )
    )


def plan_attachments(
    images: DataFrame, existing: DataFrame | None = None, conflict: str = "suffix", responses: DataFrame | None = None
) -> DataFrame:
    """(page_id, url, pos, src, alt, width) -> (page_id, src_abs, filename, width).

    Inline, scheme-relative and blocked sources drop out; names are unique over the
    whole output in page order; of several uses of a source on a page the last counts.
    ``existing`` holds the file names already there.

    ``responses`` (url, status_code, content_type, and page_id if pages fetched for themselves) says how fetching the
    images ended; a source is saved if one of its responses is an accepted image. One that is not saved is not in the
    plan. Its name stays taken for the rest of its page and is free for later pages. Without ``responses`` every
    planned image counts as saved.
    """
    src = strip(F.col("src"))
    absolute = F.when(starts_with_any(src, ("http://", "https://")), src).otherwise(resolve_url(F.col("url"), src))
    wanted = (
        images.filter((src != "") & ~starts_with_any(src, ("data:", "//")))
        .select("page_id", "pos", absolute.alias("src_abs"), "alt", "width")
        .filter(~is_blocked_host(url_host(F.col("src_abs"))))
        .withColumn("wanted", image_name(F.col("src_abs"), F.col("alt")))
        .select(
            "page_id",
            "src_abs",
            "width",
            F.struct("page_id", "pos").alias("seq"),
            F.col("page_id").cast("bigint").alias("place"),
            *split_name(F.col("wanted"), IMAGE_NAME_PARTS),
        )
    )
    if responses is not None:
        wanted = _with_saved(stage(wanted), responses)
    taken = None
    if existing is not None:
        taken = existing.select(*split_name(F.col("filename"), IMAGE_NAME_PARTS))
    named = assign_names(wanted, taken, conflict).filter(F.col("assigned").isNotNull())
    if responses is not None:
        named = named.filter("saved")
    last = F.max_by(F.struct(F.col("assigned").alias("filename"), "width"), "seq")
    return (
        named.groupBy("page_id", "src_abs")
        .agg(last.alias("last"))
        .select(
            "page_id",
            "src_abs",
            F.col("last")["filename"].alias("filename"),
            F.when(F.col("last")["width"] > 0, F.col("last")["width"]).alias("width"),
        )
    )


def _with_saved(wanted: DataFrame, responses: DataFrame) -> DataFrame:
    """Add ``saved``. An image that a third of all pages show meets its response once per range of pages."""
    keys = ["page_id", "src_abs"] if "page_id" in responses.columns else ["src_abs"]
    accepted = accept_image_responses(responses).withColumnRenamed("url", "src_abs")
    accepted = accepted.select(*keys).distinct().withColumn("saved", F.lit(True))
    ranges = range_of(wanted, "place")
    if ranges is None:
        met = wanted.join(accepted, keys, "left")
    else:
        met = join_by_block(wanted.withColumn("range", ranges), accepted, keys, "range").drop("range")
    return met.withColumn("saved", F.coalesce("saved", F.lit(False)))


def embed_text(markdown: Column, embeds: Column) -> Column:
    """Replace links to planned images by embeds; ``embeds`` maps source to embed text, null for no images."""

    def on_link(link: Column) -> Column:
        return F.coalesce(F.try_element_at(embeds, link_parts(link)["target"]), link)

    def on_tag(tag: Column) -> Column:
        return let(
            F.regexp_extract(tag, IMG_TAG, 1),
            lambda src: F.coalesce(
                F.try_element_at(embeds, src),
                F.concat(F.lit("<!-- image download failed: "), src, F.lit(" -->")),
            ),
        )

    linked = F.when(markdown.contains("]("), rewrite_matches(markdown, LINK, on_link)).otherwise(markdown)
    tagged = let(
        linked, lambda x: F.when(x.rlike("(?i)<img"), rewrite_matches(x, IMG_TAG, on_tag)).otherwise(x)
    )
    return F.when(embeds.isNull(), markdown).otherwise(tagged)


def embed_images(notes: DataFrame, plan: DataFrame) -> DataFrame:
    """Rewrite ``markdown`` of notes (page_id, ...) with an attachment plan.

    A page's plan is gathered into one map per page, so texts are joined once and
    rewritten in place. A boolean column ``has_images`` marks pages that show images
    although none was planned; without it only planned pages are rewritten.
    """
    embed = F.concat(
        F.lit("![["),
        "filename",
        F.when(F.col("width").isNotNull(), F.concat(F.lit("|"), F.col("width").cast("string"))).otherwise(""),
        F.lit("]]"),
    )
    per_page = (
        plan.select("page_id", F.struct("src_abs", embed.alias("embed")).alias("entry"))
        .groupBy("page_id")
        .agg(F.map_from_entries(F.collect_list("entry")).alias("embeds"))
    )
    joined = notes.join(per_page, "page_id", "left")
    if "has_images" in notes.columns:
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        joined = joined.withColumn("embeds", F.coalesce("embeds", F.when(F.col("has_images"), none)))
    return joined.withColumn("markdown", embed_text(F.col("markdown"), F.col("embeds"))).drop("embeds")
