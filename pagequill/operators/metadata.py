"""Article metadata: one struct per page, each field with its source priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import cached_column, let, strip
from ..functions.entities import decode_entities
from ..functions.html import attr_first, attributes, first_index, is_open, text_until
from ..functions.text import clean_text, keyword_tags, parse_date
from .tokens import meta_array, with_tokens

FIELDS = ("title", "author", "date", "description", "tags", "og_title", "og_description", "og_image")


HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Elements a heading lies in: the end of one ends a heading left open.
HEADING_PARENTS = ("header", "section", "article", "main", "body", "html")
# Elements that cannot stand in a heading: the start of one ends a heading that has no end tag.
HEADING_ENDERS = (
    "p", "ul", "ol", "dl", "li", "dt", "dd", "table", "form", "fieldset", "header", "section", "article", "main", "nav", "footer", "aside",
)


def _content(metas: Column, *sources: tuple[str, str]) -> Column:
    """Trimmed content of the first existing element, sources tried in order."""
    chosen = F.coalesce(*[F.get(_having(metas, kind, key), F.lit(0)) for kind, key in sources])
    return strip(F.coalesce(chosen["content"], F.lit("")))


def _having(metas: Column, kind: str, key: str) -> Column:
    return F.filter(metas, lambda m: m[kind] == key)


def heading_text(tokens: Column) -> Column:
    """Text of the first h1: its text nodes trimmed one by one and joined.

    It reads to the end tag, blocks inside included. A heading without one (another heading starts first, its parent
    ends, or the page does) is left open, and ends where something starts that no heading holds.
    """
    start = first_index(tokens, lambda t: is_open(t, "h1"))

    def ends(t: Column) -> Column:
        return t["tag"].isin(*HEADING_TAGS) | ((t["kind"] == "close") & t["tag"].isin(*HEADING_PARENTS))

    def inside(rest: Column) -> Column:
        def to_end(end: Column) -> Column:
            closed = F.get(rest, end - 1)
            whole = F.slice(rest, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(rest)))
            return F.when((closed["kind"] == "close") & closed["tag"].isin(*HEADING_TAGS), whole).otherwise(
                text_until(whole, F.lit(0), lambda t: is_open(t, *HEADING_ENDERS))
            )

        return let(first_index(rest, ends), to_end)

    found = let(start, lambda s: F.when(s > 0, let(F.slice(tokens, s + 1, F.size(tokens)), inside)))
    texts = F.transform(
        F.filter(found, lambda t: t["kind"] == "text"), lambda t: strip(decode_entities(t["raw"]))
    )
    return F.coalesce(F.array_join(texts, ""), F.lit(""))


def title_text(tokens: Column) -> Column:
    """Text of the first title element, when it holds exactly one text node."""
    start = first_index(tokens, lambda t: is_open(t, "title"))
    inside = let(start, lambda s: F.when(s > 0, text_until(tokens, s, lambda t: t["tag"] == "title")))
    return F.coalesce(
        let(
            inside,
            lambda p: F.when(
                (F.size(p) == 1) & (F.get(p, F.lit(0))["kind"] == "text"),
                decode_entities(F.get(p, F.lit(0))["raw"]),
            ),
        ),
        F.lit(""),
    )


def article_title(tokens: Column, og_title: Column) -> Column:
    return F.coalesce(
        F.nullif(clean_text(heading_text(tokens)), F.lit("")),
        F.nullif(clean_text(title_text(tokens)), F.lit("")),
        og_title,
    )


@cached_column
def metadata_struct() -> Column:
    """Metadata of a row with ``tokens`` and ``metas``."""
    tokens, metas = F.col("tokens"), F.col("metas")
    og_title = clean_text(_content(metas, ("property", "og:title")))
    first_author = _content(metas, ("name", "author"), ("property", "article:author"))
    published = parse_date(
        _content(
            metas,
            ("property", "article:published_time"),
            ("name", "date"),
            ("name", "publishdate"),
            ("name", "publication_date"),
        )
    )
    time_attrs = F.transform(F.filter(tokens, lambda t: is_open(t, "time")), lambda t: attributes(t["raw"]))
    dated = F.filter(time_attrs, lambda a: attr_first(a, "datetime").isNotNull())
    time_date = parse_date(F.coalesce(attr_first(F.get(dated, F.lit(0)), "datetime"), F.lit("")))
    return F.struct(
        let(og_title, lambda og: article_title(tokens, og)).alias("title"),
        let(
            first_author,
            lambda a: F.when(a != "", a).otherwise(_content(metas, ("itemprop", "author"))),
        ).alias("author"),
        let(published, lambda d: F.when(d != "", d).otherwise(time_date)).alias("date"),
        _content(metas, ("name", "description"), ("property", "og:description")).alias("description"),
        keyword_tags(_content(metas, ("name", "keywords"))).alias("tags"),
        og_title.alias("og_title"),
        F.lit("").alias("og_description"),
        _content(metas, ("property", "og:image")).alias("og_image"),
    )


def with_metadata(pages: DataFrame) -> DataFrame:
    """Add a ``meta`` struct column; narrow, nothing is shuffled."""
    return (
        with_tokens(pages)
        .withColumn("metas", meta_array())
        .withColumn("meta", metadata_struct())
        .drop("metas")
    )


def article_metadata(pages: DataFrame) -> DataFrame:
    return with_metadata(pages).select("page_id", "url", *[F.col("meta")[f].alias(f) for f in FIELDS])


def article_titles(pages: DataFrame) -> DataFrame:
    """Only the title of each page."""
    return with_metadata(pages).select("page_id", "url", F.col("meta")["title"].alias("title"))
