"""Pages -> token rows and meta rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import cached_column, each, each_numbered
from ..functions.html import attr_first, attributes, inner_text, is_open, token_array


def with_tokens(pages: DataFrame) -> DataFrame:
    """Add the token array of each page; a no-op when it is already there."""
    if "tokens" in pages.columns:
        return pages
    return pages.withColumn("tokens", _tokens_column())


@cached_column
def _tokens_column() -> Column:
    return token_array(F.coalesce("html", F.lit("")))


def html_tokens(pages: DataFrame) -> DataFrame:
    """One row per token: position, kind, tag, attributes, decoded text, raw source."""
    token = F.col("token")
    return (
        each_numbered(with_tokens(pages), F.col("tokens"), "pos", "token", "page_id")
        .select(
            "page_id",
            "pos",
            token["kind"].alias("kind"),
            token["tag"].alias("tag"),
            attributes(F.when(token["kind"].isin("open", "self", "raw"), token["raw"]).otherwise("")).alias("attrs"),
            inner_text(token).alias("text"),
            token["raw"].alias("raw"),
        )
    )


@cached_column
def meta_array(column: str = "tokens") -> Column:
    """ARRAY<STRUCT<pos, name, property, itemprop, content>> of the meta elements, in order."""
    tokens = F.col(column)
    found = F.filter(
        F.transform(tokens, lambda t, i: F.when(is_open(t, "meta"), F.struct(i.alias("pos"), t["raw"].alias("raw")))),
        lambda m: m.isNotNull(),
    )
    parsed = F.transform(
        found, lambda m: F.struct(m["pos"].alias("pos"), attributes(m["raw"]).alias("attrs"))
    )
    return F.transform(
        parsed,
        lambda m: F.struct(
            m["pos"].alias("pos"),
            *[attr_first(m["attrs"], key).alias(key) for key in ("name", "property", "itemprop", "content")],
        ),
    )


def meta_tags(pages: DataFrame) -> DataFrame:
    """One row per keyed meta element: attribute kind, key, content, position."""
    meta = F.col("meta")
    keyed = F.filter(
        F.array(
            *[F.struct(F.lit(k).alias("kind"), meta[k].alias("key")) for k in ("name", "property", "itemprop")]
        ),
        lambda k: k["key"].isNotNull(),
    )
    return (
        each(each(with_tokens(pages), meta_array(), "meta", "page_id"), keyed, "keyed", "page_id", "meta")
        .select(
            "page_id",
            meta["pos"].alias("pos"),
            F.col("keyed")["kind"].alias("kind"),
            F.col("keyed")["key"].alias("key"),
            F.coalesce(meta["content"], F.lit("")).alias("content"),
        )
    )
