"""HTML as a flat token array, one array per page row.

A page never leaves its row: tokens are an ARRAY column, so every page operator
is a narrow transformation and needs no shuffle to bring a page together again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let
from .entities import decode_entities

_WS = r" \t\n\f\r"

# Alternatives in order: comment, raw element, declaration, tag, text run, lone '<'.
# Possessive groups keep the matcher iterative on very long tags.
TOKEN = (
    r"<!--(?s:.*?)(?:-->|\z)"
    r"|<(?i:(?:script|style)(?=[" + _WS + r"/>]))(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>(?s:.*?)(?:</(?i:script|style)[^>]*+>|\z)"
    r"|<[!?][^>]*+>"
    r"|</?[A-Za-z](?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|[^<]++"
    r"|<"
)
OPEN_TAG = r"^<[A-Za-z](?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>"
ATTRIBUTE = (
    r"[^" + _WS + r"/>=]+"
    r"(?:[" + _WS + r"]*=[" + _WS + r"]*(?:\"[^\"]*\"|'[^']*'|[^" + _WS + r"\"'>][^" + _WS + r">]*)?)?"
)
TAG = r"</?[A-Za-z](?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>"
TAG_NAME = r"^</?([A-Za-z][^" + _WS + r"/>]*)"

# Block-level element names of HTML, used to cut text into blocks.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "tfoot", "thead", "title", "tr", "ul",
)


def token_array(html: Column) -> Column:
    """ARRAY<STRUCT<kind, tag, raw>>; the raw parts joined give the page back."""

    def token(raw: Column) -> Column:
        name = F.lower(F.regexp_extract(raw, TAG_NAME, 1))
        return (
            F.when(~raw.startswith("<") | (raw == "<"), _token("text", F.lit(""), raw))
            .when(raw.startswith("<!--"), _token("comment", F.lit(""), raw))
            .when(raw.startswith("<!") | raw.startswith("<?"), _token("decl", F.lit(""), raw))
            .when(raw.startswith("</"), _token("close", name, raw))
            .when(raw.rlike(r"^<(?i:script|style)[" + _WS + r"/>]"), _token("raw", name, raw))
            .when(raw.endswith("/>"), _token("self", name, raw))
            .otherwise(_token("open", name, raw))
        )

    return F.transform(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), token)


def _token(kind: str, tag: Column, raw: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), tag.alias("tag"), raw.alias("raw"))


def attributes(raw: Column, decoded: bool = True) -> Column:
    """ARRAY<STRUCT<name, value>> of one tag, in order, duplicates kept; references decoded unless told not to."""
    head = F.when(
        raw.rlike(r"^<(?i:script|style)[" + _WS + r"/>]"), F.regexp_extract(raw, OPEN_TAG, 0)
    ).otherwise(raw)
    body = F.regexp_replace(head, TAG_NAME + r"|/?>$", "")
    found = F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(0))

    def attribute(text: Column) -> Column:
        value = F.regexp_extract(text, r"^[^" + _WS + r"=]+[" + _WS + r"]*=[" + _WS + r"]*([\s\S]*)$", 1)
        bare = F.when(value.rlike("^[\"']"), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.struct(
            F.lower(F.regexp_extract(text, r"^[^" + _WS + r"=]+", 0)).alias("name"),
            (decode_entities(bare) if decoded else bare).alias("value"),
        )

    # a closing tag has no attributes
    return F.transform(F.filter(found, lambda _: ~raw.startswith("</")), attribute)


def attr_first(attrs: Column, name: str) -> Column:
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"]


def attr_last(attrs: Column, name: str) -> Column:
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(-1))["value"]


def is_open(token: Column, *tags: str) -> Column:
    return token["tag"].isin(*tags) & token["kind"].isin("open", "self")


def inner_text(token: Column) -> Column:
    """What a token says: text with references decoded, or the inside of a comment or raw element."""
    kind, raw = token["kind"], token["raw"]
    return (
        F.when(kind == "text", decode_entities(raw))
        .when(kind == "comment", F.regexp_replace(raw, r"^<!--|-->$", ""))
        .when(kind == "raw", F.regexp_replace(raw, OPEN_TAG + r"|</(?i:script|style)[^>]*>$", ""))
        .otherwise("")
    )


def first_index(tokens: Column, test) -> Column:
    """1-based index of the first token that passes ``test``; 0 when none does."""
    return F.array_position(F.transform(tokens, test), F.lit(True)).cast("int")


def text_until(tokens: Column, start: Column, stop) -> Column:
    """Tokens after ``start`` up to the first one that passes ``stop``."""
    rest = F.slice(tokens, start + 1, F.size(tokens))
    return let(
        rest,
        lambda tail: let(
            first_index(tail, stop),
            lambda end: F.slice(tail, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(tail))),
        ),
    )
