"""Text blocks of a page, boilerplate removal, and rendering to base Markdown.

All of it stays inside the page row. Block-level tags cut the token array into
segments; one short fold over the segments finds region and depths; the inline
HTML of each segment is then rewritten with native string functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import SPACE, cached_column, each, is_blank, let, rewrite_matches, scan, strip, tidy
from ..functions.entities import decode_entities
from ..functions.html import BLOCK_TAGS, TAG, attr_first, attr_last, attributes
from ..functions.urls import url_host
from ..sources.staging import stage
from .tokens import with_tokens

# Regions whose text is never article text, strongest first.
DROPPED_REGIONS = ("head", "nav", "header", "footer", "aside", "form", "ad")
ARTICLE_REGIONS = ("article", "main")
# Regions whose text may be article text where a page has no article or main.
OPEN_REGIONS = ("body", "form")
AD_CLASSES = ("ad", "ads", "advert", "advertisement", "sponsored")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
MAX_LINK_SHARE = 0.33
MIN_WORDS = 10

_COUNTERS = ("article", "main", "nav", "header", "footer", "aside", "form", "head", "div", "list", "quote")
_LANDMARKS = ("nav", "header", "footer", "aside", "form", "ad", "article", "main")
_SURROUNDING = ("nav", "header", "footer", "aside")
_MARKS = tuple(f"{name}_{what}" for name in _LANDMARKS for what in ("at", "in"))
_LISTS = ("ul", "ol")
# Tags that change what is around a block; all others only start a new one.
_ENCLOSING = (
    "article", "main", "nav", "header", "footer", "aside", "form", "head", "body", "div", "ul", "ol", "blockquote",
)

_NAME_END = r"(?=[ \t\n\f\r/>])"
_REST = r"(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>"
_ANCHOR = rf"(?is)<a{_NAME_END}{_REST}(.*?)(?:</a[^>]*>|(?=<a{_NAME_END})|\z)"
_IMAGE = rf"(?i)<img{_NAME_END}{_REST}"
_GAP_TAG = rf"(?i)</?(?:td|th|br){_NAME_END}[^>]*>"
_CELL = rf"(?i)<(?:td|th){_NAME_END}[^>]*>"
_MATH_SPAN = r"(?i)<span\s+class\s*=\s*[\"']math[\"']>"
# Inline elements handed on as they are: the Markdown steps rewrite them.
_KEPT = "mark|del|s|strike|math"


@cached_column
def block_array(column: str = "tokens", regions: tuple[str, ...] | None = None) -> Column:
    """ARRAY<STRUCT<block_id, tag, region, depth, ordered, quote, text, inline, words, link_words>>.

    With ``regions`` only the blocks that lie there; no text is made of the others.
    """
    tokens = F.col(column)
    start = F.struct(F.lit("start").alias("kind"), F.lit("").alias("tag"), F.lit("").alias("raw"))

    def from_segments(segments: Column) -> Column:
        places = scan(segments, F.struct(_first_place().alias("o")), lambda s, x: F.struct(_next_place(s["o"], x).alias("o")))

        def shown(x: Column, g: Column) -> Column:
            return ~is_blank(x["inline"]) if regions is None else g["around"]["region"].isin(*regions) & ~is_blank(x["inline"])

        paired = F.zip_with(segments, places, lambda x, g: F.when(shown(x, g), F.struct(g.alias("g"), x["inline"].alias("inline"))))
        return F.transform(F.filter(paired, lambda x: x.isNotNull()), _block)

    shown = F.filter(tokens, lambda t: ~t["kind"].isin("comment", "decl", "raw"))
    blocks = let(let(F.concat(F.array(start), shown), _segments), from_segments)
    return F.filter(blocks, lambda b: (b["text"] != "") | b["inline"].rlike(_IMAGE))


def _segments(tokens: Column) -> Column:
    """Each block-level tag with the inline HTML that follows it."""
    starts = F.filter(
        F.transform(
            tokens,
            lambda t, i: F.when((t["kind"] != "text") & (t["tag"].isin(*BLOCK_TAGS) | (i == 0)), i),
        ),
        lambda i: i.isNotNull(),
    )

    def cut(starts: Column) -> Column:
        ends = F.array_append(F.slice(starts, F.lit(2), F.size(starts)), F.size(tokens))
        return F.zip_with(
            starts,
            ends,
            lambda a, b: let(
                F.get(tokens, a),
                lambda t: F.struct(
                    t["kind"].alias("kind"),
                    t["tag"].alias("tag"),
                    t["raw"].alias("raw"),
                    F.array_join(F.transform(F.slice(tokens, a + 2, b - a - 1), lambda x: x["raw"]), "").alias("inline"),
                ),
            ),
        )

    return let(starts, cut)


def _first_place() -> Column:
    zero = F.lit(0)
    return F.struct(
        F.lit(-1).alias("block"),
        F.lit("").alias("tag"),
        F.struct(
            F.lit("body").alias("region"),
            *[zero.alias(c) for c in (*_COUNTERS, "ad", "ordered", "seen", *_MARKS)],
        ).alias("around"),
    )


def _region(counts: Column) -> Column:
    """The innermost landmark that is open: the one that was opened last."""

    def named(latest: Column) -> Column:
        chosen = F.when(latest == 0, F.lit("body"))
        for name in _LANDMARKS:
            chosen = chosen.when(counts[f"{name}_at"] == latest, F.lit(name))
        return chosen

    latest = F.greatest(*[counts[f"{name}_at"] for name in _LANDMARKS])
    return F.when(counts["head"] > 0, F.lit("head")).otherwise(let(latest, named))


def _next_place(g: Column, t: Column) -> Column:
    """Place after a block-level tag: a new block and, for tags that enclose blocks, what is around it now."""
    opens = t["kind"] == "open"
    return F.struct(
        (g["block"] + 1).alias("block"),
        F.when((t["tag"] == "p") & opens & (g["tag"] == "li"), F.lit("li"))
        .when(opens, t["tag"])
        .otherwise("")
        .alias("tag"),
        F.when(t["tag"].isin(*_ENCLOSING), _next_around(g["around"], t)).otherwise(g["around"]).alias("around"),
    )


def _next_around(g: Column, t: Column) -> Column:
    """Depths after an enclosing tag, held at zero, and the region they give."""
    opens, closes = t["kind"] == "open", t["kind"] == "close"

    def depth(name: str) -> Column:
        hit = t["tag"].isin(*_LISTS) if name == "list" else t["tag"] == {"quote": "blockquote"}.get(name, name)
        step = F.when(opens, F.lit(1)).when(closes, F.lit(-1)).otherwise(F.lit(0))
        return F.when(hit, F.greatest(g[name] + step, F.lit(0))).otherwise(g[name])

    counts = {name: depth(name) for name in _COUNTERS}
    counts["head"] = F.when((t["tag"] == "body") & opens, F.lit(0)).otherwise(counts["head"])
    counts["ad"] = F.when(
        t["tag"] == "div",
        F.when(closes & (g["ad"] >= g["div"]), F.lit(0))
        .when(opens & (g["ad"] == 0), F.when(_has_class(t["raw"], AD_CLASSES), g["div"] + 1).otherwise(0))
        .otherwise(g["ad"]),
    ).otherwise(g["ad"])
    counts["ordered"] = (
        F.when((t["tag"] == "ol") & opens, g["list"] + 1)
        .when(t["tag"].isin(*_LISTS), F.lit(0))
        .otherwise(g["ordered"])
    )
    counts["seen"] = g["seen"] + 1
    owned = opens & t["tag"].isin("article", "main")

    def marks(c: Column) -> Column:
        """When each landmark was opened, 0 if closed, and in which div.

        One left open ends with the div around it, and where an article or main begins.
        """

        def change(name: str) -> Column:
            left = c["div"] < g[f"{name}_in"]
            if name in _SURROUNDING:
                left = left | owned
            return F.when(c[name] == 0, F.lit("ended")).when(c[name] > g[name], F.lit("deeper")).when(left, F.lit("ended")).otherwise("")

        def settled(changes: Column) -> Column:
            out = {name: c[name] for name in counts}
            for name in _LANDMARKS:
                ended, deeper = changes[name] == "ended", changes[name] == "deeper"
                out[name] = F.when(ended, F.lit(0)).otherwise(c[name])
                out[f"{name}_at"] = F.when(ended, F.lit(0)).when(deeper, c["seen"]).otherwise(g[f"{name}_at"])
                out[f"{name}_in"] = F.when(ended, F.lit(0)).when(deeper, c["div"]).otherwise(g[f"{name}_in"])
            return F.struct(*[value.alias(name) for name, value in out.items()])

        return let(F.struct(*[change(name).alias(name) for name in _LANDMARKS]), settled)

    enclosed = let(
        let(F.struct(*[value.alias(name) for name, value in counts.items()]), marks),
        lambda c: F.struct(_region(c).alias("region"), *[c[name].alias(name) for name in (*counts, *_MARKS)]),
    )
    # lists and quotes open and end no landmark
    inner = F.struct(g["region"].alias("region"), *[(counts[c] if c in ("list", "quote", "ordered", "seen") else g[c]).alias(c) for c in (*counts, *_MARKS)])
    return F.when(t["tag"].isin(*_LISTS, "blockquote"), inner).otherwise(enclosed)


def _has_class(raw: Column, classes: tuple[str, ...]) -> Column:
    value = F.lower(F.coalesce(attr_first(attributes(raw, decoded=False), "class"), F.lit("")))
    return F.when(
        raw.contains("="), F.arrays_overlap(F.split(value, f"[{SPACE}]+"), F.array(*[F.lit(c) for c in classes]))
    ).otherwise(False)


def _block(item: Column) -> Column:
    g, inline = item["g"], item["inline"]
    around = g["around"]
    has_tags = inline.contains("<")

    def word_count(text: Column) -> Column:
        return F.when(text == "", F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1)

    def finish(x: Column) -> Column:
        return F.struct(
            g["block"].alias("block_id"),
            g["tag"].alias("tag"),
            around["region"].alias("region"),
            around["list"].alias("depth"),
            (around["ordered"] > 0).alias("ordered"),
            around["quote"].alias("quote"),
            x[0].alias("text"),
            inline.alias("inline"),
            word_count(x[0]).alias("words"),
            word_count(x[1]).alias("link_words"),
        )

    raw = F.array(
        F.when(has_tags, plain_text(inline)).otherwise(inline), F.when(has_tags, link_text(inline)).otherwise("")
    )
    return let(F.transform(raw, lambda x: F.when(x != "", tidy(decode_entities(x))).otherwise(x)), finish)


def block_markdown(b: Column, keep_images: bool) -> Column:
    """Markdown of a block's inline HTML, without its list mark, heading or quote frame."""
    inline = b["inline"] if keep_images else F.regexp_replace(b["inline"], _IMAGE, "")
    pre = b["tag"] == "pre"
    shown = decode_entities(F.when(pre, plain_text(inline)).otherwise(inline_markdown(inline)))
    return F.when(
        pre | inline.contains("<"), let(shown, lambda x: F.when(pre, x).otherwise(tidy(x)))
    ).otherwise(b["text"])


def plain_text(inline: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(inline, _GAP_TAG, " "), TAG, "")


def link_text(inline: Column) -> Column:
    links = F.regexp_extract_all(inline, F.lit(_ANCHOR), F.lit(1))
    return plain_text(F.array_join(links, " "))


def inline_markdown(inline: Column) -> Column:
    """Inline HTML of one block as Markdown; references are left for the caller."""

    def element(names: str) -> str:
        return rf"(?is)<(?:{names}){_NAME_END}[^>]*>(.*?)(?:</(?:{names})[ \t\n\f\r]*>|\z)"

    def image(tag: Column) -> Column:
        return let(
            attributes(tag, decoded=False),
            lambda a: F.concat(
                F.lit("!["), F.coalesce(attr_last(a, "alt"), F.lit("")), F.lit("]("), strip(image_source(a)), F.lit(")")
            ),
        )

    def link(match: Column) -> Column:
        inner = F.regexp_extract(match, _ANCHOR, 1)
        return let(
            strip(F.coalesce(attr_first(attributes(F.regexp_extract(match, TAG, 0), decoded=False), "href"), F.lit(""))),
            lambda href: F.when(href == "", inner).otherwise(
                F.concat(F.lit("["), inner, F.lit("]("), href, F.lit(")"))
            ),
        )

    def marked(text: Column) -> Column:
        bold = F.regexp_replace(text, element("b|strong"), "**$1**")
        italic = F.regexp_replace(bold, element("i|em"), "*$1*")
        return F.regexp_replace(italic, element("code"), "`$1`")

    with_images = F.when(inline.rlike(_IMAGE), rewrite_matches(inline, _IMAGE, image)).otherwise(inline)
    with_links = let(
        with_images, lambda x: F.when(x.rlike(_ANCHOR), rewrite_matches(x, _ANCHOR, link)).otherwise(x)
    )
    cells = F.regexp_replace(F.regexp_replace(marked(with_links), _CELL, " | "), _GAP_TAG, " ")
    return let(
        cells,
        lambda x: F.when(
            x.rlike(_MATH_SPAN), F.regexp_replace(x, rf"(?i)(?!</?(?:{_KEPT}|span){_NAME_END}){TAG}", "")
        ).otherwise(F.regexp_replace(x, rf"(?i)(?!</?(?:{_KEPT}){_NAME_END}){TAG}", "")),
    )


def image_source(attrs: Column) -> Column:
    """``src``, or ``data-src`` when it is missing or empty."""
    return F.coalesce(F.nullif(attr_last(attrs, "src"), F.lit("")), attr_last(attrs, "data-src"), F.lit(""))


def is_dense(block: Column) -> Column:
    return (block["words"] >= MIN_WORDS) & (block["link_words"] / F.greatest(block["words"], F.lit(1)) < MAX_LINK_SHARE)


@cached_column
def article_blocks(column: str = "blocks") -> Column:
    """Article and main blocks when the page has any, else dense blocks with their headings."""

    def pick(all_blocks: Column) -> Column:
        marked = F.filter(all_blocks, lambda b: b["region"].isin(*ARTICLE_REGIONS))
        body = F.filter(all_blocks, lambda b: b["region"].isin(*OPEN_REGIONS))

        def dense(items: Column) -> Column:
            def neighbour(i: Column) -> Column:
                return F.coalesce(is_dense(F.get(items, i)), F.lit(False))

            return F.filter(
                items,
                lambda b, i: is_dense(b)
                | (b["tag"].isin(*HEADINGS) & (neighbour(i + 1) | F.when(i > 0, neighbour(i - 1)).otherwise(F.lit(False)))),
            )

        return F.when(F.size(marked) > 0, marked).otherwise(let(body, dense))

    return let(F.col(column), pick)


@cached_column
def render(keep_images: bool = True, column: str = "blocks") -> Column:
    """Base Markdown of a block array; blocks are parted by a blank line, list items and rows by one line feed."""

    def one(items: Column) -> Column:
        def block(b: Column, i: Column) -> Column:
            return let(block_markdown(b, keep_images), lambda md: framed(b, i, md))

        def framed(b: Column, i: Column, md: Column) -> Column:
            before = F.when(i > 0, F.get(items, i - 1)["tag"]).otherwise(F.lit(""))
            level = F.substring(b["tag"], 2, 1).try_cast("int")
            cells = F.size(F.split(md, r"\| ", -1)) - 1
            body = (
                F.when(b["tag"].isin(*HEADINGS), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), md))
                .when(
                    b["tag"] == "li",
                    F.concat(
                        F.repeat(F.lit("  "), F.greatest(b["depth"] - 1, F.lit(0))),
                        F.when(b["ordered"], F.lit("1. ")).otherwise("- "),
                        md,
                    ),
                )
                .when(b["tag"] == "pre", F.concat(F.lit("```\n"), F.regexp_replace(md, r"^\n+|\n+$", ""), F.lit("\n```")))
                .when(
                    b["tag"] == "tr",
                    F.concat(
                        md,
                        F.lit(" |"),
                        F.when(before != "tr", F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), cells))).otherwise(""),
                    ),
                )
                .otherwise(md)
            )
            quoted = F.when(
                b["quote"] > 0, F.concat(F.lit("> "), F.replace(body, F.lit("\n"), F.lit("\n> ")))
            ).otherwise(body)
            gap = (
                F.when(i == 0, F.lit(""))
                .when((b["tag"] == before) & b["tag"].isin("li", "tr"), F.lit("\n"))
                .otherwise(F.lit("\n\n"))
            )
            return F.when(md != "", F.concat(gap, quoted)).otherwise("")

        return F.array_join(F.transform(items, block), "")

    return let(F.col(column), one)


def with_blocks(pages: DataFrame) -> DataFrame:
    if "blocks" in pages.columns:
        return pages
    return with_tokens(pages).withColumn("blocks", block_array())


def _block_rows(blocks: DataFrame) -> DataFrame:
    b = F.col("b")
    return each(blocks, F.col("blocks"), "b", "page_id").select(
        "page_id",
        b["block_id"].alias("block_id"),
        b["tag"].alias("tag"),
        b["region"].alias("region"),
        b["text"].alias("text"),
        b["words"].alias("words"),
        (b["link_words"] / F.greatest(b["words"], F.lit(1))).alias("link_share"),
    )


def text_blocks(pages: DataFrame) -> DataFrame:
    """One row per text block: tag, region, text, word count, share of linked words."""
    return _block_rows(with_blocks(pages))


def main_blocks(pages: DataFrame, max_host_repeat: int | None = None) -> DataFrame:
    """The article blocks only, one row each."""
    return _block_rows(with_article(pages, max_host_repeat))


def render_markdown(pages: DataFrame, keep_images: bool = True, max_host_repeat: int | None = None) -> DataFrame:
    kept = with_article(pages, max_host_repeat)
    return kept.select("page_id", "url", render(keep_images).alias("markdown"))


def with_article(pages: DataFrame, max_host_repeat: int | None = None) -> DataFrame:
    """Pages whose ``blocks`` are narrowed to the article."""
    if "blocks" not in pages.columns:
        pages = with_tokens(pages).withColumn("blocks", block_array("tokens", (*ARTICLE_REGIONS, *OPEN_REGIONS)))
    kept = pages.withColumn("blocks", article_blocks())
    if max_host_repeat is None:
        return kept
    # the blocks are read three times from here on, so they are computed once
    return drop_repeated(stage(kept.drop("html", "tokens")), max_host_repeat)


def _block_keys(host_pages: DataFrame) -> DataFrame:
    """(page_id, host, key): the distinct block texts of each page, as hashes."""
    keys = F.array_distinct(F.transform("blocks", _text_key))
    return each(host_pages, keys, "key", "page_id", url_host(F.col("url")).alias("host"))


def _text_key(block: Column) -> Column:
    return F.md5(block["text"].cast("binary"))


def repeated_blocks(pages: DataFrame, max_host_repeat: int) -> DataFrame:
    """(host, key, n_pages) of block texts found on more than ``max_host_repeat`` pages of a host.

    A text counts once per page; the page removes its own doubles first, so the
    count is a plain sum with map-side combining and no distinct shuffle.
    """
    return _repeated(_block_keys(with_blocks(pages)), max_host_repeat)


def _repeated(keys: DataFrame, max_host_repeat: int) -> DataFrame:
    counted = keys.groupBy("host", "key").agg(F.count("*").alias("n_pages"))
    return counted.filter(F.col("n_pages") > max_host_repeat)


# At most this many keys can each hold more than 1/HEAVY_KEYS of all rows.
HEAVY_KEYS = 10_000


def drop_repeated(pages: DataFrame, max_host_repeat: int) -> DataFrame:
    """Remove repeated blocks from each page's array; pages keep their row even when nothing is left.

    Keys are hashed once and staged. Only hashes travel: the texts move once, when the pages meet their own dropped keys.
    A key that holds over 1/10,000 of all key rows is broadcast: there can be no more
    than 10,000 of those. All others are joined by shuffle, where no key is hot.
    """
    keys = stage(_block_keys(pages))
    repeated = stage(_repeated(keys, max_host_repeat))
    heavy_from = keys.count() / HEAVY_KEYS
    heavy = repeated.filter(F.col("n_pages") > heavy_from).select("host", "key")
    light = repeated.filter(F.col("n_pages") <= heavy_from).select("host", "key")
    dropped = (
        keys.join(F.broadcast(heavy), ["host", "key"], "left_semi")
        .unionByName(keys.join(light, ["host", "key"], "left_semi"))
        .groupBy("page_id")
        .agg(F.collect_list("key").alias("dropped"))
    )
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("dropped", _text_key(b)), F.lit(False)))
    return pages.join(dropped, "page_id", "left").withColumn("blocks", kept).drop("dropped")
