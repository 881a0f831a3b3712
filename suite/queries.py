"""One query per operator, each over whole given tables or views of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequill.functions import markdown as md
from pagequill.functions.core import each
from pagequill.functions.entities import decode_entities as decode_entities_col
from pagequill.functions.frontmatter import frontmatter_yaml as yaml_col
from pagequill.functions.text import clean_text, image_name, keyword_tags, note_name, parse_date
from pagequill.functions.text import slugify as slugify_col
from pagequill.functions.urls import resolve_url, url_extension
from pagequill.operators import blocks, fetchlog, media, metadata, naming, notes, outcomes, tokens
from pagequill.plans.clip import ClipOptions, clip_pages
from pagequill.plans.clip import clip_responses as clip_from_responses
from pagequill.sources.staging import staging_root
from pagequill.sources.tables import read_notes, read_pages, read_url_list
from pagequill.streaming.notes import stream_notes as run_stream

from .fixtures import spread, view

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2026-12-01"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_pages(spark, f"{sf}/pages.parquet"), "page_id")


def _decorated(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "decorated_pages")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "note_sources")


def _rewritten(step: Callable[[Column], Column]) -> Query:
    """A Markdown step over every note text."""
    return lambda spark, sf: _sources(spark, sf).select("doc_id", step(F.col("markdown")).alias("markdown"))


def pages_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page_id", "url", F.md5("html").alias("html_md5"))


def url_list(spark: SparkSession, sf: str) -> DataFrame:
    """Page URLs written as text files in page order, with comments and blanks, and read as a URL list."""
    lines = _pages(spark, sf).orderBy("page_id").select(
        F.concat(F.lit("# page "), F.col("page_id").cast("string"), F.lit("\n\n  "), "url", F.lit(" ")).alias("value")
    )
    folder = _folder(spark, "urls")
    lines.write.text(folder)
    return read_url_list(spark, folder, ["https://first.example/", "https://first.example/"])


def html_tokens(spark: SparkSession, sf: str) -> DataFrame:
    attrs = F.array_join(F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), a["value"])), "|")
    return tokens.html_tokens(_decorated(spark, sf)).withColumn("attrs", attrs)


def decode_entities(spark: SparkSession, sf: str) -> DataFrame:
    found = tokens.html_tokens(_pages(spark, sf)).filter("kind = 'text'")
    return found.select("page_id", "pos", decode_entities_col(F.col("raw")).alias("text"))


def meta_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.meta_tags(_decorated(spark, sf))


def article_titles_open(spark: SparkSession, sf: str) -> DataFrame:
    return metadata.article_titles(view(spark, sf, "open_pages"))


def text_blocks_open(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.text_blocks(view(spark, sf, "open_pages"))


def article_titles(spark: SparkSession, sf: str) -> DataFrame:
    return metadata.article_titles(_pages(spark, sf))


def article_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return metadata.article_metadata(_decorated(spark, sf)).withColumn("tags", F.array_join("tags", "|"))


def clean_texts(spark: SparkSession, sf: str) -> DataFrame:
    text = _documents(spark, sf)
    return text.select("doc_id", clean_text(F.col("text")).alias("text"))


def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = tokens.meta_tags(_decorated(spark, sf)).filter("key in ('article:published_time', 'date', 'publishdate', 'publication_date')")
    return rows.select("page_id", "pos", "content", parse_date(F.col("content")).alias("day"))


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    rows = tokens.meta_tags(_decorated(spark, sf)).filter("kind = 'name' and key = 'keywords'")
    return rows.select("page_id", keyword_tags(F.col("content")).alias("tags")).withColumn("tags", F.array_join("tags", "|"))


def page_images(spark: SparkSession, sf: str) -> DataFrame:
    return media.page_images(_decorated(spark, sf)).drop("url")


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return media.page_links(_decorated(spark, sf))


def text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.text_blocks(_decorated(spark, sf))


def main_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.main_blocks(_decorated(spark, sf))


def _unmarked(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the pages lose their article element, so the density rule decides."""
    html = F.when(
        F.col("page_id") % 2 == 0,
        F.replace(F.replace("html", F.lit("<article>"), F.lit("<div>")), F.lit("</article>"), F.lit("</div>")),
    ).otherwise(F.col("html"))
    return _pages(spark, sf).withColumn("html", html)


def main_blocks_density(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.main_blocks(_unmarked(spark, sf))


MAX_HOST_REPEAT = 1


def repeated_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.repeated_blocks(_one_host(spark, sf), MAX_HOST_REPEAT)


def _one_host(spark: SparkSession, sf: str) -> DataFrame:
    """Every page under one of five hosts, so that boilerplate repeats and hosts are hot."""
    host = F.concat(F.lit("https://h"), (F.col("page_id") % 5).cast("string"), F.lit(".example/"), F.col("page_id").cast("string"))
    return _decorated(spark, sf).withColumn("url", host)


def main_blocks_unrepeated(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.main_blocks(_one_host(spark, sf), max_host_repeat=MAX_HOST_REPEAT)


def render_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.render_markdown(_decorated(spark, sf))


def empty_articles(spark: SparkSession, sf: str) -> DataFrame:
    texts = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" \t\n"), F.lit(" "))).otherwise(F.col("text"))
    rows = _documents(spark, sf).select("doc_id", texts.alias("markdown"))
    return outcomes.drop_empty(rows).select("doc_id", "status")


def validate_urls(spark: SparkSession, sf: str) -> DataFrame:
    return fetchlog.validate_urls(view(spark, sf, "url_candidates"))


def blocked_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return fetchlog.flag_blocked_hosts(view(spark, sf, "url_candidates"))


def fetch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return fetchlog.fetch_outcomes(view(spark, sf, "fetch_attempts"))


def image_responses(spark: SparkSession, sf: str) -> DataFrame:
    return fetchlog.accept_image_responses(view(spark, sf, "image_responses"))


def decode_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "responses")
    # every fourth body comes as Latin-1 bytes under its own header
    latin = F.col("seq") % 4 == 3
    plain = F.regexp_replace("text", r"[^\x00-\xFF]", "?")
    body = F.when(latin, F.encode(plain, "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    kind = F.when(latin, F.lit("text/html; charset=latin-1")).otherwise(F.col("content_type"))
    return fetchlog.decode_pages(rows.select("seq", "url", kind.alias("content_type"), body.alias("body")))


def _attempt_results(spark: SparkSession, sf: str) -> DataFrame:
    attempts = view(spark, sf, "fetch_attempts")
    ending = fetchlog.attempt_outcome(F.col("status_code"), F.col("failure"))
    blank = F.when(F.col("content_type") == "", F.lit("blank")).otherwise(ending)
    return attempts.select("seq", "url", F.when(ending == "success", blank).otherwise(ending).alias("ending"))


def classify_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.classify_outcomes(_attempt_results(spark, sf))


def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.batch_summary(classify_outcomes(spark, sf))


def resolve_urls(spark: SparkSession, sf: str) -> DataFrame:
    pages = tokens.with_tokens(_decorated(spark, sf))
    rows = each(pages, media.link_array(), "link", "page_id", "url").select("page_id", "url", "link.pos", "link.href")
    return rows.select("page_id", "pos", "href", resolve_url(F.col("url"), F.col("href")).alias("target"))


def url_extensions(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "image_responses").select("seq", "url", url_extension(F.col("url")).alias("ext"))


def image_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = media.page_images(_decorated(spark, sf))
    return rows.select("page_id", "pos", image_name(F.col("src"), F.col("alt")).alias("filename"))


def attachment_plan(spark: SparkSession, sf: str) -> DataFrame:
    return media.plan_attachments(media.page_images(_decorated(spark, sf)))


def attachment_plan_results(spark: SparkSession, sf: str) -> DataFrame:
    """Names of images of which some could not be fetched, and of which some were there before."""
    existing = spark.createDataFrame([("pic-4.png",), ("shot.png",), ("shot-3.png",), ("calm-3.png",)], "filename string")
    return media.plan_attachments(view(spark, sf, "gallery"), existing, responses=view(spark, sf, "gallery_responses"))


def embed_images(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered pages, which show their images, and after each the same images as an absolute link, a plain link and a tag."""
    pages = blocks.render_markdown(_decorated(spark, sf))
    plan = media.plan_attachments(media.page_images(_decorated(spark, sf)))
    host = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    name = F.concat(F.lit("/img/p"), (F.col("page_id") % 4).cast("string"), F.lit(".PNG?w=1"))
    text = F.concat(
        F.lit("![My Photo]("), host, name, F.lit(")\n[plain](https://cdn.example.com/a.webp) ![rel](/img/x.png)\n"),
        F.lit('<img alt="x" src="https://cdn.example.com/a.webp" width="9"> <IMG src=\'/lost.png\'>\n[z](u)'),
    )
    shown = F.concat("markdown", F.lit("\n"), text)
    return media.embed_images(pages.select("page_id", shown.alias("markdown")), plan)


def slugify(spark: SparkSession, sf: str) -> DataFrame:
    text = _documents(spark, sf)
    return text.select("doc_id", slugify_col(F.col("text")).alias("slug"))


def note_names(spark: SparkSession, sf: str) -> DataFrame:
    text = _documents(spark, sf)
    url = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("https://n.example/"), F.col("doc_id").cast("string")))
    date = F.when(F.col("doc_id") % 2 == 0, "2026-09-22").otherwise("")
    title = F.concat("text", F.repeat(F.lit(" tail"), (F.col("doc_id") % 9).cast("int")))
    return text.select("doc_id", note_name(title, url, date, date_prefix=True).alias("name"))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "name_requests")
    return rows.select("seq", note_name(F.col("title"), F.lit(""), F.lit("")).alias("name"))


def note_paths_suffix(spark: SparkSession, sf: str) -> DataFrame:
    """The thin slice: pages -> titles -> names -> unique paths."""
    titles = metadata.article_titles(_pages(spark, sf))
    names = titles.select(F.col("page_id").alias("seq"), note_name(F.col("title"), F.col("url"), F.lit("")).alias("name"))
    return naming.assign_note_paths(names, None, "suffix").select("seq", "name", "path", "action")


def note_paths_collisions(spark: SparkSession, sf: str) -> DataFrame:
    taken = view(spark, sf, "catalogue")
    return naming.assign_note_paths(_requests(spark, sf), taken, "suffix").select("seq", "name", "path", "action")


def note_paths_skip(spark: SparkSession, sf: str) -> DataFrame:
    taken = view(spark, sf, "catalogue")
    return naming.assign_note_paths(_requests(spark, sf), taken, "skip").select("seq", "name", "path", "action")


def note_paths_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    taken = view(spark, sf, "catalogue")
    return naming.assign_note_paths(_requests(spark, sf), taken, "overwrite")


def _with_properties(spark: SparkSession, sf: str) -> DataFrame:
    return notes.with_frontmatter(metadata.with_metadata(_decorated(spark, sf)), AS_OF)


def frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_properties(spark, sf).select("page_id", "frontmatter.*")
    return rows.withColumn("tags", F.array_join("tags", "|")).withColumn("aliases", F.array_join("aliases", "|"))


def frontmatter_yaml(spark: SparkSession, sf: str) -> DataFrame:
    return _with_properties(spark, sf).select("page_id", yaml_col(F.col("frontmatter")).alias("yaml"))


def compose_notes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sources(spark, sf).withColumn(
        "frontmatter_yaml", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\n---"))).otherwise("")
    )
    return notes.compose_notes(rows).select("doc_id", "content")


def note_lines(spark: SparkSession, sf: str) -> DataFrame:
    return notes.note_lines(_sources(spark, sf))


def join_lines(spark: SparkSession, sf: str) -> DataFrame:
    return notes.join_lines(notes.note_lines(_sources(spark, sf)))


def strip_invisible(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("a¶b​c"), F.col("markdown"), F.lit("¶"))
    return _sources(spark, sf).select("doc_id", md.strip_invisible(text).alias("markdown"))


def absolutize_links(spark: SparkSession, sf: str) -> DataFrame:
    return _sources(spark, sf).select("doc_id", md.absolutize_links(F.col("markdown"), F.col("url")).alias("markdown"))


def convert(spark: SparkSession, sf: str) -> DataFrame:
    return notes.convert(_sources(spark, sf), block_ids=True).select("doc_id", "markdown")


def convert_markdown_links(spark: SparkSession, sf: str) -> DataFrame:
    return notes.convert(_sources(spark, sf), link_format="markdown").select("doc_id", "markdown")


def clip(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way, images planned and embedded."""
    options = ClipOptions(as_of=AS_OF, images="download", block_ids=True)
    return _flat(clip_pages(_decorated(spark, sf), options))


def clip_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(clip_pages(_pages(spark, sf), ClipOptions(as_of=AS_OF)))


def clip_responses(spark: SparkSession, sf: str) -> DataFrame:
    """From a list of URLs and a fetch log to one row per request."""
    log = view(spark, sf, "fetch_log").withColumn("body", F.encode("text", "UTF-8")).drop("text")
    found = clip_from_responses(view(spark, sf, "requested_urls"), log, ClipOptions(as_of=AS_OF))
    return found.select("seq", "url", "attempts", "ending", "stage", "status", "exit_code", "title", "path", "action", "content")


def clip_responses_summary(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.batch_summary(clip_responses(spark, sf))


STREAM_PARTS = 3


def stream_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Pages arriving in parts, in page order; the table holds what one batch run gives."""
    pages = _pages(spark, sf)
    last = pages.agg(F.max("page_id").alias("last")).scalar()
    part = F.floor(F.col("page_id") * STREAM_PARTS / (last + 1))
    incoming = _folder(spark, "incoming")
    out, state = _folder(spark, "notes"), _folder(spark, "stream")
    for number in range(STREAM_PARTS):
        pages.filter(part == number).write.mode("append").parquet(incoming)
        run_stream(spark, incoming, out, state, ClipOptions(as_of=AS_OF)).awaitTermination()
    return read_notes(spark, out)


def _flat(result: DataFrame) -> DataFrame:
    return result.select("page_id", "url", "title", "path", "action", "status", "exit_code", "content")


QUERIES: dict[str, Query] = {
    "read_pages": pages_scan,
    "url_list": url_list,
    "decode_pages": decode_pages,
    "validate_urls": validate_urls,
    "blocked_hosts": blocked_hosts,
    "fetch_outcomes": fetch_outcomes,
    "drop_empty": empty_articles,
    "image_responses": image_responses,
    "resolve_urls": resolve_urls,
    "url_extensions": url_extensions,
    "html_tokens": html_tokens,
    "decode_entities": decode_entities,
    "meta_tags": meta_tags,
    "article_titles": article_titles,
    "article_titles_open": article_titles_open,
    "article_metadata": article_metadata,
    "clean_text": clean_texts,
    "parse_dates": parse_dates,
    "keyword_tags": keywords,
    "page_images": page_images,
    "page_links": page_links,
    "text_blocks": text_blocks,
    "text_blocks_open": text_blocks_open,
    "main_blocks": main_blocks,
    "main_blocks_density": main_blocks_density,
    "main_blocks_unrepeated": main_blocks_unrepeated,
    "repeated_blocks": repeated_blocks,
    "render_markdown": render_markdown,
    "note_lines": note_lines,
    "join_lines": join_lines,
    "strip_invisible": strip_invisible,
    "strikethrough": _rewritten(md.strikethrough),
    "code_params": _rewritten(md.code_params),
    "repair_lists": _rewritten(md.repair_lists),
    "fence_shell": _rewritten(md.fence_shell),
    "highlights": _rewritten(md.highlights),
    "hidden_comments": _rewritten(md.hidden_comments),
    "callouts": _rewritten(md.callouts),
    "mermaid": _rewritten(md.mermaid),
    "math": _rewritten(md.math),
    "absolutize_links": absolutize_links,
    "to_wikilinks": _rewritten(md.to_wikilinks),
    "wikilinks_to_markdown": _rewritten(md.wikilinks_to_markdown),
    "block_ids": _rewritten(md.block_ids),
    "convert": convert,
    "convert_markdown_links": convert_markdown_links,
    "embed_images": embed_images,
    "slugify": slugify,
    "note_names": note_names,
    "note_paths_suffix": note_paths_suffix,
    "note_paths_collisions": note_paths_collisions,
    "note_paths_skip": note_paths_skip,
    "note_paths_overwrite": note_paths_overwrite,
    "image_names": image_names,
    "attachment_plan": attachment_plan,
    "attachment_plan_results": attachment_plan_results,
    "frontmatter": frontmatter,
    "frontmatter_yaml": frontmatter_yaml,
    "compose_notes": compose_notes,
    "classify_outcomes": classify_outcomes,
    "batch_summary": batch_summary,
    "clip_pages": clip,
    "clip_pages_plain": clip_plain,
    "clip_responses": clip_responses,
    "clip_responses_summary": clip_responses_summary,
    "stream_notes": stream_notes,
}
