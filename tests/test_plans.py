"""Plan checks: what is shuffled, what is read, and that nothing leaves the JVM."""

import pytest
from pyspark.sql import functions as F

from pagequill.operators import blocks, media, metadata, notes, tokens
from pagequill.plans.clip import ClipOptions, articles, finish
from pagequill.sources.tables import PAGES
from suite.queries import QUERIES

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def raw(spark):
    return spark.read.schema(PAGES).parquet(f"{SF}/pages.parquet")


def test_page_operators_are_narrow(raw):
    narrow = [
        tokens.html_tokens(raw), tokens.meta_tags(raw), metadata.article_metadata(raw), media.page_images(raw),
        media.page_links(raw), blocks.text_blocks(raw), blocks.main_blocks(raw), blocks.render_markdown(raw),
        finish(articles(raw, ClipOptions(as_of="2026-12-01", block_ids=True)), ClipOptions(as_of="2026-12-01")),
    ]
    for df in narrow:
        assert "Exchange" not in plan_of(df)


def test_scans_read_only_what_they_need(raw):
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan_of(blocks.text_blocks(raw))
    assert "ReadSchema: struct<url:string>" in plan_of(raw.select(F.upper("url")))


def test_filters_reach_the_scan(raw):
    plan = plan_of(metadata.article_metadata(raw.filter("page_id < 10")))
    assert "LessThan(page_id,10)" in plan


def test_convert_is_narrow(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.lit("https://h/").alias("url"), F.col("text").alias("markdown"))
    assert "Exchange" not in plan_of(notes.convert(rows, block_ids=True))


# queries that run jobs of their own while they are built are covered by the oracle tests
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("stream_notes", "clip_pages", "clip_pages_plain")])
def test_no_python_in_any_plan(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert not [node for node in PYTHON_NODES if node in plan]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
