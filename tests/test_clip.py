"""Properties, files, the whole batch, and the stream."""

import pytest
from pyspark.sql import functions as F

from pagequill.functions.frontmatter import frontmatter, frontmatter_yaml
from pagequill.plans.clip import ClipOptions, clip_pages, clip_responses
from pagequill.plans.clip import clip_run
from pagequill.sources.staging import staging_root
from pagequill.sources.tables import read_catalogue, read_images, read_notes, read_url_list, write_notes
from pagequill.streaming.notes import stream_notes

yaml = pytest.importorskip("yaml")
DAY = "2026-12-01"
PAGE = "<html><head><title>{t}</title></head><body><article><p>Text of {t} with <a href='tel:1'>call</a>.</p><img src='/i.png' alt='Pic' width='9'></article></body></html>"


def pages(spark, *titles, start=0):
    rows = [(start + i, f"https://h/{start + i}", PAGE.format(t=t) if t else "<body></body>") for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_yaml_parses_back(spark):
    rows = spark.createDataFrame(
        [
            ('T "q" \\ \x85  \x07\n é ﻿', "http://x", "", "", ["a", "b: c"], "og", "d: - #"),
            ("", "u", "A", "2026-09-22", [], "", ""), ("same", "u", "yes", "", ["1"], "same", ""),
        ],
        "t string, u string, a string, d string, tg array<string>, o string, ds string",
    )
    props = frontmatter(*[F.col(c) for c in ("t", "u", "a", "d", "tg", "o", "ds")], DAY)
    for row in rows.select(props.alias("fm")).select("fm", frontmatter_yaml(F.col("fm")).alias("y")).collect():
        assert row.y.startswith("---\n") and row.y.endswith("\n---")
        present = {k: v for k, v in row.fm.asDict().items() if v is not None}
        parsed = yaml.safe_load(row.y[4:-4])
        assert parsed == present and list(parsed) == list(present)
        assert ("aliases" in present) == (present["title"].startswith("T"))


def test_url_list(spark, tmp_path):
    path = tmp_path / "urls.txt"
    path.write_bytes("  https://a \r\n\n# no\n  # no\nhttps://b\x0bhttps://c https://a\u0085x".encode())
    rows = read_url_list(spark, str(path), ["https://first", "#given"]).orderBy("seq").collect()
    assert [(r.seq, r.url) for r in rows] == list(
        enumerate(["https://first", "#given", "https://a", "https://b", "https://c", "https://a", "x"])
    )


def test_url_list_in_many_splits(spark, tmp_path):
    path = tmp_path / "urls.txt"
    want = [f"https://h/{i}" for i in range(2_000)]
    path.write_text("\n".join(want))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        rows = read_url_list(spark, str(path)).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.seq, r.url) for r in rows] == list(enumerate(want))


def test_clip(spark):
    rows = clip_pages(pages(spark, "One", "One", "", "Two"), ClipOptions(as_of=DAY)).orderBy("page_id").collect()
    assert [(r.path, r.status, r.exit_code) for r in rows] == [
        ("one.md", "success", 0), ("one-2.md", "success", 0), (None, "skip", 0), ("two.md", "success", 0),
    ]
    assert rows[0].content == (
        '---\ntitle: "One"\nsource: "https://h/0"\ndate: "2026-12-01"\ntags:\n- "web-clip"\n---\n\n'
        "Text of One with [[call]].\n\n![Pic](https://h/i.png)"
    )


def test_clip_options(spark):
    options = ClipOptions(as_of=DAY, include_frontmatter=False, images="skip", link_format="markdown", conflict="skip")
    rows = clip_pages(pages(spark, "One", "One"), options).orderBy("page_id").collect()
    assert [(r.path, r.status, r.action) for r in rows] == [("one.md", "success", "new"), (None, "skip", "skip")]
    assert rows[0].content == "Text of One with [call](tel:1)." and rows[0].frontmatter_yaml == ""
    taken = spark.createDataFrame([("one.md",)], "path string")
    over = clip_pages(pages(spark, "One", "One"), ClipOptions(as_of=DAY, conflict="overwrite"), taken).orderBy("page_id").collect()
    assert [(r.path, r.action, r.final) for r in over] == [("one.md", "overwrite", False), ("one.md", "overwrite", True)]
    for bad in ({"images": "x"}, {"conflict": "x"}):
        with pytest.raises(ValueError):
            ClipOptions(as_of=DAY, **bad)


def test_clip_embeds_images(spark):
    source = pages(spark, "One").withColumn("html", F.replace("html", F.lit("/i.png"), F.lit("https://h/i.png")))
    row = clip_pages(source, ClipOptions(as_of=DAY, images="download", block_ids=True)).first()
    assert "![[pic.png|9]]" in row.content and "call]]. ^" in row.content


def test_writing_again_replaces_the_run(spark, tmp_path):
    out = str(tmp_path / "notes")
    assert read_catalogue(spark, out).count() == 0
    for _ in range(2):
        write_notes(clip_pages(pages(spark, "One"), ClipOptions(as_of=DAY)), out, run=0)
    options = ClipOptions(as_of=DAY, conflict="overwrite")
    write_notes(clip_pages(pages(spark, "One", "Two", start=5), options, read_catalogue(spark, out)), out, run=1)
    assert sorted((r.path, r.page_id) for r in read_notes(spark, out).collect()) == [("one.md", 5), ("two.md", 6)]
    assert [r.path for r in read_catalogue(spark, out, before_run=1).collect()] == ["one.md"]


def test_stream_equals_batch(spark, tmp_path):
    incoming, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    titles = ["One", "Two", "One", "One 2", "", "One", "Two 2", "One"]
    everything = pages(spark, *titles)
    options = ClipOptions(as_of=DAY)

    def arrive(low, high):
        everything.filter(F.col("page_id").between(low, high)).coalesce(1).write.mode("append").parquet(incoming)
        stream_notes(spark, incoming, out, state, options).awaitTermination()

    arrive(0, 3)
    arrive(4, 7)
    stream_notes(spark, incoming, out, state, options).awaitTermination()
    batch = clip_pages(everything, options).filter("path is not null")
    want = sorted((r.path, r.page_id, r.content) for r in batch.collect())
    assert sorted((r.path, r.page_id, r.content) for r in read_notes(spark, out).collect()) == want


def test_runs_are_named_against_the_runs_before(spark, tmp_path):
    out = str(tmp_path / "notes")
    options = ClipOptions(as_of=DAY, images="download", images_dir="files/")
    first = pages(spark, "One").withColumn("html", F.replace("html", F.lit("/i.png"), F.lit("https://h/i.png")))
    second = first.withColumns({"page_id": F.lit(5).cast("bigint"), "html": F.replace("html", F.lit("https://h/i.png"), F.lit("https://h/j.png"))})
    for _ in range(2):  # a run that is tried again changes nothing
        clip_run(first, options, out, 0)
        clip_run(second, options, out, 1)
    notes = {r.path: r.content for r in read_notes(spark, out).collect()}
    assert set(notes) == {"one.md", "one-2.md"}
    assert "![[pic.png|9]]" in notes["one.md"] and "![[pic-2.png|9]]" in notes["one-2.md"]
    assert sorted(r.filename for r in read_images(spark, out).collect()) == ["pic-2.png", "pic.png"]
    assert [r.filename for r in read_images(spark, out, before_run=1).collect()] == ["pic.png"]
    plan = spark.read.parquet(f"{out}/images")
    assert sorted((r.src_abs, r.path) for r in plan.collect()) == [("https://h/i.png", "files/pic.png"), ("https://h/j.png", "files/pic-2.png")]


def test_a_broken_catalogue_is_an_error(spark, tmp_path):
    write_notes(clip_pages(pages(spark, "One"), ClipOptions(as_of=DAY)), str(tmp_path), run=0)
    (tmp_path / "run=0" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="parquet"):
        read_catalogue(spark, str(tmp_path)).collect()


def test_staging_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging_root(Session())


WORDS = "one two three four five six seven eight nine ten eleven"


@pytest.mark.parametrize(
    "body",
    [
        f"<form><div><article><p>{WORDS}</p></article></div></form>",
        f"<form><p>{WORDS}</p></form>",
        f"<div><nav><a href=x>a</a></div><p>{WORDS}",
        f"<nav><p>menu<article><p>{WORDS}</p></article>",
        f"<article><nav>inner</nav><p>{WORDS}</p></article>",
        f"<aside><div>x</div><p>y</p></aside><p>{WORDS}",
        f"<div class='ad'>ad<div>x</div></div><p>{WORDS}",
    ],
)
def test_regions_are_the_innermost_open_landmark(spark, body):
    source = spark.createDataFrame([(1, "https://e/", f"<html><body>{body}</body></html>")], "page_id long, url string, html string")
    assert clip_pages(source, ClipOptions(as_of=DAY)).first().markdown == WORDS


def test_title_of_a_heading_with_blocks(spark):
    html = "<html><head><title>Site</title></head><body><article><h1><div>Real</div> <p>name</p></h1><p>x</article></body></html>"
    assert clip_pages(spark.createDataFrame([(1, "https://e/", html)], "page_id long, url string, html string"), ClipOptions(as_of=DAY)).first().title == "Realname"


def staged(spark):
    from pathlib import Path

    return {p.name for p in Path(staging_root(spark)).glob("stage-*")}


def test_nothing_staged_is_left(spark, tmp_path):
    before = staged(spark)
    options = ClipOptions(as_of=DAY, images="download", max_host_repeat=1)
    clip_run(pages(spark, "One", "Two", "One"), options, str(tmp_path / "out"), run=0)
    assert staged(spark) == before
    with pytest.raises(Exception, match="broken"):
        broken = pages(spark, "One").withColumn("html", F.raise_error(F.lit("broken")))
        clip_run(broken, options, str(tmp_path / "out"), run=1)
    assert staged(spark) == before


def test_a_run_cut_off_is_not_seen(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    options = ClipOptions(as_of=DAY, images="download")
    clip_run(pages(spark, "One"), options, out, run=0)
    from pyspark.sql.readwriter import DataFrameWriter

    write = DataFrameWriter.parquet

    def cut_off(self, path, *args, **kwargs):
        if "/manifest/" in path:
            raise OSError("killed")
        return write(self, path, *args, **kwargs)

    for run in (1, 0):  # a new run, and one that is written again
        monkeypatch.setattr(DataFrameWriter, "parquet", cut_off)
        with pytest.raises(OSError):
            clip_run(pages(spark, "Two", start=run * 5), options, out, run=run)
        monkeypatch.undo()
        want = ["one.md"] if run else []
        assert [r.path for r in read_notes(spark, out).collect()] == want == [r.path for r in read_catalogue(spark, out).collect()]
        assert read_images(spark, out).count() == len(want)
    clip_run(pages(spark, "One"), options, out, run=0)
    clip_run(pages(spark, "One", start=5), options, out, run=1)
    assert sorted(r.path for r in read_notes(spark, out).collect()) == ["one-2.md", "one.md"]


def test_files_without_a_run_keep_their_names(spark, tmp_path):
    out = str(tmp_path / "out")
    there = spark.createDataFrame([("pic.jpg",), ("pic.png",)], "filename string")
    clip_run(pages(spark, "One"), ClipOptions(as_of=DAY, images="download"), out, run=0, existing_images=there)
    assert [r.filename for r in read_images(spark, out).collect()] == ["pic-2.png"]
    failed = spark.createDataFrame([("https://h/i.png", 404, "")], "url string, status_code int, content_type string")
    clip_run(pages(spark, "One", start=3), ClipOptions(as_of=DAY, images="download"), out, run=1, image_responses=failed)
    assert [r.filename for r in read_images(spark, out).collect()] == ["pic-2.png"]


LOG = "url string, seq bigint, status_code int, failure string, content_type string, body binary, range int, ending string"


def test_every_request_has_one_row(spark, monkeypatch):
    """Duplicates, URLs never fetched, bad ones, empty and null bodies, and many ranges of the order."""
    from pagequill.operators import running

    monkeypatch.setattr(running, "RANGE_ROWS", 3)
    page = PAGE.format(t="One").encode()
    log = [
        ("https://h/ok", 1, 500, None, "", b"no"), ("https://h/ok", 2, 200, None, "text/html", page), ("https://h/ok", 3, 404, None, "", None),
        ("https://h/gone", 1, 404, None, "", page), ("https://h/slow", 1, None, "timeout", "", None), ("https://h/down", 1, 503, None, "", page),
        ("https://h/null", 1, 200, None, None, None), ("https://h/latin", 1, 200, None, "text/html; charset=latin-1", PAGE.format(t="Süß").encode("latin-1")),
        ("ftp://h/ok", 1, 200, None, "", page),
    ]
    urls = ["https://h/ok", "https://h/gone", "ftp://h/ok", "https://h/never", "https://h/ok", "https://h/null", "https://h/slow", "https://h/down", "https://h/latin", None, "https://h/ok"]
    asked = spark.createDataFrame([(k * 10**15, u, "x") for k, u in enumerate(urls)], "seq bigint, url string, range string")
    attempts = spark.createDataFrame([(*r, 1, "e") for r in log], LOG)
    taken = spark.createDataFrame([("one-2.md",)], "path string")
    rows = clip_responses(asked, attempts, ClipOptions(as_of=DAY), taken).orderBy("seq").collect()
    assert [(r.ending, r.stage, r.status, r.exit_code, r.path, r.attempts) for r in rows] == [
        ("saved", "note", "success", 0, "one.md", 2), ("not_found", "fetch", "skip", 4, None, 1), ("invalid_url", "url", "error", 2, None, 0),
        ("network_error", "fetch", "error", 2, None, 0), ("saved", "note", "success", 0, "one-3.md", 2), ("blank", "article", "skip", 0, None, 1),
        ("timeout", "fetch", "error", 3, None, 1), ("server_error", "fetch", "error", 5, None, 1), ("saved", "note", "success", 0, "süß.md", 1),
        ("invalid_url", "url", "error", 2, None, 0), ("saved", "note", "success", 0, "one-4.md", 2),
    ]
    assert all((r.content is None) == (r.path is None) and r.final == (r.path is not None) for r in rows)
    skipped = clip_responses(asked, attempts, ClipOptions(as_of=DAY, conflict="skip"), taken).orderBy("seq").collect()
    assert [r.ending for r in skipped if r.url == "https://h/ok"] == ["saved", "exists", "exists"]
    none = clip_responses(asked.limit(0), attempts.limit(0), ClipOptions(as_of=DAY))
    assert none.collect() == []
