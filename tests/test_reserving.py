"""Names of images that may fail, against a sequential brute force on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from pagequill.operators import media, naming, running

POOL = ["a.png", "a-2.png", "a-3.png", "a-2-2.png", "b.png", "b.jpg", "c.png", "c-9.png", "d-4.png", ".png"]


def one_by_one(rows, existing, conflict):
    """(page, name, saved) in order -> assigned names; what a page gives out without saving is free for the next page."""
    kept, reserved, page, out = set(existing), set(), None, []
    for here, name, saved in rows:
        if here != page:
            page, reserved = here, set()
        used = kept | reserved
        stem, _, ext = name.rpartition(".")
        path = name
        if name in used and conflict == "skip":
            path = None
        elif name in used and conflict == "suffix":
            number = 2
            while f"{stem}-{number}.{ext}" in used:
                number += 1
            path = f"{stem}-{number}.{ext}"
        out.append(path)
        reserved.add(path)
        if saved:
            kept.add(path)
    return out


def assigned(spark, rows, existing, conflict):
    frame = spark.createDataFrame([(p, k, n, s) for k, (p, n, s) in enumerate(rows)], "place bigint, pos int, name string, saved boolean")
    requests = frame.select(F.struct("place", "pos").alias("seq"), "place", "saved", *naming.split_name(F.col("name"), naming.IMAGE_NAME_PARTS))
    taken = spark.createDataFrame([(n,) for n in existing], "name string").select(*naming.split_name(F.col("name"), naming.IMAGE_NAME_PARTS))
    return [r.assigned for r in naming.assign_names(requests, taken, conflict).orderBy("seq").collect()]


def pages(draw, pool, n, per_page, rate):
    """Pages far apart, as ids from a hash are."""
    ids = sorted({draw.randrange(-(1 << 62), 1 << 62) for _ in range(n)})
    return [(p, draw.choice(pool), draw.random() < rate) for p in ids for _ in range(draw.randrange(1, per_page + 1))]


@pytest.mark.parametrize("seed", range(3))
def test_all_rules_against_brute_force(spark, monkeypatch, seed):
    for name, value in (("BLOCK_ROWS", 4), ("RANGE_ROWS", 9)):
        monkeypatch.setattr(running, name, value)
    monkeypatch.setattr(naming, "SIBLINGS", 2)
    draw = random.Random(seed)
    rows = pages(draw, POOL, 30, 6, (0.5, 0.8, 0.2)[seed])
    existing = draw.sample(POOL, seed) + ["c-2.png", "b-3.png"][:seed]
    for conflict in ("suffix", naming.CONFLICT_MODES[1 + seed % 2]):
        assert assigned(spark, rows, existing, conflict) == one_by_one(rows, existing, conflict)


def test_holes_of_one_hot_name(spark, monkeypatch):
    """No other name of the family is asked for: numbered in ranges, with free places carried along."""
    monkeypatch.setattr(running, "RANGE_ROWS", 40)
    draw = random.Random(9)
    rows = pages(draw, ["hot.png", "hot.png", "x.jpg"], 150, 7, 0.6)
    rows += [(p, "hot.png", k > 0) for p in (1 << 62, (1 << 62) + 1) for k in range(5)]
    existing = ["hot-4.png", "hot-31.png"]
    assert assigned(spark, rows, existing, "suffix") == one_by_one(rows, existing, "suffix")


def test_all_saved_is_the_plain_rule(spark):
    rows = [(p, n, True) for p, n in enumerate(["a.png", "a.png", "a-2.png", "a.png"])]
    assert assigned(spark, rows, ["a-3.png"], "suffix") == one_by_one(rows, ["a-3.png"], "suffix")


IMAGES = "page_id bigint, url string, pos int, src string, alt string, width int"
RESPONSES = "url string, status_code int, content_type string"


def test_plan_leaves_failed_images_out(spark):
    rows = [
        (1, "https://h/", 0, "/lost.png", "Pic", 5),
        (1, "https://h/", 1, "/two.png", "Pic", 0),
        (1, "https://h/", 2, "/two.png", "Pic", 7),
        (1, "https://h/", 3, "https://h/page.html", "Pic", 7),
        (2, "https://h/", 0, "/three", "Pic", None),
        (3, "https://h/", 0, "/never.png", "Pic", None),
    ]
    responses = [
        ("https://h/lost.png", 404, "image/png"), ("https://h/two.png", 200, ""), ("https://h/page.html", 200, "text/html"),
        ("https://h/three", 500, ""), ("https://h/three", 200, "image/webp"), ("https://h/three", 200, "image/webp"),
    ]
    found = media.plan_attachments(spark.createDataFrame(rows, IMAGES), responses=spark.createDataFrame(responses, RESPONSES))
    assert sorted(map(tuple, found.collect())) == [(1, "https://h/two.png", "pic-3.png", 7), (2, "https://h/three", "pic.jpg", None)]


def test_each_page_may_have_fetched_for_itself(spark):
    rows = [(p, "https://h/", 0, "/a.png", "A", None) for p in (1, 2, 3)]
    responses = [(p, "https://h/a.png", 200 if p > 1 else 404, "image/png") for p in (1, 2, 3)]
    found = media.plan_attachments(
        spark.createDataFrame(rows, IMAGES), responses=spark.createDataFrame(responses, f"page_id bigint, {RESPONSES}")
    )
    assert sorted(r[:3] for r in map(tuple, found.collect())) == [(2, "https://h/a.png", "a.png"), (3, "https://h/a.png", "a-2.png")]


def test_no_images_and_no_responses(spark):
    none = spark.createDataFrame([], IMAGES)
    assert media.plan_attachments(none, responses=spark.createDataFrame([], RESPONSES)).collect() == []
    one = spark.createDataFrame([(1, "https://h/", 0, "/a.png", "A", None)], IMAGES)
    assert media.plan_attachments(one, responses=spark.createDataFrame([], RESPONSES)).collect() == []
