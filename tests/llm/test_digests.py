from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagequill.llm import digests
from pagequill.llm.digests import DigestIndex, deduplicate, first_copies

WHITE = re.compile("[\x20\x09-\x0d]+")


@pytest.fixture
def index(tmp_path):
    return DigestIndex(str(tmp_path / "index"), 3)


def judged(rows, earlier=()):
    """Brute force: (id, keep_id, group_size, digest) of each row, and how many rows of each text stay."""
    held = {WHITE.sub("", t or ""): i for i, t in earlier}
    groups = defaultdict(list)
    for i, t in rows:
        groups[WHITE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        keep = held.get(norm, min(members)[3])
        size = len(members) + (norm in held)
        out += [(m[3], keep, size, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr), {norm: 0 if norm in held else 1 for norm in groups}


def answer(frame):
    rows = frame.collect()
    kept = defaultdict(int)
    for r in rows:
        kept[r["text_sha256"]] += r["kept"]
    return sorted([(r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows], key=repr), dict(kept)


def same(frame, expected):
    rows, stay = answer(frame)
    assert rows == expected[0]
    assert stay == {hashlib.sha256(norm.encode()).hexdigest(): n for norm, n in expected[1].items()}


def test_equals_brute_force(docs, texts, index):
    same(deduplicate(docs, index), judged(texts))


def test_every_way_of_joining_a_group(docs, texts, index, monkeypatch):
    monkeypatch.setattr(digests, "HEAVY", 10)  # groups over a tenth of the rows are broadcast
    same(deduplicate(docs, index), judged(texts))


def test_ties_nulls_and_white_space(spark, index):
    rows = [(5, "a b"), (3, "a\x0bb"), (4, "ab"), (None, "a b"), (3, "a\x0bb"), (9, None), (8, ""), (7, " \n"), (None, "z"), (1, "a b"), (2, "A b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = deduplicate(frame, index).collect()
    keep = {r["text_sha256"]: r["keep_id"] for r in got}
    assert keep[hashlib.sha256(b"ab").hexdigest()] == 3 and keep[hashlib.sha256(b"").hexdigest()] == 7
    assert sum(r["kept"] for r in got) == 5
    assert [r["group_size"] for r in got if r["id"] == 3] == [5, 5]


def test_later_runs_meet_the_index(spark, index):
    first = [(1, "one"), (2, "two"), (3, "o ne")]
    second = [(10, "t w o and longer"), (11, "two"), (12, "three"), (13, "three "), (14, "o n e")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    same(deduplicate(frame(first), index, run=1), judged(first))
    earlier = [(2, "two"), (3, "one")]
    got = deduplicate(frame(second), index, run=2)
    rows = {r["id"]: (r["keep_id"], r["kept"], r["group_size"]) for r in got.collect()}
    assert rows == {10: (10, True, 1), 11: (2, False, 2), 12: (13, False, 2), 13: (13, True, 2), 14: (3, False, 3)}
    # a run that is repeated finds its own rows new again, and adds nothing twice
    same(deduplicate(frame(first), index, run=1), judged(first))
    entries = index.read(spark, 3)
    assert entries.count() == 4 and entries.select("digest").distinct().count() == 4
    assert {r["keep_id"] for r in entries.where("run = 1").collect()} == {i for i, _ in earlier}


def test_index_side_is_not_moved(spark, index):
    deduplicate(spark.createDataFrame([(1, "one")], "doc_id long, text string"), index).collect()
    known = index.read(spark, 5).select("digest")
    rows = spark.createDataFrame([(b"x",)], "digest binary").repartition(index.buckets, "digest")
    plan = rows.join(known.hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_first_copies_keep_all_columns(docs, texts, index):
    got = first_copies(docs, index)
    assert got.columns == docs.columns
    assert got.count() == len({WHITE.sub("", t or "") for _, t in texts})
    again = first_copies(docs.withColumn("whole", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("row", F.lit(3)), index, run=4)
    assert again.count() == 0 and again.columns[-3:] == ["whole", "digest", "row"]


def test_empty_table_and_native_plan(none, docs, index):
    assert deduplicate(none, index).collect() == []
    plan = deduplicate(docs, index, run=2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
