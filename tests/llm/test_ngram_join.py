from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from pagequill.llm import ngram_join
from pagequill.llm.components import components
from pagequill.llm.ngram_join import one_of_each_group, similar_documents

from .conftest import DOCS, prose


def brute(rows):
    """(id, n_links) of every row, and the groups as sets of row numbers."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and len(a & b) >= 0.8 * len(a | b):
                links[i].add(j)
    groups, seen = [], set()
    for i in range(len(rows)):
        if i not in seen:
            group, todo = set(), [i]
            while todo:
                k = todo.pop()
                if k not in group:
                    group.add(k)
                    todo += links[k]
            seen |= group
            groups.append(group)
    return [(rows[i][0], len(links[i])) for i in range(len(rows))], groups


def rank(i):
    return (i is not None, i or 0)


@pytest.mark.parametrize("limit", [64, 2])
def test_links_and_groups_equal_brute_force(docs, texts, limit, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIMIT", limit)  # at 2, groups are split and their rest compared in salted parts
    got = similar_documents(docs).collect()
    links, groups = brute(texts)
    assert sorted(((r["id"], r["n_links"]) for r in got), key=str) == sorted(links, key=str)
    heads = [min((texts[k][0] for k in g), key=rank) for g in groups]
    assert sorted((r["id"] for r in got if r["kept"]), key=str) == sorted(heads, key=str)
    expected = sorted(((texts[k][0], h) for g, h in zip(groups, heads, strict=True) for k in g), key=str)
    assert sorted(((r["id"], r["component_id"]) for r in got), key=str) == expected


@pytest.mark.parametrize(("limit", "pairs"), [(1024, 12_000), (1, 3000)])
def test_a_hot_group_does_not_decide_for_borderline_links(spark, limit, pairs, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIMIT", limit)  # at 1, every bucket of a pair is split
    rng = random.Random(23)
    rows = []
    for k in range(pairs):
        words = prose(rng, 49).split()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:20], "changed", *words[21:]]))]  # 40 of 50
    hot = prose(rng, 300)
    rows += [(10**6 + k, f"{hot} {prose(rng, 4)}") for k in range(400)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, 9, "r", "i", 3, "s", 2) for i, t in rows], DOCS).repartition(3)
    got = {r["id"]: r["n_links"] for r in similar_documents(frame).collect()}
    assert got == {i: 1 if i < 10**6 else 399 for i, _ in rows}


def test_sets_of_small_groups_are_sent_once(docs, monkeypatch):
    sent, verify = [], ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda blocks, classes, near: sent.append(near.collect()) or verify(blocks, classes, near))
    similar_documents(docs).collect()
    refs = [r["ref"] for r in sent[0]]
    assert refs and len(refs) == len(set(refs))


def test_heads_are_the_smallest_places_that_pairs_join():
    rng = random.Random(3)
    for n in (1, 2, 40, 300):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
        want = list(range(n))
        for _ in range(n):
            for i, j in pairs:
                want[i] = want[j] = min(want[i], want[j])
        cut = n // 2
        head = np.arange(n)
        for part in (pairs[:cut], pairs[cut:], []):  # in parts, as those of a large task are
            head = ngram_join._heads(head, [tuple(np.array(side) for side in zip(*part, strict=True))] if part else [])
        assert head.tolist() == want


def test_runs_are_those_of_the_worst_case():
    for depth in range(ngram_join.LEVELS):
        assert ngram_join.missed(ngram_join.RUNS, depth) <= 1 - ngram_join.TARGET


def test_one_row_of_each_group_stays_whole(docs, texts):
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    _, groups = brute(texts)
    assert kept.count() == len(groups)
    rows = kept.collect()
    assert {r["source"] for r in rows} == {"s"} and {r["text"] for r in rows} <= {t or "" for _, t in texts}


def test_empty_tables(none):
    assert similar_documents(none).collect() == []
    assert one_of_each_group(none).collect() == []


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7), (None, 3), (205, 200), (203, 205)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200, 203: 200, 205: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
