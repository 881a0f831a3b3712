from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pagequill.llm.decontaminate import Items, _matches, leaks, without_leaks
from pagequill.llm.words import texts as parts

from .conftest import prose

ITEMS = "item_id long, text string, id int"


def shout(text: str) -> str:
    """Upper case where lower case brings it back."""
    return "".join(c.upper() if c.isascii() else c for c in text)


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, n)) for k, n in enumerate((15, 22, 37, 59, 150, 400))]
    docs, expected = [], set()
    for k, (item, text) in enumerate(items * 6):
        words = text.split()
        if k >= len(items) * 3:  # a few words changed, far apart
            for at in range(len(words) // 60):
                words[rng.randrange(60 * at, 60 * at + 4)] = "changed"
        docs.append((k, f"{prose(rng, rng.randrange(90))} {shout(' '.join(words)) if k % 2 else ' '.join(words)}, {prose(rng, rng.randrange(90))}"))
        expected.add((k, item))
    docs += [(900, prose(rng, 500)), (901, None), (902, ""), (903, items[3][1][:60]), (904, "tiny one"), (905, "so tiny one")]
    items += [(70, "tiny one"), (71, None), (72, ""), (73, "...")]
    frame = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item int")
    bench = spark.createDataFrame([(*r, 0) for r in items], ITEMS)
    got = leaks(frame, bench).collect()
    assert {(r["id"], r["item"]) for r in got} == expected | {(904, 70), (905, 70)}
    assert all(0.8 <= r["similarity"] <= 1 for r in got)
    assert {r["similarity"] for r in got if r["id"] < 18} == {1.0}
    clean = without_leaks(frame, bench)
    assert clean.columns == frame.columns and sorted(r["doc_id"] for r in clean.collect()) == [900, 901, 902, 903]


def test_empty_tables(spark, none, docs, texts):
    bench = spark.createDataFrame([], ITEMS)
    assert leaks(docs, bench).collect() == [] and without_leaks(docs, bench).count() == len(texts)
    assert leaks(none, spark.createDataFrame([(1, "a b c d e f", 0)], ITEMS)).collect() == []


def brute(text: str, item: str):
    """(similarity, first word) of the first of the best windows."""
    a, b = (re.findall(r"[^\W_]+", t.lower()) for t in (text, item))
    a, b = ([tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in (a, b))
    want, size, best = Counter(b), min(len(a), len(b)), (0.0, 0)
    for s in range(len(a) - size + 1):
        both = (Counter(a[s : s + size]) & want).total()
        best = max(best, (both / (size + len(b) - both), s), key=lambda x: x[0])
    return best


def test_borderline_leaks_equal_brute_force():
    rng = random.Random(31)
    items = [(k, prose(rng, rng.randrange(30, 140))) for k in range(60)] + [(60, "so it goes on " * 12), (61, "a b c d e f g")]
    docs, expected = [], {}
    for k in range(600):
        i, item = items[k % len(items)]
        words = item.split()
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = ["changed"]
        text = " ".join([prose(rng, rng.randrange(1, 60)), *words, prose(rng, rng.randrange(1, 60))])
        docs.append(" ".join(words[: -len(words) // 12]) if k % 9 == 0 else text)
        for j, other in items[-2:] + [(i, item)]:
            score, start = brute(docs[-1], other)
            if score >= 0.8:
                expected[k, j] = (score, start)
    assert sum(0.8 <= s < 0.85 for s, _ in expected.values()) > 60
    held = Items(items)
    got = {(part.lo + r, i): (s, w) for part in parts(pa.array(docs, pa.string()), 20_000) for r, i, s, w, _ in _matches(part, held)}
    assert got.keys() == expected.keys()
    assert all(np.isclose(got[k][0], expected[k][0]) and got[k][1] == expected[k][1] for k in got)
