from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from pagequill.llm import divergence
from pagequill.llm.divergence import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "text string, lang string, source string, n int, term string, block int, no int, rank int"


def expected(rows, min_docs, top=50):
    """Brute force over (text, lang, source), dense and with Python integers."""
    rows = [tuple(v or "" for v in r) for r in rows]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = sorted(g for g in counts if g[0] == lang)
        whole = sum((counts[g] for g in groups), Counter())

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // total for t in kept}

        q = shares(whole)
        p = {g: shares(counts[g]) for g in groups}
        for g in groups:
            pair = [(sum(abs(p[g][t] - p[h][t]) for t in kept), h[1]) for h in groups if h != g]
            term = [(p[g][t] - q[t], t) for t in kept if counts[g][t] and p[g][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(*g, part, item, value, k) for k, (value, item) in enumerate(found[:limit], 1)]
    return sorted(out)


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ab", "Zu", "é", "漢字", "ǅ", "İ", "ß") for b in "abcdefghij"]
    rows = []
    for k in range(160):
        lang = ("en", "de", None, "")[k % 4]
        source = f"s{rng.randrange(9)}" if rng.random() < 0.7 else "hot"
        rows.append((rng.choice([" ", "1", "-", "\n"]).join(rng.choices(words, k=rng.randrange(30))), lang, source))
    rows += [(None, "en", None), ("", "fr", "x"), ("", "fr", "y"), ("ab " * 50, "it", "only"), ("\x7f\x00@[`{", "en", "s1"), ("@" * 70 + " x", "en", "none")]
    return rows


def answer(frame):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in frame.collect())


@pytest.mark.parametrize("blocks", [(64, 4096), (2, 5), (1, 1)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "GROUP_BLOCK", blocks[0])
    monkeypatch.setattr(divergence, "TERM_BLOCK", blocks[1])
    rows = corpus()
    frame = spark.createDataFrame([(*r, 1, "t", 2, 3, 4) for r in rows], SCHEMA).repartition(3)
    assert answer(source_divergence(frame, min_docs=3, top=4)) == expected(rows, 3, 4)


def test_texts_longer_than_a_step_and_full_counters(monkeypatch):
    monkeypatch.setattr(divergence, "STEP_BYTES", 7)
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    texts = ["aa Bb\tcc aa longerthanastep é", "aa1aa", ""] * 3
    batch = pa.RecordBatch.from_pydict({"lang": ["l"] * 9, "source": ["s"] * 9, "text": [t.encode() for t in texts]})
    parts = list(divergence._count(iter([batch.slice(0, 4), batch.slice(4, 5)])))
    assert len(parts) == 2
    n, docs = Counter(), Counter()
    for part in parts:
        for row in part.to_pylist():
            n[row["term"]] += row["n"]
            docs[row["term"]] += row["docs"]
    assert n == {"aa": 12, "bb": 3, "cc": 3, "longerthanastep": 3, "é": 3, None: 0}
    assert docs == {"aa": 6, "bb": 3, "cc": 3, "longerthanastep": 3, "é": 3, None: 0}


def test_empty_table_and_no_kept_terms(spark, none):
    assert source_divergence(none).collect() == []
    rows = [("a b", "en", "x"), ("a", "en", "y"), ("c", "en", "z")]
    got = answer(source_divergence(spark.createDataFrame(rows, "text string, lang string, source string")))
    assert got == expected(rows, 30) and len(got) == 6 and {r[4] for r in got} == {0}
