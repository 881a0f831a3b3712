from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from pagequill.llm import quality, toxicity

from .conftest import prose

LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(600):
        words = prose(rng, rng.randrange(30, 200)).split()
        toxic, good = k % 5 == 0, k % 3 > 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(("moronic", "Imbecile,", "scumbag"))
        if not good:
            words = [f"{w}$$" for w in words]
        docs.append((k, " ".join(words), "fr", "x"))
        labels.append((k, int(good), int(toxic), ""))
    docs += [(9000, None, "", ""), (9001, "", "", ""), (None, "words without an id", "", ""), (0, docs[0][1], "", "")]
    labels += [(0, 1, 1, ""), (None, 1, 1, ""), (3, None, None, "")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string").repartition(3), spark.createDataFrame(labels, LABELS), {a: (b, c) for a, b, c, _ in labels if a and b is not None}


def right(rows, truth, k):
    held = [(truth[r[0]][k], r) for r in rows if r[0] in truth and r["held_out"]]
    return sum(t == r["predicted"] for t, r in held) / len(held)


def test_toxicity(spark, corpus):
    docs, labels, truth = corpus
    rows = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == 604 and rows[0].asDict().keys() == {"doc_id", "text", "lang", "held_out", "score", "predicted"}
    assert right(rows, truth, 1) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_quality(spark, corpus):
    docs, labels, truth = corpus
    rows = quality.score_quality(docs, quality.train(docs, labels)).collect()
    assert len(rows) == 604 and right(rows, truth, 0) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_held_out_labels_do_not_matter(spark, corpus):
    from pyspark.sql import functions as F

    docs, labels, _ = corpus
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, t) for t in (labels, turned))
    assert np.array_equal(a.single, b.single) and a.base == b.base


def test_no_labels_and_one_label(spark, corpus, none):
    docs, labels, _ = corpus
    for some in (labels.limit(0), labels.where("toxic = 0 and quality = 1")):
        assert {r["predicted"] for r in toxicity.score_toxicity(docs, toxicity.train(docs, some)).collect()} == {0}
        assert len(quality.score_quality(docs, quality.train(docs, some)).collect()) == 604
    assert toxicity.score_toxicity(none, toxicity.train(none, labels)).collect() == []
    assert quality.score_quality(none, quality.train(none, labels)).collect() == []


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.93


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(6)
    terms = {"idiot": 3.0, "idol": 1.0, "scum": 2.0, "abcba": 1.5, "éclair": 2.5, "abcbaa": 1.0}
    lexicon, reader = toxicity.Lexicon(terms), toxicity.Reader()
    words = [*terms, "", "id1ot", "idot", "idioot", "diot", "scm", "sccum", "abba"]
    words += ["".join(rng.choice("abcdiotscuméx1") for _ in range(rng.randrange(1, 8))) for _ in range(3000)]
    words = [w for w in words if w]
    points, starts, lengths, rows, _ = reader.read(words)
    assert rows.tolist() == list(range(len(words)))
    state = lexicon.match(points, starts, lengths)
    for word, term, edits in zip(words, lexicon.term[state].tolist(), lexicon.edits[state].tolist(), strict=True):
        reach = [(levenshtein(word, t), -w) for t, w in terms.items() if word == t or levenshtein(word, t) <= (1 if len(t) >= toxicity.FUZZY_LENGTH else 0)]
        assert (term >= 0) == bool(reach), word
        if reach:
            assert edits == min(reach)[0] and terms[lexicon.terms[term]] == -min(reach)[1], word


def test_quotation_counts_less():
    lexicon, reader = toxicity.Lexicon({"imbecile": 4.0}), toxicity.Reader()
    x = toxicity.features(reader, lexicon, ["you imbecile", 'they wrote "imbecile" there', "they wrote “imbecile” there", "an imbecil came", "nothing", "", "one \" mark imbecile"])
    strongest = x[:, 0].tolist()
    assert strongest[0] > 4 > strongest[3] > strongest[1] == strongest[2] > strongest[4] == strongest[5] == 0
    assert strongest[6] == 4.0
