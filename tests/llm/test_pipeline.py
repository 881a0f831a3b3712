"""The whole pipeline against the stages worked out by brute force."""

from __future__ import annotations

import random

from corpus_pipeline import COLUMNS, STAGES, run
from pagequill.llm.pieces import Encoder
from pagequill.llm.queries import TOKENIZERS

from . import test_ngram_join, test_substring
from .conftest import prose


def corpus():
    rng = random.Random(12)
    passage, items = prose(rng, 35), [(k, prose(rng, 20 + 9 * k)) for k in range(4)]
    docs, labels = [], []
    for k in range(240):
        text = prose(rng, rng.randrange(20, 160))
        toxic = k % 4 == 0
        if toxic:
            text += " moronic imbecile, scumbag " + prose(rng, 9)
        elif k % 10 == 1:
            text += f"\n{passage} {prose(rng, 5)}"
        elif k % 30 == 3:
            text += f" {items[k % 4][1]} " + prose(rng, 8)
        docs.append((k, text))
        labels.append((k, 1, int(toxic)))
    docs += [(300 + k, docs[k][1]) for k in (1, 2, 5, 6)]
    docs += [(400 + k, docs[k][1] + " tail") for k in (17, 18) if len(docs[k][1].split()) > 40]
    docs += [(500, ""), (501, None), (None, "no id but words"), (None, None), (2, docs[2][1])]
    return docs, labels, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    sf = str(tmp_path)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    left = [(i, t) for i, t in docs if "imbecile" not in (t or "")]
    _, groups = test_ngram_join.brute(left)
    heads = [min(g, key=lambda k: test_ngram_join.rank(left[k][0])) for g in groups]
    left = [left[k] for k in heads]
    left = [(i, text) for i, _, _, _, text in test_substring.brute(left)]
    left = [(i, t) for i, t in left if not any(item in " ".join(t.split()) for _, item in items)]

    got = run(spark, sf).collect()
    encoder = Encoder(f"{TOKENIZERS}/piece_bpe_32k.model")
    texts = [(r["doc_id"], b"".join(encoder.pieces.written[o : o + n].tobytes() for o, n in zip(encoder.pieces.offsets[r["piece_ids"]], encoder.pieces.lengths[r["piece_ids"]], strict=True)).decode()[1:]) for r in got]
    assert sorted(texts, key=str) == sorted(left, key=str)
    assert all(r["lossless"] for r in got)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs, labels, items = corpus()
    sf = str(tmp_path)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for _, function in STAGES[:-1]:
        out = function(spark, empty, sf)
        assert out.columns == COLUMNS and out.count() == 0
    assert STAGES[-1][1](spark, empty, sf).count() == 0
