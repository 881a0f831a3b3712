from __future__ import annotations

import hashlib

from pagequill.llm.blocks import text_blocks
from pagequill.llm.substring import COVER, PERIOD, WINDOW, repeated_windows


def brute(rows):
    """By id, then in the order of the rows; windows are judged on the input."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - WINDOW + 1):
            window = tuple(words[k : k + WINDOW])
            if window in seen:
                gone[k : k + WINDOW] = [True] * WINDOW
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode() if any(gone) else text or ""))
    return sorted(out, key=str)


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_removed_words_equal_brute_force(docs, texts):
    got = repeated_windows(docs, others=["source", "id"]).collect()
    assert {r["source"] for r in got} == {"s"}
    assert sorted(((r[0], r["n_words"], r["n_removed"], r["kept_sha256"], r["text"]) for r in got), key=str) == brute(texts)


def test_texts_over_many_blocks(docs, texts, monkeypatch):
    import pagequill.llm.blocks as blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 50)  # of the driver: executors keep theirs
    got = repeated_windows(docs.repartition(17)).collect()
    assert sorted(((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["text"]) for r in got), key=str) == brute(texts)


def test_empty_table(none):
    assert repeated_windows(none).collect() == []
    assert text_blocks(none).count() == 0


def test_rows_of_other_order_of_id(spark):
    words = " ".join(f"w{k}" for k in range(25))
    rows = [(2, words), (1, f"{words} tail"), (3, "w1 " * 45)]
    got = repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"]: (r["n_words"], r["n_removed"]) for r in got} == {1: (26, 0), 2: (25, 25), 3: (45, 44)}
