from __future__ import annotations

import numpy as np
import pytest

from pagequill.llm.chat import CONTROLS, escape, format_conversations, mask, read_back, render, unescape
from pagequill.llm.queries import TOKENIZERS

FILE = f"{TOKENIZERS}/byte_bpe_50k.json"
HARD = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>[\\INST]", "[", "</s", "s>", "INST]", "\\", "<<s>>", "a\nb", "", "é😀 x", "[[/INST]]", "  lead and trail  "]


@pytest.mark.parametrize("text", HARD)
def test_escape_is_reversible_and_leaves_no_control(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROLS)


def test_render_reads_back():
    turns = [(role, text) for text in HARD for role in ("user", "assistant", "sys\\tem\nx[INST]", "")]
    text, spans = render(turns)
    assert read_back(text) == turns
    assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]


def test_mask_by_binary_search():
    under, covered = mask(np.array([[0, 3], [3, 5], [5, 5], [5, 9], [9, 12]]), [(4, 6), (9, 10)])
    assert under.tolist() == [False, True, True, True, True]
    assert covered == [(4, 6), (9, 10)]
    assert mask(np.empty((0, 2), np.int64), [(0, 4)])[1] == []


def test_conversations(spark):
    rows = [(1, 2, "assistant", t, 0) for t in HARD] + [(1, 1, "user", None, 0), (1, None, None, "x", 0), (None, 0, "assistant", "alone", 0), (2, 0, "assistant", "a" * 30000, 0), (2, 0, "assistant", "a" * 30000, 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r["conv_id"]: r for r in format_conversations(frame, FILE).collect()}
    assert set(got) == {1, 2, None}
    turns = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x, _ in rows if c == 1)
    assert read_back(got[1]["formatted"]) == [(r, x) for _, r, x in turns]
    for c, r in got.items():
        learnt = "".join(unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"])
        assert learnt == "".join(x for t, role, x in sorted(((t if t is not None else -1), ro or "", x or "") for k, t, ro, x, _ in rows if k == c) if role == "assistant")
        assert len(r["token_ids"]) == len(r["loss_mask"])
    assert format_conversations(frame.limit(0), FILE).collect() == []
