from __future__ import annotations

import numpy as np
import pyarrow as pa

from pagequill.llm.packing import deltas, pack, ranges, runs, undelta, unpack
from pagequill.llm.words import Words, shingles, texts, window_hashes

COLUMN = ["", "a", None, "b  c\td\n", "a b c d e f", "é a b c d e f", " ", "a b c d e"]


def test_words_and_shingles_equal_exactly_where_texts_do():
    for size in (1, 1 << 20):
        seen: dict[int, tuple] = {}
        spelled: dict[tuple, int] = {}
        for part in texts(pa.chunked_array([pa.array(COLUMN, pa.string())]), size):
            words = Words(part)
            hashes = words.hashes()
            own = [(t or "").encode().split() for t in COLUMN[part.lo : part.hi]]
            assert words.counts.tolist() == [len(w) for w in own]
            spans, rows = shingles(words, 5)
            expected = [(r, tuple(w[k : k + 5])) for r, w in enumerate(own) if w for k in range(max(1, len(w) - 4))]
            assert [r for r, _ in expected] == rows.tolist()
            pairs = [*zip(hashes.tolist(), [(x,) for w in own for x in w], strict=True), *zip(spans.tolist(), [s for _, s in expected], strict=True)]
            for h, w in pairs:
                if len(w) > 1:
                    assert seen.setdefault(h, w) == w and spelled.setdefault(w, h) == h


def test_window_hashes_do_not_depend_on_place():
    w = np.arange(1, 9, dtype=np.uint64)
    long = window_hashes(np.concatenate([w, w]), 8)
    assert long[0] == long[8] and len(np.unique(long)) == 8
    assert len(window_hashes(w[:3], 4)) == 0


def test_packing_round_trip():
    a, b = np.array([5, 5, 900, -3]), np.array([1, 2, 3, 2**63], np.uint64)
    back = unpack(pack(deltas(a), b))
    assert undelta(back[0]).tolist() == a.tolist() and back[1].tolist() == b.tolist()
    assert [x.tolist() for x in runs(np.array([1, 1, 4, 7, 7]))] == [[0, 2, 3], [2, 3, 5]]
    assert ranges(np.array([4, 0, 9]), np.array([2, 0, 3])).tolist() == [4, 5, 9, 10, 11]


def test_powers_and_sums_over_many_strides(monkeypatch):
    from pagequill.llm import words

    rng = np.random.default_rng(1)
    values = rng.integers(0, 256, 3 * (1 << 12) + 77).astype(np.uint8)
    monkeypatch.setattr(words, "STRIDE", 1 << 12)
    power, total = 1, 0
    sums, powers = [0], []
    for v in values.tolist():
        powers.append(power)
        total = (total + (v + 1) * power) % (1 << 64)
        sums.append(total)
        power = power * words.BYTE_PRIME % (1 << 64)
    assert words.prefix(values, words.BYTE_PRIME, 1).tolist() == sums
    assert words.powers(words.BYTE_PRIME, len(values)).tolist() == powers
    at = rng.integers(0, len(values), 500)
    assert words.power_at(words.BYTE_PRIME, at).tolist() == [powers[k] for k in at]
    assert len(words.power_at(words.BYTE_PRIME, np.empty(0, np.int64))) == 0
