from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from pagequill.llm import pieces as pieces_module
from pagequill.llm.pieces import Encoder, Pieces, encode_texts, merge_many, merge_one
from pagequill.llm.queries import TOKENIZERS
from pagequill.llm.words import mix
from pagequill.llm.words import texts as parts

from .conftest import prose

FILE = f"{TOKENIZERS}/piece_bpe_32k.model"
HARD = ["", "a", "  ", "é①▁x \n\n  y", "Hello  world\n é", "x" * 200 + " aaaaaaaaaaaaaa", "<s> <0x41> </s>", "日本語 テキスト 😀", " " * 70, None, "\n", "the " * 300]


def pieces_of(encoder, column, size=1 << 20):
    out = []
    for part in parts(pa.array(column, pa.string()), size):
        ids, counts = encoder.encode(part, np.arange(part.lo, part.hi))
        data, sizes = encoder.decode(ids, counts)
        assert data.tobytes() == part.data.tobytes() and sizes.tolist() == np.diff(part.bounds).tolist()
        out += np.split(ids, np.cumsum(counts)[:-1])
    return [x.tolist() for x in out]


def test_without_dropout_it_is_sentencepiece():
    model = sentencepiece.SentencePieceProcessor(model_file=FILE)
    column = [t for t in HARD if t and "▁" not in t] + [prose(random.Random(1), 300)]
    assert pieces_of(Encoder(FILE, dropout=0.0), column) == [model.encode(t) for t in column]


@pytest.mark.parametrize("dropout", [0.1, 1.0])
def test_dropout_varies_and_loses_nothing(dropout):
    encoder = Encoder(FILE, dropout=dropout)
    first = pieces_of(encoder, HARD)
    assert pieces_of(encoder, HARD, 1) == first  # neither kept results nor the cut of the batch matter
    assert pieces_of(Encoder(FILE, dropout=dropout), HARD) == first
    assert len({tuple(x) for x in pieces_of(encoder, ["information"] * 60)}) == (4 if dropout < 1 else 1) or dropout < 1
    if dropout < 1:
        assert pieces_of(Encoder(FILE, seed=1, dropout=dropout), HARD) != first


def test_side_by_side_is_the_agenda():
    encoder, rng = Encoder(FILE), random.Random(2)
    words = [w for w in prose(rng, 200).split()] + ["aaaaaaa", "banana" * 8]
    symbols = [encoder.pieces.symbols(" " + w) for w in words]
    variants = np.array([k % 4 for k in range(len(words))])
    for dropout in (0.0, 0.3):
        ids, sizes = merge_many(encoder.pieces, np.array(sum(symbols, []), np.int32), np.array([len(s) for s in symbols]), variants, 9, dropout)
        side = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert side == [merge_one(encoder.pieces, s, int(v), 9, dropout) for s, v in zip(symbols, variants, strict=True)]


def test_every_occurrence_draws_for_itself():
    encoder, n = Encoder(FILE), 400
    for word in ("information", "x" * 70):
        symbols = encoder.pieces.symbols(" " + word)
        free = [tuple(merge_one(encoder.pieces, symbols, k, 99, 0.1)) for k in range(n)]
        ids = pieces_of(encoder, [f"{word} {word}"] * n)
        head = len(encoder.pieces.symbols(word))
        second = []
        for row in ids:  # what follows the first word
            size, k = 0, 0
            while size < head + 1:
                size, k = size + int(encoder.pieces.lengths[row[k]]), k + 1
            second.append(tuple(row[k:]))
        plain = max(set(free), key=free.count)
        assert len(set(second)) > len(set(free)) / 2 > 4
        assert abs(second.count(plain) - free.count(plain)) < 0.15 * n


def test_kept_ways_are_the_agenda():
    encoder, rng = Encoder(FILE), random.Random(4)
    words = prose(rng, 500).split()
    ids = pieces_of(encoder, [" ".join(words)])[0]
    key = mix(mix(np.zeros(1, np.int64).view(np.uint64) ^ np.uint64(encoder.seed)) ^ np.arange(len(words), dtype=np.uint64))
    expected = [merge_one(encoder.pieces, encoder.pieces.symbols(" " + w), int(v), encoder.seed, encoder.dropout) for w, v in zip(words, key, strict=True)]
    assert ids == sum(expected, [])


def test_table(docs, texts, none):
    got = encode_texts(docs, FILE).collect()
    assert all(r["lossless"] for r in got) and len(got) == len(texts)
    assert sorted(r["n_bytes"] for r in got) == sorted(len((t or "").encode()) for _, t in texts)
    assert encode_texts(none, FILE).collect() == []


def test_arrays_shipped_as_a_file_are_the_model(tmp_path):
    built = Pieces(FILE)
    loaded = Pieces.load(str(tmp_path / "p"), built.save(str(tmp_path / "p")))
    for name in Pieces.ARRAYS:
        assert np.array_equal(getattr(built, name), getattr(loaded, name)), name
    assert (built.size, built.space, built.mask) == (loaded.size, loaded.space, loaded.mask)


def test_little_room_for_kept_chunks_changes_nothing(monkeypatch):
    column = pa.array([f"{t} {k}" for k in range(5) for t in HARD if t is not None])
    whole = pieces_of(Encoder(FILE), column.to_pylist())
    monkeypatch.setattr(pieces_module, "KEPT_BYTES", 100)
    encoder = Encoder(FILE)
    assert pieces_of(encoder, column.to_pylist()) == whole == pieces_of(encoder, column.to_pylist())
