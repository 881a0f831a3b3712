"""Substring deduplication with difference-cover anchors.

A window is a run of ``WINDOW`` words of one text. Word places that lie, modulo ``PERIOD``, in the difference cover
``COVER`` are anchors. Any two places have a common shift below the period that puts both on the cover, so two equal
windows always share an anchor run of ``WINDOW - PERIOD + 1`` words. Only windows over an anchor that occurs twice are
extended to their full length and compared, by 96 bits of hash.

Texts are held in blocks (see :mod:`blocks`). Each block first settles what repeats inside itself, so that a passage
found in a third of all texts sends one entry for each block and not one for each text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequill.llm.blocks import NO_ID, each_block, open_block, other_columns, rows_of, text_blocks
from pagequill.llm.packing import deltas, pack, ranges, runs, undelta, unpack
from pagequill.llm.words import OTHER_PRIME, Words, mix, texts, window_hashes

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
BUCKET_ENTRIES = 1_500_000
BYTES_A_WORD = 6
LOW = np.uint64((1 << 40) - 1)

MESSAGE = "bucket int, block long, settled boolean, data binary"
REPLY = "block long, data binary"


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: list[str] | None = None) -> DataFrame:
    """``(id, n_words, n_removed, text, kept_sha256)`` and the columns ``others`` for each row of ``docs``.

    A word is removed if a window over it starts earlier as well: in a row with a smaller id, or earlier in its own.
    ``text`` is as it was where nothing goes, else the words left joined by one space; ``kept_sha256`` is always of the
    words so joined. Null texts have no words and come back empty. Null ids count as the smallest id. Rows that share an
    id are taken in the order of the input. Other columns are ignored, as are names in ``others`` that the result has.
    """
    others = [c for c in others or [] if c not in ("id", "n_words", "n_removed", "text", "kept_sha256")]
    blocks = text_blocks(docs, id_col, text_col, others)
    words = (blocks.agg(F.sum("n_bytes")).first()[0] or 0) / BYTES_A_WORD
    buckets = max(12, round(words * len(COVER) / PERIOD / BUCKET_ENTRIES))
    anchors = blocks.select("block", "ids", "body").mapInArrow(lambda b: _anchors(b, buckets), MESSAGE)
    seen = anchors.groupBy("bucket").applyInArrow(_twice, REPLY)
    windows = rows_of(blocks, seen, lambda left, right: _windows(left, right, buckets), MESSAGE, ("ids", "body"))
    later = windows.groupBy("bucket").applyInArrow(_later, REPLY)
    schema = T.StructType([T.StructField(c, k) for c, k in (("id", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("text", T.StringType()), ("kept_sha256", T.StringType()))])
    for name in others or []:
        schema = schema.add(name, docs.schema[name].dataType)
    out = rows_of(blocks, later, lambda left, right: _cut(left, right, others or []), schema)
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))


def _message(buckets: list[int], blocks: list[int], settled: list[bool], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array(blocks, pa.int64()), pa.array(settled, pa.bool_()), pa.array(data, pa.binary())],
        ["bucket", "block", "settled", "data"],
    )


def _home(block: int, buckets: int) -> int:
    return int(mix(np.array([block], np.int64).view(np.uint64))[0] % np.uint64(buckets))


def _split(order_by: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each bucket, in their own order."""
    order = np.argsort(order_by, kind="stable")
    for lo, hi in zip(*runs(order_by[order]), strict=True):
        yield int(order_by[order[lo]]), order[lo:hi]


def _anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    size = WINDOW - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    for batch in batches:
        for block, ids, body in each_block(batch):
            found, rows, places = [], [], []
            for part in texts(open_block(ids, body)[1]):
                words = Words(part)
                place, count = words.places(), np.repeat(words.counts, words.counts)
                at = np.flatnonzero(cover[place % PERIOD] & (place + size <= count) & (count >= WINDOW))
                if len(at):
                    found.append(window_hashes(words.hashes(), size)[at])
                    rows.append(words.rows()[at] + part.lo)
                    places.append(place[at])
            if not found:
                continue
            found, rows, places = np.concatenate(found), np.concatenate(rows), np.concatenate(places)
            order = np.argsort(found, kind="stable")
            lo, hi = runs(found[order])
            lone = np.sort(order[lo[hi - lo == 1]])
            many = lo[hi - lo > 1]
            out = []
            if len(many):  # these repeat in the block itself: they are told, not asked
                told = np.sort(order[ranges(many, (hi - lo)[hi - lo > 1])])
                out.append((_home(block, buckets), True, pack(deltas(rows[told]), deltas(places[told]))))
            asked = np.concatenate([lone, order[many]])
            place = np.concatenate([places[lone], np.full(len(many), -1)])
            row = np.concatenate([rows[lone], np.zeros(len(many), np.int64)])
            hashes = found[asked]
            for bucket, at in _split((hashes >> np.uint64(40)).astype(np.int64) % buckets, buckets):
                out.append((bucket, False, pack(hashes[at] & LOW, deltas(row[at]), deltas(place[at]))))
            yield _message([x[0] for x in out], [block] * len(out), [x[1] for x in out], [x[2] for x in out])


def _reply(blocks: list[int], data: list[bytes]) -> pa.Table:
    return pa.table({"block": pa.array(blocks, pa.int64()), "data": pa.array(data, pa.binary())})


def _asked(table: pa.Table) -> tuple[list[int], list[bytes], list[tuple[int, bytes]]]:
    """Blocks and data of what is already settled, and the pairs (block, data) that ask."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "settled", "data")), strict=True))
    told = [(b, d) for b, s, d in rows if s]
    return [b for b, _ in told], [d for _, d in told], [(b, d) for b, s, d in rows if not s]


def _twice(table: pa.Table) -> pa.Table:
    """The anchors of a bucket whose hash another block asks about too."""
    blocks, data, asked = _asked(table)
    if asked:
        parts = [unpack(d) for _, d in asked]
        sizes = [len(p[0]) for p in parts]
        hashes = np.concatenate([p[0] for p in parts])
        order = np.argsort(hashes, kind="stable")
        lo, hi = runs(hashes[order])
        repeats = np.zeros(len(hashes), bool)
        repeats[order[ranges(lo[hi - lo > 1], (hi - lo)[hi - lo > 1])]] = True
        ends = np.cumsum(sizes)
        for (block, _), part, end in zip(asked, parts, ends, strict=True):
            row, place = undelta(part[1]), undelta(part[2])
            hit = repeats[end - len(row) : end] & (place >= 0)
            if hit.any():
                blocks.append(block)
                data.append(pack(deltas(row[hit]), deltas(place[hit])))
    return _reply(blocks, data)


def _marks(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of a block that the replies name."""
    parts = [unpack(d) for d in table.column("data").to_pylist()]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows, places = np.concatenate([undelta(p[0]) for p in parts]), np.concatenate([undelta(p[1]) for p in parts])
    order = np.lexsort((places, rows))
    return rows[order], places[order]


def _cover(n: int, starts: np.ndarray, before: int, after: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in start - before … start + after, within first … last - 1 of that start's text."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.maximum(starts - before, first), 1)
    np.add.at(steps, np.minimum(starts + after + 1, last), -1)
    return np.cumsum(steps[:-1]) > 0


def _windows(left: pa.Table, right: pa.Table, buckets: int) -> pa.Table:
    """The windows of a block over an anchor that occurs twice: one entry for each different one, its later places told."""
    rows, places = _marks(right)
    out = []
    if left.num_rows and len(rows):
        block, ids, body = (left.column(c)[0].as_py() for c in ("block", "ids", "body"))
        id_of, data = open_block(ids, body)
        keep = []
        for part in texts(data):
            lo, hi = np.searchsorted(rows, [part.lo, part.hi])
            if lo == hi:
                continue
            words = Words(part)
            row = rows[lo:hi] - part.lo
            first, last = words.first[row], words.first[row + 1] - WINDOW + 1  # of the window starts
            anchored = _cover(len(words.starts), first + places[lo:hi], PERIOD - 1, 0, first, np.maximum(last, first))
            at = np.flatnonzero(anchored)
            hashes = words.hashes()
            one = window_hashes(hashes, WINDOW)[at]
            two = window_hashes(hashes, WINDOW, OTHER_PRIME)[at].astype(np.uint32)
            keep.append((one, two, words.rows()[at] + part.lo, words.places()[at]))
        one, two, row, place = (np.concatenate(x) for x in zip(*keep, strict=True))
        order = np.lexsort((place, row, id_of[row], two, one))
        lo, _ = runs_of(one[order], two[order])
        earliest = np.zeros(len(one), bool)
        earliest[order[lo]] = True
        if not earliest.all():
            late = np.flatnonzero(~earliest)
            out.append((_home(block, buckets), True, pack(deltas(row[late]), deltas(place[late]))))
        at = np.flatnonzero(earliest)
        one, two, row, place = one[at], two[at], row[at], place[at]
        for bucket, at in _split((one >> np.uint64(40)).astype(np.int64) % buckets, buckets):
            out.append((bucket, False, pack(one[at], two[at], deltas(row[at]), deltas(place[at]), deltas(id_of[row[at]]))))
        return pa.Table.from_batches([_message([x[0] for x in out], [block] * len(out), [x[1] for x in out], [x[2] for x in out])])
    return pa.Table.from_batches([_message([], [], [], [])])


def runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs in which all keys are equal."""
    if not len(keys[0]):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(new))


def _later(table: pa.Table) -> pa.Table:
    """All but the earliest of each group of equal windows."""
    blocks, data, asked = _asked(table)
    if asked:
        parts = [unpack(d) for _, d in asked]
        source = np.repeat([b for b, _ in asked], [len(p[0]) for p in parts])
        one, two = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        row, place, ids = (np.concatenate([undelta(p[k]) for p in parts]) for k in (2, 3, 4))
        order = np.lexsort((place, row, source, ids, two, one))
        lo, _ = runs_of(one[order], two[order])
        late = np.ones(len(one), bool)
        late[order[lo]] = False
        end = 0
        for (block, _), part in zip(asked, parts, strict=True):
            end += len(part[0])
            hit = np.flatnonzero(late[end - len(part[0]) : end]) + end - len(part[0])
            if len(hit):
                blocks.append(block)
                data.append(pack(deltas(row[hit]), deltas(place[hit])))
    return _reply(blocks, data)


def _cut(left: pa.Table, right: pa.Table, others: list[str]) -> pa.Table:
    """The texts of a block without the words under the windows that the replies name."""
    ids, n_words, n_removed, kept_texts, digests = [], [], [], [], []
    kept_others = []
    if left.num_rows:
        rows, places = _marks(right)
        names, data = open_block(*(left.column(c)[0].as_py() for c in ("ids", "body")))
        bounds = np.searchsorted(rows, np.arange(len(names) + 1))
        for i, text in enumerate(data):
            raw = text.as_py()
            words = raw.split()
            lo, hi = bounds[i], bounds[i + 1]
            kept, gone = words, 0
            if lo < hi:
                removed = _cover(len(words), places[lo:hi], 0, WINDOW - 1, places[lo:hi], np.full(hi - lo, len(words)))
                kept, gone = list(compress(words, ~removed)), int(removed.sum())
            joined = b" ".join(kept)
            ids.append(names[i])
            n_words.append(len(words))
            n_removed.append(gone)
            kept_texts.append((joined if gone else raw).decode("utf-8", "replace"))
            digests.append(hashlib.sha256(joined).hexdigest())
        if others:
            kept_others = other_columns(left.column("others")[0].as_py())
    columns = [pa.array(v, k) for v, k in ((ids, pa.int64()), (n_words, pa.int64()), (n_removed, pa.int64()), (kept_texts, pa.string()), (digests, pa.string()))]
    return pa.table([*columns, *kept_others], names=["id", "n_words", "n_removed", "text", "kept_sha256", *(others if kept_others else [])])
