"""Benchmark decontamination with an index of each item's rarest word shingles.

A window that is similar enough to an item misses few of its shingles: of ``n``, at most ``n`` less the smallest whole
number from THRESHOLD * n. So any choice of one more of them meets every such window. The index holds, for every item,
that many shingles, those that the fewest items have; a text's shingles are looked up in it. Around what is found, all
windows of the item's own size are compared by the weighted Jaccard similarity (shingles weighted by their number), so
no leak is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequill.llm.packing import ranges, runs
from pagequill.llm.staging import ship
from pagequill.llm.words import Texts, Words, texts, window_hashes, word_table

SIZE = 5
THRESHOLD = 0.8
ITEMS_A_PASS = 20_000
SCHEMA = "id long, item long, similarity double, first_word int, n_words int"
SPLIT = word_table(bytes(b for b in range(128) if not chr(b).isalnum()))  # white space and punctuation part words


class Items:
    """Benchmark items as shingles with their numbers, and the index of those that find them."""

    def __init__(self, rows: list[tuple[int, str]]):
        column = pa.array([t for _, t in rows], pa.string())
        part = next(texts(column, 1 << 62), Texts(0, 0, np.empty(0, np.uint8), np.zeros(1, np.int64)))
        words = Words(part, SPLIT)
        hashes = words.hashes()
        self.ids, self.shingles, self.wanted, self.sizes = [], [], [], []
        for k, (item, _) in enumerate(rows):
            own = hashes[words.first[k] : words.first[k + 1]]
            if len(own):
                shingles, wanted = np.unique(window_hashes(own, min(SIZE, len(own))), return_counts=True)
                self.ids.append(item)
                self.shingles.append(shingles)
                self.wanted.append(wanted)
                self.sizes.append(len(own))
        self.tiny = [i for i, n in enumerate(self.sizes) if n < SIZE]
        whole = [i for i, n in enumerate(self.sizes) if n >= SIZE]
        every, holders = np.unique(np.concatenate([np.empty(0, np.uint64), *(self.shingles[i] for i in whole)]), return_counts=True)
        probes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for i in whole:
            order = np.argsort(holders[np.searchsorted(every, self.shingles[i])], kind="stable")
            spare = self.sizes[i] - SIZE + 1 - _least(self.sizes[i] - SIZE + 1)
            chosen = order[: int(np.searchsorted(np.cumsum(self.wanted[i][order]), spare, "right")) + 1]
            probes.append(self.shingles[i][chosen])
            owners.append(np.full(len(chosen), i))
        probe, owner = np.concatenate(probes), np.concatenate(owners)
        order = np.argsort(probe, kind="stable")
        self.owners = owner[order]
        self.probes, self.counts = np.unique(probe, return_counts=True)
        self.bounds = np.cumsum(self.counts) - self.counts
        self.bits = np.uint64((1 << max(10, int(len(self.probes) * 8).bit_length())) - 1)
        self.some = np.zeros(int(self.bits) + 1, bool)
        self.some[self.probes & self.bits] = True

    def find(self, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``spans`` of indexed shingles, each with the items they find."""
        at = np.flatnonzero(self.some[spans & self.bits])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.probes, spans[at]), len(self.probes) - 1)
        real = self.probes[k] == spans[at]
        at, k = at[real], k[real]
        return np.repeat(at, self.counts[k]), self.owners[ranges(self.bounds[k], self.counts[k])]


def _least(n: int) -> int:
    """Of an item's ``n`` shingles those that a window over the threshold has at least."""
    return math.ceil(THRESHOLD * n - 1e-9)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id, item, similarity, first_word, n_words)`` for each text and benchmark item that leaks into it.

    Words are runs of letters and digits in lower case. The similarity is that of the best window of the item's size; a
    text shorter than the item is compared as a whole. Null and empty texts and items match nothing. Rows of one id
    each give their rows. Items are the stated query set: they are taken in blocks of ``ITEMS_A_PASS``, each of which
    goes to all executors and meets all rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("text"))
    found = None
    for held in _item_blocks(benchmark, item_col, item_text_col):
        more = rows.mapInArrow(lambda b, h=held: _search(b, h.value), SCHEMA)
        found = more if found is None else found.union(more)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no benchmark item leaks, with all their columns."""
    own = "lower"
    while own in docs.columns:
        own += "_"
    for held in _item_blocks(benchmark, item_col, item_text_col):
        lower = docs.withColumn(own, F.lower(text_col))
        docs = lower.mapInArrow(lambda b, h=held: _clean(b, h.value, own), docs.schema)
    return docs


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[Broadcast]:
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.lower(text_col).alias("text")).where("text is not null").distinct()
    parts = max(1, -(-items.count() // ITEMS_A_PASS))
    out = []
    for k in range(parts):
        chosen = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        rows = sorted((tuple(r) for r in chosen.collect()), key=lambda r: (r[0] is not None, r))
        out.append(spark.sparkContext.broadcast(Items(rows)))
    return out


def _clean(batches: Iterator[pa.RecordBatch], items: Items, own: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for part in texts(batch.column(own), 1 << 20):
            keep[[part.lo + r[0] for r in _matches(part, items)]] = False
        yield batch.drop_columns([own]).filter(pa.array(keep))


def _search(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_pylist()
        for part in texts(batch.column("text"), 1 << 20):
            rows = _matches(part, items)
            if rows:
                columns = list(zip(*((ids[part.lo + r], *rest) for r, *rest in rows), strict=True))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "item", "similarity", "first_word", "n_words"])


def _matches(part: Texts, items: Items) -> list[tuple[int, int, float, int, int]]:
    if not items.ids or not len(part.data):
        return []
    words = Words(part, SPLIT)
    if not len(words.starts):
        return []
    hashes = words.hashes()
    spans = window_hashes(hashes, SIZE)
    seen: dict[tuple[int, int], tuple[float, int]] = {}
    _tiny(words, hashes, items, seen)
    at, item = items.find(spans)
    row = np.searchsorted(words.first, at, "right") - 1
    inside = at + SIZE <= words.first[row + 1]
    at, item, row = at[inside], item[inside], row[inside]
    order = np.lexsort((at, item, row))
    at, item, row = at[order], item[order], row[order]
    for lo, hi in zip(*runs(row * len(items.ids) + item), strict=True):
        r, i = int(row[lo]), int(item[lo])
        best = _best(spans[words.first[r] : words.first[r + 1] - SIZE + 1], items, i, int(at[lo] - words.first[r]), int(at[hi - 1] - words.first[r]))
        if best:
            seen[r, i] = best
    return [(row, items.ids[i], score, start, items.sizes[i]) for (row, i), (score, start) in sorted(seen.items())]


def _best(spans: np.ndarray, items: Items, i: int, first: int, last: int) -> tuple[float, int] | None:
    """Similarity and start of the best window of the item's own size that holds a place from ``first`` to ``last``."""
    want = items.sizes[i] - SIZE + 1
    size = min(want, len(spans))  # a shorter text is one window
    lo, hi = max(0, first - size + 1), min(last, len(spans) - size) + 1
    around = spans[lo : hi - 1 + size]
    kind = np.minimum(np.searchsorted(items.shingles[i], around), len(items.shingles[i]) - 1)
    place = np.flatnonzero(items.shingles[i][kind] == around)
    if len(place) < _least(want):
        return None
    kind = kind[place]
    order = np.argsort(kind, kind="stable")
    kind, place = kind[order], place[order]
    # a shingle counts in windows that hold fewer before it than the item has: those that begin after the last too many
    back = np.arange(len(kind)) - items.wanted[i][kind]
    after = np.where((back >= 0) & (kind[back] == kind), place[back] + 1, 0)
    begin, end = np.maximum(after, place - size + 1), np.minimum(place, hi - lo - 1) + 1
    some = begin < end
    both = np.cumsum(np.bincount(begin[some], minlength=hi - lo + 1) - np.bincount(end[some], minlength=hi - lo + 1))[: hi - lo]
    k = int(np.argmax(both))
    score = float(both[k] / (size + want - both[k]))
    return (score, lo + k) if score >= THRESHOLD else None


def _tiny(words: Words, hashes: np.ndarray, items: Items, seen: dict) -> None:
    """Items of fewer words than a shingle are one shingle of their own."""
    for i in items.tiny:
        n = items.sizes[i]
        for at in np.flatnonzero(window_hashes(hashes, n) == items.shingles[i][0]).tolist():
            row = int(np.searchsorted(words.first, at, "right")) - 1
            if at + n <= words.first[row + 1]:
                seen.setdefault((row, i), (1.0, int(at - words.first[row])))
