"""Quality scores by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Cyclic boosting gives every feature in turn a shallow tree over its bins, added
to that feature's lookup table; then the pairs of features with most left to explain get tables of their own. A score
is a sum of looked-up values, so whole batches are scored by adding rows of small tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequill.llm.labelled import SAMPLE_ROWS, held_out, sample
from pagequill.llm.staging import ship
from pagequill.llm.words import Texts, Words, shingles, texts, word_table

BINS = 32
LEAVES = 4
ROUNDS = 200
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.1
RIDGE = 2.0
CUTOFF = 0.5

FEATURES = (
    "log_words",
    "word_length",
    "longest_word",
    "upper_share",
    "digit_share",
    "mark_share",
    "rare_mark_share",
    "marked_words",
    "capital_words",
    "short_words",
    "different_words",
    "different_shingles",
    "words_a_line",
    "different_lines",
    "upper_words",
    "stop_marks",
)


def _classes() -> dict[str, np.ndarray]:
    kinds = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "mark": bytes(b for b in range(33, 127) if not chr(b).isalnum()), "stop": b".?"}
    kinds["rare"] = bytes(b for b in kinds["mark"] if b not in b".,;:'\"?-")
    out = {}
    for name, members in kinds.items():
        out[name] = np.zeros(256, np.uint8)
        out[name][list(members)] = 1
    return out


CLASSES = _classes()
LINES = word_table(b"\n")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _different(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes of each row."""
    keys = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=n)


def features(part: Texts) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    n = part.hi - part.lo
    words, lines = Words(part), Words(part, LINES)
    count = np.maximum(words.counts, 1)
    size = np.maximum(np.diff(part.bounds), 1)
    share = {k: _sums(t[part.data], part.bounds) / size for k, t in CLASSES.items()}
    length = words.ends - words.starts
    rows = words.rows()
    per_word = lambda v: np.bincount(rows, v, n) / count
    upper, last = CLASSES["upper"][part.data], CLASSES["rare"][part.data]
    longest = np.zeros(n)
    some = words.counts > 0
    if some.any():
        longest[some] = np.maximum.reduceat(length, words.first[:-1][some])
    uppers = np.concatenate(([0], np.cumsum(upper, dtype=np.int64)))
    spans, at = shingles(words, 5)
    number = np.maximum(np.bincount(at, minlength=n), 1)
    columns = [
        np.log1p(words.counts),
        np.bincount(rows, length, n) / count,
        np.log1p(longest),
        share["upper"],
        share["digit"],
        share["mark"],
        share["rare"],
        per_word(last[words.ends - 1]) if len(rows) else np.zeros(n),
        per_word(upper[words.starts]) if len(rows) else np.zeros(n),
        per_word(length <= 3),
        _different(words.hashes(), rows, n) / count,
        _different(spans, at, n) / number,
        np.log1p(words.counts / np.maximum(lines.counts, 1)),
        _different(lines.hashes(), lines.rows(), n) / np.maximum(lines.counts, 1),
        per_word(uppers[words.ends] - uppers[words.starts] >= 2) if len(rows) else np.zeros(n),
        share["stop"],
    ]
    return np.where(some[:, None], np.stack(columns, 1), 0.0)


class Additive:
    """Lookup tables for single features and for pairs."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.single = np.zeros((len(edges), BINS))
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = self.base + self.single[np.arange(b.shape[1]), b].sum(1)
        for i, j, table in self.pairs:
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    left, right = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left):
        return 0.0, 0
    gains = _gain(left, right) + _gain(g.sum() - left, h.sum() - right) - _gain(g.sum(), h.sum())
    k = int(gains.argmax())
    return float(gains[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A step for each bin: a tree of at most LEAVES leaves, grown where it gains most."""
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        cuts = [(*_best_cut(g[a:b], h[a:b]), k) for k, (a, b) in enumerate(leaves)]
        gain, at, k = max(cuts)
        if gain <= 1e-9:
            break
        a, b = leaves[k]
        leaves[k : k + 1] = [(a, a + at), (a + at, b)]
    step = np.zeros(len(g))
    for a, b in leaves:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of one axis with a cut of the other on either side, and its gain."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for at in range(1, len(a)):
            gain, step = 0.0, np.zeros_like(a)
            for lo, hi in ((0, at), (at, len(a))):
                sg, sh = a[lo:hi].sum(0), b[lo:hi].sum(0)
                more, cut = _best_cut(sg, sh)
                gain += more + float(_gain(sg.sum(), sh.sum()))
                for x, y in ((0, cut), (cut, len(sg))) if cut else ((0, len(sg)),):
                    step[lo:hi, x:y] = sg[x:y].sum() / (sh[x:y].sum() + RIDGE)
            gain -= float(_gain(a.sum(), b.sum()))
            if gain > best[0]:
                best = (gain, step.T if turned else step)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fit the tables; without rows or with one label only, the model is the smoothed mean label."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for k in range(x.shape[1])]
    model = Additive(edges, float(np.log(mean / (1 - mean))))
    if len(np.unique(y)) < 2:
        return model
    bins = model.bins(x)
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k in range(x.shape[1]):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[:, k], g, BINS), np.bincount(bins[:, k], h, BINS))
            model.single[k] += step
            total += step[bins[:, k]]
    coarse = bins // 4
    g, h = slopes()
    table = lambda b, i, j, w, n: np.bincount(b[:, i] * n + b[:, j], w, n * n).reshape(n, n)
    ranked = sorted(((_pair_tree(table(coarse, i, j, g, BINS // 4), table(coarse, i, j, h, BINS // 4))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j, np.zeros((BINS, BINS))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, own in model.pairs:
            g, h = slopes()
            _, step = _pair_tree(table(coarse, i, j, g, BINS // 4), table(coarse, i, j, h, BINS // 4))
            step = RATE * np.repeat(np.repeat(step, 4, 0), 4, 1)
            own += step
            total += step[bins[:, i], bins[:, j]]
    return model


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in texts(batch.column("text")):
            x = features(part)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(part.lo, part.hi - part.lo), batch.column("y").slice(part.lo, part.hi - part.lo), lists], ["id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Additive:
    """Fit on the features of at most ``rows`` labelled texts; only those short rows of numbers reach the driver."""
    ship(docs.sparkSession)
    found = sample(docs, labels, label, rows).mapInArrow(_features_of, "id long, y double, x array<double>").toPandas().sort_values("id")
    x = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, found["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """``(id, held_out, score, predicted)`` for each row of ``docs``. Null texts are empty; empty texts have a score too."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts(batch.column("text")):
                score = model.score(features(part))
                own = [batch.column(c).slice(part.lo, part.hi - part.lo) for c in ("id", "held_out")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(score), pa.array((score >= cutoff).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "id long, held_out boolean, score double, predicted int")
