"""Toxicity scores from a lexicon that is matched with one misspelling allowed.

The lexicon is learned: terms that mark toxic texts in a bounded labelled sample. Its trie is intersected with the
Levenshtein automaton of distance one and made deterministic, so every token of a batch walks one table at the same
time. A match counts by its term's weight, less if misspelled and much less if it stands inside quotation marks, more
if other matches or words of address stand in the window around it. A logistic model turns a text's matches into a
score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequill.llm.labelled import SAMPLE_ROWS, held_out, sample
from pagequill.llm.staging import ship, stage

CUTOFF = 0.7
LEAST_TEXTS = 3
LEAST_EVIDENCE = 12.0  # of the likelihood ratio; more where so many words are tried that chance would give some
FUZZY_LENGTH = 5  # shorter terms must match exactly
WINDOW = 6
FUZZY, QUOTED, NEAR = 0.5, 0.3, 0.15
RIDGE = 1e-3
SLICE_CHARS = 1 << 20
TOKEN = re.compile(r"[^\W_](?:[^\W_]|[!@$*](?=[^\W_]))*")
# Marks that open and close quotations, and those that do both; words of address.
OPENING, CLOSING, BOTH = "“«„‹", "”»›", '"'
ADDRESS = frozenset("you your youre ur du dein deine ihr euch tu te toi vous votre ton tú usted vosotros eres".split())


class Lexicon:
    """The table of the automaton: ``step[state, character class]``, and for each state its best term and distance."""

    def __init__(self, weights: dict[str, float]):
        self.terms = sorted(weights)
        self.weights = np.array([weights[t] for t in self.terms])
        children: list[dict[str, int]] = [{}]
        ends: list[int] = [-1]
        for k, term in enumerate(self.terms):
            node = 0
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = k
        alphabet = sorted({c for t in self.terms for c in t})
        self.classes = np.zeros(0x110000, np.uint16)  # 0: a character of no term
        for k, c in enumerate(alphabet, 1):
            self.classes[ord(c)] = k

        def close(states: set[tuple[int, int]]) -> frozenset:
            """With what a left-out character reaches; an exact way makes the same way with an edit needless."""
            states |= {(child, 1) for node, e in states if e == 0 for child in children[node].values()}
            return frozenset(s for s in states if s[1] == 0 or (s[0], 0) not in states)

        start = close({(0, 0)})
        known, todo, steps = {frozenset(): 0, start: 1}, [start], [[0] * (len(alphabet) + 1), None]
        while todo:
            here = todo.pop()
            base = {(child, 1) for node, e in here if e == 0 for child in children[node].values()} | {(node, 1) for node, e in here if e == 0}
            row = []
            for c in ["", *alphabet]:
                there = base | {(children[node][c], e) for node, e in here if c in children[node]}
                there = close(set(there))
                if there not in known:
                    known[there] = len(steps)
                    steps.append(None)
                    todo.append(there)
                row.append(known[there])
            steps[known[here]] = row
        self.step = np.array(steps, np.int32)
        self.term, self.edits = np.full(len(steps), -1, np.int32), np.zeros(len(steps), np.int8)
        for states, k in known.items():
            found = [(e, -weights[self.terms[ends[n]]], ends[n]) for n, e in states if ends[n] >= 0 and (e == 0 or len(self.terms[ends[n]]) >= FUZZY_LENGTH)]
            if found:
                self.edits[k], _, self.term[k] = min(found)

    def match(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The automaton's last state for each token; 0 if it died."""
        classes = self.classes[points]
        state = np.ones(len(starts), np.int32)
        live, at = np.arange(len(starts)), 0
        while len(live):
            live = live[lengths[live] > at]
            state[live] = self.step[state[live], classes[starts[live] + at]]
            live = live[state[live] > 0]
            at += 1
        return state


def _kind(of: str) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in of]] = True
    return out


class Reader:
    """Tokens of many texts at once, as code points."""

    def __init__(self) -> None:
        every = np.arange(0x110000)
        self.word = np.zeros(0x110000, bool)
        self.word[[c for c in every if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]] = True
        self.inner, self.opening, self.closing, self.both = _kind("!@$*"), _kind(OPENING), _kind(CLOSING), _kind(BOTH)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points, token starts, token lengths, token rows and whether each token is quoted. Texts are in lower case."""
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = self.word[points]
        after, before = np.append(word[1:], False), np.concatenate(([False], word[:-1]))
        word = word | (self.inner[points] & before & after)
        starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
        lengths = np.flatnonzero(word & ~np.append(word[1:], False)) + 1 - starts
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        rows = np.searchsorted(bounds, starts, "right") - 1
        depth = np.concatenate(([0], np.cumsum(self.opening[points].astype(np.int64) - self.closing[points])))
        turns = np.concatenate(([0], np.cumsum(self.both[points])))
        from_row = bounds[:-1][rows]
        ends = np.minimum(bounds[1:][rows], len(points))
        open_pairs = (depth[starts] - depth[from_row] > 0) & (depth[ends] - depth[starts] < 0)
        inside = open_pairs | (((turns[starts] - turns[from_row]) % 2 == 1) & (turns[ends] > turns[starts]))
        return points, starts, lengths, rows, inside


FEATURES = ("strongest", "all", "share", "exact", "misspelled", "unquoted")


def features(reader: Reader, lexicon: Lexicon, texts: list[str]) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(texts)
    points, starts, lengths, rows, quoted = reader.read(texts)
    state = lexicon.match(points, starts, lengths)
    term = lexicon.term[state]
    hit = np.flatnonzero(term >= 0)
    tokens = np.bincount(rows, minlength=n)
    row, edits = rows[hit], lexicon.edits[state[hit]]
    value = lexicon.weights[term[hit]] * np.where(edits > 0, FUZZY, 1.0) * np.where(quoted[hit], QUOTED, 1.0)
    if len(hit):
        spread = hit + row * (2 * WINDOW + 1)  # hits of other texts lie outside the window
        lo = np.searchsorted(spread, spread - WINDOW)
        hi = np.searchsorted(spread, spread + WINDOW, "right")
        company = hi - lo - 1
        for k, i in enumerate(hit.tolist()):  # few tokens match
            around = range(max(0, i - WINDOW), min(len(starts), i + WINDOW + 1))
            company[k] += any(rows[j] == rows[i] and points[starts[j] : starts[j] + lengths[j]].tobytes().decode("utf-32-le") in ADDRESS for j in around if lengths[j] <= 8)
        value = value * (1 + NEAR * np.minimum(company, 4))
    strongest = np.zeros(n)
    np.maximum.at(strongest, row, value)
    total = np.bincount(row, value, n)
    counts = [np.bincount(row, w, n) for w in (edits == 0, edits > 0, (edits == 0) & ~quoted[hit])]
    return np.stack([strongest, np.log1p(total), total / np.sqrt(tokens + 10.0), *(np.log1p(c) for c in counts)], 1)


class Model:
    def __init__(self, lexicon: Lexicon, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.lexicon, self.centre, self.scale, self.weights = lexicon, centre, scale, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts of a batch each token occurs."""
    for batch in batches:
        toxic: Counter = Counter()
        other: Counter = Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            (toxic if y >= 0.5 else other).update(set(TOKEN.findall(text)))
        words = list(toxic.keys() | other.keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([other[w] for w in words], pa.int64())], ["word", "toxic", "other"])


def learn_lexicon(found: DataFrame) -> dict[str, float]:
    """All terms of the sample ``(id, text, y)`` with enough evidence, and their log odds.

    The evidence asked for grows with the number of words tried, so that about one of them passes by chance. The sample
    bounds the terms: each stands in LEAST_TEXTS of its toxic texts at least, far oftener than in others.
    """
    ship(found.sparkSession)
    size = found.agg(F.count_if(F.col("y") >= 0.5), F.count_if(F.col("y") < 0.5)).first()
    if not size[0] or not size[1]:
        return {}
    words = found.select("text", "y").mapInArrow(_counted, "word string, toxic long, other long")
    words = words.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")).where((F.col("a") >= LEAST_TEXTS) & (F.length("word") > 1))
    words = stage(words)
    least = max(LEAST_EVIDENCE, 2 * math.log(max(1, words.count())))
    share = (F.col("a") + F.col("b")) / (size[0] + size[1])
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    evidence = 2 * (part(F.col("a"), share * size[0]) + part(F.col("b"), share * size[1]) + part(size[0] - F.col("a"), (1 - share) * size[0]) + part(size[1] - F.col("b"), (1 - share) * size[1]))
    weight = F.log((F.col("a") + 0.5) / (size[0] + 1.0)) - F.log((F.col("b") + 0.5) / (size[1] + 1.0))
    best = words.select("word", evidence.alias("evidence"), weight.alias("weight")).where(F.col("evidence") >= least).where("weight > 2")
    return {r["word"]: r["weight"] for r in best.collect()}


def fit(lexicon: Lexicon, x: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression by Newton steps with a small ridge."""
    centre, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    design = np.hstack([np.ones((len(x), 1)), (x - centre) / scale])
    mean = (y.sum() + 0.5) / (len(y) + 1)
    weights = np.zeros(design.shape[1])
    weights[0] = np.log(mean / (1 - mean))
    if len(np.unique(y)) > 1:
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
            ridge = RIDGE * len(y) * np.append(0.0, np.ones(design.shape[1] - 1))
            slope = design.T @ (y - p) - ridge * weights
            curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge + 1e-6)
            step = np.linalg.solve(curve, slope)
            weights += step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-8:
                break
    return Model(lexicon, centre, scale, weights)


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    held, size, lo = [], 0, 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield lo, i + 1, held
            held, size, lo = [], 0, i + 1
    if held:
        yield lo, lo + len(held), held


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and weights from at most ``rows`` labelled texts."""
    ship(docs.sparkSession)
    found = sample(docs, labels, label, rows).withColumn("text", F.lower("text"))
    lexicon = Lexicon(learn_lexicon(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for lo, hi, held in _pieces(batch.column("text")):
                x = features(reader, lexicon, held)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), lists], ["id", "y", "x"])

    rows_found = found.mapInArrow(run, "id long, y double, x array<double>").toPandas().sort_values("id")
    return fit(lexicon, np.array(rows_found["x"].tolist(), float).reshape(-1, len(FEATURES)), rows_found["y"].to_numpy(float))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """All rows and columns of ``docs`` with ``held_out, score, predicted`` after them, which replace columns so named;
    a column ``llm_lower`` is dropped.

    Null texts are empty; empty texts have a score too.
    """
    spark = docs.sparkSession
    ship(spark)
    held_model = spark.sparkContext.broadcast(model)  # bounded by the sample
    taken = ("held_out", "score", "predicted", "llm_lower")
    rows = docs.drop(*taken).withColumns({"held_out": held_out(F.col(id_col)), "llm_lower": F.lower(text_col)})
    names = [c for c in rows.columns if c != "llm_lower"]
    schema = rows.drop("llm_lower").schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, own = Reader(), held_model.value
        for batch in batches:
            for lo, hi, held in _pieces(batch.column("llm_lower")):
                score = own.score(features(reader, own.lexicon, held))
                columns = [batch.column(c).slice(lo, hi - lo) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= cutoff).astype(np.int32))], [*names, "score", "predicted"])

    return rows.mapInArrow(run, schema)
