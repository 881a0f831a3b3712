"""How far the sources of a language differ in their terms, by three-dimensional cube partitioning.

A language's groups (its sources) are dealt into blocks, its kept terms into blocks as well. A cell of the cube owns two
blocks of groups and one of terms. Each slice (a block of groups in a block of terms) is sent to all cells it takes part
in; a cell sums the differences of its pairs over its own terms, and the sums are added up along the term axis.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequill.llm.staging import ship, stage

GROUP_BLOCK = 64
TERM_BLOCK = 4096
# Partial counts are handed on when a task holds this many of them, and texts are cut into words in steps of this size.
HELD_TERMS = 200_000
STEP_BYTES = 1 << 20
BREAK = re.compile(rb"[ ]")
COUNTS = "lang string, source string, term string, n long, docs long"
PAIRS = "lang string, source string, item string, apart long, seen long, gap long"


def _byte_table() -> bytes:
    """Lower case for A-Z, a blank for each ASCII character that is no letter, everything else as it is."""
    letters = {c: c for c in range(256) if c > 0x7F or chr(c).isalpha()}
    return bytes(letters.get(c, 0x20) for c in range(256)).lower()


TABLE = _byte_table()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, and one row without a term for each group seen."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            terms = [None, *(t.decode() for t in counts)]
            size = len(terms)
            columns = [pa.repeat(lang, size), pa.repeat(source, size), pa.array(terms, pa.string())]
            columns += [pa.array([0, *counts.values()], pa.int64()), pa.array([0, *(docs[t] for t in counts)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, batch.column("text"), strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            here: set[bytes] = set()
            data = text.as_py().translate(TABLE)
            at = 0
            while at < len(data):
                stop = BREAK.search(data, at + STEP_BYTES)
                end = stop.start() if stop else len(data)
                words = data[at:end].split()
                counts.update(words)
                here.update(words)
                at = end
            docs.update(here)
        if sum(len(c) for c, _ in held.values()) > HELD_TERMS:
            yield from flush()
    yield from flush()


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exactly; 0 where there are no terms."""
    over = (n.cast("decimal(19,0)") + F.lit(5)) * F.lit(1_000_000_000)
    under = total.cast("decimal(19,0)") + terms.cast("decimal(19,0)") * F.lit(5)
    return F.when(terms > 0, F.lit(1) + F.call_function("div", over, under)).otherwise(F.lit(0)).cast("long")


def _matrix(members: list[dict], nos: np.ndarray, terms: np.ndarray, shares: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Shares of a slice's groups for the terms present in the cell; a term a group lacks has the group's least share."""
    out = np.repeat(np.array([m["least"] for m in members], np.int64)[:, None], len(present), axis=1)
    place = {m["no"]: k for k, m in enumerate(members)}
    rows = np.array([place[no] for no in nos.tolist()], np.int64)
    out[rows, np.searchsorted(present, terms)] = shares
    return out


def _cell(key: tuple, table: pa.Table) -> pa.Table:
    """Differences of all pairs of groups of one cell, over the terms that one of its slices holds."""
    lang, low, high = key[0].as_py(), key[1].as_py(), key[2].as_py()
    blocks = {}
    for row in range(table.num_rows):
        arrays = []
        for name in ("nos", "terms", "shares"):
            value = table.column(name)[row]
            arrays.append(np.array(value.values, np.int64) if value.is_valid and len(value) else np.empty(0, np.int64))
        blocks[table.column("block")[row].as_py()] = (table.column("members")[row].as_py(), arrays)
    present = np.unique(np.concatenate([arrays[1] for _, arrays in blocks.values()]))
    own, other = blocks[low][0], blocks[high][0]
    own_shares = _matrix(own, *blocks[low][1], present)
    other_shares = own_shares if low == high else _matrix(other, *blocks[high][1], present)
    out: list[list] = [[], [], [], []]
    for k, group in enumerate(own):
        start = k + 1 if low == high else 0
        apart = np.abs(other_shares[start:] - own_shares[k]).sum(axis=1)
        for partner, value in zip(other[start:], apart.tolist(), strict=True):
            for column, item in zip(out, (group["source"], partner["source"], value, abs(group["least"] - partner["least"])), strict=True):
                column.append(item)
    size = len(out[0])
    columns = [pa.array([lang] * size, pa.string()), pa.array(out[0], pa.string()), pa.array(out[1], pa.string())]
    columns += [pa.array(out[2], pa.int64()), pa.array([len(present)] * size, pa.int64()), pa.array(out[3], pa.int64())]
    return pa.Table.from_arrays(columns, ["lang", "source", "item", "apart", "seen", "gap"])


def _pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for all pairs of groups of a language, both ways round."""
    block = F.floor(F.col("no") / GROUP_BLOCK).cast("int")
    term_blocks = F.greatest(F.ceil(F.col("n_terms") / TERM_BLOCK), F.lit(1)).cast("int")
    placed = entries.withColumn("block", block).withColumn("term_block", F.pmod(F.xxhash64("term_id"), term_blocks).cast("int"))
    # at most GROUP_BLOCK groups x the terms of a block
    held = F.collect_list(F.struct("no", "term_id", "share")).alias("e")
    slices = placed.groupBy("lang", "block", "term_block").agg(held)
    slices = slices.select("lang", "block", "term_block", F.col("e.no").alias("nos"), F.col("e.term_id").alias("terms"), F.col("e.share").alias("shares"))
    members = F.sort_array(F.collect_list(F.struct("no", "source", "least"))).alias("members")
    blocks = groups.withColumn("block", block).groupBy("lang", "block").agg(members, F.first(term_blocks).alias("deep"), F.first("n_groups").alias("n_groups"))
    grid = blocks.withColumn("term_block", F.explode(F.sequence(F.lit(0), F.col("deep") - 1)))
    wide = F.floor((F.col("n_groups") - 1) / GROUP_BLOCK).cast("int")
    sent = grid.join(slices, ["lang", "block", "term_block"], "left").withColumn("partner", F.explode(F.sequence(F.lit(0), wide)))
    sent = sent.withColumn("low", F.least("block", "partner")).withColumn("high", F.greatest("block", "partner"))
    cells = sent.select("lang", "low", "high", "term_block", "block", "members", "nos", "terms", "shares")
    apart = cells.groupBy("lang", "low", "high", "term_block").applyInArrow(_cell, PAIRS)
    summed = apart.groupBy("lang", "source", "item").agg(F.sum("apart").alias("apart"), F.sum("seen").alias("seen"), F.max("gap").alias("gap"))
    # terms that no slice of the pair holds: both groups have their least share there
    sizes = groups.select("lang", "n_terms").distinct()
    value = F.col("apart") + (F.col("n_terms") - F.col("seen")) * F.col("gap")
    valued = summed.join(sizes, "lang").select("lang", "source", "item", value.alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return valued.select("lang", F.explode(both).alias("way"), "value").select("lang", "way.source", "way.item", "value")


def source_divergence(
    docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far a group lies from the others, and by which terms from its language.

    Terms are runs of ASCII letters (in lower case) and of all characters beyond ASCII. Each language keeps the terms in
    at least ``min_docs`` of its rows. A group or language has for each kept term the share
    ``1 + floor(10^9 (n + 5) / (N + 5 V))``. Part ``pair`` sums the absolute differences of two groups' shares over all
    kept terms and has every other group of the language; part ``term`` has the ``top`` terms by which a group lies over
    its language. Ties go to the smaller item by its UTF-8 bytes. Null texts, languages and sources count as empty.
    Every row counts as a document, also where ids repeat; other columns of ``docs`` do not matter. A language with one
    group has no pairs. An empty table has no rows.
    """
    ship(docs.sparkSession)

    def filled(name: str, alias: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(alias)

    read = docs.select(filled(lang_col, "lang"), filled(source_col, "source"), filled(text_col, "text").cast("binary").alias("text"))
    counts = read.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stage(counts)
    terms = counts.where("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = stage(kept.select("lang", "term", "in_lang", F.monotonically_increasing_id().alias("term_id")))
    found = stage(terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("in_lang").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "n_terms", "lang_total"])
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumn("no", F.row_number().over(by_lang.orderBy("source")) - 1).withColumn("n_groups", F.count("*").over(by_lang))
    groups = stage(groups.withColumn("least", _share(F.lit(0), F.col("total"), F.col("n_terms"))))

    facts = groups.select("lang", "source", "no", "total", "n_terms", "lang_total")
    entries = found.join(facts, ["lang", "source"]).withColumn("share", _share(F.col("n"), F.col("total"), F.col("n_terms")))
    over = F.col("share") - _share(F.col("in_lang"), F.col("lang_total"), F.col("n_terms"))
    by_term = entries.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    first = by_term.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= top)
    pairs = _pairs(entries.select("lang", "no", "term_id", "share", "n_terms"), groups)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank).unionByName(first)
