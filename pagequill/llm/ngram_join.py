"""Similarity join of texts on word n-grams by chosen paths.

A text is the set of its shingles of ``SIZE`` words (all its words, if fewer). Sets are split over and over: each set
follows a few of its own shingles, chosen by a hash, so that similar sets choose common ones. A bucket of at most
``LIMIT`` sets is a leaf; a larger one is split again, up to ``LEVELS`` times, unless a shingle holds nearly all of it
together: such dense buckets are leaves as well. Leaves are compared set by set, in tiles of bounded size: first by small
sketches, then, for sets that may have a partner, on the whole sets. For the second step, sets that sketches hold together
in groups of at most ``LIMIT`` meet once, as a group, and not in each of their leaves; larger groups meet by their leaves.
A tile counts a link only in the first leaf that its two sets share, and what leaves it is one count for each set and the
links that hold its sets together, never its pairs. There are as many runs with new hashes as a link needs to be found with probability ``TARGET`` in the worst case:
at the threshold, with every bucket that its sets share split ``LEVELS`` - 1 times. No other links bear on it.

Equal sets are one class from the start, whatever the number of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequill.llm.blocks import NO_ID, ROW_BITS, each_block, open_block, other_columns, rows_of, text_blocks
from pagequill.llm.components import components
from pagequill.llm.packing import deltas, pack, undelta, unpack
from pagequill.llm.packing import runs as runs_of
from pagequill.llm.staging import discard, stage
from pagequill.llm.words import Words, mix, shingles, texts

SIZE = 5
THRESHOLD = 0.8
LIMIT = 1024
PROBED = 16
DENSE = 0.8  # of a bucket's sets under one shingle: splitting does not part them
CHOSEN = (4.0, 3.0, 3.0)  # shingles that two sets at the threshold are expected to choose in common, by level
LEVELS = len(CHOSEN)
TARGET = 0.9999
SKETCH = 48
SKETCH_LEAST = 0.5  # of the sketch: five standard deviations below what the threshold gives
DRAWS = 1 << 30  # steps of a draw by parent
TILE = 1024
TILE_BYTES = 32 << 20
COLUMNS = 4096
PAIRS = 1 << 20  # of a task that wait to be joined
DROPPED = np.uint64(16)  # bits of a shingle hash that a set is sent without; 48 tell shingles of two sets apart


def missed(runs: int, depth: int) -> float:
    """At most the probability that ``runs`` miss a link at the threshold all of whose common buckets split ``depth`` times.

    Deeper levels draw from the sketches, for each parent anew. Of a sketch two sets have K members in common.
    """
    out = 0.0
    for k in range(SKETCH + 1):
        survives = 1.0
        for level in range(depth, 0, -1):
            survives = 1 - (1 - CHOSEN[level] / (THRESHOLD * SKETCH) * survives) ** k
        out += math.comb(SKETCH, k) * THRESHOLD**k * (1 - THRESHOLD) ** (SKETCH - k) * math.exp(-CHOSEN[0] * runs * survives)
    return out


RUNS = next(r for r in range(1, 100) if max(missed(r, d) for d in range(LEVELS)) <= 1 - TARGET)

DESCRIBED = "ref long, id long, n int, sig_a long, sig_b long, sketch array<int>, chosen array<array<long>>"


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, class_id, component_id, n_links, kept)`` for each row of ``docs``.

    ``class_id`` is the smallest id with the same shingle set, ``component_id`` the smallest id reachable over links of
    Jaccard similarity ``THRESHOLD`` or more, ``n_links`` the number of other rows linked directly, copies included.
    One row of each component has ``kept``. Rows without words link with nothing, not even with each other. Rows with
    the same id are separate rows; a null id counts as the smallest. Null texts have no words. Other columns are ignored.
    """
    found = _grouped(text_blocks(docs, id_col, text_col))
    return found.drop("ref")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`similar_documents` keeps, with all their columns."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    blocks = text_blocks(docs, id_col, text_col, others)
    gone = _grouped(blocks).where("not kept").select("ref", F.shiftright("ref", ROW_BITS).alias("block"))
    schema = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col), *others).schema
    kept = rows_of(blocks, gone, lambda left, right: _left_over(left, right, schema.names), schema)
    return kept.select(*docs.columns)


def _left_over(left: pa.Table, right: pa.Table, names: list[str]) -> pa.Table:
    if not left.num_rows:
        return pa.table({names[0]: pa.array([], pa.int64()), names[1]: pa.array([], pa.string())})
    ids, data = open_block(*(left.column(c)[0].as_py() for c in ("ids", "body")))
    keep = np.ones(len(ids), bool)
    keep[right.column("ref").to_numpy() & ((1 << ROW_BITS) - 1)] = False
    others = other_columns(left.column("others")[0].as_py()) if len(names) > 2 else []
    columns = [pa.array(ids, pa.int64(), mask=ids == NO_ID), data.cast(pa.large_string()).cast(pa.string()), *others]
    return pa.table(columns, names=names).filter(pa.array(keep))


def _grouped(blocks: DataFrame) -> DataFrame:
    described = stage(blocks.mapInArrow(lambda b: _describe(b), DESCRIBED))
    first = F.min(F.struct("id", "ref", "n", "sketch", "chosen")).alias("c")
    classes = described.where("n > 0").groupBy("sig_a", "sig_b").agg(first, F.count("*").alias("copies"))
    classes = stage(classes.select("sig_a", "sig_b", "copies", "c.id", "c.ref", "c.n", "c.sketch", "c.chosen"))
    found = linked(blocks, classes)  # staged
    names = classes.select("ref", "id", "copies")
    joined = found.where("links is not null").groupBy(F.col("a").alias("ref")).agg(F.sum("links").alias("linked"))
    roots = components(found.where("a is not null and links is null").select("a", "b")).select(F.col("node").alias("ref"), "root")
    named = names.join(roots, "ref", "left").join(joined, "ref", "left").withColumn("root", F.coalesce("root", "ref"))
    heads = named.groupBy("root").agg(F.min(F.struct("id", "ref")).alias("head"))
    known = classes.select("ref", "sig_a", "sig_b").join(named.join(heads, "root"), "ref").withColumnRenamed("id", "class_id").withColumnRenamed("ref", "class_ref")
    out = described.select("ref", "id", "sig_a", "sig_b").join(known, ["sig_a", "sig_b"], "left")
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(
        "ref",
        real(F.col("id")).alias("id"),
        real(F.coalesce("class_id", "id")).alias("class_id"),
        real(F.coalesce("head.id", "id")).alias("component_id"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("head.ref") == F.col("ref"), F.lit(True)).alias("kept"),
    )


def linked(blocks: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, null, links)``, the links of each class to other rows; ``(a, b, null)``, links that join all that are joined."""
    near = _plausible(classes, _leaves(classes))
    found = _verify(blocks, classes, near)
    discard(near)
    return found


def _chosen(hashes: np.ndarray, sizes: np.ndarray, seed: int, common: float) -> np.ndarray:
    """Of each set about common / THRESHOLD shingles; equal shingles of sets of equal size are chosen together."""
    odd = mix(np.array([seed * 2 + 1], np.uint64))[0] | np.uint64(1)
    share = np.minimum(common / (THRESHOLD * sizes), 1.0)
    limit = np.where(share >= 1, np.uint64(2**64 - 1), (share * 2.0**63).astype(np.uint64) * np.uint64(2))
    return hashes * odd <= limit


def _sets(part, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text, sorted, and their rows."""
    hashes, rows = shingles(words, SIZE)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids, body in each_block(batch):
            id_of, data = open_block(ids, body)
            for part in texts(data):
                hashes, rows = _sets(part, Words(part))
                n = part.hi - part.lo
                sizes = np.bincount(rows, minlength=n)
                starts = np.concatenate(([0], np.cumsum(sizes)))
                full = np.flatnonzero(sizes)
                sig = np.zeros((2, n), np.int64)
                for k in (0, 1):
                    if len(full):
                        sig[k, full] = np.add.reduceat(mix(hashes ^ np.uint64(0x5DEECE66D + k)), starts[full]).view(np.int64)
                low = (np.arange(len(hashes)) - starts[rows]) < SKETCH
                parts, counts = [], []
                for run in range(RUNS):
                    pick = _chosen(hashes, sizes[rows], 1 + run * LEVELS, CHOSEN[0])
                    parts.append((rows[pick], hashes[pick]))
                    counts.append(np.bincount(rows[pick], minlength=n))
                where = np.concatenate([r * len(parts) + k for k, (r, _) in enumerate(parts)])
                order = np.argsort(where, kind="stable")
                inner = _lists(np.concatenate([h for _, h in parts])[order].view(np.int64), np.stack(counts, 1).reshape(-1), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((block << ROW_BITS) + part.lo + np.arange(n), pa.int64()),
                        pa.array(id_of[part.lo : part.hi], pa.int64()),
                        pa.array(sizes, pa.int32()),
                        pa.array(sig[0], pa.int64(), mask=sizes == 0),
                        pa.array(sig[1], pa.int64(), mask=sizes == 0),
                        _lists((hashes[low] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.minimum(sizes, SKETCH), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(parts), pa.int32()), inner),
                    ],
                    ["ref", "id", "n", "sig_a", "sig_b", "sketch", "chosen"],
                )


def _drawn(level: int) -> Column:
    """Of each set the members of its sketch that it follows from its bucket ``parent``; every parent draws by itself."""
    share = F.least(F.lit(CHOSEN[level] / THRESHOLD) / F.least("n", F.lit(SKETCH)), F.lit(1.0)) * DRAWS
    return F.explode(F.filter("sketch", lambda t: F.pmod(F.xxhash64(t, "parent", F.lit(7)), F.lit(DRAWS)) < share)).alias("token")


def _leaves(classes: DataFrame) -> DataFrame:
    """``(leaf, held, ref)``: the buckets to compare, with their size, staged.

    Of buckets with the same members one is kept.
    """
    rows = classes.select("ref", F.posexplode("chosen").alias("at", "tokens")).select("ref", "at", F.explode("tokens").alias("token"))
    rows = rows.select("ref", F.xxhash64("at", "token").alias("leaf"))
    out, done = None, []
    for level in range(LEVELS):
        sizes = rows.groupBy("leaf").agg(F.count("*").alias("held")).where("held > 1")
        rows = stage(rows.join(sizes, "leaf"))
        large = stage(rows.where(F.col("held") > LIMIT))  # mostly a small table, whose known size spares the sets a shuffle
        done += [rows, large]
        last = level + 1 == LEVELS or large.isEmpty()
        if last:
            leaves = rows
        else:
            parents = large.withColumnRenamed("leaf", "parent")
            dense = stage(_dense(parents, classes, level + 1))
            done.append(dense)
            dense_rows = large.join(dense, large["leaf"] == dense["parent"], "left_semi")
            leaves = rows.where(F.col("held") <= LIMIT).union(dense_rows)
            # only what is split draws, a hot bucket that no split parts does not
            sparse = parents.join(dense, "parent", "left_anti").join(classes.select("ref", "n", "sketch"), "ref")
            rows = sparse.select("ref", "parent", _drawn(level + 1)).select("ref", F.xxhash64("parent", "token").alias("leaf"))
        out = leaves if out is None else out.union(leaves)
        if last:
            break
    merged = stage(_merged(out.select("leaf", "ref")))
    discard(*done)
    return merged


def _dense(parents: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    """The buckets that hold ``DENSE`` or more of their sets under one drawn shingle, ``parent``.

    That share is estimated from the sets of one in ``PROBED`` hashes, 64 or more of a bucket. It only decides how a
    bucket is worked on: as a dense one, whole and in tiles, or as one that is split. Both find the links.
    """
    probed = parents.where(F.pmod(F.xxhash64("ref", "parent", F.lit(13)), F.lit(PROBED)) == 0)
    held = probed.groupBy("parent").agg(F.count("*").alias("probes"))
    draws = probed.join(classes.select("ref", "n", "sketch"), "ref").select("parent", _drawn(level))
    parts = draws.groupBy("parent", "token").agg(F.count("*").alias("part"))
    most = parts.groupBy("parent").agg(F.max("part").alias("most")).join(held, "parent")
    return most.where(F.col("most") >= DENSE * F.col("probes")).select("parent")


def _merged(rows: DataFrame) -> DataFrame:
    """Of leaves with the same members one; those of one member go."""
    both = F.sum(F.xxhash64("ref", F.lit(1)).cast("decimal(20,0)")).alias("x"), F.bit_xor(F.xxhash64("ref", F.lit(2))).alias("y")
    members = rows.groupBy("leaf").agg(F.count("*").alias("held"), *both).where("held > 1")
    kept = members.groupBy("held", "x", "y").agg(F.min("leaf").alias("leaf"))
    return rows.select("leaf", "ref").join(kept.select("leaf", "held"), "leaf")


def _tiled(rows: DataFrame) -> DataFrame:
    """Rows dealt to tiles: a leaf of more than TILE sets meets itself in pairs of parts. ``side`` 2 is for a part and itself."""
    parts = F.ceil(F.col("held") / TILE).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("ref", F.lit(3)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)
    return dealt.withColumn("side", side).withColumn("tile", F.xxhash64("leaf", F.least("part", "other"), F.greatest("part", "other"))).drop("parts", "part", "other")


def _groups(rows: DataFrame, total: int) -> DataFrame:
    """Tiles in groups of about TILE_BYTES, so that a task holds few and many small tiles share one call."""
    groups = max(12, math.ceil(total / TILE_BYTES))
    return rows.withColumn("g", F.pmod(F.xxhash64("tile", F.lit(5)), F.lit(groups)).cast("int")).groupBy("g")


def _plausible(classes: DataFrame, leaves: DataFrame) -> DataFrame:
    """The rows ``(leaf, held, ref)`` of sets that, by their sketches, may be linked with another set of the leaf, staged.

    Sets held together by such pairs in all are one leaf, so that each is sent once, unless they are over ``LIMIT``.
    """
    rows = leaves.join(classes.select("ref", "n", "sketch"), "ref")
    tiles = _tiled(rows)
    near = _groups(tiles, tiles.count() * (4 * SKETCH + 40)).applyInArrow(_sketched, "leaf long, ref long, head long")
    found = stage(near)
    discard(leaves)
    roots = stage(components(found.select(F.col("ref").alias("a"), F.col("head").alias("b"))))
    sizes = roots.groupBy("root").agg(F.count("*").alias("held"))
    small = roots.join(sizes.where(F.col("held") <= LIMIT), "root").select(F.xxhash64("root", F.lit(11)).alias("leaf"), F.col("node").alias("ref"), "held")
    large = stage(roots.join(sizes.where(F.col("held") > LIMIT), "root").select(F.col("node").alias("ref")))
    if large.isEmpty():
        out = stage(small)
    else:
        out = stage(small.unionByName(_merged(found.join(large, "ref", "left_semi").select("leaf", "ref").distinct())))
    discard(found, roots, large)
    return out


def _verify(blocks: DataFrame, classes: DataFrame, near: DataFrame) -> DataFrame:
    """Counts and joining links as :func:`linked` returns them, staged."""
    lists = near.groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("leaf", "held"))).alias("met"))
    wanted = lists.join(classes.select("ref", "copies", "n"), "ref").withColumn("block", F.shiftright("ref", ROW_BITS))
    wanted = stage(wanted.select("block", "ref", "copies", "n", F.col("met.leaf").alias("leaves"), F.col("met.held").alias("sizes")))
    tiles = F.aggregate("sizes", F.lit(0).cast("long"), lambda sent, held: sent + F.ceil(held / TILE))
    size = wanted.agg(F.sum((F.lit(100) + 8 * F.col("n")) * tiles)).first()[0] or 0
    sets = rows_of(blocks, wanted.drop("n"), _fetch, "ref long, copies long, leaves array<long>, sizes array<long>, body binary", ("ids", "body"))
    met = sets.select("ref", "copies", "leaves", "body", F.explode(F.arrays_zip("leaves", "sizes")).alias("met"))
    rows = met.select("ref", "copies", "leaves", "body", F.col("met.leaves").alias("leaf"), F.col("met.sizes").alias("held"))
    found = stage(_groups(_tiled(rows), size).applyInArrow(_compare, "a long, b long, links long"))
    discard(wanted)
    return found


def _fetch(left: pa.Table, right: pa.Table) -> pa.Table:
    """The whole sets of the rows that are wanted of a block."""
    body: list[bytes] = [b""] * right.num_rows
    if left.num_rows and right.num_rows:
        _, data = open_block(*(left.column(c)[0].as_py() for c in ("ids", "body")))
        at = right.column("ref").to_numpy() & ((1 << ROW_BITS) - 1)
        seen = 0
        for part in texts(data.take(pa.array(at))):
            hashes, rows = _sets(part, Words(part))
            for row, lo, hi in zip(rows[(r := runs_of(rows))[0]].tolist(), *r, strict=True):
                body[seen + row] = pack(deltas(hashes[lo:hi] >> DROPPED))  # sorted, so small steps
            seen += part.hi - part.lo
    lists = {c: right.column(c).cast(pa.list_(pa.int64())) for c in ("leaves", "sizes")}  # Spark declares their items never null
    return pa.table({"ref": right.column("ref"), "copies": right.column("copies"), **lists, "body": pa.array(body, pa.binary())})


def _by_tile(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The row numbers of each tile: those of its one part and of its other; the same if a part meets itself."""
    tile, side = table.column("tile").to_numpy(), table.column("side").to_numpy()
    order = np.argsort(tile, kind="stable")
    for lo, hi in zip(*runs_of(tile[order]), strict=True):
        own = order[lo:hi]
        if side[own[0]] == 2:
            yield own, own
        else:
            yield own[side[own] == 0], own[side[own] == 1]


def _shared(a: list[np.ndarray], b: list[np.ndarray], same: bool) -> np.ndarray:
    """How many members every set of ``a`` has in common with every set of ``b``."""
    if len(a) == 2 and same:
        n = _common(a[0], a[1])
        return np.array([[len(a[0]), n], [n, len(a[1])]])
    out = np.zeros((len(a), len(b)), np.float32)
    values = np.concatenate([*a, *([] if same else b)])
    rows = np.repeat(np.arange(len(a) + (0 if same else len(b))), [len(s) for s in (a if same else [*a, *b])])
    order = np.argsort(values, kind="stable")
    lo, hi = runs_of(values[order])
    many = hi - lo > 1
    column = np.repeat(np.cumsum(many) - 1, hi - lo)
    keep = np.repeat(many, hi - lo)
    column, rows = column[keep], rows[order][keep]
    for first in range(0, int(many.sum()), COLUMNS):
        i, j = np.searchsorted(column, [first, first + COLUMNS])
        held = np.zeros((len(a) + (0 if same else len(b)), min(COLUMNS, int(many.sum()) - first)), np.float32)
        held[rows[i:j], column[i:j] - first] = 1
        out += held[: len(a)] @ (held if same else held[len(a) :]).T
    return np.rint(out).astype(np.int64)


def _sketched(table: pa.Table) -> pa.Table:
    sketch = table.column("sketch").combine_chunks()
    bounds, flat = sketch.offsets.to_numpy(), sketch.values.to_numpy().view(np.uint32)  # sorted as such
    n, ref = table.column("n").to_numpy(), table.column("ref").to_numpy()
    keep = np.zeros(table.num_rows, bool)
    head = np.arange(table.num_rows)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for a, b in _by_tile(table):
        if not len(a) or not len(b):
            continue
        one, two = ([flat[bounds[k] : bounds[k + 1]] for k in side] for side in (a, b))
        least = SKETCH_LEAST * np.minimum(np.minimum(n[a][:, None], n[b][None]), SKETCH)
        near = (_shared(one, two, a is b) >= least) & (n[a][:, None] >= THRESHOLD * n[b][None]) & (n[b][None] >= THRESHOLD * n[a][:, None])
        if a is b:
            np.fill_diagonal(near, False)
        keep[a[near.any(1)]] = True
        keep[b[near.any(0)]] = True
        i, j = np.nonzero(np.triu(near) if a is b else near)
        pairs.append((a[i], b[j]))
        waiting += len(i)
        if waiting > PAIRS:
            head, pairs, waiting = _heads(head, pairs), [], 0
    head = _heads(head, pairs)
    return table.select(["leaf", "ref"]).append_column("head", pa.array(ref[head])).filter(pa.array(keep))


def _heads(head: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of each place the smallest one that it is joined to, by ``head`` so far and by ``pairs``."""
    if not pairs:
        return head
    i, j = (head[np.concatenate(side)] for side in zip(*pairs, strict=True))
    while len(i := i[(apart := i != j)]):
        j = j[apart]
        low = np.arange(len(head))
        np.minimum.at(low, np.maximum(i, j), np.minimum(i, j))
        while (low[low] != low).any():
            low = low[low]
        head, i, j = low[head], low[i], low[j]
    return head


def _compare(table: pa.Table) -> pa.Table:
    bodies = table.column("body").to_pylist()
    ref, copies, leaf = (table.column(c).to_numpy() for c in ("ref", "copies", "leaf"))
    leaves = table.column("leaves").combine_chunks()
    bounds, flat = leaves.offsets.to_numpy(), leaves.values.to_numpy()
    counts: dict[int, int] = {}
    edges: list[tuple[int, int]] = []
    for a, b in _by_tile(table):
        if not len(a) or not len(b) or (a is b and len(a) < 2):
            continue
        one, two = ([undelta(unpack(bodies[k])[0]) for k in side] for side in (a, b))
        both = _shared(one, two, a is b)
        sizes = [np.array([len(s) for s in side]) for side in (one, two)]
        links = both >= THRESHOLD * (sizes[0][:, None] + sizes[1][None] - both)
        if a is b:
            links &= np.arange(len(a))[:, None] < np.arange(len(b))[None]
        if not links.any():
            continue
        own = leaf[a[0]]
        paths = [[flat[bounds[k] : bounds[k + 1]] for k in side] for side in (a, b)]
        earlier = _shared([p[p < own] for p in paths[0]], [p[p < own] for p in paths[1]], a is b) > 0
        links &= ~earlier
        i, j = np.nonzero(links)
        for mine, theirs, many in ((a, b, links), (b, a, links.T)):
            for k, n in zip(mine.tolist(), (many @ copies[theirs]).tolist(), strict=True):
                if n:
                    counts[int(ref[k])] = counts.get(int(ref[k]), 0) + n
        edges += _joining(ref[a[i]].tolist(), ref[b[j]].tolist())
    rows = [(k, None, n) for k, n in counts.items()] + [(x, y, None) for x, y in edges]
    return pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(("a", "b", "links"))})


def _joining(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Of the links those that join parts not yet joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for x, y in zip(a, b, strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _common(s: np.ndarray, t: np.ndarray) -> int:
    """Members in common of two sorted sets."""
    if not len(s) or not len(t):
        return 0
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    return int((t[at] == s).sum())
