"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale of their own; the length of what quantising loses bounds, for each
vector, how far its products can be off. A tile multiplies two groups of quantised vectors; only pairs whose product
plus bound reaches the threshold are computed again in double precision, inside the tile. What leaves a tile is one
count for each vector and the links that hold its vectors together, never its pairs.

Equal vectors are one class from the start, whatever the number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequill.llm.components import components
from pagequill.llm.staging import ship, stage

THRESHOLD = 0.9
GROUP = 4096
SLACK = 1e-5  # above the rounding of single-precision sums
PIECE = 1 << 16


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row of ``vectors``.

    Two rows are linked if the cosine of their vectors is ``threshold`` or more in double precision. Vectors that are
    null, empty, zero, or hold a null or a component that is not finite link with nothing, and neither do vectors of
    different length. Rows with the same id count as one node for ``component_id`` but each has its links counted; a
    null id counts as the smallest. Other columns are ignored.
    """
    ship(vectors.sparkSession)
    number = F.col("v").cast("array<double>")
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.col(vector_col).alias("v")).withColumn("v", number)
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0))))
    classes = stage(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("node", F.xxhash64("id", "v")))
    groups = max(1, -(-classes.count() // group))
    packed = classes.withColumn("g", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(groups)).cast("int"))
    packed = stage(packed.groupBy("g", F.size("v").alias("width")).applyInArrow(_pack_group, "g int, width int, data binary"))
    others = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("o")
    dealt = packed.select("*", others).select("g", "width", "data", F.least("g", "o").alias("x"), F.greatest("g", "o").alias("y"))
    tiles = dealt.groupBy("x", "y", "width").applyInArrow(lambda t: _tile(t, threshold), "node long, other long, links long")
    tiles = stage(tiles)
    counts = tiles.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(tiles.where("links is null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.join(counts, "node", "left").join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(F.min("id").alias("component"))
    known = named.join(heads, "root").select("v", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = rows.join(known, "v", "left")
    component = F.coalesce("component", "id")
    real = lambda c: F.when(c != -(2**63), c)
    return out.select(real(F.col("id")).alias("id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), real(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def _pack_group(table: pa.Table) -> pa.Table:
    """A group of vectors as one value: node, copies, unit vectors' int8 parts, scales, bounds and the vectors themselves."""
    n = table.num_rows
    whole = table.column("v").combine_chunks()
    vectors = whole.flatten().to_numpy().reshape(n, -1)
    node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    data = node.tobytes() + copies.tobytes() + vectors.tobytes()
    width = vectors.shape[1]
    g = table.column("g")[0].as_py()
    return pa.table({"g": pa.array([g], pa.int32()), "width": pa.array([width], pa.int32()), "data": pa.array([data], pa.binary())})


class Group:
    def __init__(self, data: bytes, width: int):
        n = len(data) // (16 + 8 * width)
        self.node = np.frombuffer(data, np.int64, n)
        self.copies = np.frombuffer(data, np.int64, n, 8 * n)
        raw = np.frombuffer(data, np.float64, n * width, 16 * n).reshape(n, width)
        raw = raw / np.abs(raw).max(1, keepdims=True)  # neither overflow nor underflow in the squares
        self.vectors = raw
        self.lengths = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        unit = raw / self.lengths[:, None]
        scale = 127.0 / np.abs(unit).max(1)
        self.int8 = np.rint(unit * scale[:, None]).astype(np.int8)
        self.step = 1.0 / scale
        back = self.int8 * self.step[:, None]
        self.size = np.sqrt(np.einsum("ij,ij->i", back, back))
        lost = unit - back
        self.lost = np.sqrt(np.einsum("ij,ij->i", lost, lost))


def _tile(table: pa.Table, threshold: float) -> pa.Table:
    """Links between two groups, or inside one: counts ``(node, null, links)`` and a forest ``(node, other, null)``."""
    x, y, width = (table.column(c)[0].as_py() for c in ("x", "y", "width"))
    held = {g: d for g, d in zip(table.column("g").to_pylist(), table.column("data").to_pylist(), strict=True)}
    if x not in held or y not in held:
        return _links([], [], [])
    a, b = Group(held[x], width), Group(held[y], width) if x != y else None
    b = b or a
    counts_a, counts_b = np.zeros(len(a.node), np.int64), np.zeros(len(b.node), np.int64)
    parent = np.arange(len(a.node) + len(b.node))
    shift = 0 if x == y else len(a.node)
    edges: list[tuple[int, int]] = []
    right = b.int8.astype(np.float32).T.copy()
    exact = width * 127 * 127 < 1 << 24  # then single precision holds the integer products
    for lo in range(0, len(a.node), 512):
        hi = min(lo + 512, len(a.node))
        left = a.int8[lo:hi].astype(np.float32)
        products = left @ right if exact else a.int8[lo:hi].astype(np.float64) @ right.astype(np.float64)
        products *= a.step[lo:hi, None].astype(products.dtype)
        products *= b.step[None].astype(products.dtype)
        # u.v - u'.v' <= |u'| lost(v) + lost(u) |v'| + lost(u) lost(v), here first with the largest of each
        most = a.size[lo:hi].max() * b.lost.max() + a.lost[lo:hi].max() * (b.size.max() + b.lost.max())
        i, j = np.nonzero(products >= threshold - most - SLACK)
        own = products[i, j]
        i = i + lo
        keep = own + a.size[i] * b.lost[j] + a.lost[i] * (b.size[j] + b.lost[j]) >= threshold - SLACK
        if x == y:
            keep &= i < j
        i, j = i[keep], j[keep]
        for at in range(0, len(i), PIECE):
            p, q = i[at : at + PIECE], j[at : at + PIECE]
            cosine = np.einsum("ij,ij->i", a.vectors[p], b.vectors[q]) / (a.lengths[p] * b.lengths[q])
            p, q = p[cosine >= threshold], q[cosine >= threshold]
            counts_a += np.bincount(p, b.copies[q], len(a.node)).astype(np.int64)
            (counts_a if x == y else counts_b)[:] += np.bincount(q, a.copies[p], len(b.node)).astype(np.int64)
            edges += _forest(parent, p, q + shift)
    nodes = np.concatenate([a.node, b.node]) if x != y else a.node
    counts = np.concatenate([counts_a, counts_b]) if x != y else counts_a
    some = np.flatnonzero(counts)
    n = len(some)
    first = np.concatenate([nodes[some], nodes[[e[0] for e in edges]] if edges else np.empty(0, np.int64)])
    other = nodes[[e[1] for e in edges]] if edges else np.empty(0, np.int64)
    return _links(first.tolist(), [None] * n + other.tolist(), counts[some].tolist() + [None] * len(edges))


def _links(node: list, other: list, links: list) -> pa.Table:
    return pa.table({"node": pa.array(node, pa.int64()), "other": pa.array(other, pa.int64()), "links": pa.array(links, pa.int64())})


def _forest(parent: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
    """The links that join parts not yet joined."""
    out = []
    joined = parent.tolist() if len(p) else []
    for u, v in zip(p.tolist(), q.tolist(), strict=True):
        a, b = u, v
        while joined[a] != a:
            joined[a] = joined[joined[a]]
            a = joined[a]
        while joined[b] != b:
            joined[b] = joined[joined[b]]
            b = joined[b]
        if a != b:
            joined[max(a, b)] = min(a, b)
            out.append((u, v))
    if out:
        parent[:] = joined
    return out
