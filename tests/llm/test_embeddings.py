from __future__ import annotations

import random

import numpy as np
import pytest

from pagequill.llm.embeddings import near_vectors


def rows():
    rng = random.Random(3)
    out = []
    for k in range(12):
        centre = [rng.gauss(0, 1) for _ in range(16)]
        for j in range(6):
            out.append((10 * k + j, [c + rng.gauss(0, 0.1 * (j + 1)) for c in centre]))
    out += [(500, out[0][1]), (501, out[0][1]), (502, [0.0] * 16), (503, None), (504, []), (505, [float("nan")] * 16), (506, [None] * 16), (507, [1.0] * 3), (508, [2.0] * 3)]
    out += [(509, [float("inf")] + [0.0] * 15), (510, [1e-30 * x for x in out[1][1]]), (511, [1e200, 0.0] + [0.0] * 14), (512, [1e200, -0.0] + [0.0] * 14), (-4, out[7][1])]
    return out


def brute(table):
    sound = [(i, np.array(v, float)) for i, v in table if v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i, _ in table}
    for i, a in sound:
        for j, b in sound:
            if i != j and len(a) == len(b):
                a1, b1 = a / np.abs(a).max(), b / np.abs(b).max()
                if a1 @ b1 / np.sqrt((a1 @ a1) * (b1 @ b1)) >= 0.9:
                    links[i].add(j)
    out = {}
    for i in links:
        seen, todo = set(), [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += links[k]
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("group", [4096, 7])
def test_links_equal_brute_force(spark, group):
    table = rows()
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in table], "vec_id long, embedding array<double>, label int, links string")
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(frame, group=group).collect()}
    assert got == brute(table)


def test_repeated_and_null_ids(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.1]), (4, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in near_vectors(frame).collect()), key=str)
    assert got == sorted([(1, 2, None, False), (1, 2, None, False), (None, 2, None, True), (4, 0, 4, True)], key=str)
    assert near_vectors(frame.limit(0)).collect() == []
