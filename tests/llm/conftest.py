from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block int, ref string, id string, n int, score string, llm_lower int"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(("ab", "cede", "fig", "horn", "ijk", "lemon", "no", "é", "quart", "Süß")) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, repeats, short, empty and null texts, a long one, and null and repeated ids."""
    rng = random.Random(5)
    base = prose(rng, 120)
    passage = prose(rng, 30)
    words = base.split()
    near = [" ".join(words[:k] + ["x"] + words[k + 1 :]) for k in (3, 50, 90)]
    rows: list[tuple[int | None, str | None]] = [(k, f"{prose(rng, 40)}\n{passage}\t{prose(rng, 15)}") for k in range(10, 22)]
    rows += [(30, base), (31, base), (32, base), *((33 + k, t) for k, t in enumerate(near)), (7, f"{base}  {prose(rng, 4)}")]
    rows += [(40, ""), (41, None), (42, " \n\t "), (43, "one two"), (44, "one two"), (45, "one"), (46, prose(rng, 8000)), (47, "z " * 70), (48, f"{passage} {passage}")]
    rows += [(50, prose(rng, 30)), (50, prose(rng, 30)), (30, base), (None, base), (None, None), (-3, passage)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts in several partitions, with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 9, "r", "i", 3, "s", 2) for i, t in texts], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
