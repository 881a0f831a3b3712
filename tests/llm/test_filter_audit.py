from __future__ import annotations

from collections import Counter, defaultdict
from itertools import permutations

from pagequill.llm.filter_audit import audit_filters, mask_cells

LABELS = "doc_id long, quality int, toxic int, part string"


def fails(text: str) -> str:
    words = [w for w in text.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    found = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
    return found + "C" * (100 * capitals > 10 * len(text)) + "D" * any(c in "#$%&*|" for c in text)


def expected(rows, labels):
    """Brute force over (id, text, part) and (id, quality, toxic): walk every order, one row at a time."""
    seen = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            seen[t or ""].append(i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, part in rows:
        copy = i is not None and min(seen[t or ""]) < i
        parts[part or ""].append((fails(t or "") + "E" * copy, i in good, i in toxic))
    out, total = {}, Counter()
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            left = list(members)
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if letter in m[0]]
                left = [m for m in left if letter not in m[0]]
                redundant = sum(letter in m[0] for m in members) - len(gone)
                alone = sum(m[0] == letter for m in members)
                out[part, "".join(order), step] = (len(left), len(gone), redundant, alone, sum(m[1] for m in gone), sum(m[2] for m in gone))
                total[part, letter] += len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def answer(frame):
    rows = frame.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_equals_brute_force(spark, texts):
    langs = ["en", None, "", "de"]
    rows = [(i, t, langs[k % 4]) for k, (i, t) in enumerate(texts)]
    rows += [(60, "A#", "en"), (60, "A#", "en"), (61, "A#", "de"), (None, "A#", "de"), (62, "Ab cd ef", "x"), (63, "É" * 9 + "A", "x"), (64, "word\x0b" * 100, "x")]
    rows += [(65, " ".join(f"w{k}" for k in range(100)), "x"), (66, " ".join(f"w{k % 80}" for k in range(100)), "x"), (67, " ".join(f"w{k % 79}" for k in range(100)), "x")]
    labels = [(i, k % 2, (k + 1) % 2) for k, (i, _, _) in enumerate(rows)] + [(60, None, 1), (60, 1, None), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, part int, mask int, n int").repartition(3)
    marks = spark.createDataFrame([(*r, "p") for r in labels], LABELS)
    assert answer(audit_filters(frame, marks)) == expected(rows, labels)


def test_cells_hold_every_row(spark, docs, texts):
    cells = mask_cells(docs, spark.createDataFrame([], LABELS)).collect()
    assert sum(c["n"] for c in cells) == len(texts) and all(c["good"] == c["toxic"] == 0 for c in cells)
    assert len({(c["part"], c["mask"]) for c in cells}) == len(cells) <= 32


def test_empty_table(spark, none):
    assert audit_filters(none, spark.createDataFrame([], LABELS)).collect() == []
