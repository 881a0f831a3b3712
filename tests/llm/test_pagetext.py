from __future__ import annotations

import random
from functools import cache

import pytest

from pagequill.llm import pagetext
from pagequill.llm.pagetext import MINE, extract_text, main_text, page_lines, shared_lines

CASES = {
    "<body><nav>menu<p>x</nav><form><article><h1>T</h1>t <b>u</b>v<br>w<div class='comments'>c</div></article></form>z": "T\n\nt uv w",
    "<nav>left open <article><p>kept&amp;&lt;&eacute;&#8364;</article>": "kept&<é€",
    "<article><script>var a='</p>'</script><style>x</style><p>a\n  b</p><!-- <p>no --><p> </p></article><p>after": "a b",
    "<main><aside>s</aside><p>one<p>two<ul><li>three<li>four</ul></main>": "one\n\ntwo\n\nthree\n\nfour",
    "<p>plain</p><footer>foot</footer><div id='cookie-banner'>ok?</div>": "plain",
    "<a title='x > y'>link</a> text <": "link text <",
    "": "",
    "<script>never closed": "",
}


@pytest.mark.parametrize("page", CASES)
def test_regions_and_blocks(page):
    assert main_text(page_lines(page), None) == CASES[page]


def test_shared_lines_are_a_longest_common_subsequence():
    assert shared_lines(list("abcbdab"), list("bdcaba")) and len(shared_lines(list("abcbdab"), list("bdcaba"))) == 4
    assert shared_lines(["x"] * 500, ["x"] * 400 + ["y"]) == set(range(400))
    assert shared_lines([], ["a"]) == set()


def test_lines_repeated_often_are_aligned_in_full():
    menu = ["x"] * 40
    assert shared_lines(["m", *menu], [*menu, "m", *menu]) == set(range(41))  # by their numbers the x meet those before m
    assert shared_lines([*menu, "m"], [*menu, "m", *menu]) == set(range(41))
    assert len(shared_lines(["x", "y"] * 3000, ["y", "x", "x"] * 3000)) == 6000 - 1


def test_pairs_and_bits_give_a_longest_subsequence(monkeypatch):
    rng = random.Random(5)
    for _ in range(400):
        a, b = ([rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 60))] for _ in "ab")
        @cache
        def longest(i, j):
            return 0 if i < 0 or j < 0 else longest(i - 1, j - 1) + 1 if a[i] == b[j] else max(longest(i - 1, j), longest(i, j - 1))  # noqa: B023

        for matches in (10**9, -1):  # all by pairs, all by bits
            monkeypatch.setattr(pagetext, "MATCHES", matches)
            found = sorted(shared_lines(a, b))
            rest = iter(b)
            assert all(a[i] in rest for i in found) and len(found) == longest(len(a) - 1, len(b) - 1)


def test_a_menu_of_many_equal_lines_is_no_text(spark):
    menu, own = "<div>x</div>" * 40, "<p>Own {}</p>"
    pages = [(0, "https://h.example/0", menu + "<div>Top</div>" + menu + own.format(0)), (1, "https://h.example/1", "<div>Top</div>" + menu + own.format(1))]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == "Own 1"


def test_pages_are_compared_with_their_neighbours(spark):
    page = "<div>Top line</div><p>Own {}</p><div>Bottom line</div>"
    rows = [(k, f"https://h.example/a/{k}", page.format(k)) for k in range(6)]
    rows += [(50, "https://other.example/", page.format("alone")), (51, None, None), (52, "no url", ""), (53, "https://h.example/a/9", "<article>Top line</article>")]
    rows += [(60, "https://c.example/1", "<p>copy"), (60, "https://c.example/1", "<p>copy")]
    frame = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = sorted(((r["page_id"], r["text"]) for r in extract_text(frame).collect()), key=str)
    expected = [(k, f"Own {k}") for k in range(6)] + [(50, "Top line\n\nOwn alone\n\nBottom line"), (51, ""), (52, ""), (53, "Top line"), (60, "copy"), (60, "copy")]
    assert got == sorted(expected, key=str)
    assert extract_text(frame.limit(0)).collect() == []


def test_hard_markup_takes_linear_time():
    for page in ("<a " * 50_000, "<p>" * 50_000, '<a x="' * 20_000, "</p>" * 50_000, "<!--" * 50_000, "<div>" * 5_000 + "deep"):
        page_lines(page)
    assert page_lines("<article>" + "<p>w" * 10_000)[-1] == (MINE, "w")
