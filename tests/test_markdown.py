"""Markdown steps on small tables of texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pagequill.functions import markdown as md
from pagequill.operators import notes

STEPS = [
    (md.strip_invisible, "a¶b​c", "abc"),
    (md.strikethrough, "<s>a</s> <DEL x>b\nc</del>", "~~a~~ ~~b\nc~~"),
    (md.strikethrough, "<span>x</s>", "~~x~~"),
    (md.strikethrough, "<strong>no", "<strong>no"),
    (md.code_params, "f(*a*) g(*a*,  *b*) $1", "f(`a`) g(`a`, `b`) $1"),
    (md.highlights, "<mark>a\nb</mark> <marker>c</mark>", "==a\nb== ==c=="),
    (md.hidden_comments, "<!-- a\nb -->c", "%% a\nb %%c"),
    (md.math, '<math display="block">a$1</math> <span class="math"><math>u+v</math></span>', "$$a$1$$ $$u+v$$"),
    (md.mermaid, 'x <pre class="mermaid"> A--&gt;B </pre> y', "x ```mermaid\nA-->B\n``` y"),
    (md.mermaid, '<pre id="a" class="mermaid">A</pre>', '<pre id="a" class="mermaid">A</pre>'),
    (md.fence_shell, "git y\n\ntext\n```\ncd q\n```\n  cd z\n", "```bash\ngit y\n```\n\ntext\n```\ncd q\n```\n```bash\n  cd z\n```\n"),
    (md.fence_shell, "- cd x\n1. cd\n| x\n;x\nA=1\n# c\ncatalog", "- cd x\n1. cd\n| x\n```bash\n;x\n```\n```bash\nA=1\n```\n# c\n```bash\ncatalog\n```"),
    (md.fence_shell, "a\n```\ncd\n", "a\n```\ncd\n"),
    (md.repair_lists, "First\n  Second\n    Nested\n\nx\ny\n- z\nq", "- First\n  * Second\n    + Nested\n\n- x\n- y\n- z\nq"),
    (md.repair_lists, "```\na\nb\n```\nc\nd", "```\na\nb\n```\n- c\n- d"),
    (md.repair_lists, "> q\na\nb\n# z\n```\ni\n```\nj\n\nk", "> q\n- a\n- b\n- # z\n- ```\n- i\n- ```\n- j\n\nk"),
    (md.callouts, 'a\n> <blockquote class="callout-info"><p>Mind > the ! gap</p><p>Body</p></blockquote>\nb',
     "a\n> [!info] Mind \\> the \\! gap\n> Mind \\> the \\! gap\nBody\nb"),
    (md.callouts, '> x\n> <blockquote class="callout-foo bar">\n> hi</blockquote>', "> [!foo]\n> > hi"),
    (md.callouts, '> <blockquote class="callout-odd Tip"></blockquote>', "> [!tip]\n"),
    (md.callouts, '> <blockquote class="q"></blockquote>\n>t', '> <blockquote class="q"></blockquote>\n>t'),
    (md.to_wikilinks, "[x](https://e.example) [y](rel) [](r2) ![i](z) [a\nb](q)", "[x](https://e.example) [[y]] [[r2]] ![i](z) [a\nb](q)"),
    (md.wikilinks_to_markdown, "[[A|B]] ![[k]] [[x]] [[|z]] [[a|b|c]]", "[A](B) ![[k]] [x](x) [](z) [a](b|c)"),
]


def test_steps(spark, apply):
    for step, text, want in STEPS:
        assert apply(step, [text]) == [want], (step.__name__, text)


def test_absolutize_links(apply):
    text = "[in](/x/../y) [o](https://z) ![i](p.png) [t](tel:1) [m](mailto:a) [f](#a)"
    want = "[in](https://n.org/y) [o](https://z) ![i](https://n.org/a/p.png) [t](tel:1) [m](mailto:a) [f](#a)"
    assert apply(lambda c: md.absolutize_links(c, F.lit("https://n.org/a/b")), [text]) == [want]
    assert apply(lambda c: md.absolutize_links(c, F.lit("")), [text]) == [text]


def test_block_ids(apply):
    def tag(line):
        return hashlib.md5(line.encode()).hexdigest()[:8]

    text = "para \n- ^deadbeef\ntail ^kept\n1. num\n\n- x\n# h\n  text"
    want = f"para ^{tag('para')}\ntail ^kept\n1. num ^{tag('1. num')}\n\n- x\n# h\n  text ^{tag('text')}"
    assert apply(md.block_ids, [text]) == [want]


def test_text_is_never_lost_to_marker_characters(apply):
    text = "\x01[a](b)\x01\x02 `x` \\1 $0"
    assert apply(md.to_wikilinks, [text]) == ["\x01[[a]]\x01\x02 `x` \\1 $0"]


def test_long_texts(apply):
    """No step recurses over its input: long fences, quotes and lists must pass."""
    fence = "```\n" + "cd x\n" * 50_000 + "```"
    quote = "\n".join("> line" for _ in range(50_000)) + "<blockquote"
    assert apply(md.fence_shell, [fence]) == [fence]
    assert apply(md.callouts, [quote]) == [quote]
    listed = apply(md.repair_lists, ["\n".join("item" for _ in range(20_000))])[0]
    assert listed == "\n".join("- item" for _ in range(20_000))


def test_order_of_steps(spark):
    text = "<s>a</s> <!-- x --> [r](b)\n\ngit <mark>m</mark>"
    rows = spark.createDataFrame([(1, "https://h/a", text)], "doc_id bigint, url string, markdown string")
    out = notes.convert(rows).first().markdown
    assert out == "~~a~~ %% x %% [r](https://h/b)\n\n```bash\ngit ==m==\n```"
    assert notes.convert(rows, base=None).first().markdown.startswith("~~a~~ %% x %% [[r]]")
    with pytest.raises(ValueError):
        notes.convert(rows, link_format="html")


def test_lines_round_trip(spark):
    texts = ["", "a", "a\n", "\n\nb\r\nc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, markdown string")
    back = notes.join_lines(notes.note_lines(rows)).orderBy("doc_id").collect()
    assert [r.markdown for r in back] == texts


def test_each_shell_line_adds_two_lines(spark):
    texts = ["ls\nls\nx", "x", "```\nls\n```\nA=1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, markdown string")
    before = notes.note_lines(rows).count()
    after = notes.note_lines(rows.withColumn("markdown", md.fence_shell(F.col("markdown")))).count()
    assert after == before + 2 * 3
