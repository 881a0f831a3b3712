"""Fetch outcomes, decoding, acceptance, statuses and the summary."""

import codecs

from pyspark.sql import functions as F

from pagequill.operators import fetchlog, outcomes

ATTEMPTS = "url string, seq bigint, status_code int, failure string, content_type string"


def ends(spark, rows, **options):
    table = spark.createDataFrame([(u, i, s, f, "text/html") for i, (u, s, f) in enumerate(rows)], ATTEMPTS)
    return {r.url: (r.outcome, r.attempts) for r in fetchlog.fetch_outcomes(table, **options).collect()}


def test_attempts_collapse(spark):
    rows = [
        ("a", 500, None), ("a", None, "timeout"), ("a", 200, None), ("a", 404, None), ("b", 404, None), ("b", 200, None),
        ("c", 503, None), ("c", 503, None), ("c", None, "network"), ("c", 200, None), ("d", 403, None), ("e", None, "timeout"),
    ]
    assert ends(spark, rows) == {
        "a": ("success", 3), "b": ("not_found", 1), "c": ("network_error", 3), "d": ("success", 1), "e": ("timeout", 1),
    }
    assert ends(spark, rows, max_attempts=1)["a"] == ("server_error", 1)
    assert ends(spark, rows, max_attempts=0)["b"] == ("network_error", 0)


def test_rank_filter_reaches_the_exchange(spark):
    """Of a URL with very many attempts each task ships only a few rows."""
    table = spark.range(1000).select(
        F.concat(F.lit("hot"), (F.col("id") % 1).cast("string")).alias("url"), F.col("id").alias("seq"), F.lit(503).alias("status_code"),
        F.lit(None).cast("string").alias("failure"), F.lit("").alias("content_type"),
    )
    out = fetchlog.fetch_outcomes(table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    below_exchange = plan[plan.index("Exchange hashpartitioning(url") :]
    assert "WindowGroupLimit" in below_exchange and "Partial" in below_exchange
    assert plan.count("Exchange hashpartitioning") == 1
    assert [(r.outcome, r.attempts) for r in out.collect()] == [("server_error", 3)]


def decoded(spark, *rows):
    table = spark.createDataFrame([(i, ct, bytearray(b)) for i, (ct, b) in enumerate(rows)], "seq bigint, content_type string, body binary")
    return [(r.charset, r.html) for r in fetchlog.decode_pages(table).orderBy("seq").collect()]


def test_charsets(spark):
    word = bytes([0xCF, 0xF0, 0xE8])
    meta = b'<meta charset="windows-1251">'
    http_equiv = b"<META http-equiv=content-type content='text/html; charset=koi8-r'>"
    assert decoded(
        spark,
        ("text/html; charset=windows-1251", word), ("text/html", meta + word), ("", http_equiv + word), ("", "é".encode()),
        ("", b"A\xc3B"), ("x; charset=no-such", "é".encode()), ('x; charset="latin-1"', b"\xe9"), ("charset=ASCII", b"a\xe9"),
        ("charset=iso-8859-1", b"\xe9\x80"), ("charset=cp1252", b"\x80\x81"),
    ) == [
        ("windows-1251", word.decode("cp1251")), ("windows-1251", (meta + word).decode("cp1251")),
        ("koi8-r", (http_equiv + word).decode("koi8-r")), ("utf-8", "é"), ("utf-8", "A�B"), ("no-such", "é"),
        ('"latin-1"', "�"), ("ASCII", "a�"), ("iso-8859-1", "\xe9\x80"), ("cp1252", "��"),
    ]


def test_charset_names_are_known_to_python():
    for codec, aliases in fetchlog.SINGLE_BYTE.items():
        for alias in aliases:
            assert codecs.lookup(alias).name == codecs.lookup(codec).name


def test_multi_byte_charsets_on_request(spark):
    keys = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    try:
        for key in keys:
            spark.conf.set(key, "true")
        text = "日本語"
        assert decoded(spark, ("charset=Shift_JIS", text.encode("shift_jis")), ("charset=gbk", "中文".encode("gbk"))) == [
            ("Shift_JIS", text), ("gbk", "中文"),
        ]
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_image_responses(spark):
    rows = [("http://h/a", 200, "image/png"), ("http://h/a.JPG?x", 204, ""), ("http://h/a.php", 200, "text/html"), ("http://h/a.png", 302, "image/png")]
    table = spark.createDataFrame(rows, "url string, status_code int, content_type string")
    assert {r.url for r in fetchlog.accept_image_responses(table).collect()} == {"http://h/a", "http://h/a.JPG?x"}


def test_statuses_and_summary(spark):
    ways = ["", *outcomes.EXIT_CODES, "blank"]
    rows = spark.createDataFrame(list(enumerate(ways)), "seq bigint, ending string")
    result = outcomes.classify_outcomes(rows)
    codes = {r.ending: (r.status, r.exit_code) for r in result.collect()}
    assert codes["not_found"] == ("skip", 4) and codes["server_error"] == ("error", 5) and codes[""] == ("success", 0)
    assert codes["no_article"] == ("skip", 6) and codes["write_failed"] == ("error", 7) and codes["invalid_url"] == ("error", 2)
    summary = outcomes.batch_summary(result).first()
    assert (summary.ok, summary.errors, summary.skipped, summary.exit_code) == (1, 6, 5, 1)
    assert outcomes.batch_summary(result.limit(1)).first().exit_code == 0


def test_drop_empty(spark):
    rows = spark.createDataFrame([("x",), (" \t  \n",), (None,), ("",)], "markdown string")
    assert [r.status for r in outcomes.drop_empty(rows).collect()] == ["success", "skip", "skip", "skip"]


def test_charsets_need_no_session_setting(spark):
    cases = [("windows-1251", "привет", "cp1251"), ("Shift_JIS", "日本語", "shift_jis"), ("gbk", "中文", "gbk"), ("iso-8859-8", "שלום", "iso8859-8"), ("tis-620", "ไทย", "tis-620"), ("mac-cyrillic", "Привет", "mac-cyrillic"), ("cp437", "é░", "cp437")]
    rows = [(k, f"text/html; charset={name}", bytearray(text.encode(codec))) for k, (name, text, codec) in enumerate(cases)]
    frame = fetchlog.decode_pages(spark.createDataFrame(rows, "seq int, content_type string, body binary"))
    assert [r.html for r in frame.orderBy("seq").collect()] == [c[1] for c in cases]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"


def test_image_responses_go_by_the_url_as_written(spark):
    rows = [("https://c/9.a%2Ejpg", "text/html"), ("https://c/9.JPG?x=.txt", "text/html"), ("https://c/9.php#a.png", ""), ("https://c/x", "image/png")]
    frame = spark.createDataFrame([(200, t, u) for u, t in rows], "status_code int, content_type string, url string")
    assert [r.url for r in fetchlog.accept_image_responses(frame).collect()] == ["https://c/9.JPG?x=.txt", "https://c/x"]
