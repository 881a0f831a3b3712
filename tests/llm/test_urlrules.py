from __future__ import annotations

from pagequill.llm.queries import URL_RULES
from pagequill.llm.urlrules import judge_urls

RULES = "host string, path string, action string"
CASES = {
    "https://www.EXAMPLE.com/en/1?x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
    "http://example.com/e": ("example.com", "/e", "com/", "allow"),
    "http://com": ("com", "", None, "allow"),
    "x://a.net/fr/b#c": ("a.net", "/fr/b", "net/fr/", "block"),
    "//a.net/fr/": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://anet/es/?q=://b.net/es/": ("anet", "/es/", None, "allow"),
    "http://a.net\n/es/é": ("a.net\n", "/es/é", None, "allow"),
    "http://É.NET/es/": ("É.net", "/es/", "net/es/", "block"),
}


def test_verdicts(spark):
    frame = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*CASES, *CASES])], "page_id long, url string, host string")
    judged = judge_urls(frame, spark.createDataFrame(URL_RULES, RULES))
    got = judged.collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == CASES[r["url"]], r
    plan = judged._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_ties_and_no_rules(spark):
    frame = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    rules = [("b", "/", "block"), ("b", "/", "allow"), (None, "/", "block"), ("b", None, "block"), ("a.b", "/x", "block")]
    assert judge_urls(frame, spark.createDataFrame(rules, RULES)).first()["verdict"] == "allow"
    assert judge_urls(frame, spark.createDataFrame([], RULES), default="block").first()["verdict"] == "block"
    assert judge_urls(frame.limit(0), spark.createDataFrame(rules, RULES)).collect() == []


def test_any_column_names_and_hot_urls(spark, monkeypatch):
    from pagequill.llm import urlrules

    monkeypatch.setattr(urlrules, "HEAVY", 4)
    names = ("u", "n", "digest", "part", "row", "short", "found", "action", "url")
    hot = "https://www.EXAMPLE.com/en/1?x"
    rows = [(*range(8), u) for u in [*CASES, *[hot] * 9]]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'url' else 'int'}" for n in names))
    judged = judge_urls(frame, spark.createDataFrame(URL_RULES, RULES))
    assert judged.columns == [*names, "host", "path", "rule", "verdict"]
    got = judged.collect()
    assert len(got) == len(rows) and all((r["host"], r["path"], r["rule"], r["verdict"]) == CASES[r["url"]] and r["u"] == 0 for r in got)
    for name in ("host", "path", "rule", "verdict"):
        named = judge_urls(frame.select(frame["url"].alias(name)), spark.createDataFrame(URL_RULES, RULES), url_col=name).collect()
        assert sorted((r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in named) == sorted((h, p, r or "", v) for h, p, r, v in (CASES[x["url"]] for x in got))
