"""URL columns against the standard library."""

import ipaddress
from pathlib import PurePosixPath
from urllib.parse import unquote, urljoin, urlparse

from pyspark.sql import functions as F

from pagequill.functions.urls import (
    BLOCKED_NETWORKS, LOCAL_HOSTS, blocked_ranges, is_blocked_host, resolve_url, url_extension, url_host,
)
from pagequill.operators import fetchlog

BASES = ["https://e.com/a/b?q#f", "http://e.com", "http://e.com/", "https://e.com/x/y/", "http://h/a//b/c", ""]
REFERENCES = [
    "c", "/c", "../c", "?x", "#y", "//h/z", "./", "../../../z", "", "tel:1", "javascript:0", ".", "..", "a//b",
    "/a//b/../c", "g;x=1", "?", "/", "a/./b", "HTTPS://Q.com/x", "http:foo", "../rel/3?q=1", "a b", "/x/../y", "..//z",
]


def test_resolve_url(spark):
    rows = spark.createDataFrame([(b, r) for b in BASES for r in REFERENCES], "b string, r string")
    for row in rows.select("b", "r", resolve_url(F.col("b"), F.col("r")).alias("out")).collect():
        assert row.out == urljoin(row.b, row.r), row


def test_url_extension(apply):
    urls = [
        "http://a/b.PNG?w=1", "http://a/.a%2Ejpg", "http://a/x", "http://a/x.", "http://a/.png", "http://a/..png",
        "http://a/x.tar.gz/", "http://a/b%3Fz.png", "http://a/q%zz.gif", "http://a/a+b.jpg", "x.svg#f",
    ]
    want = [PurePosixPath(unquote(urlparse(u).path).split("?")[0].split("#")[0]).suffix.lower() for u in urls]
    assert apply(url_extension, urls) == want


def test_blocked_hosts(apply):
    urls = [
        "http://10.1.2.3/x", "http://172.31.255.255", "http://172.32.0.0/", "http://[::1]/x", "http://[fd00::1]:80/x",
        "http://[fe80::1%25e]/", "http://[2001:db8::1]/", "http://[::ffff:10.0.0.1]/", "http://010.0.0.1",
        "HTTPS://u:p@127.0.0.1/x", "http://[1:2:3:4:5:6:7:8]", "http://[::]/", "", "http:///x", "http://a@b@c:1/",
        "http://[FE80::0:1]/x", "http://256.1.1.1", "http://100.127.255.255", "http://[0:0:0:0:0:0:0:1]/",
        "http://LOCALHOST/x", "http://localhost.localdomain:8080/", "http://0.0.0.0", "http://192.168.0.1",
    ]

    def blocked(host):
        if not host or host in LOCAL_HOSTS:
            return True
        try:
            return any(ipaddress.ip_address(host) in ipaddress.ip_network(n) for n in BLOCKED_NETWORKS)
        except ValueError:
            return False

    assert apply(url_host, urls) == [urlparse(u).hostname or "" for u in urls]
    assert apply(lambda c: is_blocked_host(url_host(c)), urls) == [blocked(urlparse(u).hostname) for u in urls]


def test_blocked_ranges_are_disjoint():
    ranges = sorted(blocked_ranges())
    for (fam, _, hi), (fam2, lo, _) in zip(ranges, ranges[1:]):
        assert fam != fam2 or hi < lo


def test_validate_urls(spark):
    urls = ["https://a.b/c", "HTTP://x", "ftp://a", "example.com", "http:///p", "", "http://u@:80/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "seq bigint, url string")
    out = [(r.valid, r.reason) for r in fetchlog.validate_urls(rows).orderBy("seq").collect()]
    no_host, bad = (False, "no_host"), (False, "bad_scheme")
    assert out == [(True, None), (True, None), bad, bad, no_host, bad, no_host]
