"""URL columns: parts, reference resolution, extensions, blocked hosts."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let

_URL = (
    r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"
)

# Schemes whose references may be relative.
RELATIVE_SCHEMES = (
    "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero",
    "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)

# Networks no image may be fetched from.
BLOCKED_NETWORKS = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "0.0.0.0/8", "100.64.0.0/10",
    "169.254.0.0/16", "::1/128", "fc00::/7", "fe80::/10",
)

# Local host names.
LOCAL_HOSTS = ("localhost", "localhost.localdomain")

# File extensions taken as images.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".bmp", ".ico", ".avif")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"


def tidy_url(url: Column) -> Column:
    """Drop leading control characters and blanks, and any tab or line break."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def url_parts(url: Column) -> Column:
    tidy = tidy_url(url)
    return let(
        tidy,
        lambda u: F.struct(
            F.lower(F.regexp_extract(u, _URL, 1)).alias("scheme"),
            F.regexp_extract(u, _URL, 2).alias("netloc"),
            F.regexp_extract(u, _URL, 3).alias("path"),
            F.regexp_extract(u, _URL, 4).alias("query"),
            F.regexp_extract(u, _URL, 5).alias("fragment"),
        ),
    )


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(tidy_url(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def url_host(url: Column) -> Column:
    """Lower-case host without user info, port and IPv6 brackets; '' when there is none."""
    netloc = F.regexp_extract(tidy_url(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    address = F.regexp_replace(netloc, r"^[\s\S]*@", "")
    return F.lower(
        F.when(address.contains("["), F.regexp_extract(address, r"\[([^\]]*)\]", 1)).otherwise(
            F.regexp_extract(address, "^[^:]*", 0)
        )
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen from ``base``."""
    return (
        F.when(F.coalesce(href, F.lit("")) == "", base)
        .when(F.coalesce(base, F.lit("")) == "", href)
        .otherwise(
            let(
                F.struct(url_parts(base).alias("b"), url_parts(href).alias("h")),
                lambda u: _resolve(href, u["b"], u["h"]),
            )
        )
    )


def _resolve(href: Column, b: Column, h: Column) -> Column:
    foreign = ((h["scheme"] != "") & (h["scheme"] != b["scheme"])) | ~b["scheme"].isin(*RELATIVE_SCHEMES)
    return (
        F.when(foreign, href)
        .when(h["netloc"] != "", _join(b["scheme"], h["netloc"], h["path"], h["query"], h["fragment"]))
        .when(
            h["path"] == "",
            _join(
                b["scheme"],
                b["netloc"],
                b["path"],
                F.when(h["query"] != "", h["query"]).otherwise(b["query"]),
                h["fragment"],
            ),
        )
        .otherwise(
            _join(b["scheme"], b["netloc"], _merge_paths(b["path"], h["path"]), h["query"], h["fragment"])
        )
    )


def _join(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    return F.concat(
        scheme,
        F.lit("://"),
        netloc,
        let(path, lambda p: F.when((p == "") | p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def _merge_paths(base: Column, path: Column) -> Column:
    folder = F.regexp_replace(base, "[^/]+$", "")
    joined = F.when(path.startswith("/"), path).otherwise(
        # empty inner segments vanish when a relative path is appended
        F.concat(
            F.when(folder.startswith("/") | (folder == ""), F.lit("/")).otherwise(""),
            F.array_join(F.filter(F.split(folder, "/", -1), lambda s: s != ""), "/"),
            F.when(folder.rlike("[^/]"), F.lit("/")).otherwise(""),
            _inner_slashes(path),
        )
    )
    return let(
        joined,
        lambda p: F.when(p.rlike(r"(?:^|/)\.\.?(?:/|$)"), _remove_dots(p)).otherwise(p),
    )


def _inner_slashes(path: Column) -> Column:
    return F.regexp_replace(path, "/{2,}", "/")


def _remove_dots(path: Column) -> Column:
    segments = F.split(path, "/", -1)
    kept = F.aggregate(
        segments,
        F.slice(segments, 1, 0),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    closed = F.when(path.rlike(r"(?:^|/)\.\.?$"), F.array_append(kept, F.lit(""))).otherwise(kept)
    return let(F.array_join(closed, "/"), lambda p: F.when(p == "", F.lit("/")).otherwise(p))


def unquote(text: Column) -> Column:
    """Percent decoding; '+' and broken escapes stay."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(safe), text)).otherwise(text)


def url_extension(url: Column) -> Column:
    """Lower-case suffix of the file name in the URL path, with its dot, or ''."""
    path = unquote(F.regexp_extract(tidy_url(url), _URL, 3))
    name = F.regexp_extract(F.regexp_replace(F.regexp_extract(path, "^[^?#]*", 0), "/+$", ""), "[^/]*$", 0)
    return F.lower(F.regexp_extract(name, r"^[\s\S]+(\.[^.]+)$", 1))


def written_extension(url: Column) -> Column:
    """Lower-case suffix of the URL as it is written, without query and fragment and with escapes left alone, or ''."""
    name = F.regexp_extract(F.regexp_replace(F.regexp_extract(url, "^[^?#]*", 0), "/+$", ""), "[^/]*$", 0)
    return F.lower(F.regexp_extract(name, r"^[\s\S]+(\.[^.]+)$", 1))


def ipv4_key(host: Column) -> Column:
    """Eight hex digits for a dotted IPv4 address, else null."""
    octets = F.split(host, r"\.")
    return F.when(
        host.rlike(f"^{_IPV4}$"),
        F.array_join(F.transform(octets, lambda o: F.lpad(F.hex(o.cast("int")), 2, "0")), ""),
    )


def ipv6_key(host: Column) -> Column:
    """32 hex digits for an IPv6 address (``::`` and a dotted tail allowed), else null."""
    bare = F.lower(F.regexp_replace(host, "%[^%]+$", ""))
    tail = F.regexp_extract(bare, f":({_IPV4})$", 1)
    tail_hex = ipv4_key(tail)
    dotted = F.when(
        tail != "",
        F.concat(
            F.regexp_replace(bare, r"[0-9.]+$", ""),
            F.substring(tail_hex, 1, 4),
            F.lit(":"),
            F.substring(tail_hex, 5, 4),
        ),
    ).otherwise(bare)

    def groups(text: Column) -> Column:
        return F.filter(F.split(text, ":", -1), lambda g: g != "")

    def expand(text: Column) -> Column:
        halves = F.split(text, "::", -1)
        left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        n = F.size(left) + F.size(right)
        full = F.when(
            F.size(halves) == 1, F.when(n == 8, left)
        ).when(
            (F.size(halves) == 2) & (n < 8),
            F.concat(left, F.array_repeat(F.lit("0"), 8 - n), right),
        )
        return F.upper(F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))

    shape = r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$"
    return F.when(
        host.contains(":"),
        let(dotted, lambda t: F.when(t.rlike(shape), expand(t))),
    )


def blocked_ranges() -> list[tuple[int, str, str]]:
    """(family, first key, last key) of every blocked network; the ranges are disjoint."""
    rows = []
    for text in BLOCKED_NETWORKS:
        net = ipaddress.ip_network(text)
        width = 8 if net.version == 4 else 32
        rows.append(
            (net.version, f"{int(net.network_address):0{width}X}", f"{int(net.broadcast_address):0{width}X}")
        )
    return rows


def is_blocked_host(host: Column) -> Column:
    """True for no host, a local name, or an address inside a blocked network.

    Ten constant ranges: a chain of BETWEEN tests inside the row beats any join.
    """
    keys = {4: ipv4_key(host), 6: ipv6_key(host)}
    inside = F.lit(False)
    for family in (4, 6):
        ranges = [(lo, hi) for version, lo, hi in blocked_ranges() if version == family]
        hit = let(keys[family], _between_any(ranges))
        inside = inside | F.coalesce(hit, F.lit(False))
    plain = F.coalesce(host, F.lit(""))
    return (plain == "") | plain.isin(*LOCAL_HOSTS) | (plain.rlike("^[0-9.]+$|:") & inside)


def _between_any(ranges: list[tuple[str, str]]) -> Callable[[Column], Column]:
    def test(key: Column) -> Column:
        hit = F.lit(False)
        for lo, hi in ranges:
            hit = hit | key.between(lo, hi)
        return hit

    return test
