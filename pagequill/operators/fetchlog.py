"""Fetch attempts and responses: outcomes, decoding, image checks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import SPACE
from ..functions.urls import IMAGE_EXTENSIONS, is_blocked_host, url_host, url_scheme, written_extension


def validate_urls(urls: DataFrame) -> DataFrame:
    """Add ``valid`` and ``reason`` (bad_scheme, no_host); only http and https with a host pass. A null URL has no scheme."""
    url = F.coalesce("url", F.lit(""))
    reason = F.when(~url_scheme(url).isin("http", "https"), F.lit("bad_scheme")).when(url_host(url) == "", F.lit("no_host"))
    return urls.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def flag_blocked_hosts(urls: DataFrame) -> DataFrame:
    """Add ``host`` and ``blocked``."""
    return urls.withColumn("host", url_host(F.col("url"))).withColumn("blocked", is_blocked_host(F.col("host")))


def attempt_outcome(status: Column, failure: Column) -> Column:
    return (
        F.when(failure == "timeout", F.lit("timeout"))
        .when(failure.isNotNull() | status.isNull(), F.lit("network_error"))
        .when(status == 404, F.lit("not_found"))
        .when(status >= 500, F.lit("server_error"))
        .otherwise("success")
    )


def fetch_outcomes(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Collapse the attempts of a URL: the first terminal one of the first ``max_attempts``, else the last.

    The rank filter is pushed below the exchange, so of a URL with very many attempts
    each task sends at most ``max_attempts`` rows.
    """
    if max_attempts < 1:
        return attempts.groupBy("url").agg(
            F.lit("network_error").alias("outcome"),
            F.lit(None).cast("int").alias("status_code"),
            F.lit("").alias("content_type"),
            F.lit(0).cast("bigint").alias("attempts"),
        )
    return last_attempts(attempts, max_attempts).select("url", "outcome", "status_code", "content_type", "attempts")


def last_attempts(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """(url, seq, outcome, status_code, content_type, attempts): the attempt that decides about each URL."""
    outcome = attempt_outcome(F.col("status_code"), F.col("failure"))
    ranked = attempts.select(
        "url", "seq", "status_code", "failure", "content_type", F.row_number().over(Window.partitionBy("url").orderBy("seq")).alias("n")
    )
    tried = ranked.filter(F.col("n") <= max_attempts).withColumn("outcome", outcome)
    terminal = F.when(F.col("outcome").isin("success", "not_found"), F.col("n"))
    shown = F.struct("seq", "outcome", "status_code", "content_type", F.col("n").cast("bigint").alias("attempts"))
    ended = tried.groupBy("url").agg(
        F.coalesce(F.min_by(shown, terminal), F.max_by(shown, "n")).alias("end")
    )
    return ended.select("url", "end.*")


def accept_image_responses(responses: DataFrame) -> DataFrame:
    """2xx responses that say they are an image or whose URL, as it is written, ends like one."""
    return responses.filter(
        F.col("status_code").between(200, 299)
        & (F.col("content_type").contains("image/") | written_extension(F.col("url")).isin(*IMAGE_EXTENSIONS))
    )


# Names of single-byte charsets and their common aliases.
SINGLE_BYTE = {
    "cp1250": ("cp1250", "windows-1250", "1250"),
    "cp1251": ("cp1251", "windows-1251", "1251"),
    "cp1252": ("cp1252", "windows-1252", "1252"),
    "cp1253": ("cp1253", "windows-1253", "1253"),
    "cp1254": ("cp1254", "windows-1254", "1254"),
    "cp1255": ("cp1255", "windows-1255", "1255"),
    "cp1256": ("cp1256", "windows-1256", "1256"),
    "cp1257": ("cp1257", "windows-1257", "1257"),
    "cp1258": ("cp1258", "windows-1258", "1258"),
    "iso8859-1": ("iso-8859-1", "iso8859-1", "latin-1", "latin1", "l1", "latin", "8859", "cp819"),
    "iso8859-2": ("iso-8859-2", "iso8859-2", "latin2", "l2"),
    "iso8859-3": ("iso-8859-3", "iso8859-3", "latin3", "l3"),
    "iso8859-4": ("iso-8859-4", "iso8859-4", "latin4", "l4"),
    "iso8859-5": ("iso-8859-5", "iso8859-5", "cyrillic"),
    "iso8859-7": ("iso-8859-7", "iso8859-7", "greek"),
    "iso8859-9": ("iso-8859-9", "iso8859-9", "latin5", "l5"),
    "iso8859-13": ("iso-8859-13", "iso8859-13", "latin7", "l7"),
    "iso8859-15": ("iso-8859-15", "iso8859-15", "latin9", "l9"),
    "iso8859-16": ("iso-8859-16", "iso8859-16", "latin10", "l10"),
    "koi8-r": ("koi8-r",),
    "koi8-u": ("koi8-u",),
    "iso8859-6": ("iso-8859-6", "iso8859-6", "arabic", "asmo-708", "ecma-114"),
    "iso8859-8": ("iso-8859-8", "iso8859-8", "hebrew"),
    "iso8859-10": ("iso-8859-10", "iso8859-10", "latin6", "l6"),
    "iso8859-11": ("iso-8859-11", "iso8859-11", "thai"),
    "iso8859-14": ("iso-8859-14", "iso8859-14", "latin8", "l8", "iso-celtic"),
    "cp437": ("cp437", "ibm437", "437"),
    "cp850": ("cp850", "ibm850", "850"),
    "cp852": ("cp852", "ibm852", "852"),
    "cp855": ("cp855", "ibm855", "855"),
    "cp866": ("cp866", "ibm866", "866"),
    "cp874": ("cp874",),
    "mac-roman": ("mac-roman", "macintosh", "macroman"),
    "mac-cyrillic": ("mac-cyrillic", "maccyrillic"),
    "mac-greek": ("mac-greek", "macgreek"),
    "mac-latin2": ("mac-latin2", "maclatin2", "mac-centeuro"),
    "mac-turkish": ("mac-turkish", "macturkish"),
    "mac-iceland": ("mac-iceland", "maciceland"),
    "tis-620": ("tis-620", "tis620", "tis-620-0"),
    "ascii": ("ascii", "us-ascii", "646", "iso646-us"),
}
# Multi-byte charsets.
JAVA_CHARSETS = (
    "utf-16", "utf-16le", "utf-16be", "utf-32", "gb2312", "gbk", "gb18030", "big5", "shift_jis", "euc-jp",
    "euc-kr", "iso-2022-jp",
)

# Where a page that is read as text names its charset.
META_CHARSET = r"(?i)<meta[^>]*charset\s*=\s*[\"']?([^\"'>\s]+)"


def detect_charset(content_type: Column, text: Column) -> Column:
    """Charset named by the header, else by the first meta element, else utf-8."""
    header = F.regexp_extract(F.coalesce(content_type, F.lit("")), rf"charset=([^;{SPACE}]+)", 1)
    return F.coalesce(
        F.nullif(header, F.lit("")), F.nullif(F.regexp_extract(text, META_CHARSET, 1), F.lit("")), F.lit("utf-8")
    )


def _single_byte(body: Column, codec: str) -> Column:
    """Decode by translating the upper half of ISO-8859-1; null when a byte has no character."""
    source, target, undefined = "", "", ""
    for n in range(0x80, 0x100):
        char = bytes([n]).decode(codec, "ignore")
        if not char:
            undefined += f"\\x{n:02X}"
        elif char != chr(n):
            source, target = source + chr(n), target + char
    plain = F.decode(body, "ISO-8859-1")
    decoded = F.translate(plain, source, target) if source else plain
    return F.when(~plain.rlike(f"[{undefined}]"), decoded) if undefined else decoded


@contextmanager
def _java_charsets(spark: SparkSession) -> Iterator[None]:
    """Spark takes the charsets a decode may use from the session when the column is built: all are allowed meanwhile."""
    keys = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {key: spark.conf.get(key, None) for key in keys}
    for key in keys:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def decode_body(body: Column, charset: Column) -> Column:
    """Text of a response body; bad bytes or an unknown charset give UTF-8 with replacement."""
    name = F.regexp_replace(F.lower(charset), "[_ ]", "-")
    decoded = None
    for codec, aliases in SINGLE_BYTE.items():
        decoded = (F if decoded is None else decoded).when(name.isin(*aliases), _single_byte(body, codec))
    for codec in JAVA_CHARSETS:
        text = F.decode(body, codec)
        decoded = decoded.when(name == codec.replace("_", "-"), F.when(~text.contains("\ufffd"), text))
    return F.coalesce(decoded, F.make_valid_utf8(body.cast("string")))


def decode_pages(responses: DataFrame) -> DataFrame:
    """(…, content_type, body) -> the same rows with ``charset`` and ``html`` in place of the body."""
    readable = F.make_valid_utf8(F.col("body").cast("string"))
    with_charset = responses.withColumn("charset", detect_charset(F.col("content_type"), readable))
    with _java_charsets(responses.sparkSession):
        return with_charset.withColumn("html", decode_body(F.col("body"), F.col("charset"))).drop("body")
