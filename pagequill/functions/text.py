"""Text columns: cleaning, dates, keyword lists, slugs and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import SPACE, WORD, is_blank, let, strip
from .entities import decode_entities
from .urls import IMAGE_EXTENSIONS, url_extension

# Month names, long and short.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
    "november", "december",
)

MAX_NAME = 80
ELLIPSIS = "…"


def clean_text(col: Column) -> Column:
    """Keep letters, digits, ``_``, white space and ``- ' . +``; collapse white space."""
    kept = F.regexp_replace(col, f"[^{WORD}{SPACE}\\-'.+]", "")
    return strip(F.regexp_replace(kept, f"[{SPACE}]+", " "))


def keyword_tags(col: Column) -> Column:
    return F.filter(F.transform(F.split(col, ",", -1), strip), lambda tag: tag != "")


_DAY = r"(3[01]|[12]\d|0[1-9]|[1-9])"
_CLOCK = r"(?:2[0-3]|[01]\d|\d):(?:[0-5]\d|\d):(?:[0-5]\d|\d)"
_OFFSET = (
    r"(?:(?-i:Z)|[+-](?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:\.\d{1,6})?)?"
    r"|[0-5]\d(?:[0-5]\d(?:\.\d{1,6})?)?))"
)
ISO_DATE = (
    r"(?i)^(\d{4})-(1[0-2]|0[1-9]|[1-9])-" + _DAY
    + r"(?:T" + _CLOCK + r"(?:(?:\.\d{1,6})?" + _OFFSET + r")?|[" + SPACE + r"]+" + _CLOCK + r")?$"
)
_MONTH_NAME = "(" + "|".join(MONTHS + tuple(m[:3] for m in MONTHS)) + ")"
MONTH_FIRST = rf"(?i)^{_MONTH_NAME}[{SPACE}]+{_DAY},[{SPACE}]+(\d{{4}})$"
DAY_FIRST = rf"(?i)^{_DAY}[{SPACE}]+{_MONTH_NAME}[{SPACE}]+(\d{{4}})$"


def parse_date(col: Column) -> Column:
    """ISO and month-name dates as ``YYYY-MM-DD`` in their own offset; '' for anything else."""

    def month_number(name: Column) -> Column:
        short = F.lower(F.substring(name, 1, 3))
        return F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), short).cast("string")

    def parts(t: Column) -> Column:
        def ymd(y: Column, m: Column, d: Column) -> Column:
            return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))

        return (
            F.when(
                t.rlike(ISO_DATE),
                ymd(F.regexp_extract(t, ISO_DATE, 1), F.regexp_extract(t, ISO_DATE, 2), F.regexp_extract(t, ISO_DATE, 3)),
            )
            .when(
                t.rlike(MONTH_FIRST),
                ymd(
                    F.regexp_extract(t, MONTH_FIRST, 3),
                    month_number(F.regexp_extract(t, MONTH_FIRST, 1)),
                    F.regexp_extract(t, MONTH_FIRST, 2),
                ),
            )
            .when(
                t.rlike(DAY_FIRST),
                ymd(
                    F.regexp_extract(t, DAY_FIRST, 3),
                    month_number(F.regexp_extract(t, DAY_FIRST, 2)),
                    F.regexp_extract(t, DAY_FIRST, 1),
                ),
            )
        )

    checked = let(
        let(strip(col), parts),
        lambda d: F.when(d.try_cast("date").isNotNull() & ~d.startswith("0000"), d),
    )
    return F.coalesce(checked, F.lit(""))


def slugify(col: Column) -> Column:
    """Lower-case hyphenated form of a title without tags, references and symbols."""
    plain = decode_entities(F.regexp_replace(col, "<[^>]+>", ""))
    words = F.regexp_replace(plain, f"[^{WORD}{SPACE}\\-]", "")
    hyphens = F.regexp_replace(words, f"[{SPACE}_]+", "-")
    single = F.regexp_replace(hyphens, "-{2,}", "-")
    return F.lower(F.regexp_replace(single, "^-+|-+$", ""))


def note_name(title: Column, url: Column, date: Column, date_prefix: bool = False) -> Column:
    """File name of a note: slug, optional date, cut to 80 characters, ``.md``."""
    slug = slugify(title)
    if date_prefix:
        slug = F.when(F.coalesce(date, F.lit("")) != "", F.concat(date, F.lit("-"), slug)).otherwise(slug)

    def cut(s: Column) -> Column:
        def head(n: int) -> Column:
            return F.concat(F.regexp_replace(F.substring(s, 1, n), "-+$", ""), F.lit(ELLIPSIS))

        with_hash = F.concat(head(MAX_NAME - 8), F.lit("-"), F.substring(F.md5(url.cast("binary")), 1, 6))
        short = F.when(F.coalesce(url, F.lit("")) != "", with_hash).otherwise(head(MAX_NAME - 2))
        return F.when(F.length(s) <= MAX_NAME, s).otherwise(short)

    return F.concat(let(slug, cut), F.lit(".md"))


def image_name(url: Column, alt: Column) -> Column:
    """File name of an image: slug of its alt text, or eight hash digits of its URL."""
    text = F.coalesce(alt, F.lit(""))
    stem = F.when(is_blank(text), F.substring(F.md5(url.cast("binary")), 1, 8)).otherwise(slugify(strip(text)))
    extension = let(
        url_extension(url), lambda e: F.when(e.isin(*IMAGE_EXTENSIONS), e).otherwise(".jpg")
    )
    return F.concat(stem, extension)
