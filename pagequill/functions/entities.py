"""HTML character references (named, decimal, hexadecimal)."""

from __future__ import annotations

import json
from collections import defaultdict
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let, rewrite_matches

REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"

# The references that make up almost all of real pages.
_COMMON = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\u00a0"}

REPLACEMENT = "\ufffd"


def _named_table() -> Column:
    """The standard name table, keyed by first letter so a look-up scans little.

    One JSON literal that the optimizer folds to a map constant.
    """
    return F.from_json(F.lit(_NAMES), "map<string,map<string,string>>")


def _names_json() -> str:
    by_letter: dict[str, dict[str, str]] = defaultdict(dict)
    for name, value in html5.items():
        by_letter[name[0]][name] = value
    return json.dumps(by_letter, ensure_ascii=False)


_NAMES = _names_json()

# Numbers 128-159 stand for their windows-1252 characters where one exists.
_C1 = [(chr(n), bytes([n]).decode("cp1252")) for n in range(0x80, 0xA0) if bytes([n]).decode("cp1252", "ignore")]


def _legacy_prefix() -> str:
    """Names that are also valid without a semicolon, longest first."""
    legacy = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return "^&(" + "|".join(legacy) + ")"


def code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


# Control characters and non-characters: a numeric reference to one of them gives nothing.
_DROPPED = (
    r"[\x01-\x08\x0B\x0E-\x1F\x7F\uFDD0-\uFDEF"
    + "".join(rf"\x{{{plane:X}FFFE}}\x{{{plane:X}FFFF}}" for plane in range(17))
    + "]"
)


def _character(n: Column) -> Column:
    """Text for a numeric reference; null ``n`` means out of range."""
    shown = F.regexp_replace(code_point(n), _DROPPED, "")
    return F.when(
        n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit(REPLACEMENT)
    ).otherwise(F.translate(shown, "".join(c for c, _ in _C1), "".join(c for _, c in _C1)))


def _numeric(ref: Column) -> Column:
    hexadecimal = F.regexp_extract(ref, "^&#[xX]0*([0-9a-fA-F]*)", 1)
    decimal = F.regexp_extract(ref, "^&#0*([0-9]*)", 1)
    number = F.when(
        ref.rlike("^&#[xX]"),
        F.when(F.length(hexadecimal) <= 6, F.conv(F.concat(F.lit("0"), hexadecimal), 16, 10).cast("int")),
    ).otherwise(F.when(F.length(decimal) <= 7, F.concat(F.lit("0"), decimal).cast("int")))
    return let(number, _character)


def _look_up(name: Column) -> Column:
    return F.try_element_at(F.try_element_at(_named_table(), F.substring(name, 1, 1)), name)


def _named(ref: Column) -> Column:
    name = F.substr(ref, F.lit(2))
    exact = let(name, _look_up)
    prefix = F.regexp_extract(ref, _legacy_prefix(), 1)
    by_prefix = let(
        prefix,
        lambda p: F.when(
            p != "",
            F.concat(
                _look_up(p),
                F.substr(ref, F.length(p) + 2),
            ),
        ),
    )
    return F.coalesce(exact, by_prefix, ref)


def decode_reference(ref: Column) -> Column:
    chosen = None
    for source, value in _COMMON.items():
        chosen = (F if chosen is None else chosen).when(ref == source, F.lit(value))
    return chosen.when(ref.startswith("&#"), _numeric(ref)).otherwise(_named(ref))


def decode_entities(col: Column) -> Column:
    """Replace character references; an unknown one stays as it is."""
    return F.when(col.contains("&"), rewrite_matches(col, REFERENCE, decode_reference)).otherwise(col)
