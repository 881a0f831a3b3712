"""Small Column building blocks shared by every operator.

Everything here builds native Spark expressions; nothing runs Python per row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Unicode word and white-space classes: Java's own \w and \s are ASCII only.
WORD = r"\p{L}\p{N}_"
SPACE = r"\p{Z}\t\n\x0B\f\r\x1C-\x1F\x85"
# The same white space without the line feed, for use inside one line.
LINE_SPACE = r"\p{Z}\t\x0B\f\r\x1C-\x1F\x85"

_SCAN_CHUNK = 64


def cached_column(build: Callable[..., Column]) -> Callable[..., Column]:
    """Build a large expression once per Spark application.

    Expressions name their columns and are not bound to a table, so one can be used
    in any number of queries; a streaming batch then does not build it again.
    """
    built: dict[tuple, Column] = {}

    @wraps(build)
    def get(*args) -> Column:
        session = SparkSession.getActiveSession()
        key = (session.sparkContext.applicationId if session else None, *args)
        if key not in built:
            built[key] = build(*args)
        return built[key]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as needed in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def each(rows: DataFrame, array: Column, name: str, *columns: Column | str) -> DataFrame:
    """``columns`` and, as ``name``, one row per element of ``array``, which has no null elements.

    An outer explode: beneath a plain one the optimizer puts a filter on the size of the array, and with it
    computes the whole array a second and third time.
    """
    return rows.select(*columns, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def each_numbered(rows: DataFrame, array: Column, place: str, name: str, *columns: Column | str) -> DataFrame:
    """``each`` with the position of the element, from 0, as ``place``."""
    return rows.select(*columns, F.posexplode_outer(array).alias(place, name)).filter(F.col(place).isNotNull())


# The characters of SPACE, for the trim functions.
_SPACE_CHARS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(col, F.lit(_SPACE_CHARS))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(_SPACE_CHARS))


def tidy(col: Column) -> Column:
    """Trim, and turn each run of white space into one space."""
    return strip(F.regexp_replace(col, f"[{SPACE}]+", " "))


def is_blank(col: Column) -> Column:
    return ~col.rlike(f"[^{SPACE}]")


def starts_with_any(col: Column, prefixes: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | col.startswith(prefix)
    return hit


def lines_of(col: Column) -> Column:
    return F.split(col, "\n", -1)


def rewrite_matches(
    col: Column,
    pattern: str,
    on_match: Callable[[Column], Column],
    on_gap: Callable[[Column], Column] | None = None,
) -> Column:
    """Replace each match of ``pattern`` by an expression of the matched text.

    The text is cut into gaps and matches with the same pattern and put together
    again, so the rewritten text is never searched a second time and no marker
    character is needed.
    """
    gaps = F.split(col, pattern, -1)
    hits = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
    gap_text = on_gap or (lambda gap: gap)
    joined = F.zip_with(
        gaps,
        hits,
        lambda gap, hit: F.concat(
            gap_text(gap), F.when(hit.isNotNull(), on_match(hit)).otherwise("")
        ),
    )
    return F.array_join(joined, "")


def scan(items: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running fold over an array: one ``o`` per element.

    ``first`` is the starting state, a struct with a field ``o``; ``step(state, x)``
    returns the next state of the same type. The array is folded in chunks, so
    the growing output is copied per chunk and long arrays stay cheap.
    """
    n_chunks = F.ceil(F.size(items) / F.lit(_SCAN_CHUNK)).cast("int")
    chunks = F.when(
        F.size(items) > 0,
        F.transform(
            F.sequence(F.lit(0), n_chunks - 1),
            lambda i: F.slice(items, i * _SCAN_CHUNK + 1, F.lit(_SCAN_CHUNK)),
        ),
    ).otherwise(F.slice(F.array(items), 1, 0))

    # the output lags one step behind the state, so no value is computed twice
    empty = F.slice(F.array(first["o"]), 1, 0)

    def fold_chunk(start: Column, chunk: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(start.alias("st"), empty.alias("out")),
            lambda acc, x: F.struct(
                step(acc["st"], x).alias("st"),
                F.array_append(acc["out"], acc["st"]["o"]).alias("out"),
            ),
        )

    return F.aggregate(
        chunks,
        F.struct(first.alias("st"), F.slice(F.array(empty), 1, 0).alias("outs")),
        lambda acc, chunk: let(
            fold_chunk(acc["st"], chunk),
            lambda done: F.struct(
                done["st"].alias("st"),
                F.array_append(acc["outs"], done["out"]).alias("outs"),
            ),
        ),
        lambda acc: F.slice(
            F.array_append(F.flatten(acc["outs"]), acc["st"]["o"]), F.lit(2), F.size(F.flatten(acc["outs"]))
        ),
    )


def scan_bound(items: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``scan`` over an array expression that must be computed only once."""
    return let(items, lambda bound: scan(bound, first, step))
