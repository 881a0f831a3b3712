"""Names of files that may fail to be saved.

A name given to a file that is not saved stays reserved for the rest of its page and is free again on the next one.
So the free numbers of a name have holes, and a page's n-th request for it gets the n-th free number.

* A page that saves some of its requests maps places among the numbers free after it to places among those free before
  it: place ``i`` moves up by the saved ones at or below it. Such maps are composed per (name, range of pages), all
  ranges at once; one pass along the ranges of a name gives the map each starts from; then every range numbers its own
  rows. A map is a short table and a shift: the table is shorter than a page's requests for one name.
* Where a family of names both fails and asks for ``x-k`` by itself, the two rules meet in ways no map covers. Its rows
  pass one task as a stream, in order; what is held are the taken numbers of the family, as ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.staging import stage
from .running import join_by_block

NAME = ["stem", "ext"]
FAMILY = ["root", "ext"]
_TAILS = r"(?:-(?:[2-9]|[1-9][0-9]{1,17}))+$"

Walk = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def root_of(stem: Column) -> Column:
    """The stem without its numeric tails: what all names that can meet have in common."""
    return F.regexp_replace(stem, _TAILS, "")


def first_kept(requests: DataFrame, block: str | None) -> DataFrame:
    """Add ``fresh`` under the rule that a taken name is skipped.

    The first request of a page gets the name, up to and including the first page where that request is saved.
    """
    on_page = F.row_number().over(Window.partitionBy(*NAME, "place").orderBy("seq"))
    opening = requests.withColumn("opens", on_page == 1)
    until = opening.filter(F.col("opens") & F.col("saved")).groupBy(*NAME).agg(F.min("place").alias("until"))
    joined = join_by_block(opening, until, NAME, block)
    return joined.withColumn("fresh", F.col("opens") & (F.col("until").isNull() | (F.col("place") <= F.col("until")))).drop("opens", "until")


def _along_pages(measure: bool) -> Walk:
    """Walk rows in (stem, ext, block, place, seq) order.

    ``measure`` emits one row (stem, ext, block, table, shift) per name and range: the composed map of its pages.
    Otherwise every row comes with ``start`` (the map its range starts from) and leaves with ``index``, the number of
    its place among all numbers of the name, from 1.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        key = page = None
        table: list[int] = []
        shift, here, saved = 0, 0, []
        names = ["stem", "ext", "block", "table", "shift"]
        types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()]

        def placed(i: int) -> int:
            return table[i - 1] if i <= len(table) else i + shift

        def close_page() -> None:
            nonlocal table, shift, here, saved
            if saved:
                gone = set(saved)
                free = [i for i in range(1, saved[-1]) if i not in gone]
                size = max(len(free), len(table) - len(saved))
                moved = [placed(free[i - 1] if i <= len(free) else i + len(saved)) for i in range(1, size + 1)]
                shift += len(saved)
                while moved and moved[-1] == len(moved) + shift:
                    moved.pop()
                table = moved
            here, saved = 0, []

        for batch in batches:
            done: list[tuple] = []
            index: list[int] = []
            columns = [batch.column(n).to_pylist() for n in ("stem", "ext", "block", "place", "saved")]
            starts = None if measure else batch.column("start").to_pylist()
            for row, (stem, ext, block, place, kept) in enumerate(zip(*columns, strict=True)):
                if (stem, ext, block) != key:
                    close_page()
                    if measure and key is not None:
                        done.append((*key, table, shift))
                    key, page = (stem, ext, block), place
                    start = starts[row] if starts else None
                    table, shift = (list(start["table"]), start["shift"]) if start else ([], 0)
                elif place != page:
                    close_page()
                    page = place
                here += 1
                index.append(placed(here))
                if kept:
                    saved.append(here)
            if measure:
                yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names)
            else:
                rest = [n for n in batch.schema.names if n != "start"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(index, pa.int64())], [*rest, "index"])
        if measure and key is not None:
            close_page()
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, table, shift), types, strict=True)], names)

    return walk


def _along_ranges() -> Walk:
    """Walk maps (stem, ext, block, table, shift) in order; each leaves with the map of all ranges before it."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        key = None
        table: list[int] = []
        shift = 0
        for batch in batches:
            starts: list[dict] = []
            columns = [batch.column(n).to_pylist() for n in ("stem", "ext", "table", "shift")]
            for stem, ext, own, add in zip(*columns, strict=True):
                if (stem, ext) != key:
                    key, table, shift = (stem, ext), [], 0
                starts.append({"table": table, "shift": shift})
                size = max(len(own), len(table) - add)
                inner = [own[i - 1] if i <= len(own) else i + add for i in range(1, size + 1)]
                table = [table[i - 1] if i <= len(table) else i + shift for i in inner]
                shift += add
            kind = pa.struct([("table", pa.list_(pa.int64())), ("shift", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("stem"), batch.column("ext"), batch.column("block"), pa.array(starts, kind)], ["stem", "ext", "block", "start"]
            )

    return walk


def free_places(requests: DataFrame) -> DataFrame:
    """Add ``index``: the place of each request among all numbers of its name, 1 for the plain name.

    ``requests`` (seq, place, block, saved, stem, ext, ...) is staged; no other name of its families is asked for.
    """
    ranges = [*NAME, "block"]
    order = [*ranges, "place", "seq"]
    small = requests.select(*order, "saved").repartition(*ranges).sortWithinPartitions(*order)
    maps = stage(small.mapInArrow(_along_pages(True), "stem string, ext string, block bigint, table array<bigint>, shift bigint"))
    # one row for each range of a name, at most as many as there are ranges
    starts = maps.repartition(*NAME).sortWithinPartitions(*ranges).mapInArrow(
        _along_ranges(), "stem string, ext string, block bigint, start struct<table: array<bigint>, shift: bigint>"
    )
    rows = requests.join(starts, ranges).select(*requests.columns, "start").repartition(*ranges).sortWithinPartitions(*order)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema.fields)
    return stage(rows.mapInArrow(_along_pages(False), f"{fields}, index bigint"))


def _one_by_one(columns: list[str]) -> Walk:
    """Walk the rows of whole families in order: names taken before (``seq`` null), then requests."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from bisect import bisect_right

        import pyarrow as pa

        tail = re.compile(r"([\s\S]*)-([2-9]|[1-9][0-9]{1,17})")
        taken: dict[str, tuple[list[int], list[int]]] = {}  # numbers taken for good: starts and ends of ranges
        reserved: set[tuple[str, int]] = set()  # numbers given out on this page
        family = page = None

        def place_of(stem: str) -> tuple[str, int]:
            parts = tail.fullmatch(stem)
            return (parts[1], int(parts[2])) if parts else (stem, 1)

        def is_taken(base: str, number: int) -> bool:
            starts, ends = taken.get(base, ((), ()))
            at = bisect_right(starts, number) - 1
            return (base, number) in reserved or (at >= 0 and number <= ends[at])

        def take(base: str, number: int) -> None:
            starts, ends = taken.setdefault(base, ([], []))
            at = bisect_right(starts, number)
            if at and number <= ends[at - 1]:
                return
            if at and ends[at - 1] == number - 1:
                ends[at - 1] = number
                at -= 1
            else:
                starts.insert(at, number)
                ends.insert(at, number)
            if at + 1 < len(starts) and starts[at + 1] == ends[at] + 1:
                ends[at] = ends[at + 1]
                del starts[at + 1], ends[at + 1]

        def next_free(base: str) -> int:
            number = 2
            for start, end in zip(*taken.get(base, ((), ())), strict=True):
                while number < start:
                    if (base, number) not in reserved:
                        return number
                    number += 1
                number = max(number, end + 1)
            while (base, number) in reserved:
                number += 1
            return number

        for batch in batches:
            keep, number_of, place_names = [], [], [batch.column(n).to_pylist() for n in ("root", "stem", "ext", "place", "saved")]
            is_request = batch.column("seq").is_valid().to_pylist()
            for row, (root, stem, ext, place, saved) in enumerate(zip(*place_names, strict=True)):
                if (root, ext) != family:
                    family, page = (root, ext), None
                    taken.clear()
                    reserved.clear()
                if not is_request[row]:
                    take(*place_of(stem))
                    continue
                if place != page:
                    page = place
                    reserved.clear()
                own = place_of(stem)
                number = None
                if is_taken(*own):
                    number = next_free(stem)
                    own = (stem, number)
                reserved.add(own)
                if saved:
                    take(*own)
                keep.append(row)
                number_of.append(number)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in columns), pa.array(number_of, pa.int64())], [*columns, "number"])

    return walk


def numbered_one_by_one(requests: DataFrame, taken: DataFrame) -> DataFrame:
    """Add ``number`` to the requests (root, seq, place, saved, stem, ext, ...) of whole families; null: the plain name."""
    columns = [c for c in requests.columns if c != "root"]
    held = taken.select(*NAME).withColumn("root", root_of(F.col("stem")))
    held = held.join(requests.select(*FAMILY).distinct(), FAMILY, "left_semi")
    rows = requests.unionByName(held, allowMissingColumns=True).withColumn("later", F.col("seq").isNotNull())
    rows = rows.repartition(*FAMILY).sortWithinPartitions(*FAMILY, "later", "place", "seq").drop("later")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema.fields if f.name != "root")
    return rows.mapInArrow(_one_by_one(columns), f"{fields}, number bigint")
