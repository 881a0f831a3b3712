"""Unique names under the conflict rules, computed without a sequential pass.

Requests are handled in ``seq`` order. Under ``suffix`` a taken name ``x`` becomes
the first free of ``x-2``, ``x-3``, ... . Two requests can only meet in one of two
ways: they ask for the same name, or one asks for ``x`` and the other for ``x-k``.

* Same name: the place of a request among its equals is a running count, taken in
  blocks so that a name asked for by a third of all pages is spread over many tasks.
* ``x`` against ``x-k``: only the distinct names ``x-k`` matter, not their rows. Such
  a name is free for its first own request unless the overflow of ``x`` got there
  before. Whether it did depends on how many smaller siblings keep their names, so
  each sibling is a step that maps the number kept so far. Steps are composed per
  block of siblings, all blocks at once; one pass along the blocks of a parent gives
  the number each block starts from. What stays open depends on whether ``x`` itself
  keeps its name, which is asked up the nesting of ``-k-k``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.staging import stage
from .reserving import FAMILY, first_kept, free_places, numbered_one_by_one, root_of
from .running import block_of, carry, join_by_block, range_of, running_total

CONFLICT_MODES = ("suffix", "overwrite", "skip")
NAME = ["stem", "ext"]
PARENT = ["parent", "ext"]
# Numbers of siblings in one block of steps.
SIBLINGS = 256

# A tail a suffix counter can produce: 2, 3, ... without leading zeros.
_TAIL = r"^([\s\S]*)-([2-9]|[1-9][0-9]{1,17})$"
# Above every number of siblings: the bar of a name that is taken from the start.
_ALWAYS = 1 << 62

NOTE_NAME_PARTS = r"^([\s\S]+)(\.[^.]+)$"
IMAGE_NAME_PARTS = r"^([\s\S]*)(\.[^.]*)$"


def split_name(name: Column, parts: str) -> tuple[Column, Column]:
    """Stem and extension (with its dot); a name without one is all stem."""
    has_ext = name.rlike(parts)
    return (
        F.when(has_ext, F.regexp_extract(name, parts, 1)).otherwise(name).alias("stem"),
        F.when(has_ext, F.regexp_extract(name, parts, 2)).otherwise("").alias("ext"),
    )


def assign_note_paths(notes: DataFrame, catalogue: DataFrame | None, conflict: str = "suffix") -> DataFrame:
    """(seq, name) -> (seq, name, path, action, final).

    ``catalogue`` holds the paths of earlier runs. ``seq`` is the input order: whole
    numbers, unique, however far apart. ``action`` is new, suffixed, overwrite or skip; ``path`` is null for
    skip; ``final`` marks the request whose content ends up under the path.
    """
    requests = notes.select(
        "seq", F.col("seq").cast("bigint").alias("place"), "name", *split_name(F.col("name"), NOTE_NAME_PARTS)
    )
    taken = None
    if catalogue is not None:
        taken = catalogue.select(*split_name(F.col("path"), NOTE_NAME_PARTS))
    named = assign_names(requests, taken, conflict)
    return named.select("seq", "name", F.col("assigned").alias("path"), "action", "final")


def assign_names(requests: DataFrame, taken: DataFrame | None, conflict: str) -> DataFrame:
    """Add ``assigned``, ``action`` and ``final`` to requests (seq, place, stem, ext, ...).

    ``seq`` orders the requests; ``place``, a whole number that grows with it, cuts them into ranges. With a boolean
    column ``saved`` the requests of one ``place`` are a page, and a name that is not saved is free on the next page.
    """
    if conflict not in CONFLICT_MODES:
        raise ValueError(f"unknown conflict mode: {conflict}")
    requests = stage(requests)
    ranges = range_of(requests, "place")
    block = None if ranges is None else "block"
    requests = requests.withColumn("block", F.lit(0).cast("bigint") if ranges is None else ranges)
    if taken is None:
        taken = requests.sparkSession.createDataFrame([], "stem string, ext string, cat boolean")
    else:
        taken = stage(taken.distinct().withColumn("cat", F.lit(True)))
    may_fail = "saved" in requests.columns
    if conflict == "suffix":
        return _suffixed_or_failed(requests, taken, block) if may_fail else _suffixed(requests, taken, block)
    if conflict == "skip" and may_fail:
        requests = stage(first_kept(requests, block))
    ranked = _ranked(requests, block, taken)
    own = F.concat("stem", "ext")
    fresh = (F.col("rank") == 1) & ~F.col("cat")
    if conflict == "overwrite":
        return ranked.select(
            *requests.columns,
            own.alias("assigned"),
            F.when(fresh, F.lit("new")).otherwise("overwrite").alias("action"),
            (F.col("rank") == F.col("total")).alias("final"),
        )
    if may_fail:
        fresh = F.col("fresh") & ~F.col("cat")
    return ranked.select(
        *[c for c in requests.columns if c != "fresh"],
        F.when(fresh, own).alias("assigned"),
        F.when(fresh, F.lit("new")).otherwise("skip").alias("action"),
        fresh.alias("final"),
    )


def _ranked(requests: DataFrame, block: str | None, *flags: DataFrame) -> DataFrame:
    """Add ``rank`` (1, 2, ... per name in seq order), ``total`` and boolean flags known per name.

    Flags join the per-block counts, not the requests, so a hot name joins once per block. ``block`` is None where all
    requests are in one.
    """
    if block is None:
        name = Window.partitionBy(*NAME)
        ranked = requests.withColumn("rank", F.row_number().over(name.orderBy("seq"))).withColumn("total", F.count("*").over(name))
        for flag in flags:
            column = next(c for c in flag.columns if c not in NAME)
            ranked = ranked.join(flag, NAME, "left").withColumn(column, F.coalesce(column, F.lit(False)))
        return ranked
    inside = Window.partitionBy(*NAME, "block").orderBy("seq")
    local = requests.withColumn("_local", F.row_number().over(inside))
    counts = carry(requests.groupBy(*NAME, "block").agg(F.count("*").alias("_sum")), NAME, "block")
    names: list[str] = []
    for flag in flags:
        column = next(c for c in flag.columns if c not in NAME)
        counts = counts.join(flag, NAME, "left").withColumn(column, F.coalesce(column, F.lit(False)))
        names.append(column)
    return (
        local.join(counts.select(*NAME, "block", "_before", "_total", *names), [*NAME, "block"])
        .withColumn("rank", F.col("_local") + F.col("_before"))
        .withColumnRenamed("_total", "total")
        .drop("_local", "_before")
    )


def _tail_parent(stem: Column) -> Column:
    return F.regexp_extract(stem, _TAIL, 1)


def _tail_number(stem: Column) -> Column:
    return F.regexp_extract(stem, _TAIL, 2).try_cast("bigint")


def _contested(requests: DataFrame, taken: DataFrame) -> DataFrame:
    """Distinct names ``x-k`` (asked for or taken) whose parent ``x`` may overflow as far as ``k``.

    Overflow never passes the number of requests for the parent and of its siblings together.
    Columns: stem, ext, parent, k, k_block, cat, first_seq, first_block.
    """
    has_tail = F.col("stem").rlike(_TAIL)
    asked = (
        requests.filter(has_tail)
        .groupBy(*NAME)
        .agg(F.min("seq").alias("first_seq"), F.min_by("block", "seq").alias("first_block"))
    )
    kids = asked.join(taken.filter(has_tail), NAME, "full_outer").select(
        *NAME,
        _tail_parent(F.col("stem")).alias("parent"),
        _tail_number(F.col("stem")).alias("k"),
        F.floor(_tail_number(F.col("stem")) / SIBLINGS).cast("bigint").alias("k_block"),
        F.coalesce("cat", F.lit(False)).alias("cat"),
        "first_seq",
        "first_block",
    )
    parents = (
        requests.groupBy(*NAME)
        .agg(F.count("*").alias("n"))
        .join(taken, NAME, "left")
        .filter((F.col("n") > 1) | F.col("cat") | has_tail)
        .select(F.col("stem").alias("parent"), "ext", "n")
    )
    siblings = kids.groupBy(*PARENT).agg(F.count("*").alias("siblings"))
    reach = parents.join(siblings, PARENT).select(*PARENT, (F.col("n") + F.col("siblings") + 1).alias("reach"))
    return (
        join_by_block(kids, reach, PARENT, "k_block", "inner")
        .filter(F.col("k") <= F.col("reach"))
        .select(*NAME, "parent", "k", "k_block", "cat", "first_seq", "first_block")
    )


def _with_requests_before(kids: DataFrame, requests: DataFrame, taken: DataFrame, block: str | None) -> DataFrame:
    """Add ``before``: requests for the parent ahead of the first one for the kid."""
    marks = kids.filter(F.col("first_seq").isNotNull()).select(
        F.col("parent").alias("stem"),
        "ext",
        F.col("first_block").alias("block"),
        F.col("first_seq").alias("seq"),
        F.lit(0).alias("one"),
        F.col("stem").alias("kid"),
    )
    # parents are matched per block of requests, so a hot name is joined once per block
    parents = kids.select(F.col("parent").alias("stem"), "ext").distinct()
    if block is None:
        wanted = requests.join(parents, NAME, "left_semi")
    else:
        blocks = requests.select(*NAME, "block").distinct().join(parents, NAME, "left_semi")
        wanted = requests.join(blocks, [*NAME, "block"], "left_semi")
    asked = wanted.select(
        *NAME, "block", "seq", F.lit(1).alias("one"), F.lit(None).cast("string").alias("kid")
    )
    counted = (
        running_total(marks.unionByName(asked), NAME, block, ["seq"], "one", "before")
        .filter(F.col("kid").isNotNull())
        .select(F.col("kid").alias("stem"), "ext", "before")
    )
    parent_cat = taken.select(F.col("stem").alias("parent"), "ext", F.col("cat").alias("parent_cat"))
    return (
        join_by_block(kids.join(counted, NAME, "left"), parent_cat, PARENT, "k_block")
        .select(
            *NAME,
            "parent",
            "k",
            "k_block",
            "cat",
            F.coalesce("before", F.lit(0)).alias("before"),
            F.coalesce("parent_cat", F.lit(False)).alias("parent_cat"),
        )
    )


def _steps(kids: DataFrame) -> DataFrame:
    """One row per block of a parent's numbers: its kids in order, and two arrays of bars.

    A kid keeps its name if fewer siblings below the block keep theirs than its bar says. The bars of a
    block are found one kid after the other from the step rule: with ``h`` siblings kept so far, kid ``k``
    keeps its name if it is taken already or ``h < k - 1 - overflow``, where the overflow of the parent
    before the kid's first request is one less if the parent keeps its own name (``bars1``) than if it
    does not (``bars0``). Seen from the start of the block, the kid's condition is a bar on ``h`` there:
    the number that is as many places up among the numbers no earlier kid has a bar at.
    """
    kid = F.struct("k", "stem", "cat", "before", "parent_cat")
    blocks = kids.groupBy(*PARENT, "k_block").agg(F.sort_array(F.collect_list(kid)).alias("kids"))  # at most SIBLINGS

    def bars(own: int) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("sorted"), F.array().cast("array<bigint>").alias("bars"))

        def step(state: Column, kid: Column) -> Column:
            size = F.size(state["sorted"]).cast("bigint")
            overflow = F.greatest(kid["before"] - own, F.lit(0))
            places = kid["k"] - 1 - overflow - size
            lower = F.size(F.filter(state["sorted"], lambda bar, i: bar - (i + 1) < places))
            place = F.when(kid["cat"], size.cast("int")).otherwise(lower)
            bar = F.when(kid["cat"], F.lit(_ALWAYS) + size).otherwise(places + lower)
            new = F.concat(
                F.slice(state["sorted"], F.lit(1), place), F.array(bar), F.slice(state["sorted"], place + 1, F.size(state["sorted"]))
            )
            never = ~kid["cat"] & (places <= 0)
            return F.struct(
                F.when(never, state["sorted"]).otherwise(new).alias("sorted"),
                F.array_append(state["bars"], F.when(never, F.lit(0).cast("bigint")).otherwise(bar)).alias("bars"),
            )

        return F.aggregate("kids", start, step)["bars"]

    return blocks.withColumn("bars0", bars(0)).withColumn("bars1", bars(1))


def _along_blocks() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walk rows (parent, ext, k_block, bars0, bars1) in order: how many siblings below each block keep their names.

    Only the numbers so far are held. A closure, so that workers need not import this package.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        key, kept = None, [0, 0]
        for batch in batches:
            parents, exts = batch.column("parent").to_pylist(), batch.column("ext").to_pylist()
            out: list[list[int]] = [[], []]
            bars = [batch.column(name) for name in ("bars0", "bars1")]
            for row, this in enumerate(zip(parents, exts, strict=True)):
                if this != key:
                    key, kept = this, [0, 0]
                for own in (0, 1):
                    out[own].append(kept[own])
                    kept[own] += int((np.asarray(bars[own][row].values) > kept[own]).sum())
            columns = [batch.column("parent"), batch.column("ext"), batch.column("k_block"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["parent", "ext", "k_block", "kept0", "kept1"])

    return walk


def _settle(kids: DataFrame) -> DataFrame:
    """Add ``held``: the name is not available to the parent's overflow when that comes by."""
    blocks = stage(_steps(kids))
    bars = blocks.select(*PARENT, "k_block", "bars0", "bars1").withColumn(
        "blocks", F.count("*").over(Window.partitionBy(*PARENT))
    )
    # a parent's blocks pass one task as a stream, eight bytes for each number its overflow can meet
    walked = bars.filter(F.col("blocks") > 1).drop("blocks").repartition(*PARENT).sortWithinPartitions(*PARENT, "k_block")
    kept = walked.mapInArrow(_along_blocks(), "parent string, ext string, k_block bigint, kept0 bigint, kept1 bigint")
    each = blocks.join(kept, [*PARENT, "k_block"], "left").select(
        *PARENT, "k_block", "kept0", "kept1", F.explode(F.arrays_zip("kids", "bars0", "bars1")).alias("x")
    )
    facts = stage(
        each.select(
            F.col("x.kids.stem").alias("stem"),
            "ext",
            "parent",
            F.col("x.kids.k").alias("k"),
            "k_block",
            F.col("x.kids.cat").alias("cat"),
            F.col("x.kids.parent_cat").alias("parent_cat"),
            (F.coalesce("kept0", F.lit(0)) < F.col("x.bars0")).alias("held0"),
            (F.coalesce("kept1", F.lit(0)) < F.col("x.bars1")).alias("held1"),
        )
    )
    return _down_the_nesting(facts)


def _down_the_nesting(facts: DataFrame) -> DataFrame:
    """Replace ``held0`` and ``held1`` by ``held``, as the parent gets its own name or not.

    A parent that is no sibling of another itself has its name unless it is taken. Others are asked in rounds, as
    many as ``-k-k`` are nested among the few names for which it matters.
    """

    def answered(rows: DataFrame, own: Column) -> DataFrame:
        return rows.select(*NAME, "parent", "k", "k_block", "cat", F.when(own, F.col("held1")).otherwise(F.col("held0")).alias("held"))

    differs = F.col("held0") != F.col("held1")
    settled = answered(facts.filter(~differs), F.lit(True))
    names = facts.select(F.col("stem").alias("parent"), "ext", F.lit(True).alias("nested"))
    waiting = stage(join_by_block(facts.filter(differs), names, PARENT, "k_block"))
    settled = settled.unionByName(answered(waiting.filter(F.col("nested").isNull()), ~F.col("parent_cat")))
    waiting = waiting.filter("nested").drop("nested")
    while not waiting.isEmpty():
        own = settled.select(F.col("stem").alias("parent"), "ext", (F.col("held") & ~F.col("cat")).alias("own"))
        met = stage(join_by_block(waiting, own, PARENT, "k_block"))
        settled = settled.unionByName(answered(met.filter(F.col("own").isNotNull()), F.col("own")))
        waiting = met.filter(F.col("own").isNull()).drop("own")
    return settled


def _suffixed_or_failed(requests: DataFrame, taken: DataFrame, block: str | None) -> DataFrame:
    """``_suffixed`` where some requests are not saved: three ways, by what happens in a family of names."""
    requests = requests.withColumn("root", root_of(F.col("stem")))
    failing = stage(requests.filter(~F.col("saved")).select(*FAMILY).distinct().withColumn("fails", F.lit(True)))
    if failing.isEmpty():
        return _suffixed(requests.drop("root"), taken, block)
    met = _contested(requests, taken).filter(F.col("first_seq").isNotNull()).select(root_of(F.col("stem")).alias("root"), "ext").distinct()
    families = stage(failing.join(met.withColumn("meets", F.lit(True)), FAMILY, "left"))
    split = stage(join_by_block(requests, families, FAMILY, block))
    alone = split.filter(F.coalesce("meets", F.lit(False))).drop("fails", "meets")
    split = split.filter(F.col("meets").isNull())
    placed = free_places(split.filter("fails").drop("root", "fails", "meets"))
    safe = split.filter(F.col("fails").isNull()).drop("root", "fails", "meets").withColumn("index", F.lit(None).cast("bigint"))
    named = _suffixed(stage(safe.unionByName(placed)), taken, block).drop("index")
    return named.unionByName(_with_paths(numbered_one_by_one(alone, taken), [c for c in requests.columns if c != "root"]))


def _with_paths(numbered: DataFrame, columns: list[str]) -> DataFrame:
    """Add what ``number`` (null for the plain name) makes of each request."""
    return numbered.select(
        *columns,
        F.when(F.col("number").isNull(), F.concat("stem", "ext"))
        .otherwise(F.concat("stem", F.lit("-"), F.col("number").cast("string"), "ext"))
        .alias("assigned"),
        F.when(F.col("number").isNull(), F.lit("new")).otherwise("suffixed").alias("action"),
        F.lit(True).alias("final"),
    )


def _suffixed(requests: DataFrame, taken: DataFrame, block: str | None) -> DataFrame:
    contested = stage(_contested(requests, taken))
    any_contested = not contested.isEmpty()
    lost = taken.select(*NAME, F.lit(True).alias("lost"))
    if any_contested:
        settled = _settle(_with_requests_before(contested, requests, taken, block))
        lost = lost.unionByName(settled.filter(~F.col("held")).select(*NAME, F.lit(True).alias("lost"))).distinct()
        held = settled.filter("held").select(F.col("parent").alias("stem"), "ext", "k", "k_block")
        parents = held.select(*NAME).distinct().withColumn("crowded", F.lit(True))
        ranked = _ranked(requests, block, lost, parents)
    else:
        ranked = _ranked(requests, block, lost).withColumn("crowded", F.lit(False))
    if "index" in requests.columns:  # place among the free numbers, where some are given back
        ranked = ranked.withColumn("rank", F.coalesce("index", "rank"))
    # j-th request that cannot have the plain name; 0 for the one that can
    ranked = ranked.withColumn("j", F.col("rank") - F.when(F.col("lost"), 0).otherwise(1))
    plain = ranked.filter((F.col("j") == 0) | ~F.col("crowded")).withColumn(
        "number", F.when(F.col("j") > 0, F.col("j") + 1)
    )
    numbered = plain
    if any_contested:
        crowded = ranked.filter((F.col("j") > 0) & F.col("crowded"))
        numbered = plain.unionByName(_around_held(crowded, held))
    return _with_paths(numbered, requests.columns)


def _around_held(crowded: DataFrame, held: DataFrame) -> DataFrame:
    """Add ``number``: the j-th integer from 2 on that is not held.

    The i-th held number k has k - 1 - i free ones before it; the j-th free number is
    j + 1 plus the count of held ones with fewer than j free ones before them.
    """
    placed = running_total(
        held.withColumn("one", F.lit(1)),
        NAME,
        "k_block",
        ["k"],
        "one",
        "i",
    )
    steps = (
        placed.withColumn("j", F.col("k") - F.col("i"))
        .groupBy(*NAME, "j")
        .agg(F.count("*").alias("one"))
        .withColumn("side", F.lit(0))
    )
    rows = crowded.withColumn("one", F.lit(0).cast("bigint")).withColumn("side", F.lit(1))
    both = rows.unionByName(steps, allowMissingColumns=True).withColumn("j_block", block_of(F.col("j")))
    return (
        running_total(both, NAME, "j_block", ["j", "side", "seq"], "one", "skipped")
        .filter(F.col("side") == 1)
        .withColumn("number", F.col("j") + 1 + F.col("skipped"))
        .drop("one", "side", "j_block", "skipped")
    )
