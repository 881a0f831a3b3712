"""Running totals that stay parallel when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Numbers that are dense by themselves (ranks, counters) are taken in blocks of this many.
BLOCK_ROWS = 65_536
# Any other order is cut at quantiles: into ranges of this many rows, but at most RANGES of them.
RANGE_ROWS = 16_384
RANGES = 1_024
_CHUNK = 32


def running_total(
    rows: DataFrame, keys: list[str], block: str | None, order: list[str], value: str, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same key up to and including this one.

    ``block`` must grow with ``order``; None says that all rows are in one. Each (key, block) is summed on its own; only
    one number per block is carried along the key, so a hot key is spread over
    many tasks and never sorted in one.
    """
    if block is None:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(out, F.sum(value).over(whole))
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum(value).over(inside))
    carried = carry(rows.groupBy(*keys, block).agg(F.sum(value).alias("_sum")), keys, block)
    return (
        local.join(carried.select(*keys, block, "_before"), [*keys, block])
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_local", "_before")
    )


def carry(sums: DataFrame, keys: list[str], block: str) -> DataFrame:
    """Add ``_before`` (sum over earlier blocks) and ``_total`` (over all blocks) of each key."""
    key = Window.partitionBy(*keys)
    earlier = key.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).withColumn(
        "_total", F.sum("_sum").over(key)
    )


def join_by_block(rows: DataFrame, facts: DataFrame, keys: list[str], block: str | None, how: str = "left") -> DataFrame:
    """Join one fact row per key to many rows of that key, a hot key once per block."""
    if block is None:
        return rows.join(facts, keys, how)
    per_block = rows.select(*keys, block).distinct().join(facts, keys, how)
    return rows.join(per_block, [*keys, block], how)


def block_of(order: Column) -> Column:
    return F.floor(order / BLOCK_ROWS).cast("bigint")


def range_of(rows: DataFrame, order: str) -> Column | None:
    """The number of the range that ``order`` (a whole number) lies in; ranges hold about equally many of ``rows``.

    The bounds are quantiles of ``rows``, so they follow the values wherever these lie: ids need not be dense, and may
    come from a hash. Only the bounds, fewer than ``RANGES``, reach the driver. What lies under a bound is not counted
    from the quantiles: all that is built on ranges counts its rows exactly. Nulls are in the first range. None stands
    for a single range, where nothing is to be carried from one to the next.
    """
    size = rows.count()
    wanted = min(RANGES, -(-size // RANGE_ROWS))
    if wanted < 2:
        return None
    steps = F.array(*[F.lit(k / wanted) for k in range(1, wanted)])
    found = rows.agg(F.percentile_approx(order, steps, F.lit(10 * RANGES)).alias("at")).first()["at"] or []
    bounds = sorted(set(found))
    if not bounds:
        return None
    # two short scans instead of a long one: first the chunk of bounds, then the place in it
    chunks = [bounds[k : k + _CHUNK] for k in range(0, len(bounds), _CHUNK)]
    value = F.col(order)

    def passed(bound: Column) -> Column:
        return bound <= value

    def literal(numbers: list[int]) -> Column:
        return F.array(*[F.lit(n).cast("bigint") for n in numbers])

    chunk = F.size(F.filter(literal([c[0] for c in chunks]), passed))
    inside = F.size(F.filter(F.element_at(F.array(*[literal(c) for c in chunks]), chunk), passed))
    return F.when(value < bounds[0], F.lit(0)).otherwise(F.coalesce((chunk - 1) * _CHUNK + inside, F.lit(0))).cast("bigint")
