"""How filters interact: what each removes at each place of each order.

A text becomes one mask of the filters it fails. All that follows works on cells, the counts of rows by part and mask. A
recursive query walks the orders: it starts from the masks that occur, extends every prefix by each filter that is not
in it yet, and carries the bits applied; the rows of a level say what that step does to the rows of each mask. They do
not depend on the size of the table: at most 32 masks times 325 prefixes, for five filters. The cells weigh them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagequill.llm.staging import stage

WHITE = r"[\x20\x09-\x0D]+"

STEPS = """
WITH RECURSIVE steps(mask, prefix, applied, bit) AS (
  SELECT DISTINCT mask, '', 0, 0 FROM {cells}
  UNION ALL
  SELECT s.mask, concat(s.prefix, f.letter), s.applied | s.bit, f.bit
  FROM steps s LATERAL VIEW inline(filter({filters}, f -> ((s.applied | s.bit) & f.bit) = 0)) f
)
SELECT mask, prefix, right(prefix, 1) AS letter, length(prefix) AS step,
  CAST(mask & (applied | bit) = 0 AS INT) AS kept,
  CAST(mask & bit <> 0 AND mask & applied = 0 AS INT) AS removed,
  CAST(mask & bit <> 0 AND mask & applied <> 0 AS INT) AS redundant,
  CAST(mask = bit AS INT) AS only
FROM steps WHERE prefix <> ''
"""

ORDERS = """
WITH RECURSIVE orders(filter_order, applied) AS (
  SELECT '', 0
  UNION ALL
  SELECT concat(o.filter_order, f.letter), o.applied | f.bit
  FROM orders o LATERAL VIEW inline(filter({filters}, f -> (o.applied & f.bit) = 0)) f
)
SELECT filter_order, step, left(filter_order, step) AS prefix
FROM orders LATERAL VIEW explode(sequence(1, {size})) AS step WHERE length(filter_order) = {size}
"""


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone, by letter."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 80,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, mask, n, good, toxic)``: rows by part and by the set of filters they fail, bit 0 for A to bit 4 for E.

    A row fails E if a row of a smaller id has the same text. Rows of null ids are neither smaller nor larger, and have
    no labels. An id labelled more than once is good or toxic if one of its labels says so.

    No row is joined to its group of copies. Rows are counted by text digest, id, part and labels first, which spreads a
    hot text over its ids; then by digest, part and labels, after partial counts; the rows at the smallest id are known
    in each of these groups, and the smallest of the groups of a digest decides. A window holds the groups of one text:
    as many as parts and labels differ.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mask = sum((fails.cast("int") * 2**k for k, fails in enumerate(text_failures(F.col("text")).values())), F.lit(0))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), text.alias("text"))
    rows = read.select("id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), mask.alias("mask"))
    rows = rows.select("id", "part", F.unhex("digest").alias("digest"), "mask")
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))

    def flag(name: str) -> Column:
        return F.max((F.col(name) == 1).cast("int")).alias(name)

    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    marks = marks.agg(flag("quality"), flag("toxic")).withColumn("spread", F.lit(0).cast("long"))
    # a null id meets no label; its digest spreads such rows
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0))
    rows = rows.join(marks, ["id", "spread"], "left").select(
        "id", "part", "digest", "mask", "n", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("bad")
    )
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    nulls = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nulls")
    groups = rows.groupBy("digest", "part", "mask", "good", "bad").agg(F.sum("n").alias("n"), first, nulls)
    smallest = F.min("first.id").over(Window.partitionBy("digest"))
    at_first = F.when(F.col("first.id") == smallest, F.col("first.n")).otherwise(0)
    groups = groups.withColumn("unique", F.col("nulls") + at_first)
    sides = F.array(
        F.struct(F.col("mask"), F.col("unique").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("unique")).alias("n")),
    )
    split = groups.select("part", "good", "bad", F.explode(F.filter(sides, lambda s: s["n"] > 0)).alias("side"))
    n = F.col("side.n")
    return split.groupBy("part", F.col("side.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("bad")).alias("toxic")
    )


def audit_orders(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``.

    ``cells`` (part, mask, n, good, toxic) is staged, as every level of the recursion reads it. One row for each part,
    order of all ``letters`` and step, zeros included. ``shapley`` sums what the step's filter removes over all orders.
    """
    spark = cells.sparkSession
    filters = "array(" + ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << k})" for k, c in enumerate(letters)) + ")"
    steps = spark.sql(STEPS.replace("{filters}", filters), cells=cells)
    orders = spark.sql(ORDERS.replace("{filters}", filters).replace("{size}", str(len(letters))))

    def total(indicator: str, of: str, name: str) -> Column:
        return F.sum(F.col(of) * F.col(indicator)).cast("long").alias(name)

    # masks and prefixes: bounded by the number of filters
    by_prefix = cells.join(F.broadcast(steps), "mask").groupBy("part", "prefix", "letter", "step").agg(
        total("kept", "n", "kept"),
        total("removed", "n", "removed"),
        total("redundant", "n", "redundant"),
        total("only", "n", "unique_fails"),
        total("removed", "good", "good_lost"),
        total("removed", "toxic", "toxic_lost"),
    )
    rows = by_prefix.drop("step").join(F.broadcast(orders), "prefix")
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return rows.withColumn("shapley", shapley).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``audit_orders`` of the rows of ``docs``. A part with rows has all its orders; an empty table has no parts."""
    return audit_orders(stage(mask_cells(docs, labels, part_col, id_col, text_col)))
