"""Note properties and their YAML block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let, rewrite_matches

# Characters JSON leaves bare but YAML does not accept in a quoted scalar.
_UNPRINTABLE = r"[\x7F-\x9F\u2028\u2029\uFEFF\uFFFE\uFFFF]"


def frontmatter(
    title: Column,
    source: Column,
    author: Column,
    date: Column,
    tags: Column,
    og_title: Column,
    description: Column,
    as_of: str,
) -> Column:
    """Ordered property struct; a null field means the property is absent."""

    def present(col: Column) -> Column:
        return F.nullif(col, F.lit(""))

    name = F.coalesce(title, F.lit(""))
    return F.struct(
        F.coalesce(present(name), F.lit("Untitled")).alias("title"),
        source.alias("source"),
        present(author).alias("author"),
        F.coalesce(present(date), F.lit(as_of)).alias("date"),
        F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("web-clip"))).alias("tags"),
        F.when((og_title != "") & (og_title != name), F.array(og_title)).alias("aliases"),
        present(description).alias("description"),
    )


def yaml_scalar(col: Column) -> Column:
    """A double-quoted scalar: the JSON string of the value, which is also YAML."""
    json = F.to_json(F.array(col))
    quoted = F.substr(json, F.lit(2), F.length(json) - 2)
    return let(
        quoted,
        lambda q: F.when(
            q.rlike(_UNPRINTABLE),
            rewrite_matches(
                q, _UNPRINTABLE, lambda c: F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(c)), 4, "0"))
            ),
        ).otherwise(q),
    )


def frontmatter_yaml(props: Column) -> Column:
    """YAML block of a property struct, fenced by ``---`` lines."""

    def scalar(key: str) -> Column:
        return F.when(props[key].isNotNull(), F.concat(F.lit(f"{key}: "), yaml_scalar(props[key]), F.lit("\n"))).otherwise("")

    def items(key: str) -> Column:
        rows = F.array_join(F.transform(props[key], lambda v: F.concat(F.lit("- "), yaml_scalar(v), F.lit("\n"))), "")
        return F.when(props[key].isNotNull(), F.concat(F.lit(f"{key}:\n"), rows)).otherwise("")

    return F.concat(
        F.lit("---\n"),
        scalar("title"),
        scalar("source"),
        scalar("author"),
        scalar("date"),
        items("tags"),
        items("aliases"),
        scalar("description"),
        F.lit("---"),
    )
