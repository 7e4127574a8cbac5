"""Metadata (tags, properties, sensitive) and rule lists as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The type of metadata columns, and of a list of rules.
METADATA = "struct<tags: map<string, array<string>>, properties: map<string, string>, sensitive: array<string>>"
RULES = "array<struct<name: string, kind: string, mode: string, type: string, expr: string>>"
#: The property that numbers a version.
MARKER = "confluent:version"


def _later_wins(a: Column, b: Column) -> Column:
    """The union of two maps; of a key in both, the second's value. Nulls are empty."""
    both = F.map_zip_with(F.coalesce(a, b), F.coalesce(b, a), lambda k, x, y: F.coalesce(y, x))
    return both


def merge_metadata(*layers: Column) -> Column:
    """One metadata of several: of tags and properties the later layer's value, of sensitive names all, in order of
    first mention; null if all are null."""

    def two(a: Column, b: Column) -> Column:
        sensitive = F.when(a["sensitive"].isNull(), b["sensitive"]).when(b["sensitive"].isNull(), a["sensitive"]).otherwise(F.array_union(a["sensitive"], b["sensitive"]))
        merged = F.struct(_later_wins(a["tags"], b["tags"]).alias("tags"), _later_wins(a["properties"], b["properties"]).alias("properties"), sensitive.alias("sensitive"))
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merged)

    return reduce(two, layers)


def canonical_metadata(m: Column) -> Column:
    """Sorted keys, sorted distinct tags and sensitive names; what is empty is null, and so is empty metadata."""
    tags = F.map_from_entries(F.array_sort(F.transform(F.map_entries(m["tags"]), lambda e: F.struct(e["key"].alias("key"), F.array_sort(F.array_distinct(e["value"])).alias("value")))))
    properties = F.map_from_entries(F.array_sort(F.map_entries(m["properties"])))
    sensitive = F.array_sort(F.array_distinct(m["sensitive"]))
    some = lambda x: F.when(F.size(x) > 0, x)
    out = F.struct(some(tags).alias("tags"), some(properties).alias("properties"), some(sensitive).alias("sensitive"))
    return F.when(out["tags"].isNotNull() | out["properties"].isNotNull() | out["sensitive"].isNotNull(), out)


def marked_version(m: Column) -> Column:
    return m["properties"][MARKER]


def without_marker(m: Column) -> Column:
    """Metadata without the version marker; properties that are empty then are null."""
    rest = F.map_filter(m["properties"], lambda k, v: k != MARKER)
    return F.when(m.isNotNull(), F.struct(m["tags"].alias("tags"), F.when(F.size(rest) > 0, rest).alias("properties"), m["sensitive"].alias("sensitive")))


def merge_rules(*layers: Column) -> Column:
    """The layers' rules one after the other; a rule takes the place of an earlier one of its name."""

    def add(have: Column, rule: Column) -> Column:
        same = lambda x: x["name"] == rule["name"]
        replaced = F.transform(have, lambda x: F.when(same(x), rule).otherwise(x))
        return F.when(F.exists(have, lambda x: F.coalesce(same(x), F.lit(False))), replaced).otherwise(F.concat(have, F.array(rule)))

    every = F.concat(*(F.coalesce(x, F.expr(f"cast(array() as {RULES})")) for x in layers))
    return F.aggregate(every, F.expr(f"cast(array() as {RULES})"), add)
