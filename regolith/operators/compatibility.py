"""Compatibility of new schema versions with those before them, at seven levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("NONE", "BACKWARD", "BACKWARD_TRANSITIVE", "FORWARD", "FORWARD_TRANSITIVE", "FULL", "FULL_TRANSITIVE")


def verdicts(new: DataFrame, history: DataFrame, readable: Callable[[DataFrame, str, str, str], DataFrame]) -> DataFrame:
    """For new schemas (key, text, type) against their history (key, version, old_text, old_type): per key and level
    whether they are compatible, and the newest version that fails.

    Levels that aren't transitive look at the newest version only. Another type fails at every level but NONE. The
    texts are compared once in each direction, as distinct pairs, and all levels are read off the same verdicts."""
    pairs = new.join(history, "key")
    newest = history.groupBy("key").agg(F.max("version").alias("newest"))
    same = pairs.where("type = old_type")
    done = readable(readable(same, "text", "old_text", "reads_old"), "old_text", "text", "read_by_old")
    other = pairs.where("type <> old_type").withColumn("reads_old", F.lit(False)).withColumn("read_by_old", F.lit(False))
    rows = done.select("key", "version", "reads_old", "read_by_old").unionAll(other.select("key", "version", "reads_old", "read_by_old")).join(newest, "key")
    failing = []
    for level in LEVELS:
        fails = F.lit(False)
        if "BACKWARD" in level or "FULL" in level:
            fails = fails | ~F.col("reads_old")
        if "FORWARD" in level or "FULL" in level:
            fails = fails | ~F.col("read_by_old")
        if not level.endswith("TRANSITIVE"):
            fails = fails & (F.col("version") == F.col("newest"))
        failing.append(F.max(F.when(fails, F.col("version"))).alias(level))
    wide = rows.groupBy("key").agg(*failing)
    out = new.select("key").join(wide, "key", "left").unpivot(["key"], list(LEVELS), "level", "failing_version")
    return out.select("key", "level", F.col("failing_version").isNull().alias("compatible"), "failing_version")


def candidates(new: DataFrame, history: DataFrame, group: str) -> DataFrame:
    """The pairs that are to be compared: live versions of the same group, an absent group being one, too."""
    live = history.where(~F.col("deleted")).withColumnRenamed(group, "_group").drop("deleted")
    pairs = new.join(live, "key")
    return pairs.where(F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


#: The wire groups of Protobuf scalars; types of one group may replace each other.
WIRE_GROUPS = {
    "int32": "GENERAL_NUMBER", "uint32": "GENERAL_NUMBER", "int64": "GENERAL_NUMBER", "uint64": "GENERAL_NUMBER", "bool": "GENERAL_NUMBER", "enum": "GENERAL_NUMBER",
    "sint32": "SIGNED_NUMBER", "sint64": "SIGNED_NUMBER", "string": "STRING_OR_BYTES", "bytes": "STRING_OR_BYTES", "fixed32": "FIXED32", "sfixed32": "FIXED32",
    "fixed64": "FIXED64", "sfixed64": "FIXED64", "float": "FLOAT", "double": "DOUBLE",
}


def field_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of Protobuf fields (message, tag, name, type, label): one row for every difference, with its kind and whether
    it is compatible. Fields are matched by message and tag; a required field can't be added or removed."""
    side = lambda df, s: df.select("message", "tag", *(F.col(c).alias(f"{s}_{c}") for c in ("name", "type", "label")))
    both = side(old, "old").join(side(new, "new"), ["message", "tag"], "full")
    group = lambda c: F.coalesce(F.create_map(*(F.lit(x) for kv in WIRE_GROUPS.items() for x in kv))[F.col(c)], F.col(c))
    changed = group("old_type") != group("new_type")
    kind = (
        F.when(F.col("old_tag_missing"), F.when(F.col("new_label") == "required", "REQUIRED_FIELD_ADDED").otherwise("FIELD_ADDED"))
        .when(F.col("new_tag_missing"), F.when(F.col("old_label") == "required", "REQUIRED_FIELD_REMOVED").otherwise("FIELD_REMOVED"))
        .when(changed, "FIELD_SCALAR_KIND_CHANGED")
        .when(F.col("old_name") != F.col("new_name"), "FIELD_NAME_CHANGED")
    )
    rows = both.withColumn("old_tag_missing", F.col("old_name").isNull()).withColumn("new_tag_missing", F.col("new_name").isNull())
    rows = rows.select("message", "tag", kind.alias("kind")).where("kind is not null")
    return rows.withColumn("compatible", F.col("kind").isin("FIELD_ADDED", "FIELD_REMOVED", "FIELD_NAME_CHANGED"))
