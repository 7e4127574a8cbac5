"""Registration in set form: ids by content within a context, versions by content within a subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.scratch import stored

#: (intent, mode) pairs that pass the mode gate; SetMode and NotSchemaState always do.
ALLOWED = {
    "Write": ("READWRITE",),
    "Import": ("IMPORT",),
    "Modify": ("READWRITE", "IMPORT"),
    "SetMode": ("READWRITE", "IMPORT", "READONLY", "READONLY_OVERRIDE"),
    "NotSchemaState": ("READWRITE", "IMPORT", "READONLY", "READONLY_OVERRIDE"),
}


def fingerprint(kind: Column, text: Column) -> Column:
    """The content hash of a schema without references, metadata and rules."""
    nul = F.lit("\x00")
    return F.sha2(F.concat(kind, nul, text, nul, nul, nul), 256)


def positions(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the position from 1 within the group by the order, for groups of any size.

    A window would bring a whole group, such as the default context, into one task. Here the rows are dealt out by
    range over group and order, numbered where they lie, and only one row for each group and partition is summed."""
    keys = [*group, *order]
    placed = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "positions")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")
    sizes = sizes.withColumn("_before", before).drop("_n")
    same = [F.col(f"p.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group] + [F.col("p._part") == F.col("s._part")]
    joined = placed.alias("p").join(sizes.alias("s"), same)
    number = (F.col("s._before") + F.col("p._at") - F.col("s._first") + 1).cast("int")
    return joined.select(*(F.col(f"p.{c}") for c in df.columns), number.alias(name))


def register(requests: DataFrame, kind: str = "AVRO") -> DataFrame:
    """ctx, subject, version, id and seq of the versions that the requests (seq, ctx, subject, content) leave, under
    no compatibility rule and without deletes: per context an id for each content, per subject a version for each,
    both in the order of first requests. Equal requests are reduced before the shuffle."""
    rows = requests.select("ctx", "subject", "seq", fingerprint(F.lit(kind), F.col("content")).alias("fp"))
    versions = rows.groupBy("ctx", "subject", "fp").agg(F.min("seq").alias("seq"))
    ids = positions(versions.groupBy("ctx", "fp").agg(F.min("seq").alias("seq")), ["ctx"], ["seq"], "id")
    numbered = positions(versions, ["ctx", "subject"], ["seq"], "version")
    return numbered.join(ids.select("ctx", "fp", "id"), ["ctx", "fp"]).select("ctx", "subject", "version", "id", "seq")


def registration_summary(requests: DataFrame) -> DataFrame:
    """Per context: subjects, versions, ids and a checksum of who got which."""
    done = register(requests)
    return done.groupBy("ctx").agg(
        F.count_distinct("subject").alias("subjects"),
        F.count("*").alias("versions"),
        F.max("id").cast("long").alias("ids"),
        F.sum(F.col("id").cast("long") * F.col("version")).alias("checksum"),
    )


def gate(requests: DataFrame) -> DataFrame:
    """Requests (…, intent, mode) with the error code 42205 where the mode refuses the intent."""
    passes = F.lit(False)
    for intent, modes in ALLOWED.items():
        passes = passes | ((F.col("intent") == intent) & F.col("mode").isin(*modes))
    return requests.withColumn("error_code", F.when(~passes, F.lit(42205)))


def merged_settings(updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The settings that updates leave: of each field the last value that was set; unset fields change nothing."""
    fields = [c for c in updates.columns if c not in (*keys, order)]
    return updates.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields))
