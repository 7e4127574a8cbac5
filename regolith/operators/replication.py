"""Exporters: which events of the change log go where, and what a destination has too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.functions.names import DEFAULT, WILDCARD, context_of, glob_match, subject_of


def selected(log: DataFrame, patterns: list[str]) -> DataFrame:
    """Events whose subject matches a pattern: a bare one in the default context, `:.c:` in that one, `:*:` in all."""
    one = [F.lit(p) for p in patterns]
    hits = F.lit(False)
    for p in one:
        ctx = context_of(p)
        hits = hits | (((ctx == WILDCARD) | (F.col("ctx") == ctx)) & glob_match(F.col("subject"), subject_of(p)))
    return log.where(hits)


def destination_context(kind: str, ctx: Column, cluster: str = "", custom: str = "") -> Column:
    """AUTO puts the source's cluster before the context; CUSTOM, NONE and DEFAULT fix it or keep it."""
    return {
        "AUTO": F.concat(F.lit(f".{cluster}"), F.when(ctx == DEFAULT, "").otherwise(ctx)),
        "CUSTOM": F.lit(custom),
        "NONE": ctx,
        "DEFAULT": F.lit(DEFAULT),
    }[kind]


def renamed(subject: Column, rename: str | None) -> Column:
    return F.replace(F.lit(rename), F.lit("${subject}"), subject) if rename else subject


def outgoing(log: DataFrame, patterns: list[str], kind: str, cluster: str = "", custom: str = "", rename: str | None = None, after: int = 0) -> DataFrame:
    """The events from a sequence number on, as the destination gets them, in order of seq."""
    rows = selected(log.where(F.col("seq") > after), patterns)
    return rows.select("seq", destination_context(kind, F.col("ctx"), cluster, custom).alias("ctx"), renamed(F.col("subject"), rename).alias("subject"), "version", "id", F.col("kind"))


def surplus(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Subjects of the destination that the source doesn't have."""
    return destination.select("ctx", "subject").distinct().join(source.select("ctx", "subject").distinct(), ["ctx", "subject"], "left_anti")


def prune_floor(exporters: DataFrame, log: DataFrame) -> DataFrame:
    """The sequence number below which no exporter reads any more: the least offset, at most the log's end; without
    exporters all of the log; if an offset is unknown, nothing."""
    end = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("end"))
    least = exporters.agg(F.min("offset").alias("least"), F.count("*").alias("n"), F.count("offset").alias("known"))
    floor = F.when(F.col("n") == 0, F.col("end")).when(F.col("known") < F.col("n"), F.lit(0)).otherwise(F.least("least", "end"))
    # one row each
    return end.join(least).select(floor.cast("long").alias("floor"))


def replayed(events: DataFrame) -> DataFrame:
    """The state that events leave at a destination, in any order and however often each was delivered: per version
    the last event by seq decides."""
    last = events.groupBy("ctx", "subject", "version").agg(F.max_by(F.struct("id", "kind"), "seq").alias("e"))
    return last.select("ctx", "subject", "version", F.col("e.id").alias("id"), (F.col("e.kind") == "SOFT_DELETE").alias("deleted")).where("e.kind <> 'HARD_DELETE'")


#: state -> command -> next state; what is missing is refused.
COMMANDS = {
    "STARTING": {"pause": "PAUSED", "resume": "STARTING", "reset": "STARTING"},
    "RUNNING": {"pause": "PAUSED", "resume": "RUNNING", "reset": "RUNNING"},
    "PAUSED": {"pause": "PAUSED", "resume": "RUNNING", "reset": "PAUSED"},
    "ERROR": {"pause": "PAUSED", "resume": "RUNNING", "reset": "ERROR"},
    "FAILED": {"pause": "PAUSED", "reset": "FAILED"},
}


def commanded(exporters: DataFrame) -> DataFrame:
    """Exporters (name, state, offset, command) after their command: the new state and offset, or error 42250 where
    the command is refused. Resetting sets the offset to 0 and leaves a paused exporter paused."""
    table = F.create_map(*(x for s, cs in COMMANDS.items() for c, t in cs.items() for x in (F.lit(f"{s} {c}"), F.lit(t))))
    to = table[F.concat_ws(" ", "state", "command")]
    offset = F.when(to.isNotNull() & (F.col("command") == "reset"), F.lit(0).cast("long")).otherwise(F.col("offset"))
    return exporters.select("name", F.coalesce(to, F.col("state")).alias("state"), offset.alias("offset"), F.when(to.isNull(), 42250).alias("error_code"))


def progressed(exporters: DataFrame, reports: DataFrame) -> DataFrame:
    """Exporters (name, state, offset) after reports (name, expected, offset): a report counts only if the offset is
    still the expected one and the exporter is neither paused nor failed."""
    r = reports.select("name", "expected", F.col("offset").alias("to"))
    counts = (F.col("offset") == F.col("expected")) & ~F.col("state").isin("PAUSED", "FAILED")
    return exporters.join(r, "name", "left").select("name", "state", F.when(counts, F.col("to")).otherwise(F.col("offset")).alias("offset"))


def bootstrap(exporters: DataFrame, floor: int) -> DataFrame:
    """Which exporters must ship the current state because the log no longer reaches back to their offset."""
    return exporters.select("name", (F.col("offset") < floor).alias("bootstraps"))
