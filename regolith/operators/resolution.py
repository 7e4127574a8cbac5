"""Resolution: which row a request means, by first match and top one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.functions.names import DEFAULT, context_of, subject_of, version_number
from regolith.operators.listings import latest_rows

DEFAULT_LEVEL, DEFAULT_MODE = "BACKWARD", "READWRITE"


def resolve_versions(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """For requests (name, spec): the version's id, or an error code: 42202 invalid specification, 40401 unknown
    subject, 40402 unknown version. The latest is the greatest live version; others must be live."""
    asked = requests.select("name", "spec", context_of(F.col("name")).alias("ctx"), subject_of(F.col("name")).alias("subject"), version_number(F.col("spec")).alias("wanted"))
    live = versions.where(~F.col("deleted"))
    known = live.select("ctx", "subject").distinct().withColumn("known", F.lit(True))
    last = latest_rows(live.select("ctx", "subject", "version", "id")).select("ctx", "subject", F.col("version").alias("last"), F.col("id").alias("last_id"))
    exact = live.select("ctx", "subject", F.col("version").alias("wanted"), F.col("id").alias("exact_id"))
    out = asked.join(known, ["ctx", "subject"], "left").join(last, ["ctx", "subject"], "left").join(exact, ["ctx", "subject", "wanted"], "left")
    error = F.when(F.col("wanted").isNull(), 42202).when(F.col("known").isNull(), 40401).when((F.col("wanted") != -1) & F.col("exact_id").isNull(), 40402)
    found = F.when(F.col("wanted") == -1, F.col("last_id")).otherwise(F.col("exact_id"))
    return out.select("name", "spec", F.when(error.isNull(), found).alias("id"), error.alias("error_code"))


def has_subjects(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """For requests (name): whether there is a live version, and whether there is any, of the subject, or of any subject
    of the context if the name is a context alone."""
    asked = requests.select("name", context_of(F.col("name")).alias("ctx"), subject_of(F.col("name")).alias("subject"))
    each = versions.groupBy("ctx", "subject").agg(F.bool_or(~F.col("deleted")).alias("live"))
    wide = each.groupBy("ctx").agg(F.bool_or("live").alias("live")).select("ctx", F.lit("").alias("subject"), "live")
    found = each.unionAll(wide).groupBy("ctx", "subject").agg(F.bool_or("live").alias("live"))
    out = asked.join(found, ["ctx", "subject"], "left")
    return out.select("name", F.coalesce("live", F.lit(False)).alias("live"), F.col("live").isNotNull().alias("known"))


def _first(priority: list[Column], value: Column) -> Column:
    return F.min_by(value, F.struct(*(p.alias(f"p{i}") for i, p in enumerate(priority))))


def across_contexts(names: DataFrame, versions: DataFrame) -> DataFrame:
    """For unqualified names: the default context's subject, or else that of the first other context in order."""
    live = versions.where(~F.col("deleted")).select("ctx", "subject").distinct()
    hits = names.join(live, names["name"] == live["subject"])
    return hits.groupBy("name").agg(_first([F.col("ctx") != DEFAULT, F.col("ctx")], F.col("ctx")).alias("ctx"))


def locate_ids(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """For requests (id, hint): the context in which the id is meant; deleted uses count. Without a hint it is the
    default context; an unqualified hint prefers contexts where the subject uses the id, the default one first, and
    falls back to the default; a qualified one with a subject admits that use alone, without a subject its context."""
    hint = F.coalesce(F.col("hint"), F.lit(""))
    bound = hint.startswith(":.") & (context_of(hint) != DEFAULT)
    asked = requests.select("id", "hint", bound.alias("bound"), context_of(hint).alias("hint_ctx"), subject_of(hint).alias("hint_subject"))
    uses = versions.select("id", "ctx", "subject").distinct()
    same = F.col("subject") == F.col("hint_subject")
    inside = F.col("ctx") == F.col("hint_ctx")
    fits = F.when(F.col("bound"), inside & (same | (F.col("hint_subject") == ""))).otherwise(same | (F.col("ctx") == DEFAULT))
    hits = asked.join(uses, "id").where(fits)
    best = _first([~same, F.col("ctx") != DEFAULT, F.col("ctx")], F.col("ctx"))
    return hits.groupBy("id", "hint").agg(best.alias("ctx"))


def id_uses(versions: DataFrame) -> DataFrame:
    """Per id and subject: the greatest version and the first time."""
    return versions.groupBy("ctx", "id", "subject").agg(F.max("version").alias("version"), F.min("ts").alias("since"))


def _scope(scopes: DataFrame, kind: str, column: str, name: str) -> DataFrame:
    keys = ["ctx", "subject"] if kind == "subject" else ["ctx"] if kind == "context" else []
    return scopes.where(F.col("kind") == kind).select(*keys, F.col(column).alias(name))


def effective_config(subjects: DataFrame, scopes: DataFrame) -> DataFrame:
    """The configuration of each subject: its own, or that of its context (the global one for the default context),
    or the server's. Whole records are taken, never merged; only then a missing level is filled in."""
    record = lambda kind: scopes.where(F.col("kind") == kind).withColumn("record", F.struct("level", "alias", F.lit(kind).alias("origin")))
    own = record("subject").select("ctx", "subject", F.col("record").alias("own"))
    context = record("context").select("ctx", F.col("record").alias("context"))
    everywhere = record("global").select(F.lit(DEFAULT).alias("ctx"), F.col("record").alias("everywhere"))
    out = subjects.select("ctx", "subject").join(own, ["ctx", "subject"], "left").join(context, "ctx", "left").join(everywhere, "ctx", "left")
    chosen = F.coalesce("own", F.when(F.col("ctx") == DEFAULT, F.col("everywhere")).otherwise(F.col("context")))
    return out.select("ctx", "subject", F.coalesce(chosen["level"], F.lit(DEFAULT_LEVEL)).alias("level"), chosen["alias"].alias("alias"), F.coalesce(chosen["origin"], F.lit("server")).alias("config_origin"))


def effective_mode(subjects: DataFrame, scopes: DataFrame) -> DataFrame:
    """The mode of each subject: a global override wins, then its own, then that of its context (or the global one)."""
    modes = scopes.where("mode is not null")
    own = _scope(modes, "subject", "mode", "own")
    context = _scope(modes, "context", "mode", "context")
    everywhere = _scope(modes, "global", "mode", "everywhere")
    out = subjects.select("ctx", "subject").join(own, ["ctx", "subject"], "left").join(context, "ctx", "left")
    out = out.join(everywhere.groupBy().agg(F.first("everywhere").alias("everywhere")).withColumn("k", F.lit(1)), F.lit(1) == F.col("k"), "left")
    outer = F.when(F.col("ctx") == DEFAULT, F.col("everywhere")).otherwise(F.col("context"))
    mode = F.when(F.col("everywhere") == "READONLY_OVERRIDE", F.col("everywhere")).otherwise(F.coalesce("own", outer, F.lit(DEFAULT_MODE)))
    return out.select("ctx", "subject", mode.alias("mode"))


def latest_with(versions: DataFrame, schemas: DataFrame, **properties: str) -> DataFrame:
    """The newest live version of each subject whose schema has all of the properties."""
    for k, v in properties.items():
        schemas = schemas.where(F.col(k) == v)
    rows = versions.where(~F.col("deleted")).select("ctx", "subject", "version", "id").join(schemas.select("ctx", "id"), ["ctx", "id"], "left_semi")
    return latest_rows(rows)


def resolve_aliases(names: DataFrame, scopes: DataFrame) -> DataFrame:
    """Requested subjects (ctx, subject) with those that their aliases stand for."""
    own = scopes.where("kind = 'subject' and alias is not null and alias <> ''").select("ctx", "subject", "alias")
    return names.join(own, ["ctx", "subject"], "left").select("ctx", "subject", F.coalesce("alias", "subject").alias("target"))
