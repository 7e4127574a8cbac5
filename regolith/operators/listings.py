"""Listings: which subjects, versions, schemas and contexts there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions.names import DEFAULT, WILDCARD, qualified


def in_prefix(df: DataFrame, ctx: str = WILDCARD, prefix: str = "") -> DataFrame:
    """Rows of one context, or of all, whose subject begins with a prefix; both reach the scan as filters."""
    if ctx != WILDCARD:
        df = df.where(F.col("ctx") == ctx)
    return df.where(F.col("subject").startswith(prefix)) if prefix else df


def visible(deleted: bool, deleted_only: bool, live: Column) -> Column:
    """Whether something is listed: only what is gone, or also what is gone, or only what is live."""
    return ~live if deleted_only else F.lit(True) if deleted else live


def list_subjects(versions: DataFrame, ctx: str = WILDCARD, prefix: str = "", deleted: bool = False, deleted_only: bool = False) -> DataFrame:
    """Qualified names of the subjects; one is live if any of its versions is."""
    live = in_prefix(versions, ctx, prefix).groupBy("ctx", "subject").agg(F.bool_or(~F.col("deleted")).alias("live"))
    return live.where(visible(deleted, deleted_only, F.col("live"))).select(qualified(F.col("ctx"), F.col("subject")).alias("name"))


def list_versions(versions: DataFrame, deleted: bool = False, deleted_only: bool = False) -> DataFrame:
    return versions.where(visible(deleted, deleted_only, ~F.col("deleted"))).select("ctx", "subject", "version")


def latest_rows(versions: DataFrame) -> DataFrame:
    """Each subject's greatest version, by an aggregation: nothing is sorted and a subject of very many versions is
    reduced before the shuffle."""
    others = [c for c in versions.columns if c not in ("ctx", "subject")]
    row = F.max_by(F.struct(*others), "version").alias("r")
    return versions.groupBy("ctx", "subject").agg(row).select("ctx", "subject", *(F.col(f"r.{c}").alias(c) for c in others))


def list_schemas(versions: DataFrame, schemas: DataFrame, ctx: str = WILDCARD, prefix: str = "", latest_only: bool = False, deleted: bool = False, rule_type: str | None = None) -> DataFrame:
    """Versions with their schemas. The latest is chosen among the rows that the deletion filter leaves, and the rule
    type is applied after that, so it must not move below it. Only domain rules count, not encoding rules."""
    rows = in_prefix(versions, ctx, prefix)
    rows = rows if deleted else rows.where(~F.col("deleted"))
    rows = latest_rows(rows) if latest_only else rows
    out = rows.select("ctx", "subject", "version", "id").join(schemas, ["ctx", "id"])
    return out.where(F.col("domain_rule") == rule_type) if rule_type else out


def with_aliases(subjects: DataFrame, scopes: DataFrame) -> DataFrame:
    """Subjects with the sorted aliases that point at them; targets of aliases are added even if they don't exist."""
    own = scopes.where("kind = 'subject' and alias is not null and alias <> ''")
    pointed = own.select("ctx", F.col("alias").alias("target"), qualified(F.col("ctx"), F.col("subject")).alias("by"))
    to = pointed.groupBy("ctx", F.col("target").alias("subject")).agg(F.sort_array(F.collect_set("by")).alias("aliases"))
    return subjects.select("ctx", "subject").distinct().join(to, ["ctx", "subject"], "full")


def list_contexts(versions: DataFrame, scopes: DataFrame) -> DataFrame:
    """Contexts that hold anything, and the default one always."""
    seen = versions.select("ctx").unionAll(scopes.where("ctx <> ''").select("ctx"))
    return seen.unionAll(versions.sparkSession.createDataFrame([(DEFAULT,)], "ctx string")).distinct()


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of a listing, after whatever filters visibility; a negative offset counts as none. Spark keeps
    offset + limit rows of each task at most."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(limit)


def overview(versions: DataFrame, settings: DataFrame) -> DataFrame:
    """Per subject: versions, deleted ones, the latest's version and id, and its effective settings."""
    rows = versions.groupBy("ctx", "subject").agg(
        F.count("*").alias("versions"),
        F.count_if("deleted").alias("deleted"),
        F.max_by("version", F.when(~F.col("deleted"), F.col("version"))).alias("latest_version"),
        F.max_by("id", F.when(~F.col("deleted"), F.col("version"))).alias("latest_id"),
    )
    return rows.join(settings, ["ctx", "subject"], "left")


def context_overview(versions: DataFrame) -> DataFrame:
    """Per context: live and wholly deleted subjects, and versions."""
    subjects = versions.groupBy("ctx", "subject").agg(F.bool_or(~F.col("deleted")).alias("live"), F.count("*").alias("n"))
    return subjects.groupBy("ctx").agg(F.count_if("live").alias("live_subjects"), F.count_if(~F.col("live")).alias("deleted_subjects"), F.sum("n").alias("versions"))


def subject_detail(versions: DataFrame, refs: DataFrame) -> DataFrame:
    """Every version with the number of ids that refer to it and the smallest of them."""
    by = refs.groupBy("ctx", "subject", "version").agg(F.count_distinct("referrer").alias("referrers"), F.min("referrer").alias("first_referrer"))
    return versions.select("ctx", "subject", "version", "id", "deleted").join(by, ["ctx", "subject", "version"], "left").fillna(0, ["referrers"])


def newest(versions: DataFrame, many: int) -> DataFrame:
    """The newest live versions of each subject; each task keeps as many before the shuffle."""
    order = Window.partitionBy("ctx", "subject").orderBy(F.desc("version"))
    return versions.where(~F.col("deleted")).withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= many)
