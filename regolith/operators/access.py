"""Authorization as joins and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.functions.names import DEFAULT, WILDCARD, context_of, glob_match, normalized_context, percent_decoded, segments, star_match, subject_of

#: The bindings of a registry are an administrator's list; up to this number they are broadcast to the subjects.
BROADCAST = 10_000


def bound(bindings: DataFrame) -> DataFrame:
    """Bindings (principal, role, pattern) with the patterns of context and subject. `ctx::subject` names a context,
    with its dot or without; nothing before `::` and a pattern without it mean the default context. A pattern without
    a subject is left out."""
    pattern = F.col("pattern")
    named = F.when(pattern.contains("::"), F.substring_index(pattern, "::", 1)).otherwise(F.lit(DEFAULT))
    ctx = F.when(named.isin("", DEFAULT), F.lit(DEFAULT)).when((named == WILDCARD) | named.startswith("."), named).otherwise(F.concat(F.lit("."), named))
    subject = F.when(pattern.contains("::"), F.regexp_extract(pattern, "(?s)^.*?::(.*)$", 1)).otherwise(pattern)
    return bindings.select("principal", "role", ctx.alias("p_ctx"), subject.alias("p_subject")).where("p_subject <> ''")


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST else df


def matches(ctx: str, subject: str) -> Column:
    return star_match(F.col(ctx), F.col("p_ctx")) & star_match(F.col(subject), F.col("p_subject"))


def roles(subjects: DataFrame, bindings: DataFrame) -> DataFrame:
    """principal, ctx, subject and the sorted roles that a principal's bindings give on it."""
    hits = subjects.select("ctx", "subject").join(small(bound(bindings)), matches("ctx", "subject"))
    return hits.groupBy("principal", "ctx", "subject").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


def sees_everything(users: DataFrame, bindings: DataFrame) -> DataFrame:
    """The principals (of users: principal, roles) that have a global role or no bindings at all."""
    some = bindings.select("principal").distinct().withColumn("some", F.lit(True))
    return users.join(some, "principal", "left").where((F.size("roles") > 0) | F.col("some").isNull()).select("principal")


def visible_subjects(subjects: DataFrame, users: DataFrame, bindings: DataFrame) -> DataFrame:
    """principal, ctx and subject: what each principal may know of."""
    every = subjects.select("ctx", "subject").join(small(sees_everything(users, bindings)), F.lit(True))  # each sees each
    own = subjects.select("ctx", "subject").join(small(bound(bindings)), matches("ctx", "subject")).select("principal", "ctx", "subject")
    return every.select("principal", "ctx", "subject").unionAll(own).distinct()


def visible_contexts(contexts: DataFrame, users: DataFrame, bindings: DataFrame) -> DataFrame:
    """principal and ctx: the contexts that a principal may know of; a pattern needs only touch a context."""
    every = contexts.select("ctx").join(small(sees_everything(users, bindings)), F.lit(True))
    own = contexts.select("ctx").join(small(bound(bindings)), star_match(F.col("ctx"), F.col("p_ctx"))).select("principal", "ctx")
    return every.select("principal", "ctx").unionAll(own).distinct()


def usable_containers(containers: DataFrame, limits: DataFrame) -> DataFrame:
    """principal and container: limits (principal, containers) name those that a principal may use; none means all."""
    free = F.size("containers") == 0
    return containers.select("container").join(small(limits), free | F.array_contains("containers", F.col("container"))).select("principal", "container")


def request_target(path: Column) -> Column:
    """What a request is about: (kind, ctx, subject), where kind is subject, context, listing or global. Names are
    decoded first, so that an encoded context is not taken for a subject."""
    segs = segments(path)
    at = lambda i: F.get(segs, F.lit(i))
    n = F.size(segs)
    target = lambda kind, ctx=None, subject=None: F.struct(
        F.lit(kind).alias("kind"), (F.lit(None).cast("string") if ctx is None else ctx).alias("ctx"), (F.lit(None).cast("string") if subject is None else subject).alias("subject")
    )

    def subject(raw: Column) -> Column:
        name = percent_decoded(raw)
        return F.when(context_valid(name), target("subject", context_of(name), subject_of(name))).otherwise(target("global"))

    def either(raw: Column) -> Column:
        name = percent_decoded(raw)
        alone = (context_of(name) != DEFAULT) & (subject_of(name) == "") | name.isin(":.:", ":.")
        return F.when(~context_valid(name), target("global")).when(alone, target("context", context_of(name))).otherwise(target("subject", context_of(name), subject_of(name)))

    first, second, third = at(0), at(1), at(2)
    return (
        F.when((n == 1) & first.isin("subjects", "schemas", "contexts", "admin") | (first == "_admin"), target("listing"))
        .when((first == "schemas") & (second == "ids") & (n == 4) & at(3).isin("subjects", "versions"), target("listing"))
        .when((first == "admin") & (second == "api") & (n == 3) & third.isin("overview", "backup", "restore"), target("listing"))
        .when((first == "subjects") & (n > 1), subject(second))
        .when((first == "compatibility") & (second == "subjects") & (n > 2), subject(third))
        .when(first.isin("config", "mode") & (n > 1), either(second))
        .when((first == "contexts") & (n > 1), target("context", F.coalesce(normalized_context(percent_decoded(second)), F.lit(""))))
        .when((first == "admin") & (second == "api") & (third == "subjects") & (n > 3), subject(at(3)))
        .otherwise(target("global"))
    )


def context_valid(name: Column) -> Column:
    return normalized_context(context_of(name)).isNotNull()


def decision(path: Column, method: Column, kind: Column, roles: Column, anywhere: Column) -> Column:
    """Whether a request is allowed, by the roles (an array) that hold for its target, and those held anywhere."""
    has = lambda r, role: F.array_contains(r, role)
    segs, n = segments(path), F.size(segments(path))
    first = F.get(segs, F.lit(0))
    console = path.startswith("/admin") | path.startswith("/_admin")
    secrets = (first == "exporters") & ((n == 2) | (n == 3) & (F.get(segs, F.lit(2)) == "config"))
    lookup = (first == "subjects") & (n == 2) | (first == "compatibility") & (F.get(segs, F.lit(1)) == "subjects") & (F.get(segs, F.lit(3)) == "versions")
    reading = method.isin("GET", "HEAD", "OPTIONS") | (method == "POST") & F.coalesce(lookup, F.lit(False))
    return (
        F.when(kind == "listing", F.when(console, has(anywhere, "admin")).otherwise(F.size(anywhere) > 0))
        .when(console | (path == "/metrics"), has(roles, "admin"))
        .when(has(roles, "admin"), True)
        .when(F.coalesce(secrets, F.lit(False)), False)
        .when(reading, F.size(roles) > 0)
        .otherwise(has(roles, "write") & (kind == "subject"))
    )


def authorized(requests: DataFrame, users: DataFrame, bindings: DataFrame) -> DataFrame:
    """principal, method, path, kind and allowed for each distinct request, under the global roles of users (principal,
    roles) and the bindings. A binding reaches a context's own settings only if its pattern covers all subjects; the
    registry as a whole is for global roles. A principal that is not among the users has no roles but its bindings'."""
    asked = requests.select("principal", "method", "path").distinct().withColumn("t", request_target(F.col("path")))
    rules = bound(bindings)
    held = rules.groupBy("principal").agg(F.collect_set("role").alias("held"))
    hit = (F.col("principal") == F.col("p")) & star_match(F.coalesce("t.ctx", F.lit("")), F.col("p_ctx"))
    hit = hit & ((F.col("t.kind") == "subject") & star_match(F.coalesce("t.subject", F.lit("")), F.col("p_subject")) | (F.col("t.kind") == "context") & (F.col("p_subject") == "*"))
    scoped = asked.join(small(rules.withColumnRenamed("principal", "p")), hit, "left").groupBy("principal", "method", "path", "t").agg(F.collect_set("role").alias("scoped"))
    none = F.expr("cast(array() as array<string>)")
    known = scoped.join(users.select("principal", "roles"), "principal", "left").join(held, "principal", "left")
    own = F.coalesce("roles", none)
    allowed = decision(F.col("path"), F.col("method"), F.col("t.kind"), F.array_union(own, F.col("scoped")), F.array_union(own, F.coalesce("held", none)))
    return known.select("principal", "method", "path", F.col("t.kind").alias("kind"), F.coalesce(allowed, F.lit(False)).alias("allowed"))


def route_hosts(requests: DataFrame, hosts: DataFrame) -> DataFrame:
    """Requests (host) with the container of the first matching pattern (ordinal, pattern, container), or 42101."""
    hits = requests.select("host").distinct().join(F.broadcast(hosts) if hosts.count() <= BROADCAST else hosts, glob_match(F.col("host"), F.col("pattern")), "left")
    out = hits.groupBy("host").agg(F.min_by("container", "ordinal").alias("container"))
    return out.withColumn("error_code", F.when(F.col("container").isNull(), F.lit(42101)))
