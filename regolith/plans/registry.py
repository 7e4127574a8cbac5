"""The registry queries over the derived relations, each with the SQL that DuckDB runs for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions import avro, json_text, names
from regolith.operators import access, compatibility, listings, metrics, references, registration, replication, resolution
from regolith.sources.derived import Registry, registry, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUALIFIED = "CASE WHEN ctx = '.' THEN subject ELSE ':' || ctx || ':' || subject END"
#: The shape of a path, in DuckDB.
ROUTE_OF = """CASE WHEN split_part(trim({0}, '/'), '/', 1) NOT IN ('', 'subjects', 'schemas', 'contexts', 'config', 'mode', 'compatibility', 'exporters', 'metrics', 'admin', '_admin', 'v1')
    OR strlen({1}) > 64 OR contains({1}, '"') OR contains({1}, chr(92)) THEN '/other' ELSE {1} END"""
SHAPE = """('/' || regexp_replace(regexp_replace(regexp_replace(trim(path, '/'), '(^|/)(subjects|config|mode|contexts|exporters|ids)/[^/]*', '\\1\\2/*', 'g'), '(^|/)versions/(\\+?[0-9]{1,9}|latest)(/|$)', '\\1versions/*\\3', 'g'), '^$', ''))"""
ROUTE = ROUTE_OF.format("path", SHAPE)


def query(sql: str | None) -> Callable:
    """Registers a query of the registry, and its SQL over the same relations."""

    def add(f: Callable[[Registry], DataFrame]) -> Callable[[Registry], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(registry(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_relations(sql)
        return f

    return add


def frame(r: Registry, rows: list[tuple], schema: str) -> DataFrame:
    return r.spark.createDataFrame(rows, schema)


def values(rows: list[tuple]) -> str:
    """The same rows in SQL."""
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, row)) + ")" for row in rows)


@query("""
    SELECT ctx, count(DISTINCT subject) AS subjects, count(*) AS versions, CAST(max(id) AS BIGINT) AS ids, CAST(sum(CAST(id AS BIGINT) * version) AS BIGINT) AS checksum
    FROM versions GROUP BY ctx""")
def registration_replay(r: Registry) -> DataFrame:
    return registration.registration_summary(r.requests)


@query("SELECT ctx, subject, version, id, seq FROM versions")
def registered_versions(r: Registry) -> DataFrame:
    return registration.register(r.requests)


@query("SELECT DISTINCT content, fp FROM content")
def content_fingerprints(r: Registry) -> DataFrame:
    texts = r.requests.select("content").distinct()
    return texts.select("content", registration.fingerprint(F.lit("AVRO"), F.col("content")).alias("fp"))


@query(f"SELECT {QUALIFIED} AS name FROM versions GROUP BY ctx, subject HAVING bool_or(NOT deleted)")
def list_subjects(r: Registry) -> DataFrame:
    return listings.list_subjects(r.versions)


@query(f"SELECT {QUALIFIED} AS name FROM versions WHERE ctx = '.eu' AND starts_with(subject, 'p') GROUP BY ctx, subject")
def list_subjects_prefix_deleted(r: Registry) -> DataFrame:
    return listings.list_subjects(r.versions, ".eu", "p", deleted=True)


@query("SELECT ctx, subject, version FROM versions WHERE deleted")
def list_versions_deleted_only(r: Registry) -> DataFrame:
    return listings.list_versions(r.versions, deleted_only=True)


@query("""
    SELECT v.ctx, v.subject, v.version, v.id, s.text, s.domain_rule FROM versions v JOIN schemas s ON s.ctx = v.ctx AND s.id = v.id
    WHERE NOT v.deleted""")
def list_schemas(r: Registry) -> DataFrame:
    return listings.list_schemas(r.versions, r.schemas).select("ctx", "subject", "version", "id", "text", "domain_rule")


LATEST = "SELECT *, row_number() OVER (PARTITION BY ctx, subject ORDER BY version DESC) AS rn FROM versions WHERE NOT deleted"


@query(f"""
    SELECT v.ctx, v.subject, v.version, v.id FROM ({LATEST}) v JOIN schemas s ON s.ctx = v.ctx AND s.id = v.id
    WHERE rn = 1 AND s.domain_rule = 'CONDITION'""")
def list_schemas_latest_rule(r: Registry) -> DataFrame:
    return listings.list_schemas(r.versions, r.schemas, latest_only=True, rule_type="CONDITION").select("ctx", "subject", "version", "id")


@query("""
    WITH a AS (SELECT ctx, alias AS subject, string_agg(DISTINCT CASE WHEN ctx = '.' THEN subject ELSE ':' || ctx || ':' || subject END, ',' ORDER BY CASE WHEN ctx = '.' THEN subject ELSE ':' || ctx || ':' || subject END) AS aliases
               FROM scopes WHERE kind = 'subject' AND alias <> '' GROUP BY ctx, alias)
    SELECT ctx, subject, aliases FROM subjects FULL JOIN a USING (ctx, subject)""")
def subjects_with_aliases(r: Registry) -> DataFrame:
    return listings.with_aliases(r.subjects, r.scopes).select("ctx", "subject", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT DISTINCT ctx FROM (SELECT ctx FROM versions UNION ALL SELECT ctx FROM scopes WHERE ctx <> '' UNION ALL SELECT '.') c")
def list_contexts(r: Registry) -> DataFrame:
    return listings.list_contexts(r.versions, r.scopes)


@query("SELECT ctx, subject, version FROM versions ORDER BY ctx, subject, version LIMIT 25 OFFSET 40")
def versions_page(r: Registry) -> DataFrame:
    return listings.page(r.versions.select("ctx", "subject", "version"), ["ctx", "subject", "version"], 40, 25)


CONFIG = """(
    SELECT s.ctx, s.subject,
           CASE WHEN o.kind IS NOT NULL THEN o.level WHEN s.ctx = '.' THEN g.level ELSE c.level END AS raw_level,
           CASE WHEN o.kind IS NOT NULL THEN o.alias WHEN s.ctx = '.' THEN g.alias ELSE c.alias END AS alias,
           CASE WHEN o.kind IS NOT NULL THEN 'subject' WHEN s.ctx = '.' THEN 'global' WHEN c.kind IS NOT NULL THEN 'context' ELSE 'server' END AS config_origin
    FROM subjects s LEFT JOIN scopes o ON o.kind = 'subject' AND o.ctx = s.ctx AND o.subject = s.subject AND o.alias IS NULL
    LEFT JOIN scopes c ON c.kind = 'context' AND c.ctx = s.ctx LEFT JOIN scopes g ON g.kind = 'global')"""


def own_scopes(r: Registry) -> DataFrame:
    """Settings without the rows that are aliases, so that a scope has one."""
    return r.scopes.where("alias is null")


@query(f"SELECT ctx, subject, coalesce(raw_level, 'BACKWARD') AS level, alias, config_origin FROM {CONFIG} x")
def effective_config(r: Registry) -> DataFrame:
    return resolution.effective_config(r.subjects, own_scopes(r))


@query("""
    SELECT s.ctx, s.subject, CASE WHEN g.mode = 'READONLY_OVERRIDE' THEN g.mode
           ELSE coalesce(o.mode, CASE WHEN s.ctx = '.' THEN g.mode ELSE c.mode END, 'READWRITE') END AS mode
    FROM subjects s LEFT JOIN scopes o ON o.kind = 'subject' AND o.ctx = s.ctx AND o.subject = s.subject AND o.mode IS NOT NULL
    LEFT JOIN scopes c ON c.kind = 'context' AND c.ctx = s.ctx LEFT JOIN scopes g ON g.kind = 'global'""")
def effective_mode(r: Registry) -> DataFrame:
    return resolution.effective_mode(r.subjects, r.scopes)


@query(f"""
    SELECT v.ctx, v.subject, v.versions, v.deleted, l.version AS latest_version, l.id AS latest_id, coalesce(c.raw_level, 'BACKWARD') AS level, c.alias, c.config_origin
    FROM (SELECT ctx, subject, count(*) AS versions, count(*) FILTER (deleted) AS deleted FROM versions GROUP BY ctx, subject) v
    LEFT JOIN (SELECT * FROM ({LATEST}) x WHERE rn = 1) l ON l.ctx = v.ctx AND l.subject = v.subject
    LEFT JOIN {CONFIG} c ON c.ctx = v.ctx AND c.subject = v.subject""")
def admin_overview(r: Registry) -> DataFrame:
    return listings.overview(r.versions, resolution.effective_config(r.subjects, own_scopes(r)))


@query("""
    SELECT ctx, count(*) FILTER (live) AS live_subjects, count(*) FILTER (NOT live) AS deleted_subjects, CAST(sum(n) AS BIGINT) AS versions
    FROM (SELECT ctx, subject, bool_or(NOT deleted) AS live, count(*) AS n FROM versions GROUP BY ctx, subject) s GROUP BY ctx""")
def admin_contexts(r: Registry) -> DataFrame:
    return listings.context_overview(r.versions)


@query("""
    SELECT v.ctx, v.subject, v.version, v.id, v.deleted, count(DISTINCT f.referrer) AS referrers, min(f.referrer) AS first_referrer
    FROM versions v LEFT JOIN refs f ON f.ctx = v.ctx AND f.subject = v.subject AND f.version = v.version GROUP BY ALL""")
def admin_subjects(r: Registry) -> DataFrame:
    return listings.subject_detail(r.versions, r.refs)


ASKED = [("click-value", "latest"), ("click-value", " LATEST "), (":.eu:view-value", "3"), (":.us:error-value", "-1"), ("nothing", "1"), ("view-value", "0"), ("view-value", "x"), (":.eu:click-value", "99999"), (":.:signup-value", "2"), (":abc:x", "latest")]


@query(f"""
    WITH a AS (SELECT name, spec, CASE WHEN starts_with(name, ':.') THEN regexp_extract(name, '^:(\\.[^:]*)', 1) ELSE '.' END AS ctx,
                      CASE WHEN starts_with(name, ':.') THEN regexp_extract(name, '^:\\.[^:]*:(.*)$', 1) ELSE name END AS subject,
                      CASE WHEN lower(trim(spec)) = 'latest' THEN -1 WHEN try_cast(trim(spec) AS INT) = -1 OR try_cast(trim(spec) AS INT) >= 1 THEN try_cast(trim(spec) AS INT) END AS wanted
               FROM (VALUES {values(ASKED)}) t(name, spec)),
         live AS (SELECT * FROM versions WHERE NOT deleted),
         m AS (SELECT ctx, subject, max(version) AS last FROM live GROUP BY ctx, subject),
         e AS (SELECT a.name, a.spec, l.id, CASE WHEN wanted IS NULL THEN 42202 WHEN m.last IS NULL THEN 40401 WHEN l.id IS NULL THEN 40402 END AS error_code
               FROM a LEFT JOIN m ON m.ctx = a.ctx AND m.subject = a.subject
               LEFT JOIN live l ON l.ctx = a.ctx AND l.subject = a.subject AND l.version = CASE WHEN a.wanted = -1 THEN m.last ELSE a.wanted END)
    SELECT name, spec, CASE WHEN error_code IS NULL THEN id END AS id, error_code FROM e""")
def resolve_versions(r: Registry) -> DataFrame:
    return resolution.resolve_versions(frame(r, ASKED, "name string, spec string"), r.versions)


NAMED = [(n,) for n in ("click-value", "nothing", ":.eu:", ":.us:view-value", ":.none:", ":.eu:nothing")]
#: The same names in parts.
NAMED_PARTS = [("click-value", ".", "click-value"), ("nothing", ".", "nothing"), (":.eu:", ".eu", ""), (":.us:view-value", ".us", "view-value"), (":.none:", ".none", ""), (":.eu:nothing", ".eu", "nothing")]


@query(f"""
    SELECT name, coalesce(bool_or(NOT v.deleted), false) AS live, count(v.version) > 0 AS known FROM (VALUES {values(NAMED_PARTS)}) n(name, c, s)
    LEFT JOIN versions v ON v.ctx = c AND (v.subject = s OR s = '') GROUP BY name""")
def existing_subjects(r: Registry) -> DataFrame:
    return resolution.has_subjects(frame(r, NAMED, "name string"), r.versions)


@query("""
    SELECT name, ctx FROM (SELECT n.name, v.ctx, row_number() OVER (PARTITION BY n.name ORDER BY v.ctx <> '.', v.ctx) AS rn
    FROM (SELECT DISTINCT subject AS name FROM versions UNION SELECT 'nothing') n JOIN (SELECT DISTINCT ctx, subject FROM versions WHERE NOT deleted AND (ctx <> '.' OR subject <> 'view-value')) v ON v.subject = n.name) x WHERE rn = 1""")
def across_contexts(r: Registry) -> DataFrame:
    asked = r.versions.select(F.col("subject").alias("name")).distinct()
    return resolution.across_contexts(asked, r.versions.where("ctx <> '.' or subject <> 'view-value'"))


HINTS = [None, "", "click-value", ":.eu:", ":.us:view-value", ":.:error-value", "nothing"]


@query(f"""
    WITH a AS (SELECT i.id, h.hint, coalesce(h.hint, '') AS t FROM (SELECT DISTINCT id FROM versions) i, (VALUES {values([(h,) for h in HINTS])}) h(hint)),
         b AS (SELECT *, CASE WHEN starts_with(t, ':.') THEN regexp_extract(t, '^:(\\.[^:]*)', 1) ELSE '.' END AS hc,
                      CASE WHEN starts_with(t, ':.') THEN regexp_extract(t, '^:\\.[^:]*:(.*)$', 1) ELSE t END AS hs FROM a),
         c AS (SELECT b.id, b.hint, u.ctx, row_number() OVER (PARTITION BY b.id, b.hint ORDER BY u.subject <> hs, u.ctx <> '.', u.ctx) AS rn
               FROM b JOIN (SELECT DISTINCT id, ctx, subject FROM versions) u ON u.id = b.id
               WHERE CASE WHEN hc <> '.' THEN u.ctx = hc AND (hs = '' OR u.subject = hs) ELSE u.subject = hs OR u.ctx = '.' END)
    SELECT id, hint, ctx FROM c WHERE rn = 1""")
def locate_ids(r: Registry) -> DataFrame:
    asked = r.versions.select("id").distinct().select("id", F.explode(F.array(*(F.lit(h) for h in HINTS))).alias("hint"))
    return resolution.locate_ids(asked, r.versions)


@query("SELECT ctx, id, subject, max(version) AS version, min(ts) AS since FROM versions GROUP BY ctx, id, subject")
def id_uses(r: Registry) -> DataFrame:
    return resolution.id_uses(r.versions)


@query("""
    SELECT ctx, subject, version, id FROM (SELECT v.*, row_number() OVER (PARTITION BY v.ctx, v.subject ORDER BY version DESC) AS rn
    FROM versions v JOIN schemas s ON s.ctx = v.ctx AND s.id = v.id WHERE NOT deleted AND s.team = 'search') x WHERE rn = 1""")
def latest_with_property(r: Registry) -> DataFrame:
    return resolution.latest_with(r.versions, r.schemas, team="search")


@query("""
    SELECT s.ctx, s.subject, coalesce(a.alias, s.subject) AS target FROM (SELECT DISTINCT ctx, subject FROM (SELECT ctx, subject FROM subjects UNION ALL SELECT ctx, subject FROM scopes WHERE kind = 'subject') u) s
    LEFT JOIN scopes a ON a.kind = 'subject' AND a.alias <> '' AND a.ctx = s.ctx AND a.subject = s.subject""")
def resolve_aliases(r: Registry) -> DataFrame:
    asked = r.subjects.unionAll(r.scopes.where("kind = 'subject'").select("ctx", "subject")).distinct()
    return resolution.resolve_aliases(asked, r.scopes)


@query("""
    SELECT q.ctx, q.subject, q.fp AS fingerprint, s.id, max(v.version) AS version FROM (SELECT DISTINCT ctx, subject, fp FROM content) q
    JOIN schemas s ON s.ctx = q.ctx AND s.fingerprint = q.fp LEFT JOIN versions v ON v.ctx = q.ctx AND v.subject = q.subject AND v.id = s.id
    WHERE EXISTS (SELECT 1 FROM versions u WHERE u.ctx = s.ctx AND u.id = s.id) GROUP BY ALL""")
def lookup_content(r: Registry) -> DataFrame:
    asked = r.content.select("ctx", "subject", F.col("fp").alias("fingerprint")).distinct()
    return references.lookup(asked, r.schemas, r.versions)


@query("""
    SELECT DISTINCT f.ctx, f.subject, f.version, f.referrer FROM refs f
    WHERE EXISTS (SELECT 1 FROM versions v WHERE v.ctx = f.ctx AND v.id = f.referrer AND NOT v.deleted)""")
def live_referrers(r: Registry) -> DataFrame:
    return references.live_referrers(r.refs, r.versions)


@query("""
    SELECT v.ctx, v.subject, v.version, CASE WHEN EXISTS (SELECT 1 FROM refs f JOIN versions w ON w.ctx = f.ctx AND w.id = f.referrer AND NOT w.deleted
           WHERE f.ctx = v.ctx AND f.subject = v.subject AND f.version = v.version) THEN 42206 END AS error_code FROM versions v""")
def deletable_versions(r: Registry) -> DataFrame:
    return references.deletable(r.versions, r.refs)


@query("SELECT ctx, id FROM schemas s WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.ctx = s.ctx AND v.id = s.id AND NOT v.deleted)")
def orphan_ids(r: Registry) -> DataFrame:
    return references.orphans(r.schemas, r.versions.where("not deleted"))


@query("""
    , walk AS (SELECT DISTINCT subject AS root, target AS subject, 1 AS depth FROM edges WHERE starts_with(subject, 'order-')
               UNION SELECT w.root, e.target, w.depth + 1 FROM walk w JOIN edges e ON e.subject = w.subject WHERE w.depth < 10)
    SELECT root, subject, min(depth) AS depth FROM walk GROUP BY root, subject""")
def reference_closure(r: Registry) -> DataFrame:
    return references.closure(r.edges, r.edges.where("subject like 'order-%'").select("subject").distinct())


GATES = [(i, m) for i in registration.ALLOWED for m in ("READWRITE", "IMPORT", "READONLY", "READONLY_OVERRIDE")]


@query(f"""
    SELECT intent, mode, CASE WHEN intent IN ('SetMode', 'NotSchemaState') OR (intent = 'Write' AND mode = 'READWRITE') OR (intent = 'Import' AND mode = 'IMPORT')
           OR (intent = 'Modify' AND mode IN ('READWRITE', 'IMPORT')) THEN NULL ELSE 42205 END AS error_code FROM (VALUES {values(GATES)}) t(intent, mode)""")
def mode_gate(r: Registry) -> DataFrame:
    return registration.gate(frame(r, GATES, "intent string, mode string"))


@query("""
    SELECT ctx, subject, arg_max(level, seq) FILTER (level IS NOT NULL) AS level, arg_max(validate, seq) FILTER (validate IS NOT NULL) AS validate FROM (
        SELECT ctx, subject, seq, CASE seq % 3 WHEN 0 THEN 'FULL' WHEN 1 THEN 'NONE' END AS level, CASE seq % 5 WHEN 0 THEN true WHEN 1 THEN false END AS validate FROM requests) u
    GROUP BY ctx, subject""")
def merged_settings(r: Registry) -> DataFrame:
    level = F.when(F.col("seq") % 3 == 0, "FULL").when(F.col("seq") % 3 == 1, "NONE")
    validate = F.when(F.col("seq") % 5 == 0, True).when(F.col("seq") % 5 == 1, False)
    return registration.merged_settings(r.requests.select("ctx", "subject", "seq", level.alias("level"), validate.alias("validate")), ["ctx", "subject"], "seq")


@query("""
    SELECT seq, CASE WHEN ctx = '.' THEN '.src' ELSE '.src' || ctx END AS ctx, 'copy-' || subject AS subject, version, id, kind FROM log
    WHERE seq > 100 AND ((ctx = '.' AND starts_with(subject, 'c')) OR (ctx = '.eu' AND subject SIMILAR TO '.*r.*-value'))""")
def exported_events(r: Registry) -> DataFrame:
    return replication.outgoing(r.log, ["c*", ":.eu:*r*-value"], "AUTO", cluster="src", rename="copy-${subject}", after=100)


@query("SELECT ctx, subject, version, id, deleted FROM versions")
def replayed_log(r: Registry) -> DataFrame:
    return replication.replayed(r.log.unionAll(r.log))


@query("SELECT DISTINCT ctx, subject FROM versions v WHERE NOT EXISTS (SELECT 1 FROM versions s WHERE NOT (s.ctx = '.us' AND s.version > 3) AND s.subject <> 'view-value' AND s.ctx = v.ctx AND s.subject = v.subject)")
def surplus_subjects(r: Registry) -> DataFrame:
    source = r.versions.where("not (ctx = '.us' and version > 3) and subject <> 'view-value'")
    return replication.surplus(source, r.versions)


OFFSETS = [("a", 500), ("b", 120), ("c", 10**9)]


@query("SELECT least(120, (SELECT max(seq) FROM log)) AS floor")
def prune_floor(r: Registry) -> DataFrame:
    return replication.prune_floor(frame(r, OFFSETS, "name string, offset long"), r.log)


@query(f"SELECT method, {ROUTE} AS route, CAST(substr(CAST(code AS VARCHAR), 1, 3) AS INT) AS status, count(*) AS requests FROM http GROUP BY ALL")
def request_counts(r: Registry) -> DataFrame:
    return metrics.request_counts(r.http)


@query("SELECT {} AS route, {}, count(*) AS count, round(sum(millis), 2) AS total FROM http GROUP BY 1".format(ROUTE, ", ".join(f"count(*) FILTER (millis <= {e}) AS le_{str(e).replace('.', '_')}" for e in metrics.EDGES)))
def latency_histogram(r: Registry) -> DataFrame:
    return metrics.histogram(r.http)


@query("""
    WITH s AS (SELECT ctx, subject, bool_or(NOT deleted) AS live, count(*) AS n FROM versions GROUP BY ctx, subject)
    SELECT 'subjects' AS gauge, count(*) FILTER (live) AS value FROM s UNION ALL SELECT 'deleted_subjects', count(*) FILTER (NOT live) FROM s
    UNION ALL SELECT 'versions', CAST(sum(n) AS BIGINT) FROM s UNION ALL SELECT 'contexts', count(DISTINCT ctx) FROM s""")
def registry_gauges(r: Registry) -> DataFrame:
    return metrics.gauges(r.versions)


@query(f"""
    SELECT 'requests_total{{method="' || method || '",route="' || route || '",status="' || status || '"}} ' || n AS line FROM (
        SELECT method, {ROUTE} AS route, CAST(substr(CAST(code AS VARCHAR), 1, 3) AS INT) AS status, count(*) AS n FROM http GROUP BY ALL) x ORDER BY 1""")
def metrics_text(r: Registry) -> DataFrame:
    return metrics.exposition(metrics.request_counts(r.http))


@query(f"""
    SELECT route, xs[CAST(round((len(xs) - 1) * 0.5) AS INT) + 1] AS p50, xs[CAST(round((len(xs) - 1) * 0.99) AS INT) + 1] AS p99
    FROM (SELECT {ROUTE} AS route, list(millis ORDER BY millis) AS xs FROM http GROUP BY 1) x""")
def latency_percentiles(r: Registry) -> DataFrame:
    return metrics.nearest_rank(r.http)


BINDINGS = [("ann", "admin", "*"), ("bob", "write", "click*"), ("bob", "read", ".eu::*"), ("cid", "read", "view-value"), ("cid", "write", ".us::*error*")]


@query(f"""
    WITH b AS (SELECT principal, role, CASE WHEN contains(pattern, '::') THEN split_part(pattern, '::', 1) ELSE '.' END AS ctx,
                      replace(CASE WHEN contains(pattern, '::') THEN split_part(pattern, '::', 2) ELSE pattern END, '*', '%') AS p FROM (VALUES {values(BINDINGS)}) t(principal, role, pattern))
    SELECT b.principal, s.ctx, s.subject, string_agg(DISTINCT b.role, ',' ORDER BY b.role) AS roles FROM subjects s JOIN b ON b.ctx = s.ctx AND s.subject LIKE b.p GROUP BY ALL""")
def subject_roles(r: Registry) -> DataFrame:
    return access.roles(r.subjects, frame(r, BINDINGS, "principal string, role string, pattern string"))


USERS = [("ann", "admin"), ("bob", ""), ("cid", ""), ("dan", "read"), ("eve", "write"), ("fay", ""), ("gus", "")]
SCOPES = [("bob", "write", ".eu::orders-*"), ("bob", "read", "*"), ("cid", "write", "eu::*"), ("fay", "admin", "*::pay*"), ("gus", "read", "a?b"), ("gus", "write", ".us::[x]*"), ("gus", "read", ".bad::")]
#: Paths with what they are about, written by hand: the kind, and the name whose roles count, as context and subject.
PATHS = [
    ("/subjects", "listing", None, None), ("/contexts/", "listing", None, None), ("/schemas/ids/3/versions", "listing", None, None), ("/schemas/ids/3", "global", None, None),
    ("/admin", "listing", None, None), ("/_admin/x", "listing", None, None), ("/admin/api/backup", "listing", None, None), ("/admin/api/subjects/pay-a", "subject", ".", "pay-a"),
    ("/metrics", "global", None, None), ("/config", "global", None, None), ("/exporters", "global", None, None), ("/exporters/e", "global", None, None), ("/exporters/e/config", "global", None, None), ("/exporters/e/status", "global", None, None),
    ("/subjects/:.eu:orders-a", "subject", ".eu", "orders-a"), ("/subjects/%3A.eu%3Aorders-a/versions", "subject", ".eu", "orders-a"), ("/subjects/:.eu:/versions", "subject", ".eu", ""), ("/subjects/pay+day", "subject", ".", "pay day"),
    ("/compatibility/subjects/:.eu:orders-a/versions/latest", "subject", ".eu", "orders-a"), ("/compatibility/subjects/axb/versions", "subject", ".", "axb"), ("/config/a%3Fb", "subject", ".", "a?b"), ("/mode/axb", "subject", ".", "axb"),
    ("/config/:.eu:", "context", ".eu", None), ("/config/%3A.eu%3A", "context", ".eu", None), ("/mode/:.us:", "context", ".us", None), ("/contexts/eu", "context", ".eu", None), ("/contexts/.us", "context", ".us", None), ("/mode/:.us:[x]1", "subject", ".us", "[x]1"), ("/config/:.us:x1", "subject", ".us", "x1"),
]
VERBS = ("GET", "POST", "PUT", "DELETE")
#: A binding's pattern as LIKE patterns of context and subject.
LIKES = """SELECT principal, role, replace(CASE WHEN NOT contains(pattern, '::') OR split_part(pattern, '::', 1) IN ('', '.') THEN '.' WHEN split_part(pattern, '::', 1)[1] IN ('.', '*') THEN split_part(pattern, '::', 1)
        ELSE '.' || split_part(pattern, '::', 1) END, '*', '%') AS c, replace(CASE WHEN contains(pattern, '::') THEN split_part(pattern, '::', 2) ELSE pattern END, '*', '%') AS p FROM (VALUES {}) x(principal, role, pattern) WHERE NOT ends_with(pattern, '::')"""


@query(f"""
    WITH u AS (SELECT * FROM (VALUES {values(USERS)}) x(principal, role)), b AS ({LIKES.format(values(SCOPES))}),
         q AS (SELECT u.principal, m.method, p.* FROM u, (VALUES {values([(v,) for v in VERBS])}) m(method), (VALUES {values(PATHS)}) p(path, kind, ctx, subject)),
         r AS (SELECT q.*, string_split(trim(path, '/'), '/') AS s,
                      coalesce(list(DISTINCT b.role) FILTER (b.role IS NOT NULL), []) || coalesce(list(DISTINCT u.role) FILTER (u.role <> ''), []) AS roles
               FROM q JOIN u ON u.principal = q.principal LEFT JOIN b ON b.principal = q.principal AND q.ctx LIKE b.c AND (q.kind = 'subject' AND q.subject LIKE b.p OR q.kind = 'context' AND b.p = '%')
               GROUP BY ALL)
    SELECT principal, method, path, kind, CASE
        WHEN kind = 'listing' AND (starts_with(path, '/admin') OR starts_with(path, '/_admin')) THEN principal IN ('ann', 'fay')
        WHEN kind = 'listing' THEN true
        WHEN starts_with(path, '/admin') OR path = '/metrics' THEN coalesce(list_contains(roles, 'admin'), false)
        WHEN list_contains(roles, 'admin') THEN true
        WHEN s[1] = 'exporters' AND (len(s) = 2 OR s[3] = 'config') THEN false
        WHEN method = 'GET' OR method = 'POST' AND (s[1] = 'subjects' AND len(s) = 2 OR s[1] = 'compatibility') THEN coalesce(len(roles) > 0, false)
        ELSE coalesce(list_contains(roles, 'write'), false) AND kind = 'subject' END AS allowed FROM r""")
def access_decisions(r: Registry) -> DataFrame:
    users = frame(r, USERS, "principal string, role string").selectExpr("principal", "if(role = '', cast(array() as array<string>), array(role)) roles")
    asked = users.select("principal", F.explode(F.array(*map(F.lit, VERBS))).alias("method")).select("*", F.explode(F.array(*(F.lit(p[0]) for p in PATHS))).alias("path"))
    return access.authorized(asked, users, frame(r, SCOPES, "principal string, role string, pattern string"))


@query(f"""
    WITH u AS (SELECT * FROM (VALUES {values(USERS)}) x(principal, role)), b AS ({LIKES.format(values(BINDINGS))})
    SELECT u.principal, s.ctx, s.subject FROM subjects s, u WHERE u.role <> '' OR u.principal NOT IN (SELECT principal FROM b)
        OR EXISTS (SELECT 1 FROM b WHERE b.principal = u.principal AND s.ctx LIKE b.c AND s.subject LIKE b.p)""")
def visible_subjects(r: Registry) -> DataFrame:
    users = frame(r, USERS, "principal string, role string").selectExpr("principal", "if(role = '', cast(array() as array<string>), array(role)) roles")
    return access.visible_subjects(r.subjects, users, frame(r, BINDINGS, "principal string, role string, pattern string"))


@query(f"""
    WITH u AS (SELECT * FROM (VALUES {values(USERS)}) x(principal, role)), b AS ({LIKES.format(values(BINDINGS))}), c AS (SELECT DISTINCT ctx FROM subjects)
    SELECT u.principal, c.ctx FROM c, u WHERE u.role <> '' OR u.principal NOT IN (SELECT principal FROM b)
        OR EXISTS (SELECT 1 FROM b WHERE b.principal = u.principal AND c.ctx LIKE b.c)""")
def visible_contexts(r: Registry) -> DataFrame:
    users = frame(r, USERS, "principal string, role string").selectExpr("principal", "if(role = '', cast(array() as array<string>), array(role)) roles")
    return access.visible_contexts(r.subjects.select("ctx").distinct(), users, frame(r, BINDINGS, "principal string, role string, pattern string"))


HOSTS = [(1, "a.example.com", "one"), (2, "*.example.com", "two"), (3, "[xy].org", "three")]
ASKED_HOSTS = [("a.example.com",), ("b.example.com",), ("x.org",), ("z.org",)]


@query("SELECT host, container, error_code FROM (VALUES ('a.example.com', 'one', NULL), ('b.example.com', 'two', NULL), ('x.org', 'three', NULL), ('z.org', NULL, 42101)) t(host, container, error_code)")
def host_containers(r: Registry) -> DataFrame:
    return access.route_hosts(frame(r, ASKED_HOSTS, "host string"), frame(r, HOSTS, "ordinal int, pattern string, container string"))


#: A record schema for each id: a field `a`, and for two of three ids a field `b`, with a default for every other.
FIELD_A = "CASE id % 7 WHEN 0 THEN 'int' WHEN 1 THEN 'long' WHEN 2 THEN 'float' WHEN 3 THEN 'double' WHEN 4 THEN 'string' WHEN 5 THEN 'bytes' ELSE 'boolean' END"
FIELD_B = "CASE id % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'long' WHEN 2 THEN 'float' WHEN 3 THEN 'double' ELSE 'string' END"
AVRO = f"""concat('{{"type":"record","name":"R","fields":[{{"name":"a","type":"', {FIELD_A}, '"}}',
    CASE WHEN id % 3 <> 0 THEN concat(',{{"name":"b","type":"', {FIELD_B}, '"', CASE WHEN id % 2 = 0 THEN CASE WHEN id % 5 = 4 THEN ',"default":""' ELSE ',"default":0' END ELSE '' END, '}}') ELSE '' END, ']}}')"""
#: Whether the record of one id reads that of another, by the table of promotions.
PROMOTED = "(r{0} = w{0} OR (w{0}, r{0}) IN (" + ", ".join(f"('{w}', '{r}')" for w, r in sorted(avro.PROMOTIONS)) + "))"
READS = f"({PROMOTED.format('a')} AND CASE WHEN rb IS NULL THEN true WHEN wb IS NULL THEN rd ELSE {PROMOTED.format('b')} END)"
SHAPES = f"(SELECT DISTINCT id, {FIELD_A} AS a, CASE WHEN id % 3 <> 0 THEN {FIELD_B} END AS b, id % 2 = 0 AS d FROM versions)"


def history(r: Registry) -> tuple[DataFrame, DataFrame]:
    """The newest version of every subject as a new schema, and the versions before it."""
    rows = r.versions.select(F.concat_ws(":", "ctx", "subject").alias("key"), "version", F.expr(AVRO).alias("text"))
    last = rows.groupBy("key").agg(F.max("version").alias("last"), F.max_by("text", "version").alias("text"))
    before = rows.join(last.select("key", "last"), "key").where("version < last")
    return last.select("key", "text", F.lit("AVRO").alias("type")), before.select("key", "version", F.col("text").alias("old_text"), F.lit("AVRO").alias("old_type"))


PAIRS = f"""
    WITH l AS (SELECT ctx, subject, max(version) AS last, arg_max(id, version) AS new_id FROM versions GROUP BY ctx, subject),
         p AS (SELECT concat(v.ctx, ':', v.subject) AS key, v.version, l.last - 1 AS newest, n.a AS na, n.b AS nb, n.d AS nd, o.a AS oa, o.b AS ob, o.d AS od
               FROM versions v JOIN l ON l.ctx = v.ctx AND l.subject = v.subject AND v.version < l.last JOIN {SHAPES} n ON n.id = l.new_id JOIN {SHAPES} o ON o.id = v.id),
         q AS (SELECT key, version, newest,
                      (SELECT {READS} FROM (SELECT na AS ra, nb AS rb, nd AS rd, oa AS wa, ob AS wb) x) AS reads_old,
                      (SELECT {READS} FROM (SELECT oa AS ra, ob AS rb, od AS rd, na AS wa, nb AS wb) x) AS read_by_old FROM p)"""


@query(f"{PAIRS} SELECT key, version, reads_old, read_by_old FROM q")
def avro_readable(r: Registry) -> DataFrame:
    new, old = history(r)
    pairs = new.join(old, "key")
    done = avro.with_readable(avro.with_readable(pairs, "text", "old_text", "reads_old"), "old_text", "text", "read_by_old")
    return done.select("key", "version", "reads_old", "read_by_old")


FAILS = {"NONE": "false", "BACKWARD": "NOT reads_old AND version = newest", "BACKWARD_TRANSITIVE": "NOT reads_old", "FORWARD": "NOT read_by_old AND version = newest", "FORWARD_TRANSITIVE": "NOT read_by_old",
         "FULL": "NOT (reads_old AND read_by_old) AND version = newest", "FULL_TRANSITIVE": "NOT (reads_old AND read_by_old)"}


@query(f"{PAIRS} " + " UNION ALL ".join(f"SELECT key, '{k}' AS level, count(*) FILTER ({v}) = 0 AS compatible, max(version) FILTER ({v}) AS failing_version FROM q GROUP BY key" for k, v in FAILS.items()))
def avro_compatibility_levels(r: Registry) -> DataFrame:
    new, old = history(r)
    return compatibility.verdicts(new, old, avro.with_readable)


@query(f"SELECT DISTINCT {AVRO} AS text, {AVRO} AS canonical, CAST(NULL AS VARCHAR) AS error FROM versions")
def avro_canonical(r: Registry) -> DataFrame:
    return avro.with_canonical(r.versions.select(F.expr(AVRO).alias("text")).distinct(), "text").select("text", "canonical", "error")


@query("SELECT DISTINCT content, replace(content, ' ', '') AS canonical, replace(content, ' ', '') AS normalized FROM requests")
def json_canonical(r: Registry) -> DataFrame:
    return json_text.with_canonical(r.requests.select("content").distinct(), "content")


@query("""
    SELECT w.ctx, w.subject, w.version, v.version AS resolved, v.id, CASE WHEN v.id IS NULL THEN 42201 END AS error_code
    FROM (SELECT DISTINCT ctx, subject, CASE WHEN version % 3 = 0 THEN -1 ELSE version * 2 END AS version FROM versions) w
    LEFT JOIN (SELECT ctx, subject, max(version) AS latest FROM versions WHERE NOT deleted GROUP BY ctx, subject) l ON l.ctx = w.ctx AND l.subject = w.subject
    LEFT JOIN versions v ON v.ctx = w.ctx AND v.subject = w.subject AND v.version = CASE WHEN w.version = -1 THEN l.latest ELSE w.version END""")
def resolve_references(r: Registry) -> DataFrame:
    wanted = r.versions.select("ctx", "subject", F.expr("CASE WHEN version % 3 = 0 THEN -1 ELSE version * 2 END").alias("version")).distinct()
    return references.resolve_references(wanted, r.versions)


#: Protobuf fields of two generations of each id's message.
PROTO_TYPE = "CASE {} % 8 WHEN 0 THEN 'int32' WHEN 1 THEN 'int64' WHEN 2 THEN 'string' WHEN 3 THEN 'bytes' WHEN 4 THEN 'fixed32' WHEN 5 THEN 'sint32' WHEN 6 THEN 'double' ELSE 'Other' END"
PROTO = """SELECT ctx || id AS message, t AS tag, 'f' || CASE WHEN (id + t) % {rename} = 0 THEN t + 100 ELSE t END AS name, {type} AS type, CASE WHEN (id + t) % 5 = 0 THEN 'required' ELSE 'optional' END AS label
    FROM (SELECT ctx, id, {each} AS t FROM schemas) s WHERE (id * 7 + t) % {drop} <> 0"""
OLD = dict(rename=99999, type=PROTO_TYPE.format("(id + t)"), drop=4)
NEW = dict(rename=6, type=PROTO_TYPE.format("(id + t * t % 3)"), drop=5)
GROUP = "CASE WHEN {0} IN ('int32', 'int64') THEN 'n' WHEN {0} IN ('string', 'bytes') THEN 's' ELSE {0} END"


@query(f"""
    WITH o AS ({PROTO.format(each="unnest(range(1, 7))", **OLD)}), n AS ({PROTO.format(each="unnest(range(1, 7))", **NEW)}),
         k AS (SELECT message, tag, CASE WHEN o.name IS NULL THEN CASE WHEN n.label = 'required' THEN 'REQUIRED_FIELD_ADDED' ELSE 'FIELD_ADDED' END
                      WHEN n.name IS NULL THEN CASE WHEN o.label = 'required' THEN 'REQUIRED_FIELD_REMOVED' ELSE 'FIELD_REMOVED' END
                      WHEN {GROUP.format('o.type')} <> {GROUP.format('n.type')} THEN 'FIELD_SCALAR_KIND_CHANGED' WHEN o.name <> n.name THEN 'FIELD_NAME_CHANGED' END AS kind
               FROM o FULL JOIN n USING (message, tag))
    SELECT message, tag, kind, kind IN ('FIELD_ADDED', 'FIELD_REMOVED', 'FIELD_NAME_CHANGED') AS compatible FROM k WHERE kind IS NOT NULL""")
def proto_field_differences(r: Registry) -> DataFrame:
    fields = lambda how: r.schemas.sparkSession.sql(PROTO.replace("FROM schemas", "FROM {schemas}").format(each="explode(sequence(1, 6))", schemas="{schemas}", **how), schemas=r.schemas)
    return compatibility.field_differences(fields(OLD), fields(NEW))


@query("""
    SELECT concat(ctx, ':', subject) AS key, v.version FROM versions v JOIN schemas s USING (ctx, id)
    JOIN (SELECT ctx, subject, arg_max(s.team, version) AS team FROM versions v JOIN schemas s USING (ctx, id) GROUP BY ctx, subject) n USING (ctx, subject)
    WHERE NOT v.deleted AND s.team = n.team""")
def compatibility_candidates(r: Registry) -> DataFrame:
    rows = r.versions.join(r.schemas.select("ctx", "id", "team"), ["ctx", "id"]).select(F.concat_ws(":", "ctx", "subject").alias("key"), "version", "deleted", "team")
    new = rows.groupBy("key").agg(F.max_by("team", F.when(F.col("team").isNotNull(), F.col("version"))).alias("team"))
    return compatibility.candidates(new, rows, "team").select("key", "version")
