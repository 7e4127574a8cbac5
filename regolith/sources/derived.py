"""A registry derived from the driver's tables, each relation defined once in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.operators.registration import positions

#: What the two engines spell differently: a zero character, SHA-256 in hex, epoch milliseconds of a timestamp.
SPARK = {
    "nul": "char(0)",
    "sha": "sha2({}, 256)",
    "ms": "(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {}) div 1000)",
}
DUCKDB = {"nul": "chr(0)", "sha": "sha256({})", "ms": "(epoch_us({}) // 1000)"}

#: name -> SQL over driver tables and the relations before it.
RELATIONS = {
    # registration requests in commit order; the content stands for a canonical schema text
    "requests": """
        SELECT event_id AS seq,
               CASE user_id % 3 WHEN 0 THEN '.' WHEN 1 THEN '.eu' ELSE '.us' END AS ctx,
               event_type || '-value' AS subject, props AS content, {ms_ts} AS ts, value
        FROM events""",
    # the content hash of a schema without references, metadata and rules
    "content": """
        SELECT ctx, subject, content, seq, ts, {fingerprint} AS fp FROM requests""",
    "ids": """
        SELECT ctx, fp, content, CAST(row_number() OVER (PARTITION BY ctx ORDER BY seq) AS INT) AS id
        FROM (SELECT ctx, fp, min(content) AS content, min(seq) AS seq FROM content GROUP BY ctx, fp) f""",
    "versions": """
        SELECT v.ctx, v.subject, CAST(row_number() OVER (PARTITION BY v.ctx, v.subject ORDER BY v.seq) AS INT) AS version,
               i.id, v.seq % 4 = 0 AS deleted, v.ts, v.seq
        FROM (SELECT ctx, subject, fp, min(seq) AS seq, min(ts) AS ts FROM content GROUP BY ctx, subject, fp) v
        JOIN ids i ON i.ctx = v.ctx AND i.fp = v.fp""",
    "schemas": """
        SELECT ctx, id, 'AVRO' AS type, content AS text, fp AS fingerprint,
               CASE id % 5 WHEN 0 THEN 'TRANSFORM' WHEN 1 THEN 'CONDITION' ELSE NULL END AS domain_rule,
               CASE id % 7 WHEN 0 THEN 'ENCRYPT' ELSE NULL END AS encoding_rule,
               CASE WHEN id % 2 = 0 THEN 'payments' WHEN id % 3 = 0 THEN 'search' ELSE NULL END AS team
        FROM ids""",
    # an id referenced by the schemas of other ids: (subject, version) is the target, id the referrer's
    "refs": """
        SELECT v.ctx, v.subject, v.version, s.id AS referrer
        FROM versions v JOIN schemas s ON s.ctx = v.ctx AND s.id % 11 = v.version AND s.id <> v.id""",
    "subjects": "SELECT DISTINCT ctx, subject FROM versions",
    # settings by scope: global, context and subject; a null level is unset
    "scopes": """
        SELECT 'global' AS kind, '' AS ctx, '' AS subject, 'BACKWARD' AS level, CAST(NULL AS STRING) AS alias, 'READWRITE' AS mode
        UNION ALL SELECT 'context', '.eu', '', 'FULL', NULL, 'READONLY' FROM region WHERE r_regionkey = 3
        UNION ALL SELECT 'context', '.us', '', NULL, NULL, 'READWRITE' FROM region WHERE r_regionkey = 1
        UNION ALL
        SELECT 'subject', ctx, subject, max(level), NULL, max(mode) FROM (
        SELECT CASE n_nationkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '.eu' ELSE '.us' END AS ctx,
               CASE n_nationkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' WHEN 3 THEN 'signup' ELSE 'purchase' END || '-value' AS subject,
               CASE n_regionkey WHEN 0 THEN 'NONE' WHEN 1 THEN 'FORWARD' WHEN 2 THEN 'FULL_TRANSITIVE' ELSE NULL END AS level,
               CASE n_nationkey % 4 WHEN 0 THEN 'IMPORT' WHEN 1 THEN 'READONLY' ELSE NULL END AS mode
        FROM nation) n GROUP BY ctx, subject
        UNION ALL
        SELECT 'subject', CASE s_suppkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '.eu' ELSE '.us' END, s_name, NULL,
               CASE s_suppkey % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'gone' ELSE 'error' END || '-value', NULL
        FROM supplier""",
    # subject -> referenced subject, with a cycle between the regions
    "edges": """
        SELECT 'order-' || o_orderkey AS subject, 'customer-' || o_custkey AS target FROM orders
        UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey FROM customer
        UNION ALL SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey FROM nation
        UNION ALL SELECT 'region-' || r_regionkey, 'region-' || ((r_regionkey + 1) % 5) FROM region""",
    # the change log: registrations, then soft deletes
    "log": """
        SELECT seq * 2 AS seq, ctx, subject, version, id, 'REGISTER' AS kind FROM versions
        UNION ALL SELECT seq * 2 + 1, ctx, subject, version, id, 'SOFT_DELETE' FROM versions WHERE deleted""",
    "http": """
        SELECT event_id, CASE event_type WHEN 'click' THEN '/subjects/' || event_type || '/versions' WHEN 'view' THEN '/schemas/ids/' || user_id
                         WHEN 'error' THEN '/config' ELSE '/subjects/' || event_type || '/versions/latest' END AS path,
               CASE WHEN event_id % 5 = 0 THEN 'POST' ELSE 'GET' END AS method,
               CASE WHEN event_id % 17 = 0 THEN 40401 WHEN event_id % 23 = 0 THEN 42201 ELSE 200 END AS code, value AS millis
        FROM events""",
}


def _filled(sql: str, spell: dict[str, str]) -> str:
    nul = spell["nul"]
    payload = f"concat('AVRO', {nul}, content, {nul}, {nul}, {nul})"
    return sql.replace("{ms_ts}", spell["ms"].format("ts")).replace("{fingerprint}", spell["sha"].format(payload))


TABLES = ("events", "region", "nation", "supplier", "orders", "customer")


class Registry:
    """The relations of a registry as attributes; each is built when it is first asked for, and what a query doesn't
    touch is never read.

    Spark numbers ids and versions by positions, since a window would put a whole context in one task."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self._sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in RELATIONS:
            raise AttributeError(name)
        return self._relation(name)

    def _relation(self, name: str) -> DataFrame:
        if name not in self._known:
            own = {"ids": self._ids, "versions": self._versions}
            self._known[name] = own[name]() if name in own else self._read(name) if name in TABLES else self._derived(name)
        return self._known[name]

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._sf_dir}/{name}.parquet")

    def _derived(self, name: str) -> DataFrame:
        names = "|".join([*TABLES, *RELATIONS])
        text, before = _filled(RELATIONS[name], SPARK), rf"\b(FROM|JOIN) ({names})\b"
        used = {m[1] for m in re.findall(before, text)}
        return self.spark.sql(re.sub(before, r"\1 {\2}", text), **{k: self._relation(k) for k in used})

    def _ids(self) -> DataFrame:
        first = self.content.groupBy("ctx", "fp").agg(F.min("content").alias("content"), F.min("seq").alias("seq"))
        return positions(first, ["ctx"], ["seq"], "id").select("ctx", "fp", "content", "id")

    def _versions(self) -> DataFrame:
        first = self.content.groupBy("ctx", "subject", "fp").agg(F.min("seq").alias("seq"), F.min("ts").alias("ts"))
        numbered = positions(first, ["ctx", "subject"], ["seq"], "version").join(self.ids.select("ctx", "fp", "id"), ["ctx", "fp"])
        return numbered.select("ctx", "subject", "version", "id", (F.col("seq") % 4 == 0).alias("deleted"), "ts", "seq")


def registry(spark: SparkSession, sf_dir: str) -> Registry:
    """The derived registry over a folder of the driver's tables."""
    return Registry(spark, sf_dir)


def with_relations(select: str) -> str:
    """DuckDB SQL of a query over the same relations; one that begins with WITH adds its own."""
    select = select.strip()
    select = ", " + select[4:] if select.startswith("WITH ") else select
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({_filled(sql, DUCKDB)})" for name, sql in RELATIONS.items()) + "\n" + select
