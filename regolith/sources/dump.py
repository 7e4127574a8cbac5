"""The dump of a registry as JSON lines, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("header", "config", "mode", "schema", "exporter")


def dump_lines(versions: DataFrame, schemas: DataFrame, scopes: DataFrame) -> DataFrame:
    """kind, place and line: a header, the settings, the modes, then every version with its schema, deleted ones too.

    The lines are ordered by (kind's rank, place); a writer that needs one file sorts by them."""
    spark = versions.sparkSession
    head = spark.range(1).select(F.lit(0).alias("rank"), F.lit("").alias("place"), F.to_json(F.struct(F.lit("header").alias("record"), F.lit(1).alias("format"))).alias("line"))
    place = F.concat_ws("\x00", "ctx", "subject")
    config = scopes.where("level is not null or alias is not null").select(F.lit(1).alias("rank"), place.alias("place"), F.to_json(F.struct(F.lit("config").alias("record"), "kind", "ctx", "subject", "level", "alias")).alias("line"))
    mode = scopes.where("mode is not null").select(F.lit(2).alias("rank"), place.alias("place"), F.to_json(F.struct(F.lit("mode").alias("record"), "kind", "ctx", "subject", "mode")).alias("line"))
    body = versions.select("ctx", "subject", "version", "id", "deleted", "ts").join(schemas.select("ctx", "id", "type", "text"), ["ctx", "id"])
    schema = body.select(
        F.lit(3).alias("rank"),
        F.concat_ws("\x00", "ctx", "subject", F.lpad(F.col("version").cast("string"), 10, "0")).alias("place"),
        F.to_json(F.struct(F.lit("schema").alias("record"), "ctx", "subject", "version", "id", "deleted", "ts", F.col("type").alias("schemaType"), F.col("text").alias("schema"))).alias("line"),
    )
    return head.unionAll(config).unionAll(mode).unionAll(schema)


def write_dump(lines: DataFrame, path: str) -> None:
    """Text files whose concatenation in name order is the dump: ranges of the order, sorted within."""
    lines.repartitionByRange("rank", "place", "line").sortWithinPartitions("rank", "place", "line").select("line").write.text(path)


def read_dump(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """versions, schemas and scopes of a dump; lines of unknown kinds are skipped."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    kind = F.get_json_object("line", "$.record")
    get = lambda schema: F.from_json("line", schema).alias("r")
    rows = lines.where(kind == "schema").select(get("ctx string, subject string, version int, id int, deleted boolean, ts long, schemaType string, schema string")).select("r.*")
    config = lines.where(kind == "config").select(get("kind string, ctx string, subject string, level string, alias string")).select("r.*")
    mode = lines.where(kind == "mode").select(get("kind string, ctx string, subject string, mode string")).select("r.*")
    return {
        "versions": rows.select("ctx", "subject", "version", "id", "deleted", "ts"),
        "schemas": rows.select("ctx", "id", F.col("schemaType").alias("type"), F.col("schema").alias("text")).distinct(),
        "scopes": config.join(mode, ["kind", "ctx", "subject"], "full"),
    }
