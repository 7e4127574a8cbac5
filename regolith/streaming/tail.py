"""Tailing the change log with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regolith.operators.replication import outgoing

LOG_SCHEMA = "seq long, ctx string, subject string, version int, id int, kind string"


def read_log(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """The log as a stream of Parquet files, some at a time. There is no event time and no late data: the order is
    that of seq, which is given at commit."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def export(log: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, patterns: list[str], kind: str = "NONE", cluster: str = "", custom: str = "", rename: str | None = None) -> StreamingQuery:
    """Delivers the selected events batch by batch, each in order of seq. The checkpoint holds the offsets; a batch
    that fails is delivered again, so `deliver` must take repeats, as applied() does."""

    def batch(df: DataFrame, number: int) -> None:
        deliver(outgoing(df, patterns, kind, cluster, custom, rename).sortWithinPartitions("seq"), number)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def applied(path: str) -> Callable[[DataFrame, int], None]:
    """A destination that keeps every batch in a folder of its own: a batch that is delivered twice replaces itself."""
    return lambda df, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """All events of a destination."""
    return spark.read.schema(f"{LOG_SCHEMA}, batch long").parquet(path)


def version_state(log: DataFrame) -> DataFrame:
    """A running table of the last event of every version, for update mode."""
    return log.groupBy("ctx", "subject", "version").agg(F.max_by(F.struct("id", "kind"), "seq").alias("last"), F.max("seq").alias("seq"))
