"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where none is named, a local session takes a temporary
    one; on a cluster that is an error, since executors don't share their disks."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="regolith-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


#: Folders of tables written by stored() and not yet deleted, by session folder.
_written: list[str] = []


def written() -> int:
    """A mark for cleared()."""
    return len(_written)


def cleared(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Deletes what stored() has written since a mark, but for the tables in `keep`. Only for a caller that knows that
    nothing unfinished reads them."""
    kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for t in keep for f in t.inputFiles()}
    jvm = spark.sparkContext._jvm
    gone = [p for p in _written[mark:] if p.rsplit("/", 1)[-1] not in kept]
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _written[mark:] = [p for p in _written[mark:] if p not in gone]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts its lineage and fixes what is not
    deterministic in it."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
