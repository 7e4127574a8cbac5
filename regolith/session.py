"""Session defaults for local runs; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(app: str = "regolith", cores: str | int | None = None) -> SparkSession:
    """A local session with adaptive execution, UTC and a shuffle width that fits the cores."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("REGOLITH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once for each application, unless their PYTHONPATH has it."""
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    on_path = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) in on_path or getattr(sc, "_regolith_shipped", False):
        return spark
    to = Path(tempfile.mkdtemp(prefix="regolith-ship-")) / "regolith.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted((root / "regolith").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(to))
    sc._regolith_shipped = True
    return spark
