"""Counters, cumulative histograms, gauges and nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions.names import http_status, method_label, route_shape
from regolith.scratch import stored

#: Upper edges of the histogram, in the unit of the measure.
EDGES = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)


def request_counts(http: DataFrame) -> DataFrame:
    return http.groupBy(method_label(F.col("method")).alias("method"), route_shape(F.col("path")).alias("route"), http_status(F.col("code")).alias("status")).agg(F.count("*").alias("requests"))


def histogram(http: DataFrame, measure: str = "millis", edges: tuple[float, ...] = EDGES) -> DataFrame:
    """Per route: how many were at most each edge, all, and their sum; one pass, without exploding the rows."""
    sums = [F.count_if(F.col(measure) <= e).alias(f"le_{str(e).replace('.', '_')}") for e in edges]
    return http.groupBy(route_shape(F.col("path")).alias("route")).agg(*sums, F.count("*").alias("count"), F.round(F.sum(measure), 2).alias("total"))


def gauges(versions: DataFrame) -> DataFrame:
    """Live subjects, wholly deleted subjects, versions and contexts of the registry, one row each."""
    subjects = versions.groupBy("ctx", "subject").agg(F.bool_or(~F.col("deleted")).alias("live"), F.count("*").alias("n"))
    row = subjects.agg(
        F.count_if("live").alias("subjects"), F.count_if(~F.col("live")).alias("deleted_subjects"), F.coalesce(F.sum("n"), F.lit(0)).alias("versions"), F.count_distinct("ctx").alias("contexts")
    )
    return row.unpivot([], ["subjects", "deleted_subjects", "versions", "contexts"], "gauge", "value")


def exposition(counts: DataFrame) -> DataFrame:
    """The counters as sorted lines of text."""
    line = F.format_string('requests_total{method="%s",route="%s",status="%d"} %d', "method", "route", "status", "requests")
    return counts.select(line.alias("line")).orderBy("line")


def nearest_rank(http: DataFrame, points: tuple[float, ...] = (0.5, 0.99), measure: str = "millis") -> DataFrame:
    """Per route: the sample at index round((n - 1) * p) of the sorted samples, not an interpolation; nulls come first.

    Equal samples are counted before the shuffle. The distinct ones are dealt out by range over route and value; sums
    for each partition and route tell which partition holds an index, and only there a running count finds it. So no
    route's samples meet in one row or task."""
    route = route_shape(F.col("path")).alias("route")
    counts = http.groupBy(route, F.col(measure).alias("x")).agg(F.count("*").alias("c"))
    values = stored(counts.repartitionByRange("route", "x").withColumn("_part", F.spark_partition_id()), "ranks")
    every, upto = Window.partitionBy("route"), Window.partitionBy("route").orderBy("_part")  # a row for each partition
    sizes = values.groupBy("route", "_part").agg(F.sum("c").alias("size"))
    sizes = sizes.select("route", "_part", "size", (F.sum("size").over(upto) - F.col("size")).alias("before"), F.sum("size").over(every).alias("n"))
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("point"), F.round((F.col("n") - 1) * p).alias("at")) for i, p in enumerate(points))))
    hits = sizes.withColumn("w", wanted).where("before <= w.at and w.at < before + size").select(F.col("route").alias("_route"), F.col("_part").alias("_at"), "before", "w.point", "w.at")
    near = values.join(hits, F.col("route").eqNullSafe(F.col("_route")) & (F.col("_part") == F.col("_at")))
    running = Window.partitionBy("route", "_part", "point").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("end", F.col("before") + F.sum("c").over(running)).where("end - c <= at and at < end")
    return near.groupBy("route").agg(*(F.max(F.when(F.col("point") == i, F.col("x"))).alias(f"p{round(p * 100)}") for i, p in enumerate(points)))
