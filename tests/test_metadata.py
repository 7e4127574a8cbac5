from pyspark.sql import functions as F

from regolith.functions import metadata as M
from regolith.operators import replication


def test_layers(spark):
    df = spark.sql(f"SELECT cast(named_struct('tags', map('t', array('b', 'a', 'a')), 'properties', map('p', '1', 'confluent:version', '2'), 'sensitive', array('s', 'r')) AS {M.METADATA}) a, cast(named_struct('tags', null, 'properties', map('p', '9'), 'sensitive', array('s', 'z')) AS {M.METADATA}) b, cast(null AS {M.METADATA}) c")
    r = df.select(M.merge_metadata(F.col("a"), F.col("c"), F.col("b")).alias("m"), M.merge_metadata(F.col("c"), F.col("c")).alias("n"), M.without_marker(F.col("a")).alias("w"), M.canonical_metadata(F.col("a")).alias("k"), M.marked_version(F.col("a")).alias("v")).first()
    assert (r.m.tags, r.m.properties, r.m.sensitive, r.n) == ({"t": ["b", "a", "a"]}, {"p": "9", "confluent:version": "2"}, ["s", "r", "z"], None)
    assert (r.w.properties, r.k.tags, sorted(r.k.properties), r.k.sensitive, r.v) == ({"p": "1"}, {"t": ["a", "b"]}, ["confluent:version", "p"], ["r", "s"], "2")


def test_rules_of_a_name_replace_in_place(spark):
    rule = lambda n, t: f"named_struct('name', '{n}', 'kind', 'CONDITION', 'mode', 'WRITE', 'type', '{t}', 'expr', '')"
    df = spark.sql(f"SELECT array({rule('a', 'x')}, {rule('b', 'x')}) p, array({rule('a', 'y')}, {rule('c', 'y')}) q, cast(null AS {M.RULES}) r")
    got = df.select(M.merge_rules(F.col("p"), F.col("r"), F.col("q")).alias("m")).first().m
    assert [(x.name, x.type) for x in got] == [("a", "y"), ("b", "x"), ("c", "y")]


def test_exporter_states(spark):
    df = spark.createDataFrame([("a", "FAILED", 5, "resume"), ("b", "PAUSED", 5, "reset"), ("c", "RUNNING", 5, "pause")], "name string, state string, offset long, command string")
    got = {r.name: (r.state, r.offset, r.error_code) for r in replication.commanded(df).collect()}
    assert got == {"a": ("FAILED", 5, 42250), "b": ("PAUSED", 0, None), "c": ("PAUSED", 5, None)}
    reports = spark.createDataFrame([("c", 5, 9), ("b", 4, 9)], "name string, expected long, offset long")
    now = {r.name: r.offset for r in replication.progressed(df.drop("command"), reports).collect()}
    assert now == {"a": 5, "b": 5, "c": 9}
    assert {r.name for r in replication.bootstrap(df, 6).where("bootstraps").collect()} == {"a", "b", "c"}
