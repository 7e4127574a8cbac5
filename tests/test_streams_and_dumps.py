from pyspark.sql import functions as F

from regolith.operators import registration, replication
from regolith.sources import dump
from regolith.sources.derived import registry
from regolith.streaming import tail

SF = "/root/testdata/sf0.001"


def test_export_catches_up_and_takes_repeats(spark, tmp_path):
    log = registry(spark, SF).log.select("seq", "ctx", "subject", "version", "id", "kind")
    for part in (0, 1):
        log.where(F.col("seq") % 2 == part).coalesce(2).write.mode("append").parquet(f"{tmp_path}/log")
        q = tail.export(tail.read_log(spark, f"{tmp_path}/log"), tail.applied(f"{tmp_path}/out"), f"{tmp_path}/offsets", ["c*", ":.eu:*"], "AUTO", cluster="x")
        q.awaitTermination(120)
    got = tail.delivered(spark, f"{tmp_path}/out")
    want = replication.outgoing(log, ["c*", ":.eu:*"], "AUTO", cluster="x")
    cols = want.columns
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.collect()))
    state = replication.replayed(got.select(cols).unionAll(got.select(cols)))
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, replication.replayed(want).collect()))


def test_restore_of_a_dump_is_the_registry(spark, tmp_path):
    r = registry(spark, SF)
    scopes = r.scopes.where("alias is null")
    dump.write_dump(dump.dump_lines(r.versions, r.schemas, scopes), f"{tmp_path}/dump")
    back = dump.read_dump(spark, f"{tmp_path}/dump")
    rows = lambda df, cols: sorted(map(repr, map(tuple, df.select(cols).collect())))
    cols = ["ctx", "subject", "version", "id", "deleted", "ts"]
    assert rows(back["versions"], cols) == rows(r.versions, cols)
    assert rows(back["schemas"], ["ctx", "id", "type", "text"]) == rows(r.schemas, ["ctx", "id", "type", "text"])
    cols = ["kind", "ctx", "subject", "level", "mode"]
    assert rows(back["scopes"], cols) == rows(scopes.where("level is not null or mode is not null"), cols)
    first = spark.read.text(sorted(str(p) for p in (tmp_path / "dump").glob("part-*"))[0]).first().value
    assert '"record":"header"' in first


def test_positions_of_a_group_of_any_size(spark):
    rows = [("big", i * 7 % 1009) for i in range(1009)] + [("b", 2), ("b", 1), (None, 5)]
    got = registration.positions(spark.createDataFrame(rows, "g string, x int"), ["g"], ["x"], "at").collect()
    assert all(r["at"] == (r.x + 1 if r.g == "big" else {1: 1, 2: 2, 5: 1}[r.x]) for r in got) and len(got) == len(rows)


def test_prune_floor(spark):
    log = spark.createDataFrame([(i,) for i in range(1, 11)], "seq long")
    floor = lambda rows: replication.prune_floor(spark.createDataFrame(rows, "name string, offset long"), log).first().floor
    assert (floor([]), floor([("a", 4), ("b", 7)]), floor([("a", 99)]), floor([("a", 4), ("b", None)])) == (10, 4, 10, 0)
