import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from regolith.llm import sharding as S


def test_curve_visits_neighbours():
    for dims, bits in ((1, 3), (2, 4), (3, 3), (4, 2)):
        steps, at = S.hilbert_steps(dims), {}
        for point in itertools.product(range(1 << bits), repeat=dims):
            state = h = 0
            for level in reversed(range(bits)):
                cell = sum((point[j] >> level & 1) << j for j in range(dims))
                code = steps[state * (1 << dims) + cell]
                state, h = code >> dims, h << dims | code & (1 << dims) - 1
            at[h] = point
        assert sorted(at) == list(range(1 << bits * dims))
        assert all(sum(abs(x - y) for x, y in zip(at[i], at[i + 1])) == 1 for i in range(len(at) - 1))


def test_spark_curve_equals_steps(spark):
    steps = S.hilbert_steps(3)
    rows = list(itertools.product(range(8), repeat=3))
    df = spark.createDataFrame(rows, "a int, b int, c int")
    for r in df.withColumn("h", S.hilbert_index([F.col("a"), F.col("b"), F.col("c")], 3)).collect():
        state = h = 0
        for level in (2, 1, 0):
            code = steps[state * 8 + sum((r[j] >> level & 1) << j for j in range(3))]
            state, h = code >> 3, h << 3 | code & 7
        assert r.h == h


def check_rows_law(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, ())) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_op1(spark, sf, sample):
    rows = S.op1_hilbert_shards(spark, sf).collect()
    check_rows_law(rows, 40)
    texts = {r.doc_id: (r.text or "").encode() for r in sample.collect()}
    assert sorted(texts) == sorted(r.doc_id for r in rows)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "rows", None) for r in rows)
    assert sorted(r.rank for r in rows) == list(range(len(rows)))
    assert [r.hilbert for r in sorted(rows, key=lambda r: r.rank)] == sorted(r.hilbert for r in rows)


def test_odd_rows(documents, nothing):
    keys = S.document_keys(documents)
    done = S.hilbert_shards(keys, ["lang", "source", "size"], ["text_crc32", "size", "doc_id"], 4)
    check_rows_law(done.collect(), 4)
    assert S.hilbert_shards(S.document_keys(nothing), ["lang", "source", "size"], ["doc_id"], 4).count() == 0


def test_files_and_pruning(spark, sample, tmp_path):
    m = S.write_shards(sample, f"file://{tmp_path}/out", ["n_chars", "lang"], ["doc_id"], 8)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == sample.count() and set(sample.columns) <= set(back.columns)
    hit = {r.shard for r in S.candidates(m, n_chars=(0, 400), lang=("de", "de")).collect()}
    holds = {r.shard for r in back.where("n_chars <= 400 and lang = 'de'").select("shard").distinct().collect()}
    assert holds <= hit and len(hit) < 8


def test_fractions_and_negative_numbers_have_cells_and_names_may_clash(spark, tmp_path):
    df = spark.range(400).selectExpr("id", "id / 400.0D x", "cast(id as int) - 200 y", "id * 10 _at", "id _cell0", "7 _part")
    done = S.hilbert_shards(df, ["x", "y"], ["id"], 8, carry=df.columns)
    shards = {r.shard: r for r in S.manifest(done, ["x", "y"]).collect()}
    assert len(shards) == 8 and all(r.x_max - r.x_min < 0.2 for r in shards.values())
    assert done.where("_at = id * 10 and _cell0 = id and _part = 7 and y = id - 200").count() == 400
    assert len(S.candidates(S.manifest(done, ["x"]), x=(0.5, 0.51)).collect()) <= 2
    for name in S.MADE:
        with pytest.raises(ValueError):
            S.hilbert_shards(df.withColumnRenamed("_part", name), ["x"], ["id"], 8, carry=["id", name])


def test_equal_rows_are_spread(spark):
    df = spark.range(0, 4000, 1, 8).selectExpr("1 a", "'same' b")
    got = S.hilbert_shards(df, ["a"], ["b"], 40).groupBy("shard").count().collect()
    assert {r["count"] for r in got} == {100} and len(got) == 40
