import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.llm import mtree as M
from tests.oracle import differences


def brute(rows, k):
    """rows: (id, vector or None); queries are ids divisible by 50."""
    good = [(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in {(i, v) for i, v in good if i % 50 == 0}:
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal"])
def test_tree_is_exact_and_leaves_out_work(kind):
    rng = np.random.default_rng(4)
    v = rng.integers(-300, 300, (3000, 8))
    if kind == "clustered":
        v = rng.integers(-3000, 3000, (30, 8))[rng.integers(0, 30, 3000)] + rng.integers(-20, 20, (3000, 8))
    if kind == "equal":
        v[500:2500] = v[0]
    ids = rng.permutation(3000)
    tree = M.Tree.of(M.Tree.build(ids, v, float((v * v).sum(1).max())).row(), np.int64)
    work = 0
    for i in range(0, 3000, 100):
        found, computed = tree.search(int(ids[i]), v[i], 5, [])
        work += computed
        s = v @ v[i]
        want = [(-int(s[j]), int(ids[j])) for j in np.lexsort((ids, -s)) if j != i][:5]
        assert found == want
    if kind == "clustered":
        assert work < 30 * 3000 / 2


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(0, 400, 3)]
    rows += [(1000 + i, [0.5, 0.5, 0.5]) for i in range(60)] + [(50, [1.0, 1.0]), (51, [2.0, -1.0]), (52, [])]
    rows += [(2000, None), (2001, [1.0, None, 2.0]), (2050, [1.0, float("nan"), 2.0]), (2051, [1.0, float("inf"), 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = {tuple(r) for r in M.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5).collect()}
    assert got == brute(rows, 5)
    assert M.top_k(df.where("false"), "vec_id", "embedding", F.lit(True), 5).count() == 0


def test_op2(spark):
    assert differences(spark, "/root/testdata/sf0.01", M.op2_mtree_topk, M.ORACLE_OP2) is None
