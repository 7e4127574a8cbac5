import random

from regolith.operators.metrics import nearest_rank


def test_nearest_rank_without_gathering_a_route(spark):
    r = random.Random(4)
    rows = [(p, None if r.random() < 0.02 else round(r.gauss(50, 9), r.choice([0, 3]))) for p in ("/config", "/subjects") for _ in range(3000)] + [("/mode", None), (None, 2.0)]
    done = nearest_rank(spark.createDataFrame(rows, "path string, millis double"), (0.0, 0.5, 0.99))
    plan = done._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "_part" in plan
    want = {}
    for p, x in rows:
        want.setdefault(p, []).append(x)
    for p, xs in want.items():
        xs.sort(key=lambda x: (x is not None, x))
        want[p] = tuple(xs[int((len(xs) - 1) * q + 0.5)] for q in (0.0, 0.5, 0.99))
    assert sorted(map(str, want.values())) == sorted(str(tuple(row[1:])) for row in done.collect())
