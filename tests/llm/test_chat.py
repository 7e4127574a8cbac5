import hashlib
import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from regolith.llm import chat as C
from regolith.llm.common import table


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_op9(spark, sf):
    by = defaultdict(list)
    for r in table(spark, sf, "conversations").collect():
        by[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    odd = "\\### Assistant: </turn> ok"
    by[-7] = [(0, "user", odd), (1, "assistant", odd)]
    got = {r.conv_id: r for r in C.op9_chat_format(spark, sf).collect()}
    assert sorted(got) == sorted(by)
    for k, turns in by.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        x = got[k]
        assert (x.n_turns, x.turns_sha256) == (len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (x.loss_chars, x.loss_sha256) == (len(learned), digest(learned))


def test_round_trip_of_control_strings(spark):
    r = random.Random(5)
    bits = ["\\", "<", "|", "<|", "<|end|>", "<|turn|>", "<\\|", "a", "😀", "\n"]
    rows = [(c, r.randint(0, 3), r.choice(["user", "assistant", "assistant", "<|end|>", "\\", None, ""]), None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 8)))) for c in range(200) for _ in range(r.randint(1, 7))]
    rows += rows[:5] + [(None, 0, "user", "x"), (7, None, None, None)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    done = C.format_chats(df).withColumn("turns", C.read_turns(F.col("formatted"))).withColumn("loss", C.read_loss(F.col("formatted"), F.col("loss_spans")))
    got = {x.conv_id: x for x in done.collect()}
    assert set(got) == set(by)
    for k, turns in by.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[k].turns] == [x[2:] for x in turns]
        assert got[k].loss == "".join(x[3] for x in turns if x[2] == "assistant")
        blocks = 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:]))
        assert got[k].formatted.count("<|end|>") == blocks
    assert C.format_chats(df.where("false")).count() == 0


def test_no_python_runs(spark, sf):
    plan = C.op9_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_long_conversation_takes_seconds_and_comes_back(spark):
    n = 60000
    rows = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 3 = 0, 'user', 'assistant') role", "concat('é<|', id, repeat(' w\\\\', id % 9)) text")
    begin = time.time()
    done = C.format_chats(rows).withColumn("turns", C.read_turns(F.col("formatted"))).withColumn("loss", C.read_loss(F.col("formatted"), F.col("loss_spans")))
    r = done.first()
    assert time.time() - begin < 60
    want = [x.text for x in rows.orderBy("turn").collect()]
    assert [t.text for t in r.turns] == want
    assert r.loss == "".join(t for i, t in enumerate(want) if i % 3)


def test_rows_without_a_key_are_conversations_of_their_own(spark):
    rows = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "user", "b"), (None, 1, "user", "b"), (3, None, None, None)], "conv_id long, turn long, role string, text string")
    got = C.format_chats(rows.withColumn("key", F.lit(1)).withColumn("turns", F.lit(2))).collect()
    assert sorted((r.conv_id is None, r.formatted.count(C.TURN)) for r in got) == [(False, 1), (True, 1), (True, 1), (True, 1)]
