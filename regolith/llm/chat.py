"""Chat formatting by Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of one role are merged by an array
aggregation, and the blocks are concatenated:

    <|turn|>ROLE<|text|>TEXT<|also|>TEXT OF THE NEXT TURN OF THE SAME ROLE<|end|>

Inside roles and texts a backslash is doubled and `<|` becomes `<\\|`. Backslashes of a text thus come in runs of
even length, so `<`, one backslash, `|` stands for `<|` alone and no text holds a marker: the way back is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.llm.common import refuse_clash, table

TURN, TEXT, ALSO, END = "<|turn|>", "<|text|>", "<|also|>", "<|end|>"
#: Turns of this role are learned.
LEARNED = "assistant"


def escaped(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def sorted_turns(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """key and turns: an array of (turn, role, text), in the order of these three; null roles and texts as empty. A row
    without a key is a conversation of its own, so that such rows don't meet in one task."""
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    rows = df.select(F.col(key).alias("key"), alone.alias("alone"), one.alias("t"))
    return rows.groupBy("key", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("alone")


def held(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once however often f's inner functions use it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def numbers(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns of the same role: cut out between the places where the role changes."""
    n = F.size(turns)
    role = lambda i: F.get(turns, i)["role"]
    starts = F.filter(numbers(n), lambda i: (i == 0) | (role(i) != role(i - 1)))

    def blocks(starts: Column) -> Column:
        def block(at: Column, j: Column) -> Column:
            end = F.coalesce(F.get(starts, j + 1), n)
            texts = F.transform(F.slice(turns, at + 1, end - at), lambda t: t["text"])
            return F.struct(role(at).alias("role"), texts.alias("texts"))

        return F.transform(starts, block)

    return held(starts, blocks)


def segments(blocks: Column) -> Column:
    """The output in order, as (part, learned): markers and roles, and between them the escaped texts."""

    def of(block: Column) -> Column:
        part = lambda x, learned: F.struct(x.alias("part"), learned.alias("learned"))
        no = F.lit(False)
        head = part(F.concat(F.lit(TURN), escaped(block["role"]), F.lit(TEXT)), no)
        body = F.transform(
            block["texts"],
            lambda x, i: F.array(part(F.when(i > 0, F.lit(ALSO)).otherwise(F.lit("")), no), part(escaped(x), block["role"] == LEARNED)),
        )
        return F.concat(F.array(head), F.flatten(body), F.array(part(F.lit(END), no)))

    return F.flatten(F.transform(blocks, of))


#: Elements whose running sums are built up at once: an array grows by being copied, so a long one is summed in parts.
PART = 256


def running_sums(sizes: Column) -> Column:
    """Of an array of longs, the sum of what stands before each element."""

    def sums(values: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(values, state, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    zero = F.lit(0).cast("long")

    def of(sizes: Column) -> Column:
        parts = F.transform(numbers(F.ceil(F.size(sizes) / PART).cast("int")), lambda i: F.slice(sizes, i * PART + 1, F.lit(PART)))
        before = sums(F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x)), zero)
        return F.flatten(F.zip_with(parts, before, sums))

    return held(sizes, of)


def format_chats(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, formatted, and loss_spans: (start, length) in code points, from 0, of each learned text in it.

    Turns with the same number are ordered by role and text; repeated rows are turns of their own; null roles and texts
    are empty; a row without a key is a conversation of its own. One conversation becomes one row, so its turns must
    fit in a task; the work grows with its turns. An empty frame gives an empty frame."""
    refuse_clash([key], ["formatted", "loss_spans"])
    turns = sorted_turns(df, key, turn, role, text)

    def written(parts: Column) -> Column:
        sizes = F.transform(parts, lambda s: F.length(s["part"]).cast("long"))
        placed = F.arrays_zip(parts.alias("part"), sizes.alias("length"), running_sums(sizes).alias("start"))
        learned = F.filter(placed, lambda x: x["part"]["learned"])
        spans = F.transform(learned, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
        return F.struct(F.array_join(F.transform(parts, lambda s: s["part"]), "").alias("formatted"), spans.alias("loss_spans"))

    done = turns.select(F.col("key").alias(key), held(held(merged(F.col("turns")), segments), written).alias("_done"))
    return done.select(key, "_done.formatted", "_done.loss_spans")


def literal(marker: str) -> str:
    return f"\\Q{marker}\\E"


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    blocks = F.split(formatted, literal(END), -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        both = F.split(F.substr(block, F.lit(len(TURN) + 1)), literal(TEXT), -1)
        return F.transform(F.split(both[1], literal(ALSO), -1), lambda x: F.struct(unescaped(both[0]).alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


#: Code points of the pieces into which a text is cut, coarse and fine, to reach a place in it.
COARSE, FINE = 1 << 18, 1 << 12


def cut(x: Column, size: int) -> Column:
    """x in pieces of so many code points, at least one."""
    return F.transform(numbers(F.greatest(F.ceil(F.length(x) / size).cast("int"), F.lit(1))), lambda i: F.substr(x, i * size + 1, F.lit(size)))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped and joined. A place in a string is found by counting from its start, so
    the text is cut into pieces first and each span read from those that hold it."""
    pieces = F.flatten(F.transform(cut(formatted, COARSE), lambda c: cut(c, FINE)))

    def all_read(pieces: Column) -> Column:
        def read(s: Column) -> Column:
            first = F.floor(s["start"] / FINE).cast("int")
            many = F.floor((s["start"] + s["length"]) / FINE).cast("int") - first + 1
            near = F.array_join(F.slice(pieces, first + 1, many), "")
            return unescaped(F.substr(near, (s["start"] - first * FINE + 1).cast("int"), s["length"].cast("int")))

        return F.array_join(F.transform(spans, read), "")

    return held(pieces, all_read)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings in its texts, read back from the formatted output."""
    odd = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.union(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, LEARNED, odd)], "conv_id long, turn long, role string, text string"))
    done = format_chats(rows).withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
