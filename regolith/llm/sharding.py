"""Sharding along a Hilbert curve, in DataFrame operations only.

Each metadata dimension is cut at its own quantiles into 2**BITS cells, the cells' Hilbert index orders the
rows, and the ordered rows are cut into runs. Rows that are near in every dimension land in the same shard, so
that the shards' minima and maxima prune reads on any of the dimensions (see manifest()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regolith.llm.common import discard, refuse_clash, stored, table

#: Bits per dimension: 2**5 cells each, at quantiles.
BITS = 5
SHARDS = 40


def hilbert_steps(dims: int) -> list[int]:
    """The curve as a state machine: entry [state * 2**dims + cell] is next_state << dims | digit.

    A state is (entry corner, direction). A cell is one bit of each dimension, the first dimension lowest."""
    size = 1 << dims
    rotl = lambda x, k: ((x << k % dims) | (x >> (dims - k % dims))) & (size - 1)
    rotr = lambda x, k: rotl(x, dims - k % dims)
    gray = lambda i: i ^ i >> 1
    rank = {gray(i): i for i in range(size)}

    def corner(i: int) -> int:
        return gray((i - 1) // 2 * 2) if i else 0

    def axis(i: int) -> int:
        if not i:
            return 0
        i -= i % 2 == 0
        return ((i ^ (i + 1)).bit_length() - 1) % dims

    out = []
    for state in range(size * dims):
        entry, direction = divmod(state, dims)
        for cell in range(size):
            digit = rank[rotr(cell ^ entry, direction + 1)]
            to = (entry ^ rotl(corner(digit), direction + 1)) * dims + (direction + axis(digit) + 1) % dims
            out.append(to << dims | digit)
    return out


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The Hilbert index of integer columns, each in [0, 2**bits)."""
    dims = len(cells)
    steps = F.array(*(F.lit(x) for x in hilbert_steps(dims)))

    def step(acc: Column, level: Column) -> Column:
        cell = F.lit(0)
        for j, c in enumerate(cells):
            bit = F.call_function("shiftright", c.cast("int"), level).bitwiseAND(1)
            cell = cell + bit * (1 << j)
        code = F.element_at(steps, acc["state"] * (1 << dims) + cell + 1)
        return F.struct(
            F.shiftright(code, dims).alias("state"),
            (acc["h"] * (1 << dims) + code.bitwiseAND((1 << dims) - 1)).alias("h"),
        )

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.array(*(F.lit(b) for b in reversed(range(bits)))), start, step)["h"]


def ordinal(df: DataFrame, name: str) -> Column:
    """A number that orders a column's values: numbers as they are, others by their first seven bytes; null first."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return F.coalesce(F.col(name).cast("double"), F.lit(float("-inf")))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        whole = F.col(name).cast("long")
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        whole = F.unix_micros(F.col(name).cast("timestamp"))
    else:
        head = F.rpad(F.substring(F.col(name).cast("string").cast("binary"), 1, 7), 7, F.lit(b"\x00"))
        whole = F.conv(F.hex(head), 16, 10).cast("long")
    return F.coalesce(whole, F.lit(-(2**63)))


#: What hilbert_shards adds.
MADE = ["hilbert", "rank", "shard", "slot"]


def hilbert_shards(
    df: DataFrame, dims: list[str], tie: list[str], shards: int = SHARDS, carry: list[str] | None = None, bits: int = BITS
) -> DataFrame:
    """Puts every row of df into one of `shards` shards, whose row counts differ by one at most.

    Adds hilbert, rank, shard and slot (from 0, without gaps within a shard) to the columns `dims`, `tie` and
    `carry`, which must not have these names. Rows of one cell are ordered by `tie`, and rows equal in that by where
    they were read, so that neither a cell nor a row that repeats, however many rows it holds, makes a large task: the
    range partitioning is on all of these. Nulls sort first in their dimension. An empty frame gives an empty frame.

    Two passes: the quantiles (a sketch of bounded size per dimension), then a range-partitioned sort. Positions
    within partitions are written down once (a written table), and only one row for each partition is summed up
    to turn them into ranks.
    """
    keep = list(dict.fromkeys([*dims, *tie, *(carry or [])]))
    refuse_clash(keep, MADE)
    inner = {c: f"_in{i}" for i, c in enumerate(keep)}  # no inner name can clash
    base = df.select(*(F.col(c).alias(n) for c, n in inner.items()))
    points = [i / (1 << bits) for i in range(1, 1 << bits)]
    if carry:  # wide rows: read the dimensions alone for the quantiles
        source = base
    else:
        source = base = stored(base, "shard-keys")
    axes = [inner[d] for d in dims]
    cuts = source.agg(*(F.percentile_approx(ordinal(base, d), points, 10000).alias(f"c{i}") for i, d in enumerate(axes))).first()
    cells = []
    for i, d in enumerate(axes):
        bounds = sorted(set(cuts[f"c{i}"] or []))
        at = ordinal(base, d)
        cells.append(sum((F.when(at >= b, 1).otherwise(0) for b in bounds), F.lit(0)) if bounds else F.lit(0))
    keyed = base.select("*", *(c.cast("int").alias(f"_cell{i}") for i, c in enumerate(cells)))
    keyed = keyed.select(*inner.values(), hilbert_index([F.col(f"_cell{i}") for i in range(len(dims))], bits).alias("hilbert"), F.monotonically_increasing_id().alias("_read"))
    order = ["hilbert", *(inner[c] for c in tie), "_read"]
    placed = stored(
        keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_read").withColumn("_at", F.monotonically_increasing_id()), "shard-order"
    )
    if not carry:
        discard(df.sparkSession, base)
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row for each partition of the sort
    sizes = sizes.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"),
    )
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    ranked = placed.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn("rank", F.col("_before") + within)
    shard = F.expr(f"(rank * {shards}) div _all")
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("rank") - first).cast("long"))
        .select(*(F.col(n).alias(c) for c, n in inner.items()), *MADE)
    )


def manifest(assigned: DataFrame, dims: list[str]) -> DataFrame:
    """One row for each shard: rows, and the least and greatest value of each dimension, for pruning."""
    return assigned.groupBy("shard").agg(
        F.count("*").alias("rows"),
        *(f(d).alias(f"{d}_{n}") for d in dims for n, f in (("min", F.min), ("max", F.max))),
    )


def candidates(shards: DataFrame, **ranges: tuple) -> DataFrame:
    """The shards of a manifest that may hold a row with every dimension d within ranges[d] = (low, high)."""
    for d, (low, high) in ranges.items():
        shards = shards.where((F.col(f"{d}_max") >= low) & (F.col(f"{d}_min") <= high))
    return shards.select("shard")


def write_shards(df: DataFrame, path: str, dims: list[str], tie: list[str], shards: int = SHARDS) -> DataFrame:
    """Writes df with all its columns, one folder for each shard in curve order; returns the manifest."""
    done = hilbert_shards(df, dims, tie, shards, carry=df.columns)
    done.drop("rank", "hilbert").write.partitionBy("shard").parquet(path)
    return manifest(done, dims)


def document_keys(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the text's UTF-8 bytes plus 16, and its CRC-32; a null text counts as no bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards along the curve over language, source and size, under the law `rows`.
    Equal texts of one cell stand side by side."""
    done = hilbert_shards(document_keys(table(spark, sf_dir, "documents")), ["lang", "source", "size"], ["text_crc32", "size", "doc_id"])
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert", "rank"
    )
