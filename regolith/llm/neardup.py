"""Near-duplicates: fast similarity sketches, banding, and exact verification on full shingle sets.

A sketch of BINS coordinates is filled in rounds: in round i every shingle is hashed to a bin and a value, and a bin
keeps its least (round, value). In the first BINS rounds the bin is hashed too; in the next BINS rounds, round
BINS + b puts every shingle into bin b, so that every coordinate is filled whatever the set's size; small sets need
more rounds and large ones few. Two sets agree on a coordinate with the probability of their similarity, and the
number of agreeing coordinates concentrates about it.

Rows of equal sets are one node. Nodes that agree on all coordinates of a band share a bucket. Links are confirmed
on the full sets, and the components of the confirmed links are the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.llm.common import discard, mixed, stored, table, tidied
from regolith.llm.graph import components

WORDS = 5
#: Sets are linked if PER_CENT * union <= 100 * intersection.
PER_CENT = 85
#: BANDS bands of ROWS coordinates: a pair at similarity 0.85 shares no bucket with a probability of 3e-6, at 0.8 of
#: 6e-4, at 0.9 of 2e-10; one at 0.25 shares one with a probability of 6e-4.
BANDS, ROWS = 40, 8
BINS = BANDS * ROWS
#: Rows of two hashes (16 bytes) and a number that are broadcast at most; more are joined by a shuffle.
BROADCAST = 1_000_000
#: A node keeps PLANES bits of each coordinate, PLANES planes of LONGS longs.
PLANES, LONGS = 2, BINS // 64
#: Bits of a set's parity marks, in longs.
MARKS = 2048 // 64
#: How far a pair's bits may differ to be compared in full: so many deviations beyond the mean at the threshold.
DEVIATIONS = 4.8


class Links(NamedTuple):
    """What links two sets, and how candidates are found."""

    per_cent: int = PER_CENT
    bands: int = BANDS
    rows: int = ROWS
    deviations: float | None = DEVIATIONS  # None: every pair that shares a band is compared in full

    def differ(self) -> int:
        """The greatest number of coordinates whose bits differ. A pair at the threshold differs in more with a
        probability of about 1e-6, one above it more seldom."""
        if self.deviations is None:
            return BINS
        p = (1 - self.per_cent / 100) * (1 - 0.5**PLANES)
        return int(BINS * p + self.deviations * (BINS * p * (1 - p)) ** 0.5)


#: For documents to be dropped: similarity 0.8, bands of 7; a pair at 0.8 shares no bucket with a probability of 3e-5.
STAGE = Links(80, 45, 7)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of so many words; of all its words, if they are fewer."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return np.unique(out)


def sketch(items: np.ndarray) -> np.ndarray:
    """The BINS coordinates of a non-empty set of hashes: the round in the high 32 bits, the value in the low."""
    empty = np.uint64(2**64 - 1)
    out = np.full(BINS, empty)
    low = np.uint64(2**32 - 1)
    at, step = 0, max(1, -(-4 * BINS // len(items)))
    while at < 2 * BINS:
        rounds = np.arange(at, min(at + step, 2 * BINS), dtype=np.uint64)
        h = mixed(items[None, :] ^ mixed(rounds + np.uint64(1))[:, None])
        bins = np.where(rounds[:, None] < BINS, (h >> np.uint64(32)) % np.uint64(BINS), rounds[:, None] - np.uint64(BINS))
        np.minimum.at(out, bins.ravel().astype(np.int64), (rounds[:, None] << np.uint64(32) | h & low).ravel())
        at += step
        if not (out == empty).any():
            break
    return out


def bands(coordinates: np.ndarray, count: int = BANDS, each: int = ROWS) -> np.ndarray:
    """One hash for each band of so many coordinates, different from band to band."""
    rows = coordinates[: count * each].reshape(count, each)
    out = np.arange(count, dtype=np.uint64)
    for i in range(each):
        out = mixed(out ^ rows[:, i]) + np.uint64(i)
    return out


def sign_bits(coordinates: np.ndarray) -> np.ndarray:
    """PLANES bits of each coordinate, plane by plane, as longs."""
    h = mixed(coordinates)
    planes = [(h >> np.uint64(i) & np.uint64(1)).astype(np.uint8) for i in range(PLANES)]
    return np.packbits(np.concatenate(planes)).view(np.int64)


def parity_marks(items: np.ndarray) -> np.ndarray:
    """MARKS longs, in which every item flips one bit. An item that only one of two sets has flips a bit in one alone, so
    the marks of two sets differ in at most as many bits as the sets differ in items."""
    size = MARKS * 64
    odd = np.bincount((items % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_hash(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def identity(key: str, text: str) -> list[Column]:
    """Two hashes that tell rows apart by key and text."""
    k, t = F.col(key), F.col(text).cast("string")
    return [F.xxhash64(k, t).alias("a"), F.xxhash64(t, k, F.lit(1)).alias("b")]


def sketched(df: DataFrame, key: str, text: str, links: Links) -> DataFrame:
    """key, a, b, n_shingles, set_hash, bands, bits and marks of every row; the last three are empty for an empty set."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in map(pa.StringScalar.as_py, b.column(3)):
                items = shingles(t)
                if len(items):
                    coordinates = sketch(items)
                    rows.append((len(items), set_hash(items), bands(coordinates, links.bands, links.rows).view(np.int64), sign_bits(coordinates), parity_marks(items)))
                else:
                    rows.append((0, set_hash(items), [], [], []))
            if rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["key", "a", "b", "n_shingles", "set_hash", "bands", "bits", "marks"])

    kinds = (pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3)
    source = df.select(F.col(key).alias("key"), *identity(key, text), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, a long, b long, n_shingles long, set_hash binary, bands array<long>, bits array<long>, marks array<long>")


def full_sets(df: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """node and items (its sorted shingle hashes) for `wanted` (node, a, b): from the rows with these hashes.
    Up to BROADCAST nodes are broadcast; more are joined by a shuffle."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SETS):
                part = b.slice(at, SETS)
                items = [shingles(t).tobytes() for t in map(pa.StringScalar.as_py, part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.binary())], ["node", "items"])

    many = wanted.count()
    source = df.select(*identity(key, text), F.col(text).cast("string").alias("text"))
    found = source.join(F.broadcast(wanted) if many <= BROADCAST else wanted, ["a", "b"])
    out = stored(found.select("node", "text").mapInArrow(run, "node long, items binary"), "neardup-sets")
    return out.dropDuplicates(["node"]) if out.count() > many else out  # only where rows repeat


#: Sets that a task makes before it hands them on.
SETS = 1000


def linked(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for u, v, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(pa.BinaryScalar.as_py, b.column(2)), map(pa.BinaryScalar.as_py, b.column(3))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= per_cent * (len(x) + len(y) - both):
                    rows.append((u, v))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["u", "v"])

    first = sets.select(F.col("node").alias("u"), F.col("items").alias("x"))
    second = sets.select(F.col("node").alias("v"), F.col("items").alias("y"))
    return pairs.join(first, "u").join(second, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def alike(a: str, b: str, links: Links) -> Column:
    """Whether the nodes a and b (structs with n and bits) may be similar enough, by their sizes and bits."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = 100 * F.least(n, m) >= links.per_cent * F.greatest(n, m)
    if links.deviations is None:
        return sizes
    plane = lambda x, i: F.col(f"{x}.bits")[i]
    differ = F.lit(0)
    for at in range(LONGS):
        one = F.lit(0).cast("long")
        for i in range(at, PLANES * LONGS, LONGS):
            one = one.bitwiseOR(plane(a, i).bitwiseXOR(plane(b, i)))
        differ = differ + F.bit_count(one)
    return sizes & (differ <= links.differ())


def near_enough(a: str, b: str, marks: str, others: str, links: Links) -> Column:
    """Whether the nodes a and b (structs with n) can be similar enough by their parity marks. Exact: sets that are
    linked differ in at most (100 - per_cent) / (100 + per_cent) of the sum of their sizes, and their marks in no more."""
    # by array functions: so many terms would make the join's condition too large to be compiled
    differ = F.aggregate(F.zip_with(marks, others, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return (100 + links.per_cent) * differ <= (100 - links.per_cent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(f"{a}.node", f"{b}.node").alias("u"), F.greatest(f"{a}.node", f"{b}.node").alias("v")]


def node_labels(df: DataFrame, key: str, text: str, nodes: DataFrame, links: Links) -> DataFrame | None:
    """node and label of all nodes that are linked with others; None if there are none.

    First every node is compared with its buckets' hubs: a bucket's hub is its node with the most company in all its
    buckets. That joins up most of a group with a few comparisons for each node. Then, in buckets whose nodes still
    differ in label, the nodes outside of the commonest label are compared with all of another label. So no pair
    inside a bucket is left out whose link could change a group, whatever the bucket's size; pairs whose sizes, bits
    or parity marks differ too much aren't compared in full. The marks leave hardly any pair below the threshold, so a
    large group of texts that are nearly similar enough gives few pairs. Buckets are aggregated before the shuffle and joined back, and
    adaptive execution splits the large ones."""
    spark = df.sparkSession
    every = nodes.select("node", F.explode("bands").alias("band"))
    shared = every.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    members = stored(every.join(shared, "band"), "neardup-members")
    company = members.groupBy("node").agg(F.sum("c").alias("w"))
    traits = nodes.join(company, "node").select("node", F.struct("w", "node", F.col("n_shingles").alias("n"), "bits").alias("a"))
    full = stored(members.select("band", "node").join(traits, "node").select("band", "a"), "neardup-buckets")
    discard(spark, members)
    known = nodes.select("node", F.col("rep.a").alias("a"), F.col("rep.b").alias("b"))

    def verified(pairs: DataFrame) -> DataFrame | None:
        pairs = stored(pairs.distinct(), "neardup-pairs")
        ends = pairs.select(F.col("u").alias("node")).distinct().unionAll(pairs.select("v").distinct()).distinct()
        wanted = stored(known.join(ends, "node"), "neardup-nodes")
        found = None
        if wanted.limit(1).count():
            sets = full_sets(df, key, text, wanted)
            found = stored(linked(pairs, sets, links.per_cent), "neardup-links")
            discard(spark, sets)
        discard(spark, pairs, wanted)
        return found

    hubs = full.groupBy("band").agg(F.max("a").alias("b"))
    near = verified(full.join(hubs, "band").where((F.col("a.node") != F.col("b.node")) & alike("a", "b", links)).select(*ordered("a", "b")))
    labels = None if near is None else stored(components(near), "neardup-labels")
    own = F.col("a.node")
    at = full.select("band", "a", own.alias("label")) if labels is None else full.join(labels, own == F.col("node"), "left").select("band", "a", F.coalesce("label", own).alias("label"))
    counts = at.groupBy("band", "label").agg(F.count("*").alias("c"))
    mixed_bands = counts.groupBy("band").agg(F.count("*").alias("labels"), F.max(F.struct("c", "label"))["label"].alias("major")).where("labels > 1")
    of = nodes.select(F.col("node").alias("n"), "bands", "marks")
    rest = stored(at.join(mixed_bands.select("band", "major"), "band").join(of, F.col("a.node") == F.col("n")).drop("n"), "neardup-rest")
    discard(spark, full)
    minor = rest.where("label <> major").select("band", F.col("a").alias("b"), F.col("label").alias("other"), F.col("bands").alias("others"), F.col("marks").alias("flips"))
    # every common band of such a pair is here: it is taken in its first one, and from one side
    once = ((F.col("label") == F.col("major")) | (F.col("a.node") < F.col("b.node"))) & (F.array_intersect("bands", "others")[0] == F.col("band"))
    more = verified(rest.join(minor, "band").where((F.col("label") != F.col("other")) & alike("a", "b", links) & near_enough("a", "b", "marks", "flips", links) & once).select(*ordered("a", "b")))
    discard(spark, rest)
    if more is None or not more.limit(1).count():
        return labels
    return stored(components(more if near is None else near.unionAll(more)), "neardup-labels")


def grouped(df: DataFrame, key: str, text: str, links: Links) -> DataFrame:
    """key, a, b, n_shingles and first (none, key, a, b) of every row; first is the row of the smallest key in its
    group, one with a null key only if there is no other; rows without words are their own."""
    rows = stored(sketched(df, key, text, links), "neardup-sketches")
    me = F.struct(F.isnull("key").alias("none"), "key", "a", "b")
    nodes = rows.where("n_shingles > 0").groupBy("set_hash").agg(F.min(me).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("marks").alias("marks"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "neardup-sets")
    labels = node_labels(df, key, text, nodes, links)
    known = nodes.select("node", "set_hash", "rep")
    if labels is not None:
        inside = known.join(labels, "node")
        least = inside.groupBy("label").agg(F.min("rep").alias("first"))
        found = inside.join(least, "label").select("node", "first")
        known = known.join(found, "node", "left").select("set_hash", F.coalesce("first", "rep").alias("first"))
    else:
        known = known.select("set_hash", F.col("rep").alias("first"))
    out = rows.where("n_shingles > 0").join(known, "set_hash").select("key", "a", "b", "n_shingles", "first")
    return out.unionAll(rows.where("n_shingles = 0").select("key", "a", "b", "n_shingles", me.alias("first")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", links: Links = Links()) -> DataFrame:
    """key, n_shingles, component_id (the smallest key that links reach) and kept (key = component_id) of every row.

    Rows with equal sets are linked. Rows without words have no set and are linked with nothing. A null key is the
    component of rows that no other key is linked with, and is not kept; repeated rows give the same result each. An
    empty frame gives an empty frame. Texts are read twice: all for the sketches, and those in shared buckets for
    their full sets."""
    out = grouped(df, key, text, links)
    return out.select(F.col("key").alias(key), "n_shingles", F.col("first.key").alias("component_id"), F.coalesce(F.col("key") == F.col("first.key"), F.lit(False)).alias("kept"))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def distinct_documents(docs: DataFrame, links: Links = STAGE) -> DataFrame:
    """One document of each group, with the columns they had: the one of the smallest id, or without an id if none has
    one. Documents without words all stay. Rows are told apart by id and text, so an id with several texts stays with
    those that are kept; of rows equal in both one stays.

    What is to be left out is broadcast up to BROADCAST rows of 16 bytes and joined by a shuffle beyond; rows are made
    distinct only where some repeat, since that takes a shuffle."""
    found = stored(grouped(docs, "doc_id", "text", links), "neardup-found")
    mine = (F.col("a") == F.col("first.a")) & (F.col("b") == F.col("first.b"))
    drop = found.where(~mine).select(F.col("a").alias("_a"), F.col("b").alias("_b")).distinct()
    names = [f"_doc{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names)}
    plain = docs.select(*(F.col(c).alias(n) for c, n in at.items()))
    rows = plain.select("*", *(x.alias(f"_{n}") for x, n in zip(identity(at["doc_id"], at["text"]), "ab")))
    out = rows.join(F.broadcast(drop) if drop.count() <= BROADCAST else drop, ["_a", "_b"], "left_anti")
    twice = found.where(mine & (F.col("n_shingles") > 0)).groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).count().where("count > 1").select("_a", "_b")
    if twice.limit(1).count():
        out = out.join(twice, ["_a", "_b"], "left_anti").unionByName(out.join(twice, ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"]))
    return out.select(*(F.col(n).alias(c) for c, n in at.items()))
