"""A modified Kneser-Ney model of character n-grams for each language, counted by Spark and kept in sorted hash arrays.

The symbols are the characters of a text's words, lower-cased and joined by single spaces, enclosed by line breaks.
Every n-gram of ORDER symbols of every text is counted; the shorter ones count the symbols seen before them. So the
model has an entry for each n-gram that occurs and grows with the corpus. An entry is a 64-bit hash and a log
probability; a context has a hash and a log back-off weight.

A language's corpus is halved by the texts' checksums, each half has its own model, and a text is judged by the half
it isn't in. Otherwise a text's own n-grams would speak for it, however strange they are.

The entries of a language are dealt into shards by the two symbols before the last one, which all n-grams and
contexts needed at one place of a text have in common; entries without two such symbols are in every shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.llm.common import mixed, stored, tidied

ORDER = 5
EDGE = "\n"
#: Symbols that are counted or scored at a time, and distinct n-grams that a task holds before it hands them on.
CHUNK, HELD = 1 << 20, 1 << 20
#: Entries of a shard; entries that a worker holds while it scores (12 bytes each, and 12 for each context).
UNIT, BLOCK = 1 << 15, 4 << 20
#: Symbols are this many if a language has no model.
ALPHABET = 256
#: Odd multipliers for the last symbol, the one before it, and so on.
ODD = [int(x) | 1 for x in mixed(np.arange(101, 101 + ORDER, dtype=np.uint64))]


class Arrays(NamedTuple):
    """A shard of a language's model."""

    hashes: np.ndarray  # of n-grams of all lengths
    logp: np.ndarray
    contexts: np.ndarray  # hashes of contexts
    backoff: np.ndarray  # log weights
    symbols: int  # different ones, and one for all others


def symbols(words: str) -> np.ndarray:
    """The code points of words joined by spaces, with ORDER - 1 edges before them and one behind."""
    return np.frombuffer((EDGE * (ORDER - 1) + words.lower() + EDGE).encode("utf-32-le"), np.uint32)


def pieces(a: np.ndarray) -> Iterator[np.ndarray]:
    """A text's symbols in parts of at most CHUNK, each with the ORDER - 1 symbols before it."""
    for at in range(0, len(a) - ORDER + 1, CHUNK):
        yield a[at : at + CHUNK + ORDER - 1]


def mixed_symbols(a: np.ndarray) -> np.ndarray:
    return mixed(a.astype(np.uint64) + np.uint64(1))


def hash_at(m: np.ndarray, ends: np.ndarray | slice, size: int) -> np.ndarray:
    """Hashes of the `size` mixed symbols that end at each place."""
    if isinstance(ends, slice):
        n = ends.stop - ends.start
        out = np.full(n, size, np.uint64)
        for j in range(size):
            out += m[ends.start - j : ends.stop - j] * np.uint64(ODD[j])
    else:
        out = np.full(len(ends), size, np.uint64)
        for j in range(size):
            out += m[ends - j] * np.uint64(ODD[j])
    return mixed(out)


def shard_of(before: np.ndarray | Column, last: np.ndarray | Column, shards: int | Column):
    """The shard of an n-gram by the two symbols before its last one; the same in numpy and in Spark."""
    return (before * 8191 + last * 131) % shards


class Tally:
    """Distinct n-grams, by key, and how often each occurs."""

    def __init__(self) -> None:
        self.keys: dict[str, int] = {}
        self.parts: list[tuple[int, np.ndarray]] = []
        self.size = 0
        self.empty()

    def empty(self) -> None:
        self.keys.clear()
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.grams, self.of = np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int32)

    def add(self, key: str, text: np.ndarray) -> bool:
        """Takes a text's symbols; true once it holds so much that it should be emptied by rows()."""
        for p in pieces(text):
            self.parts.append((self.keys.setdefault(key, len(self.keys)), p))
            self.size += len(p)
            if self.size >= CHUNK:
                self.count()
        return len(self.hashes) >= HELD

    def count(self) -> None:
        if not self.parts:
            return
        a = np.concatenate([p for _, p in self.parts])
        ends = np.ones(len(a), bool)
        at = 0
        for _, p in self.parts:
            ends[at : at + ORDER - 1] = False
            at += len(p)
        ends = np.flatnonzero(ends)
        of = np.repeat(np.array([k for k, _ in self.parts], np.int32), [len(p) - ORDER + 1 for _, p in self.parts])
        h = hash_at(mixed_symbols(a), ends, ORDER) ^ mixed(of.astype(np.uint64) + np.uint64(77))
        found, n = np.unique(h, return_counts=True)
        at = np.searchsorted(self.hashes, found)
        known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == found if len(self.hashes) else np.zeros(len(found), bool)
        self.counts[at[known]] += n[known]
        if not known.all():
            new, at = found[~known], at[~known]
            _, here = (table := Table.of(new)).find(h)
            here = np.flatnonzero(here)
            place = np.zeros(len(new), np.int64)
            place[table.find(h[here])[0]] = here  # any of an n-gram's places
            self.hashes, self.counts = np.insert(self.hashes, at, new), np.insert(self.counts, at, n[~known])
            self.grams = np.insert(self.grams, at, a[ends[place][:, None] + np.arange(1 - ORDER, 1)], axis=0)
            self.of = np.insert(self.of, at, of[place])
        self.parts, self.size = [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.count()
        names = list(self.keys)
        for at in range(0, len(self.counts), 1 << 16):
            part = slice(at, at + (1 << 16))
            n = len(self.counts[part])
            text = self.grams[part].tobytes().decode("utf-32-le")
            grams = [text[i : i + ORDER] for i in range(0, n * ORDER, ORDER)]
            keys = pa.DictionaryArray.from_arrays(pa.array(self.of[part]), pa.array(names, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([keys, pa.array(grams, pa.string()), pa.array(self.counts[part])], ["key", "gram", "n"])
        self.empty()


def half(text: Column) -> Column:
    return F.crc32(text.cast("binary")) % 2


def model_key(text: Column, lang: Column, other: bool) -> Column:
    """The key of the model that a text is counted in, or of the other, by which it is judged."""
    own = half(F.coalesce(text, F.lit("")))
    return F.concat((F.lit(1) - own if other else own).cast("string"), F.coalesce(F.concat(F.lit("="), lang), F.lit("")))


def gram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """key, gram and n: how often each n-gram of ORDER symbols occurs in all texts of a key. A task adds up its texts'
    n-grams and hands on each once."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for b in batches:
            for t, key in zip(map(pa.StringScalar.as_py, b[0]), b[1].to_pylist()):
                if (words := (t or "").encode().split()) and tally.add(key, symbols(b" ".join(words).decode())):
                    yield from tally.rows()
        yield from tally.rows()

    t, g = F.col(text).cast("string"), F.col(lang).cast("string")
    found = df.select(t.alias("text"), model_key(t, g, False).alias("key")).mapInArrow(run, "key string, gram string, n long")
    return found.groupBy("key", "gram").agg(F.sum("n").alias("n"))


def statistics(counts: DataFrame) -> DataFrame:
    """key, k, gram, share (its discounted share of its context), weight (the context's back-off weight), symbols and
    shards, for the n-grams of all lengths. Each length's counts are added up from the next longer one's; discounts
    are those of a key and length, by the number of n-grams that occur 1 to 4 times."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy("key", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
    every = None
    for k, level in levels.items():
        rows = level.select("key", F.lit(k).alias("k"), "gram", "n")
        every = rows if every is None else every.unionAll(rows)
    every = stored(every, "quality-grams")
    n = F.col("n")
    of = [F.count_if(n == i).cast("double") for i in range(1, 5)]
    found = every.groupBy("key", "k").agg(F.count("*").alias("c"), *(x.alias(f"n{i + 1}") for i, x in enumerate(of)))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    whole = F.least("n1", "n2", "n3", "n4") > 0
    cuts = [
        F.when(whole, F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))))).otherwise(0.5 * i).alias(f"d{i}") for i in (1, 2, 3)
    ]
    found = found.select("key", "k", "c", *cuts)
    size = found.groupBy("key").agg(F.sum("c").alias("c"), (F.sum(F.when(F.col("k") == 1, F.col("c"))) + 1).alias("symbols"))
    size = size.select("key", "symbols", F.ceil(F.col("c") / UNIT).cast("int").alias("shards"))
    discounts = found.drop("c").join(size, "key")
    within = Window.partitionBy("key", "k", F.expr("substring(gram, 1, k - 1)"))  # at most one row for each symbol
    cut = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = every.join(discounts, ["key", "k"]).withColumn("cut", cut).withColumn("total", F.sum("n").over(within))
    return rows.select("key", "k", "gram", ((n - F.col("cut")) / F.col("total")).alias("share"), (F.sum("cut").over(within) / F.col("total")).alias("weight"), "symbols", "shards")


class Table(NamedTuple):
    """Sorted distinct hashes, and for each value of their first `bits` bits where those with it begin."""

    hashes: np.ndarray
    starts: np.ndarray
    bits: int

    @classmethod
    def of(cls, hashes: np.ndarray) -> Table:
        bits = max(len(hashes).bit_length() + 1, 1)
        starts = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        return cls(hashes, starts.astype(np.uint32), bits)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each value is, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        last = len(self.hashes) - 1
        at = self.starts[(values >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        here = self.hashes[np.minimum(at, last)]
        known = here == values
        left = np.flatnonzero(here < values)
        while len(left):
            at[left] += 1
            left = left[at[left] <= last]
            here = self.hashes[at[left]]
            known[left] = here == values[left]
            left = left[here < values[left]]
        return np.minimum(at, last), known


def interpolated(k: np.ndarray, grams: list[str], share: np.ndarray, weight: np.ndarray, count: int) -> Arrays:
    """The arrays of one shard, by its n-grams of all lengths: p = share + weight * p of the n-gram without its first
    symbol, down to one of `count` equal symbols."""
    hashes, logp, contexts, backoff = [], [], [], []
    lower = mixed(np.zeros(1, np.uint64)), np.array([1 / count])
    for size in range(1, ORDER + 1):
        own = np.flatnonzero(k == size)
        m = mixed_symbols(np.frombuffer("".join(grams[i] for i in own).encode("utf-32-le"), np.uint32)).reshape(-1)
        ends = np.arange(1, len(own) + 1) * size - 1
        at, known = Table.of(lower[0]).find(hash_at(m, ends, size - 1))
        p = share[own] + weight[own] * np.where(known, lower[1][at], 0)
        h = hash_at(m, ends, size)
        order = np.argsort(h)
        lower = h[order], p[order]
        hashes.append(lower[0])
        logp.append(np.log(lower[1]).astype(np.float32))
        context, first = np.unique(hash_at(m, ends - 1, size - 1), return_index=True)
        contexts.append(context)
        backoff.append(np.log(weight[own][first]).astype(np.float32))
    return Arrays(*map(np.concatenate, (hashes, logp, contexts, backoff)), count)


def joined(parts: list[Arrays]) -> Model:
    """The arrays of a language's shards as one model; entries that are in several shards are there once."""
    hashes, at = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True)
    contexts, of = np.unique(np.concatenate([p.contexts for p in parts]), return_index=True)
    return Model(Table.of(hashes), np.concatenate([p.logp for p in parts])[at], Table.of(contexts), np.concatenate([p.backoff for p in parts])[of], parts[0].symbols)


ARRAYS = pa.schema([("key", pa.string()), ("shard", pa.int32()), ("shards", pa.int32()), ("symbols", pa.int64()), ("entries", pa.int64()), *((x, pa.binary()) for x in Arrays._fields[:4])])


def language_models(df: DataFrame, text: str, lang: str) -> DataFrame:
    """The models of all keys as a written table, a row for each shard: key, shard, shards, symbols, entries and the
    four arrays."""

    def arrays(key: tuple, rows: pa.Table) -> pa.Table:
        name, shard = (x.as_py() for x in key)
        m = interpolated(rows["k"].to_numpy(), rows["gram"].to_pylist(), rows["share"].to_numpy(), rows["weight"].to_numpy(), rows["symbols"][0].as_py())
        row = {"key": name, "shard": shard, "shards": rows["shards"][0].as_py(), "symbols": m.symbols, "entries": len(m.hashes)}
        return pa.Table.from_pylist([row | {x: getattr(m, x).tobytes() for x in Arrays._fields[:4]}], schema=ARRAYS)

    rows = statistics(stored(gram_counts(df, text, lang), "quality-counts"))
    at = lambda i: F.ascii(F.expr(f"substring(gram, k - {i}, 1)")).cast("long")
    own = F.when(F.col("k") > 2, F.array(shard_of(at(2), at(1), F.col("shards")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("shards") - 1))
    dealt = rows.withColumn("shard", F.explode(own))
    made = dealt.groupBy("key", "shard").applyInArrow(arrays, "key string, shard int, shards int, symbols long, entries long, hashes binary, logp binary, contexts binary, backoff binary")
    return stored(made, "quality-models")


class Pass(NamedTuple):
    """What is scored at once: the keys, and of each the shards that are looked up (from, to, of how many)."""

    keys: dict[str, tuple[int, int, int]]
    later: bool  # whether the key's first shards are in an earlier pass


def passes(models: DataFrame, block: int) -> list[Pass]:
    """Deals the keys out to passes of at most `block` entries; a key that has more is scored in several, by shards.
    One row for each language comes to the driver."""
    sizes = models.groupBy("key").agg(F.sum("entries").alias("n"), F.first("shards").alias("shards")).orderBy("key").collect()
    out: list[Pass] = []
    room = 0
    for r in sizes:
        if r.n > block:
            each = max(1, r.shards * block // r.n)
            out += [Pass({r.key: (at, min(at + each, r.shards), r.shards)}, at > 0) for at in range(0, r.shards, each)]
            room = 0
            continue
        if r.n > room:
            out.append(Pass({}, False))
            room = block
        out[-1].keys[r.key] = (0, r.shards, r.shards)
        room -= r.n
    return out or [Pass({}, False)]


def loaded(models: DataFrame, one: Pass) -> dict[str, Model]:
    """The models of a pass; they are no larger than its block, which is what allows to broadcast them."""
    if not one.keys:
        return {}
    rows = models.where(F.col("key").isin(list(one.keys)))
    if len(one.keys) == 1:
        (first, last, _), *_ = one.keys.values()
        rows = rows.where((F.col("shard") >= first) & (F.col("shard") < last))
    parts: dict[str, list[Arrays]] = {}
    for r in rows.toArrow().to_pylist():
        kinds = (np.uint64, np.float32, np.uint64, np.float32)
        parts.setdefault(r["key"], []).append(Arrays(*(np.frombuffer(r[x], kind) for x, kind in zip(Arrays._fields[:4], kinds)), r["symbols"]))
    return {key: joined(p) for key, p in parts.items()}


class Model(NamedTuple):
    grams: Table
    logp: np.ndarray
    contexts: Table
    backoff: np.ndarray
    symbols: int


def log_probabilities(model: Model | None, a: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the symbol at each of the places `ends`, after the ORDER - 1 symbols before it."""
    if model is None:
        return np.full(len(ends), -math.log(ALPHABET))
    m = mixed_symbols(a)
    out = np.zeros(len(ends))
    left = np.arange(len(ends))
    for size in range(ORDER, 0, -1):
        at, known = model.grams.find(hash_at(m, ends[left], size))
        out[left[known]] += model.logp[at[known]]
        left = left[~known]
        if not len(left):
            return out
        at, known = model.contexts.find(hash_at(m, ends[left] - 1, size - 1))
        out[left[known]] += model.backoff[at[known]]
    out[left] -= math.log(model.symbols)
    return out


def log_likelihoods(texts: list[tuple[str, str]], models: dict[str, Model], spans: dict[str, tuple[int, int, int]]) -> list[tuple[float, int]]:
    """For each (key, words joined by spaces): the sum of the log probabilities at those places whose shard is in the
    key's span, and the number of all places. Texts are looked up together, about CHUNK symbols at a time."""
    sums, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    waiting: dict[str, list[tuple[int, np.ndarray]]] = {}
    size: dict[str, int] = {}

    def look_up(key: str) -> None:
        parts = waiting.pop(key)
        size.pop(key)
        a = np.concatenate([p for _, p in parts])
        starts = np.cumsum([0, *(len(p) for _, p in parts[:-1])])
        inside = np.ones(len(a), bool)
        for s in starts:
            inside[s : s + ORDER - 1] = False
        of = np.repeat(np.array([i for i, _ in parts]), [len(p) - ORDER + 1 for _, p in parts])
        ends = np.flatnonzero(inside)
        first, last, shards = spans.get(key, (0, 1, 1))
        if (first, last) != (0, shards):
            at = shard_of(a[ends - 2].astype(np.int64), a[ends - 1].astype(np.int64), shards)
            mine = (at >= first) & (at < last)
            ends, of = ends[mine], of[mine]
        sums[:] += np.bincount(of, log_probabilities(models.get(key), a, ends), len(texts))

    for i, (key, words) in enumerate(texts):
        if words:
            a = symbols(words)
            sizes[i] = len(a) - ORDER + 1
            for p in pieces(a):
                waiting.setdefault(key, []).append((i, p))
                size[key] = size.get(key, 0) + len(p)
                if size[key] >= CHUNK:
                    look_up(key)
    for key in list(waiting):
        look_up(key)
    return list(zip(sums.tolist(), sizes.tolist()))
