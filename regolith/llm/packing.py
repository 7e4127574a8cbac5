"""Cost-balanced packing of tokenised documents into sequences of fixed length.

A piece of n tokens costs n + n*n / QUADRATIC, the feed-forward and the attention part of a layer. Within a block
of documents the sequences needed are opened at once, and the documents, longest first, each go to the sequence of
the lowest cost so far that has room. One that fits nowhere is cut over the cheapest sequences with room.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regolith.llm.bpe import byte_chars
from regolith.llm.common import refuse_clash, table, tidied

LENGTH = 2048
#: Tokens at which a piece's quadratic cost equals its linear cost.
QUADRATIC = 2048
#: A block is packed once it has so many documents, or so many bytes of ids.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Bytes of ids of an output batch (one piece more at most), which the worker and the JVM hold several times over.
BATCH_BYTES = 2 << 20
END_ID = 1
#: Characters of a word beyond which tiktoken isn't used.
LONG_WORD = 2000
#: Sequence ids: the partition's number, shifted, plus the sequence's number within it.
SHIFT = 40


#: Fixed value: the expression by which the byte-level pre-tokenizer of the tokenizers library cuts a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def tokenizer(path: str) -> Any:
    """The tokenizers library's own, as the file has it; loaded when first needed."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoder(path: str) -> Callable[[str], bytes]:
    """From text to ids as little-endian unsigned 32-bit integers: what the tokenizers library gives for the file at
    `path` with add_special_tokens=False, where a special token's string in a text is that token.

    Where the file proves to be a byte-level BPE whose ids follow its merges, tiktoken gives the same ids from its
    vocabulary in an eighth of the time. A text with a special token's string, one with a word of over LONG_WORD
    characters, on which tiktoken is quadratic, and every text under another file go to the library itself."""
    exact = lambda text: np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    if (found := byte_ranks(path)) is None:
        return exact
    import tiktoken

    ranks, added = found
    fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
    apart = re.compile("|".join([rf"\S{{{LONG_WORD}}}", *map(re.escape, added)])).search

    def encode(text: str) -> bytes:
        return exact(text) if apart(text) else np.array(fast.encode_ordinary(text), "<u4").tobytes()

    return encode


def byte_ranks(path: str) -> tuple[dict[bytes, int], list[str]] | None:
    """The vocabulary of a tokenizers file as byte strings by id, and its added tokens' strings, if it is a byte-level
    BPE of plain settings whose entries' ids begin with all single bytes and go on in the order of the merges, and
    whose added tokens match as they are; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        return None
    if any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or not all(x["content"] for x in added):
        return None
    if any(x.get(y) for x in added for y in ("single_word", "lstrip", "rstrip")):
        return None
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [model["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    byte = {c: b for b, c in enumerate(byte_chars())}
    special = {x["content"] for x in added}
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}, sorted(special)


def balanced(lengths: list[int], capacity: int = LENGTH, quadratic: int = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Packs items of at most `capacity` tokens into ceil(total / capacity) sequences.

    Returns pieces (item, start within it, length, sequence, offset). Items of length 0 get none; ties go to the
    earlier item and the earlier sequence."""
    total = sum(lengths)
    n = -(-total // capacity)
    cost, room = np.zeros(n), np.full(n, capacity)
    out = []
    for i in sorted((i for i, x in enumerate(lengths) if x), key=lambda i: -lengths[i]):
        at, left = 0, lengths[i]
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            s = int(np.where(fits, cost, np.inf).argmin())
            put = min(left, int(room[s]))
            out.append((i, at, put, s, capacity - int(room[s])))
            cost[s] += put + put * put / quadratic
            room[s] -= put
            at, left = at + put, left - put
    return out


def pack(df: DataFrame, key: str, text: str, path: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """The pieces of all rows' token ids: key, start, length, ids (binary, little-endian unsigned 32-bit integers),
    doc_tokens, sequence_id and offset.

    Each task tokenises its rows and packs them block by block as they pass, so nothing is shuffled and a task
    holds one block at most; a block ends with one sequence that isn't full. Whole runs of `length` tokens of a
    long document become sequences of their own, at once. A null or empty text is the end id alone. Repeated rows
    are documents of their own. A key that has one of the other columns' names is refused. The result depends on how the input is split, and each split's on itself alone."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None  # loaded by the first batch; many partitions may be empty
        end = end_id.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << SHIFT
        wide = length * 4
        schema = None
        rows: list[tuple] = []
        tails: list[tuple] = []
        held = made = waiting = 0

        def emit(least: int) -> Iterator[pa.RecordBatch]:
            """The pieces so far, in batches, while they have more than `least` bytes of ids."""
            nonlocal waiting
            while rows and waiting > least:
                end = size = 0
                while end < len(rows) and size < BATCH_BYTES:
                    size += len(rows[end][3])
                    end += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[:end]), schema)], schema=schema)
                del rows[:end]
                waiting -= size
                pa.default_memory_pool().release_unused()

        def flush() -> None:
            nonlocal held, made, waiting
            pieces = balanced([len(t[2]) // 4 for t in tails], length)
            for i, at, n, s, offset in pieces:
                k, start, ids, tokens = tails[i]
                rows.append((k, start + at, n, ids[at * 4 : (at + n) * 4], tokens, base + made + s, offset))
            made += max((p[3] for p in pieces), default=-1) + 1
            waiting += held
            tails.clear()
            held = 0

        for b in batches:
            encode = encode or encoder(path)
            schema = schema or pa.schema([pa.field("key", b.schema[0].type), *((n, pa.binary() if n == "ids" else pa.int64()) for n in NAMES)])
            for k, t in zip(b[0].to_pylist(), map(pa.StringScalar.as_py, b[1])):
                ids = encode(t or "") + end
                tokens, whole = len(ids) // 4, len(ids) // wide
                for i in range(whole):
                    rows.append((k, i * length, length, ids[i * wide : (i + 1) * wide], tokens, base + made, 0))
                    made += 1
                if len(ids) > whole * wide:
                    tails.append((k, whole * length, ids[whole * wide :], tokens))
                    held += len(tails[-1][2])
                waiting += whole * wide
                if len(tails) >= BLOCK or held >= BLOCK_BYTES:
                    flush()
                yield from emit(BATCH_BYTES)
        flush()
        yield from emit(0)

    refuse_clash([key], list(NAMES))
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField("key", kind), *(T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in NAMES)])
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, out).toDF(key, *NAMES)


NAMES = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def packed_documents(docs: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    done = pack(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))
