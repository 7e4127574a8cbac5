"""Byte-level BPE by sentencepiece: a model serialised from a rank file, encoding and decoding.

Every byte is written as one printable character and every vocabulary entry as the string of its bytes'
characters, scored by its negative rank, under the identity normalisation. sentencepiece then merges the pair of
the best score first, which is the pair of the lowest rank, leftmost on ties: byte-level BPE.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regolith.llm.common import refuse_clash, table, tidied

#: Entries of a worker's memo, and the longest chunk kept in it, in characters.
MEMO, LONGEST = 150_000, 64
#: An output batch is handed on once it holds so many bytes.
BATCH_BYTES = 16 << 20


@functools.cache
def byte_chars() -> tuple[str, ...]:
    """A printable character for each byte: itself where it prints, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    at = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return tuple(at[b] for b in range(256))


@functools.cache
def vocabulary(path: str) -> list[bytes]:
    """The entries of a rank file, by rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(entry) for entry, rank in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def model_bytes(entries: list[bytes]) -> bytes:
    """The serialised sentencepiece model; the piece at index i is the entry of rank i. The piece for unknown
    characters, which no text reaches, comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = {b: c for b, c in enumerate(byte_chars())}
    model = pb.ModelProto()
    for rank, entry in enumerate(entries):
        model.pieces.add(piece=entry.decode("latin-1").translate(chars), score=-rank)
    model.pieces.add(piece="<unk>", score=0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size = pb.TrainerSpec.BPE, len(model.pieces)
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(entries), -1, -1, -1
    norm = model.normalizer_spec
    norm.name, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Memo(dict):
    """Remembers f(key) in two generations: when the young one is full it becomes the old one, and what is still
    used moves back. Long keys aren't kept, so the size is bounded."""

    def __init__(self, f: Callable[[str], bytes]) -> None:
        self.f = f
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.f(key)
        if len(key) <= LONGEST:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


#: A space before white space or the end; other spaces always begin a pre-token.
LOOSE = re.compile(r" (?=\s|\Z)")


class ChunkEncoder:
    """Encodes texts by chunks that begin at a space and end before the next.

    Under the pattern, a pre-token begins at every space that a non-space follows, wherever it stands, so a text
    whose spaces are all such is the concatenation of its chunks, and each distinct chunk is encoded once. Other
    texts go to `whole`. Both must encode by the same pattern.
    """

    def __init__(self, whole: Callable[[str], bytes]) -> None:
        self.whole = whole
        self.first, self.later = Memo(whole), Memo(lambda chunk: whole(" " + chunk))

    def __call__(self, text: str) -> bytes:
        if LOOSE.search(text):
            return self.whole(text)
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))


@functools.cache
def encoder(path: str, pattern: str) -> ChunkEncoder:
    """From text to ids as little-endian unsigned 32-bit integers, one for each worker process."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(vocabulary(path)))
    chars = {b: c for b, c in enumerate(byte_chars())}
    split = regex.compile(pattern).findall

    def piece(token: str) -> bytes:
        ids = sp.encode(token.encode().decode("latin-1").translate(chars), out_type=int)
        return b"".join(i.to_bytes(4, "little") for i in ids)

    known = Memo(piece)
    return ChunkEncoder(lambda text: b"".join(map(known.__getitem__, split(text))))


def batched(rows: Iterator[tuple], schema: pa.Schema, weigh: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about BATCH_BYTES each."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


Batches = Iterator[pa.RecordBatch]


def encoding(path: str, pattern: str) -> Callable[[Batches], Batches]:
    """From batches (key, text) to batches (key, ids)."""

    @tidied
    def run(batches: Batches) -> Batches:
        encode = encoder(path, pattern)
        schema = None
        for b in batches:
            schema = schema or pa.schema([pa.field("key", b.schema[0].type), pa.field("ids", pa.binary())])
            rows = ((k, encode(t or "")) for k, t in zip(b[0].to_pylist(), map(pa.StringScalar.as_py, b[1])))
            yield from batched(rows, schema, lambda r: len(r[1]))

    return run


def decoding(path: str, ids: str, into: str) -> Callable[[Batches], Batches]:
    """Adds to batches what their ids stand for."""

    @tidied
    def run(batches: Batches) -> Batches:
        entry = vocabulary(path).__getitem__
        for b in batches:
            at = b.schema.get_field_index(ids)
            texts = [None if x is None else b"".join(map(entry, memoryview(x).cast("I"))) for x in map(pa.BinaryScalar.as_py, b[at])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], schema=b.schema.append(pa.field(into, pa.binary())))

    return run


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))


def schema_of(df: DataFrame, *binaries: str) -> T.StructType:
    return T.StructType([df.schema[0], *(T.StructField(b, T.BinaryType()) for b in binaries)])


def bpe_encode(df: DataFrame, key: str, text: str, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """key and ids (binary: little-endian unsigned 32-bit integers) of each row's whole text, null as empty. Each
    match of the pattern is encoded on its own. No shuffle; repeated rows and null keys stay as they are."""
    refuse_clash([key], ["ids"])
    rows = keyed(df, key, text)
    return rows.mapInArrow(encoding(path, pattern), schema_of(rows, "ids")).withColumnRenamed("key", key)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for. Ids outside the vocabulary raise an error; null ids give null; a column
    that has the name `into` already is refused."""
    refuse_clash(df.columns, [into])
    return df.mapInArrow(decoding(path, ids, into), T.StructType([*df.schema.fields, T.StructField(into, T.BinaryType())]))


def bpe_round_trip(df: DataFrame, key: str, text: str, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """key, ids and decoded: bpe_encode and bpe_decode in one pass, by one worker."""
    refuse_clash([key], ["ids", "decoded"])
    encode, decode = encoding(path, pattern), decoding(path, "ids", "decoded")
    rows = keyed(df, key, text)
    return rows.mapInArrow(lambda batches: decode(encode(batches)), schema_of(rows, "ids", "decoded")).withColumnRenamed("key", key)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text encoded by the 50k ranks and decoded again, as digests. Null and empty texts have no ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = bpe_round_trip(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return done.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
