import base64
import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from regolith.llm import bpe, packing

ALPHABET = [*"aàbZ09 \n\t  \r.,!#'s'éß漢😀\x1c\x85 　", "  ", "'ll", " 's", "\x00", "ing", "\xa0", "<|endoftext|>", "ation", "über"]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def odd_texts(n=4000, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_sentencepiece_model_encodes_as_tiktoken(tiktoken_encoding):
    encode = bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in [*odd_texts(), "ab" * 20000]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tiktoken_encoding.encode_ordinary(text), repr(text[:50])


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    m = bpe.Memo(lambda k: k.encode())
    assert all(m[str(i % 37)] == str(i % 37).encode() for i in range(500)) and len(m) <= 10 and len(m.old) <= 10


def test_op3(spark, sf, sample, tiktoken_encoding):
    got = {r.doc_id: r for r in bpe.op3_byte_bpe(spark, sf).collect()}
    for r in sample.collect():
        text = r.text or ""
        ids = tiktoken_encoding.encode_ordinary(text)
        want = len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_encoding_odd_rows(documents, nothing):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = bpe.bpe_decode(bpe.bpe_encode(documents, "doc_id", "text", path), path).collect()
    want = sorted(((r.doc_id is None, r.doc_id), (r.text or "").encode()) for r in documents.collect())
    assert sorted(((r.doc_id is None, r.doc_id), bytes(r.decoded)) for r in rows) == want
    assert bpe.bpe_decode(bpe.bpe_encode(nothing, "doc_id", "text", path), path).count() == 0


def test_packing_encoder_equals_tokenizers(tokenizer):
    encode = packing.encoder(P.path("byte_bpe_50k.json"))
    special = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext|" + "z" * 9]
    assert packing.byte_ranks(P.path("byte_bpe_50k.json"))[1] == ["<|endoftext|>"] and 50256 in tokenizer.encode(special[0], add_special_tokens=False).ids
    for text in [*odd_texts(seed=2), *special, "ab" * 20000]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text[:50])


def test_other_files_go_to_the_library(tmp_path, tokenizer):
    import json

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    assert packing.byte_ranks(str(tmp_path / "t.json")) is None
    encode = packing.encoder(str(tmp_path / "t.json"))
    assert np.frombuffer(encode("hello"), "<u4").tolist() == tokenizer.encode(" hello", add_special_tokens=False).ids


def test_clashing_names_are_refused(documents):
    df = documents.withColumnRenamed("doc_id", "start").withColumnRenamed("key", "decoded")
    for f in (lambda: packing.pack(df, "start", "text", P.path("byte_bpe_50k.json")), lambda: bpe.bpe_decode(df, P.path("byte_bpe_50k.tiktoken"), "text")):
        with pytest.raises(ValueError):
            f()


def test_balanced_covers_and_fills():
    r = random.Random(3)
    for _ in range(50):
        lengths = [r.choice([0, 1, r.randint(1, 2048), r.randint(1, 60)]) for _ in range(r.randint(0, 200))]
        pieces = packing.balanced(lengths, 2048, 2048)
        by, seq = defaultdict(list), defaultdict(list)
        for i, at, n, s, offset in pieces:
            by[i].append((at, n))
            seq[s].append((offset, n))
        for i, n in enumerate(lengths):
            assert sum(x for _, x in by[i]) == n and all(a + x == b for (a, x), (b, _) in zip(sorted(by[i]), sorted(by[i])[1:]))
        for parts in seq.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a + x == b for (a, x), (b, _) in zip(parts, parts[1:])) and sum(x for _, x in parts) <= 2048
        assert len(seq) == -(-sum(lengths) // 2048)


def test_costs_are_balanced():
    pieces = packing.balanced([1000] * 20 + [10] * 2000, 2048, 2048)
    cost = defaultdict(float)
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 2048
    in_order = [1000 * 2 + 2 * 1000**2 / 2048] * 10
    assert max(cost.values()) - min(cost.values()) < max(in_order) - 2048


def check_pieces(pieces, docs, tokenizer):
    by, seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        seq[p.sequence_id].append(p)
    for key, text in docs.items():
        ids, at = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(by[key], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for parts in seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    return len(seq) * 2048 - sum(p.length for p in pieces)


def test_op8(spark, sf, sample, tokenizer):
    padding = check_pieces(packing.op8_cost_packing(spark, sf).collect(), {r.doc_id: r.text for r in sample.collect()}, tokenizer)
    assert padding < 2048 * spark.sparkContext.defaultParallelism


def test_packing_odd_rows(documents, nothing, tokenizer):
    rows = documents.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_pieces(packing.packed_documents(rows).collect(), {r.doc_id: r.text for r in rows.collect()}, tokenizer)
    every = packing.packed_documents(documents)
    assert every.where("start = 0").count() == documents.count()  # repeats and rows without an id are documents, too
    assert packing.packed_documents(nothing).count() == 0
