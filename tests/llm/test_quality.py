import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from regolith.llm import ngrams as N
from regolith.llm import quality as Q


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated)


def test_features_equal_brute_force():
    r = random.Random(3)
    for _ in range(2000):
        text = "".join(r.choice(["a", "b ", "é\n", "# ", "\t", "\x0b", "<", "a b a b ", " ", " \n", " ", "\x1c"]) for _ in range(r.randint(0, 120)))
        raw = text.encode()
        words = raw.split()
        assert Q.features(raw, words, b" ".join(words).decode()) == brute(text), repr(text)


def kneser_ney(texts):
    """The model of texts (words joined by spaces) in plain dictionaries: probabilities, back-off weights, symbols."""
    tables = {5: Counter(t[i : i + 5] for t in ("\n" * 4 + x.lower() + "\n" for x in texts) for i in range(len(t) - 4))}
    for k in (4, 3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    p, weights, size = {}, {}, len(tables[1]) + 1
    for k in range(1, 6):
        counts = tables[k]
        of = [sum(n == i for n in counts.values()) for i in range(5)]
        cut = [0, 0.5, 1, 1.5]
        if all(of[1:]):
            y = of[1] / (of[1] + 2 * of[2])
            cut = [0, *(min(max(i - (i + 1) * y * of[i + 1] / of[i], 0.05), i - 0.05) for i in (1, 2, 3))]
        total, left = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            left[g[:-1]] += cut[min(n, 3)]
        weights |= {h: left[h] / total[h] for h in total}
        for g, n in counts.items():
            p[g] = (n - cut[min(n, 3)]) / total[g[:-1]] + weights[g[:-1]] * (p[g[1:]] if k > 1 else 1 / size)
    return p, weights, size


def surprise(model, text):
    """The mean negative log probability of a text's symbols."""
    if model is None:
        return math.log(256)
    p, weights, size = model
    t, out = "\n" * 4 + text.lower() + "\n", 0.0
    for i in range(4, len(t)):
        g = t[i - 4 : i + 1]
        while g and g not in p:
            out -= math.log(weights.get(g[:-1], 1))
            g = g[1:]
        out -= math.log(p[g]) if g else -math.log(size)
    return out / (len(t) - 4)


def brute_perplexities(rows):
    """For each (key, text, lang): the log perplexity by the half of the language that the text isn't in."""
    line = lambda t: b" ".join((t or "").encode().split()).decode()
    half = lambda t: zlib.crc32((t or "").encode()) % 2
    parts = {}
    for _, t, g in rows:
        if line(t):
            parts.setdefault((g, half(t)), []).append(line(t))
    models = {k: kneser_ney(v) for k, v in parts.items()}
    return {k: surprise(models.get((g, 1 - half(t))), line(t)) if line(t) else None for k, t, g in rows}


def test_probabilities_sum_to_one():
    texts = ["the cat sat on the mat", "the dog sat", "und der hund, die katze 12!"] * 3
    p, weights, size = kneser_ney(texts)
    every = [g for g in p if len(g) == 1]
    for context in {g[:-1] for g in p if len(g) == 5} | {"zzzz"}:
        total = sum(math.exp(-surprise_of(p, weights, size, context + c)) for c in [*every, "?"])
        assert abs(total - 1) < 1e-9


def surprise_of(p, weights, size, g):
    out = 0.0
    while g and g not in p:
        out -= math.log(weights.get(g[:-1], 1))
        g = g[1:]
    return out - (math.log(p[g]) if g else -math.log(size))


@pytest.mark.parametrize("block", [N.BLOCK, 9000, 1500])
def test_perplexity_equals_brute_force(spark, sample, block, monkeypatch):
    """In one pass, in several, and with languages whose models take several passes."""
    monkeypatch.setattr(N, "UNIT", 500)
    few = sample.where("doc_id < 60").select("doc_id", F.expr("substring(text, 1, 900)").alias("text"), F.expr("if(doc_id % 7 = 0, null, lang)").alias("lang"))
    odd = [(1000, "", "en"), (1001, None, "en"), (1002, "x", "xx"), (1003, "A\u0130 \U00020000\U0001f600 \U00020000 ß", None), (1004, "twice the same words", "de"), (1005, "twice the same words", "de")]
    df = few.unionAll(spark.createDataFrame(odd, few.schema)).cache()
    want = brute_perplexities([(r.doc_id, r.text, r.lang) for r in df.collect()])
    models = N.language_models(df, "text", "lang")
    assert block == N.BLOCK or len(N.passes(models, block)) > 2
    got = {r._carry0: r.log_perplexity for r in Q.scored(df, "text", "lang", ["doc_id"], models, block).collect()}
    assert set(got) == set(want)
    for k, x in want.items():
        assert got[k] == x or abs(got[k] - x) < 1e-4, (k, got[k], x)


def test_long_texts_are_counted_and_scored_in_parts(monkeypatch):
    text = " ".join(f"w{i % 13}x{i % 7}" for i in range(400))
    tally = N.Tally()
    tally.add("k", N.symbols(text))
    whole = {(k, g): n for b in tally.rows() for k, g, n in zip(*(c.to_pylist() for c in b.columns))}
    monkeypatch.setattr(N, "CHUNK", 64)
    for p in (text, ""):
        tally.add("k", N.symbols(p))
    parts = {}
    for b in tally.rows():
        for k, g, n in zip(*(c.to_pylist() for c in b.columns)):
            parts[k, g] = parts.get((k, g), 0) + n
    assert parts == {**whole, ("k", "\n\n\n\n\n"): 1}


def test_op10(spark, sf, sample):
    got = {r.doc_id: r for r in Q.op10_quality_perplexity(spark, sf).collect()}
    for r in sample.collect():
        x, want = got[r.doc_id], brute(r.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert x.kept <= (not x.base_failed)


def test_bands_reject_gibberish_and_keep_prose(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    prose = [x for x in docs.where("lang = 'en'").orderBy("doc_id").collect() if len(x.text.split()) > 100]
    german = docs.where("lang = 'de' and length(text) > 1500").orderBy("doc_id").first().text
    r = random.Random(1)
    letters = list(prose[0].text.replace(" ", ""))
    r.shuffle(letters)
    odd = [" ".join("".join(r.choice("zqxjkvwpf0139") for _ in range(9)) for _ in range(150)), german, " ".join("".join(letters[i : i + 5]) for i in range(0, len(letters), 5)), " | ".join(f"{i} {i * i}" for i in range(300))]
    odd = [(10**6 + i, x, "en", "s", 1) for i, x in enumerate(odd)]
    df = docs.unionAll(spark.createDataFrame(odd, docs.schema))
    rows = Q.quality(df, ["doc_id"]).collect()
    assert not any(x.kept for x in rows if x.doc_id >= 10**6)
    assert sum(x.kept for x in rows if not x.base_failed) >= 0.97 * sum(not x.base_failed for x in rows)
    widths = {round(x.band_high - x.band_low, 2) for x in rows if not x.base_failed and x.n_words > 3000}
    assert len(widths) > 1


def test_odd_rows(documents, nothing):
    rows = Q.quality(documents, ["doc_id"]).collect()
    assert len(rows) == documents.count() and not any(r.kept for r in rows if r.n_words < 20)
    kept = Q.kept_documents(documents)
    assert kept.columns == documents.columns
    assert Q.kept_documents(nothing).count() == 0
