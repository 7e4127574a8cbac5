import math
import zlib

import numpy as np
import pytest

from regolith.llm import langid as L
from regolith.llm.common import table


def test_accuracy_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    rows = L.op7_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.98
    assert np.mean([r.rejected for r in rows]) < 0.01


def test_blocks_of_a_long_text_hold_every_ngram_once(monkeypatch):
    text = "Straße, naïve words " * 50
    whole = np.sort(np.concatenate(list(L.subwords(text))))
    monkeypatch.setattr(L, "STEP", 7)
    assert (np.sort(np.concatenate(list(L.subwords(text)))) == whole).all()
    assert sum(len(h) for h in L.subwords("ab")) == 2 + 1


def test_labels_and_texts_alone_decide(spark):
    docs = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * (1 + i % 5), "en" if i % 2 else "de", "s", 1) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    a, b = L.document_model(df), L.document_model(df.selectExpr("doc_id", "text", "lang", "'zz' source", "5 n_chars"))
    assert (a.rows == b.rows).all() and a.langs == ["de", "en"]
    assert L.predict(a, "the dog and the cat")[0] == "en" and L.predict(a, "die katze und der hund")[0] == "de"


@pytest.mark.parametrize("text", [None, "", "123 !? 456", "\n\t "])
def test_no_letters_is_undetermined(text):
    model = L.Model(["en"], np.ones((L.BUCKETS, 1), np.float32), None, np.zeros(1, np.float32), 1.0, 0.0)
    assert L.predict(model, text) == ("und", 0.0, True)


def brute(model, text):
    """Prediction, probability and rejection by plain loops over a text's n-grams."""
    words = "".join(chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in text.lower().encode()).split()
    a = (" " + " ".join(words) + " ").encode("latin-1")
    at = []
    for n in L.SIZES:
        for i in range(len(a) - n + 1):
            h = n
            for b in a[i : i + n]:
                h = ((h ^ b) * 0x01000193) % 2**32
            h ^= h >> 15
            h = h * 0x85EBCA6B % 2**32
            at.append((h ^ h >> 13) % L.BUCKETS)
    mean = [sum(float(model.rows[h][j]) for h in at) / len(at) for j in range(model.rows.shape[1])]
    z = [x + b for x, b in zip(mean if model.linear is None else [sum(m * float(w) for m, w in zip(mean, c)) for c in model.linear.T], model.bias.tolist())]
    e = [math.exp((x - max(z)) / model.temperature) for x in z]
    best = max(range(len(e)), key=lambda i: e[i])
    p = e[best] / sum(e)
    k = sum(len(at) >= n for n in L.LENGTHS) - 1
    odds = math.log(min(max(p, 0.001), 0.999) / (1 - min(max(p, 0.001), 0.999)))
    usual = sum(float(model.usual[h]) for h in at) / len(at)
    return model.langs[best], p, k >= 0 and (odds < model.threshold[k] or usual < model.least[k])


@pytest.mark.parametrize("dim", [L.DIM, 2])
def test_predictions_equal_brute_force(spark, sample, monkeypatch, dim):
    """With fewer languages than dimensions and with more."""
    monkeypatch.setattr(L, "DIM", dim)
    model = L.document_model(sample)
    assert (model.linear is None) == (dim > 4)
    odd = [(-1, "Ünï cödé 漢字 words"), (-2, "ab"), (-3, "zqxj kvwpf qzzkx vjwq xkcd pfffq zzxqj wvkkq")]
    rows = sample.select("doc_id", "text").where("length(text) < 3000").limit(60).unionAll(spark.createDataFrame(odd, "doc_id long, text string"))
    for r in L.identify(rows, model).collect():
        lang, p, rejected = brute(model, r.text)
        assert (r.lang_pred, r.rejected) == (lang, rejected) and abs(r.score - p) < 1e-5
    with pytest.raises(ValueError):
        L.identify(rows.withColumnRenamed("doc_id", "Score"), model)


def test_whole_texts_are_learned():
    """A bag holds every n-gram of a text of any length; the passages lie within it."""
    text = "naïve wörter, " * 5000
    at, n = L.bag(text)
    every = np.concatenate(list(L.subwords(text)))
    assert n.sum() == len(every) and (np.unique(every) == at).all()
    assert all(p in text for p in L.learned_parts(text, -12345)) and len(L.learned_parts(text, 5)) == 3 and L.learned_parts("ab", 9) == ["ab"]


def test_odd_rows(documents, nothing):
    kept = L.known_documents(documents)
    assert kept.columns == documents.columns and kept.where("text is null or trim(text) = ''").count() == 0
    assert L.known_documents(nothing).count() == 0


@pytest.mark.parametrize("key", ["cast(null as long)", "7L"])
def test_sample_is_bounded_whatever_the_keys(spark, monkeypatch, key):
    got, fit = [], L.fit
    monkeypatch.setattr(L, "SAMPLE", 40)
    monkeypatch.setattr(L, "fit", lambda bags: got.extend(bags) or fit(bags))
    rows = spark.range(0, 600, 1, 6).selectExpr(f"if(id % 3 = 0, id, {key}) doc_id", "concat('text ', translate(cast(id as string), '0123456789', 'abcdefghij')) text", "if(id % 2 = 0, 'en', 'de') lang")
    L.train(rows.unionAll(rows), "doc_id", "text", "lang")
    assert sorted(b.lang for b in got) == ["de"] * 20 + ["en"] * 20
    assert len({(b.buckets.tobytes(), b.counts.tobytes()) for b in got}) > 30 and len({b.later for b in got}) == 2


@pytest.fixture(scope="module")
def made():
    """Prose in four languages of 60 words each, and the model of it."""
    words = {lang: [a + b for a in first.split() for b in last.split()] for lang, first, last in [("en", "wh th sh str cl", "ing ould eight ow ain"), ("de", "sch pf zw gr kn", "ung eit ach euz ier"), ("fr", "qu bl tr ch pr", "eau oir ille ique eux"), ("es", "ll gu cu ri mo", "ción ado eño uela ito")]}
    rng = np.random.default_rng(5)
    texts = [(" ".join(rng.choice(w, n)), lang, i % 4 == 0) for i in range(120) for lang, w in words.items() for n in (60,)]
    return words, rng, texts


@pytest.mark.parametrize("langs", [("en",), ("en", "de"), ("en", "de", "fr", "es")])
def test_unlearned_languages_and_noise_are_rejected(made, langs):
    words, rng, texts = made
    own = [t for t in texts if t[1] in langs]
    model = L.fit([L.Bag(*L.bag(x), lang, later) for t, lang, later in own for x in L.learned_parts(t, len(t) * 7919)])
    model = L.calibrated(model, [m for t, lang, later in own if later for m in L.measures(model, t, lang)])
    foreign = ["Сегодня утром мы пошли в город, чтобы купить хлеб и молоко", "Σήμερα το πρωί πήγαμε στην πόλη για να αγοράσουμε ψωμί", "zqxj kvwpf qzzkx vjwq xkcd pfffq zzxqj wvkkq jqxz vvkpq"]
    foreign += [" ".join(rng.choice(w, 40)) for lang, w in words.items() if lang not in langs]
    assert all(L.predict(model, t)[2] for t in foreign)
    own = [(lang, L.predict(model, " ".join(rng.choice(words[lang], n)))) for lang in langs for n in (1, 2, 3, 5, 10, 100) for _ in range(40)]
    assert np.mean([rejected for _, (_, _, rejected) in own]) < 0.01


def test_every_row_is_learned_or_calibrates(spark, monkeypatch):
    """Ten times as many rows as bags: the counts of n-grams, temperature and limits are those of plain loops over all
    rows, each once, whatever the partitions and the parts in which a bag is added up."""
    monkeypatch.setattr(L, "SAMPLE", 40)
    words = {"en": "the quick brown fox jumps over lazy dogs while it rains".split(), "de": "der schnelle braune fuchs springt über faule hunde bei regen".split()}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words[lang], 1 + i % 23)) + (" aber zwar" if i % 50 == 0 else ""), lang) for i in range(400) for lang in ("en" if i % 3 else "de",)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(df.repartition(3), "doc_id", "text", "lang")
    monkeypatch.setattr(L, "RUN", 2)
    again = L.train(df.unionAll(df).repartition(7), "doc_id", "text", "lang")
    assert all(np.array_equal(a, b) for a, b in zip(model, again))
    hashed = [(r.text, r.lang, r.h) for r in df.selectExpr("text", "lang", "xxhash64(string(doc_id), text) h").collect()]
    bags = [L.Bag(*L.bag(p), lang, False) for t, lang, h in hashed if not L.later(h % 20) for p in L.learned_parts(t, h)]
    assert np.allclose(model.usual, L.usualness(bags, model.langs), atol=1e-5)
    held = [(t, lang, h) for t, lang, h in hashed if L.later(h % 20)]
    assert 0 < len(held) < 200 and len(held) > 40
    y = {lang: np.array([L.measured(model, p)[0] for t, l, h in held if l == lang for p in L.learned_parts(t, h)]) for lang in model.langs}
    loss = sum(L.losses(z, np.full(len(z), model.langs.index(lang))).mean(0) for lang, z in y.items())
    assert model.temperature == L.TEMPERATURES[loss.argmin()]
    found = [(lang, m) for t, lang, _ in held for m in L.measures(model, t, lang)]
    for which, limits in ((1, model.threshold), (2, model.least)):
        weighed = [(m[0], m[which], 1 / sum(x == lang and k[0] == m[0] for x, k in found)) for lang, m in found]
        assert np.allclose(limits, L.least_right(weighed), atol=2 * L.GRAIN)
    assert all(lang == L.predict(model, t)[0] for t, lang, _ in hashed if t.count(" ") > 5)


def test_a_language_all_of_whose_rows_calibrate_is_learned(spark):
    rows = [(i, "the cat and the dog sat on the mat", "en") for i in range(200)] + [(-1, "der hund und die katze", "de")]
    for shift in range(20):
        df = spark.createDataFrame([(k - shift * (k < 0), t, lang) for k, t, lang in rows], "doc_id long, text string, lang string")
        if L.later(df.where("doc_id < 0").selectExpr("pmod(xxhash64(string(doc_id), text), 1000) s").first().s):
            break
    assert L.predict(L.train(df, "doc_id", "text", "lang"), "die katze und der hund")[0] == "de"
