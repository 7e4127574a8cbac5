"""Language identification: averaged hashed subword embeddings under a linear softmax, trained here in numpy.

A text is lower-cased, everything but letters becomes a space, and its UTF-8 byte n-grams of SIZES are hashed into
BUCKETS rows of an embedding table. The mean of a text's rows goes through a linear layer and a softmax, whose
temperature is fitted on documents kept out of the training. Since a softmax must choose, and is sure of itself on
noise or with one language, a text is also measured by how usual its n-grams were in the training. A prediction is
rejected if its odds or its n-grams' mean usualness are below what right predictions of such a length had on the
documents kept out; both limits are fitted for each of LENGTHS.

Every labelled row is learned or calibrates, however many there are: Spark adds the n-grams of all rows up in bags of
a bounded number, which the driver's descent goes through, and sums the losses and counts the measures of all rows
that calibrate.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regolith.llm.common import discard, refuse_clash, stored, table, tidied

SIZES, BUCKETS, DIM = (3, 4), 1 << 15, 16
#: All labelled documents are dealt into at most so many bags (or one of each language, if those are more), shared
#: equally by the languages: the driver's descent goes through these. Of each document the whole text is learned, as
#: shares of its n-grams by bucket, and beside it passages of so many characters, from a place that its hash decides.
SAMPLE, PASSAGES = 2000, (300, 80)
#: Documents that one task adds up in a bag; a bag of more is added up in parts. Shares are added up as whole numbers of
#: 1 / UNIT, so that no order of the rows tells.
RUN, UNIT, HALF = 4096, 1 << 32, 1 << 15
EPOCHS, STEPS, BATCH, RATE = 5, 600, 32, 0.5
#: (A few bags are gone through more often, for so many steps at least.)
#: Of the bags, the share that calibrates; the share of its right answers at which the limits begin, and how far beyond
#: it they lie, as a part of its distance from the median (few documents don't show the worst texts).
CALIBRATE, REJECTED, SLACK = 0.25, 0.001, 0.5
TEMPERATURES = np.geomspace(0.05, 5, 60)
#: Measures of documents that calibrate are counted by steps of so much.
GRAIN = 0.01
#: Lengths in n-grams, from each of which on to the next a text has limits of its own; shorter ones are not rejected.
LENGTHS = np.array([12, 24, 48, 96, 192, 384])
UNDETERMINED = "und"
#: Bytes that are hashed at a time.
STEP = 1 << 20

LETTER = regex.compile(r"\p{L}")
#: Letters of ASCII and all bytes of other characters stay; the rest is space.
KEEP = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Model(NamedTuple):
    langs: list[str]
    rows: np.ndarray  # of each bucket: its embedding, or that times the linear layer if there are fewer languages
    linear: np.ndarray | None  # from embeddings to languages, where rows are embeddings
    bias: np.ndarray
    temperature: float
    threshold: np.ndarray | float  # least log odds, for each of LENGTHS
    usual: np.ndarray = np.zeros(BUCKETS, np.float32)  # log frequency of each bucket, languages weighing the same
    least: np.ndarray | float = -np.inf  # mean of usual over a text's n-grams, for each of LENGTHS

    def scores(self, mean: np.ndarray) -> np.ndarray:
        """The languages' logits by the mean of a text's rows."""
        return (mean if self.linear is None else mean @ self.linear) + self.bias


class Bag(NamedTuple):
    """A training row: the buckets of texts of a language, how often each occurs, and whether they calibrate."""

    buckets: np.ndarray
    counts: np.ndarray
    lang: str
    later: bool


def subwords(text: str) -> Iterator[np.ndarray]:
    """The buckets of a text's n-grams, in blocks; words are joined and enclosed by single spaces."""
    a = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(KEEP).split()) + b" ", np.uint8)
    overlap = max(SIZES) - 1
    for at in range(0, max(len(a) - overlap, 1), STEP):
        block = a[at : at + STEP + overlap].astype(np.uint32)
        for n in SIZES:
            if len(block) >= n:
                end = len(block) - n + 1 if at + STEP + overlap >= len(a) else STEP
                h = np.full(end, n, np.uint32)
                for i in range(n):
                    h = (h ^ block[i : i + end]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA6B)
                yield (h ^ (h >> np.uint32(13))) % np.uint32(BUCKETS)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text, and how often each occurs."""
    counts = np.zeros(BUCKETS, np.int64)
    for h in subwords(text):
        counts += np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.uint16), counts[at].astype(np.float32)


def measured(model: Model, text: str) -> tuple[np.ndarray, float, int] | None:
    """Logits and mean usualness of a text's n-grams, and their number."""
    total, usual, n = np.zeros(model.rows.shape[1]), 0.0, 0
    for h in subwords(text):
        total += model.rows[h].sum(0, dtype=np.float64)
        usual += float(model.usual[h].sum(dtype=np.float64))
        n += len(h)
    return (model.scores(total / n), usual / n, n) if n else None


def log_odds(p: float) -> float:
    """Above 0.999 all are alike."""
    p = min(max(float(p), 0.001), 0.999)
    return float(np.log(p / (1 - p)))


def limit(limits: np.ndarray | float, n: int) -> float:
    """The limit for a text of n n-grams."""
    at = length(n)
    return float(np.broadcast_to(limits, len(LENGTHS))[at]) if at >= 0 else -np.inf


def predict(model: Model, text: str | None) -> tuple[str, float, bool]:
    """Language, probability and whether the prediction is rejected. A text that is null or has no letters is
    undetermined, with probability 0, and rejected; so is any text if nothing was learned."""
    if not text or not model.langs or not LETTER.search(text) or (found := measured(model, text)) is None:
        return UNDETERMINED, 0.0, True
    z, usual, n = found
    p = softmax(z[None] / model.temperature)[0]
    best = int(p.argmax())
    return model.langs[best], float(p[best]), bool(log_odds(p[best]) < limit(model.threshold, n) or usual < limit(model.least, n))


def usualness(bags: list[Bag], langs: list[str]) -> np.ndarray:
    """Log frequency of each bucket among the bags' n-grams; each language weighs the same, and every bucket has
    half an occurrence beside its own."""
    share = np.zeros(BUCKETS)
    for lang in langs:
        own = [b for b in bags if b.lang == lang]
        if own:
            count = np.full(BUCKETS, 0.5)
            for b in own:
                count[b.buckets] += b.counts
            share += count / count.sum()
    return np.log(share / share.sum() * BUCKETS).astype(np.float32)


def heads(text: str) -> list[str]:
    """The heads of every length that are shorter than the text; a character has about two n-grams, of one size and
    the other."""
    return sorted({text[: int(n) * 3 // 4] for n in LENGTHS} - {text})


def length(n: int) -> int:
    """The place in LENGTHS of a text of n n-grams; -1 if it is shorter."""
    return int(np.searchsorted(LENGTHS, n, "right")) - 1


def measures(model: Model, text: str, lang: str) -> list[tuple[int, float, float]]:
    """What right predictions on the whole text and on its heads of every length have: (length, log odds, usualness)."""
    out = []
    for part in (text, *heads(text)):
        if (found := measured(model, part)) is not None:
            z, mean, n = found
            p = softmax(z[None] / model.temperature)[0]
            at = length(n)
            if at >= 0 and model.langs[int(p.argmax())] == lang:
                out.append((at, log_odds(p.max()), mean))
    return out


def least_right(found: list[tuple[int, float, float]]) -> np.ndarray:
    """The limit for each of LENGTHS, by (length, measure, weight) of right predictions."""
    out, last = [], -np.inf
    for at in range(len(LENGTHS)):
        x = np.array(sorted((m, w) for k, m, w in found if k == at)).reshape(-1, 2)
        if len(x):  # or else as for shorter texts, whose measures scatter more
            below = np.cumsum(x[:, 1])
            low, middle = (x[np.searchsorted(below, q * below[-1]), 0] for q in (REJECTED, 0.5))
            last = low - SLACK * (middle - low)
        out.append(last)
    return np.array(out)


def calibrated(model: Model, found: list[tuple[int, float, float]]) -> Model:
    """The model with its limits, by the measures of documents that it wasn't fitted to."""
    odds, usual = ([(m[0], m[which], 1.0) for m in found] for which in (1, 2))
    return model._replace(threshold=least_right(odds), least=least_right(usual))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def losses(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The logarithmic loss of each row of logits by each of TEMPERATURES; y has the right languages' places."""
    e = z[:, None, :] / TEMPERATURES[:, None]
    e = np.exp(e - e.max(2, keepdims=True))
    return -np.log(e[np.arange(len(y)), :, y] / e.sum(2) + 1e-12)


def fit(bags: list[Bag], seed: int = 7) -> Model:
    """A model of training rows, by stochastic gradient descent in a fixed order; it rejects nothing yet."""
    langs = sorted({b.lang for b in bags})
    at = {lang: i for i, lang in enumerate(langs)}
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    linear, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    bags = [b for b in bags if len(b.buckets)]
    if not bags:
        return Model([], np.zeros((BUCKETS, 0), np.float32), None, np.zeros(0), 1.0, 0.0)
    fits = [b for b in bags if not b.later] or bags
    each = -(-len(fits) // BATCH)
    steps = max(EPOCHS, -(-STEPS // each)) * each

    seen = np.zeros(BUCKETS, bool)
    for b in bags:
        seen[b.buckets] = True
    place, own = np.cumsum(seen) - 1, table[seen]

    def shares(part: list[Bag]) -> np.ndarray:
        x = np.zeros((len(part), len(own)), np.float32)
        for i, b in enumerate(part):
            c = b.counts.astype(np.float32)
            x[i, place[b.buckets]] = c / c.sum()
        return x

    # a bag of many texts has each n-gram about as often as the others of its language: steps are divided by a bucket's
    # mean share, or frequent n-grams alone would tell the languages apart and rare ones, which tell most, learn nothing
    share = sum(shares(fits[i : i + BATCH]).sum(0, dtype=np.float64) for i in range(0, len(fits), BATCH)) / len(fits)
    pace = 1 / (share + 1 / BUCKETS)
    pace = (pace / (pace @ share)).astype(np.float32)[:, None]
    for done in range(steps):
        if done % each == 0:
            order = rng.permutation(len(fits))
        part = [fits[j] for j in order[done % each * BATCH :][:BATCH]]
        x = shares(part)
        mean = x @ own
        wrong = softmax(mean @ linear + bias)
        wrong[np.arange(len(part)), [at[b.lang] for b in part]] -= 1
        rate = RATE * (1 - done / steps)
        back = wrong @ linear.T
        linear -= rate * mean.T @ wrong
        bias -= rate * wrong.mean(0)
        own -= rate * pace * (x.T @ back)
    table[seen] = own
    few = len(langs) <= DIM
    model = Model(langs, (table @ linear).astype(np.float32) if few else table, None if few else linear, bias, 1.0, 0.0)
    held = [b for b in bags if b.later] or bags
    z = np.concatenate([shares(held[i : i + BATCH]) @ own @ linear + bias for i in range(0, len(held), BATCH)]).astype(np.float64)
    loss = sum(losses(z[i : i + BATCH], np.array([at[b.lang] for b in held[i : i + BATCH]])).sum(0) for i in range(0, len(held), BATCH))
    return model._replace(temperature=float(TEMPERATURES[loss.argmin()]), usual=usualness(fits, langs))


def learned_parts(text: str, h: int) -> list[str]:
    """The whole text, and passages of it from a place that h decides."""
    at = [h % max(len(text) - size, 1) for size in PASSAGES]
    return [text, *(text[i : i + size] for i, size in zip(at, PASSAGES) if len(text) > size)]


def later(slot: int) -> bool:
    """Whether the documents of a bag calibrate."""
    return zlib.crc32(f"calibrate {slot}".encode()) < CALIBRATE * 2**32


def arrow(columns: list[list], kinds: tuple[pa.DataType, ...], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names.split())


def texts_of(b: pa.RecordBatch) -> Iterator[tuple[str, str, int, int]]:
    """Text, language, hash and slot of each row."""
    return zip(map(pa.StringScalar.as_py, b.column(0)), *(b.column(i).to_pylist() for i in (1, 2, 3)))


SUMS, SUMS_KINDS = "lang string, slot int, buckets binary, sums binary", (pa.string(), pa.int32(), pa.binary(), pa.binary())


def summed(rows: Iterator[tuple[str, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Sums by bucket, without the buckets that have none."""
    for lang, slot, sums in rows:
        at = np.flatnonzero(sums)
        yield arrow([[lang], [slot], [at.astype(np.uint16).tobytes()], [sums[at].tobytes()]], SUMS_KINDS, "lang slot buckets sums")


@tidied
def parts_summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by language, slot and run: for each run the sums of its texts' shares; for each language the
    numbers of n-grams, at slot -1 of documents that are learned and at -2 of those that calibrate."""

    def rows() -> Iterator[tuple[str, int, np.ndarray]]:
        lang, run, shares, counts = None, None, None, {}
        for b in batches:
            for (t, new, h, slot), r in zip(texts_of(b), b.column(4).to_pylist()):
                if (new, slot, r) != run:
                    if run is not None:
                        yield *run[:2], shares
                    run, shares = (new, slot, r), np.zeros(BUCKETS, np.int64)
                if new != lang:
                    yield from ((lang, k, c) for k, c in counts.items())
                    lang, counts = new, {}
                n = counts.setdefault(-2 if later(slot) else -1, np.zeros(BUCKETS, np.int64))
                for part in learned_parts(t, h):
                    at, c = bag(part)
                    n[at] += c.astype(np.int64)
                    shares[at] += np.rint(c / max(c.sum(dtype=np.float64), 1) * UNIT).astype(np.int64)
        if run is not None:
            yield *run[:2], shares
        yield from ((lang, k, c) for k, c in counts.items())

    return summed(rows())


@tidied
def bags_summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of parts that are sorted by language and slot: a bit for each bucket that has one, and those sums, of
    bags as shares of HALF in half precision."""

    def rows() -> Iterator[tuple[str, int, np.ndarray]]:
        key, sums = None, None
        for b in batches:
            for lang, slot, at, part in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (lang, slot) != key:
                    if key is not None:
                        yield *key, sums
                    key, sums = (lang, slot), np.zeros(BUCKETS, np.int64)
                sums[np.frombuffer(at, np.uint16)] += np.frombuffer(part, np.int64)
        if key is not None:
            yield *key, sums

    for lang, slot, sums in rows():
        x = sums[sums > 0]
        x = x.astype(np.float32) if slot < 0 else (x / x.sum(dtype=np.float64) * HALF).astype(np.float16)
        yield arrow([[lang], [slot], [np.packbits(sums > 0).tobytes()], [x.tobytes()]], SUMS_KINDS, "lang slot buckets sums")


def train(rows: DataFrame, key: str, text: str, lang: str) -> Model:
    """Fits on all labelled rows. A hash of key and text deals each language's rows into an equal number of bags, SAMPLE
    in all (or one of each language, if that is more); a bag has the mean shares of its texts' n-grams, and the descent
    goes through the bags. Only these come to the driver, 70 kB each at most, however many rows there are and whatever
    their size, and no language's rows meet in one task. The rows of a part of the bags stay out of the fit: all of
    them give the temperature and the limits of what is accepted, each language weighing the same. Equal rows count
    once, and rows that share a key or have none count like any. Null texts and languages don't count."""
    spark = rows.sparkSession
    named = rows.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"), F.col(key).cast("string").alias("k"))
    named = named.where("t is not null and l is not null")
    counts = {r.l: r["count"] for r in named.groupBy("l").count().collect()}  # one row for each language
    quota = max(SAMPLE // max(len(counts), 1), 1)
    runs = spark.createDataFrame([(x, -(-n // (quota * RUN))) for x, n in counts.items()], "l string, runs long")
    hashed = named.select("t", "l", F.xxhash64("k", "t").alias("h")).withColumn("slot", F.expr(f"int(pmod(h, {quota}))"))
    dealt = hashed.join(F.broadcast(runs), "l").selectExpr("t", "l", "h", "slot", f"pmod(shiftrightunsigned(h, 1) div {quota}, runs) r")
    order = ("l", "slot", "r")
    parts = dealt.repartition(*order).dropDuplicates([*order, "h"]).sortWithinPartitions(*order).mapInArrow(parts_summed, SUMS)
    got = parts.repartition("lang", "slot").sortWithinPartitions("lang", "slot").mapInArrow(bags_summed, SUMS).toArrow()
    sums = []
    for x, slot, at, n in zip(*(got.column(i).to_pylist() for i in (0, 1)), *(got.column(i) for i in (2, 3))):
        places = np.flatnonzero(np.unpackbits(np.frombuffer(at.as_buffer(), np.uint8))).astype(np.uint16)
        sums.append((x, slot, places, np.frombuffer(n.as_buffer(), np.float32 if slot < 0 else np.float16)))  # a view
    sums.sort(key=lambda s: s[:2])
    fitted = {x for x, slot, _, _ in sums if slot == -1}  # a language of which all rows calibrate is learned by them, too
    bags = [Bag(at, n, x, later(slot) and x in fitted) for x, slot, at, n in sums if slot >= 0]
    model = fit(bags)
    if not model.langs:
        return model
    learned = [Bag(at, n, x, False) for x, slot, at, n in sums if slot == (-1 if x in fitted else -2)]
    model = model._replace(usual=usualness(learned, model.langs))
    held = [slot for slot in range(quota) if later(slot)] if any(later(slot) for _, slot, _, _ in sums if slot >= 0) else None
    judged = judgements(model, hashed if held is None else hashed.where(F.col("slot").isin(held)))
    model = limited(cooled(model, judged), judged)
    discard(spark, judged)
    return model


def judgements(model: Model, calibrating: DataFrame) -> DataFrame:
    """The logits of all rows, of their passages (`learned`) and of their heads, written down: one row for each of these
    texts. Right ones of the whole texts and heads have the place of their length as `at`, others -1. Texts aren't
    shuffled: equal rows have equal judgements, and these count once."""
    known = calibrating.sparkSession.sparkContext.broadcast(tuple(model))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*known.value)
        place = {lang: i for i, lang in enumerate(model.langs)}
        for b in batches:
            out = []
            for t, lang, h, _ in texts_of(b):
                passages = learned_parts(t, h)[1:]
                for i, part in enumerate((t, *passages, *heads(t))):
                    if (found := measured(model, part)) is not None:
                        z, usual, n = found
                        judged = (i == 0 or i > len(passages)) and int(z.argmax()) == place[lang]
                        at, learned = length(n) if judged else -1, i <= len(passages)
                        if learned or at >= 0:
                            out.append((lang, h, i, place[lang], learned, at, usual, z.tobytes()))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.float64(), pa.binary())
            yield arrow([*zip(*out)] or [[]] * len(kinds), kinds, "l h i y learned at usual z")

    rows = calibrating.mapInArrow(run, "l string, h long, i int, y int, learned boolean, at int, usual double, z binary")
    made = stored(rows.dropDuplicates(["l", "h", "i"]).drop("l", "h", "i"), "langid-judged")
    known.destroy()
    return made


def logits(b: pa.RecordBatch) -> np.ndarray:
    """Column z of rows of judgements()."""
    return np.frombuffer(b"".join(b.column("z").to_pylist()), np.float64).reshape(b.num_rows, -1)


def cooled(model: Model, judged: DataFrame) -> Model:
    """The model with the temperature at which all rows and their passages have the least loss, languages weighing the
    same. One row for each language and temperature comes to the driver."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = {}, Counter()
        for b in batches:
            if b.num_rows:
                y, z = b.column("y").to_numpy(), logits(b)
                for k in np.unique(y).tolist():
                    loss = losses(z[y == k], y[y == k])
                    sums[k] = sums.get(k, 0) + np.rint(loss * 2**20).astype(np.int64).sum(0)
                    n[k] += len(loss)
        for k, loss in sums.items():
            yield arrow([[k] * len(loss), range(len(loss)), loss.tolist(), [n[k]] * len(loss)], (pa.int32(), pa.int32(), pa.int64(), pa.int64()), "y i loss n")

    total = judged.where("learned").mapInArrow(run, "y int, i int, loss long, n long").groupBy("y", "i").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).collect()
    mean = np.zeros(len(TEMPERATURES))
    for r in sorted(total):
        mean[r.i] += r.loss / r.n
    return model._replace(temperature=float(TEMPERATURES[mean.argmin()])) if total else model


def limited(model: Model, judged: DataFrame) -> Model:
    """The model with its limits, by all right judgements, languages weighing the same at each length. Numbers of these
    come to the driver, for each language, length and step of GRAIN."""
    temperature = model.temperature

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = Counter()
            if b.num_rows:
                odds = [log_odds(p) for p in softmax(logits(b) / temperature).max(1)]
                for kind, found in enumerate((odds, b.column("usual").to_pylist())):
                    n.update((y, at, kind, int(np.floor(m / GRAIN))) for y, at, m in zip(b.column("y").to_pylist(), b.column("at").to_pylist(), found))
            yield arrow([*zip(*n), n.values()] if n else [[]] * 5, (*[pa.int32()] * 4, pa.int64()), "y at kind m n")

    found = judged.where("at >= 0").mapInArrow(run, "y int, at int, kind int, m int, n long").groupBy("y", "at", "kind", "m").agg(F.sum("n").alias("n")).collect()
    every = Counter()
    for r in found:
        every[r.y, r.at, r.kind] += r.n
    odds, usual = (least_right([(r.at, r.m * GRAIN, r.n / every[r.y, r.at, r.kind]) for r in sorted(found) if r.kind == kind]) for kind in (0, 1))
    return model._replace(threshold=odds, least=usual)


def identify(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Adds the predicted language, its probability and whether it is rejected, by the whole text alone. No shuffle;
    the model is broadcast: a row of DIM numbers at most for each bucket, and one for each language. A frame that has
    columns of these names is refused. Nulls and empty texts are undetermined; repeated rows are judged each."""
    refuse_clash(df.columns, list(names))
    known = df.sparkSession.sparkContext.broadcast(tuple(model))
    at = df.columns.index(text)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*known.value)
        for b in batches:
            got = [predict(model, t) for t in map(pa.StringScalar.as_py, b.column(at))]
            new = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    made = [T.StructField(n, kind) for n, kind in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *made]))


def held_out() -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text, modulo 4, is 2; false for null ids."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_model(docs: DataFrame) -> Model:
    return train(docs.where(~held_out()), "doc_id", "text", "lang")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by a model of the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, document_model(docs)).drop("text")


def known_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is determined and not rejected, with the columns they had."""
    names = [f"_doc{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    plain = docs.select(*(F.col(c).cast("string").alias(n) if i == at else F.col(c).alias(n) for i, (c, n) in enumerate(zip(docs.columns, names))))
    done = identify(plain, document_model(docs), names[at])
    return done.where("not rejected").select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))
