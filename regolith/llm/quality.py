"""Quality rules over words, symbols and repetition, and n-gram perplexity bands for each language.

The language model is that of ngrams: modified Kneser-Ney over character n-grams of order 5, counted by Spark over all
documents and kept as sorted hash arrays. A document is judged by the half of its language's documents that it is not
in. The bands are quantiles of the documents' log perplexities in their language, fitted to each side on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regolith.llm import ngrams
from regolith.llm.common import mixed, stored, table, tidied

#: A band reaches, on either side, REACH times as far from the median as the quantile TAIL: 4.1 deviations, where
#: documents scatter normally. The deviation of a text of n symbols counts sqrt(n / (n + SHORT)) times, since the mean
#: surprise of a short text scatters more.
TAIL, REACH, SHORT = 0.05, 2.5, 1000


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a window of so many words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    w = mixed(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
    h = np.zeros(n, np.uint64)
    for i in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(h, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def features(text: bytes, words: list[bytes], joined: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    return len(words), len(joined) - max(len(words) - 1, 0), symbols, len(lines) - len(set(lines)), repeated_words(words)


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scored(df: DataFrame, text: str, lang: str, carry: list[str], models: DataFrame, block: int = ngrams.BLOCK) -> DataFrame:
    """The columns `carry` (as _carry0, ...), the features, _lang, symbols and log_perplexity (per symbol; null without
    words). The models are broadcast in passes of at most `block` entries; a text is read in the pass of its key, and
    again for each further pass of a language whose model is larger than that."""
    t, g = F.col(text).cast("string"), F.col(lang).cast("string")
    source = df.select(*(F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)), g.alias("_lang"), t.alias("_text"), ngrams.model_key(t, g, True).alias("_key"))
    found = ngrams.passes(models, block)
    first, later = [p for p in found if not p.later], [p for p in found if p.later]
    kept = len(carry) + 1
    fields = [pa.field(f, pa.int64()) for f in FEATURES] + [pa.field("symbols", pa.int64()), pa.field("_sum", pa.float64())]
    made = [T.StructField(x.name, T.DoubleType() if x.type == pa.float64() else T.LongType()) for x in fields]
    digest = F.sha2(F.coalesce("_text", F.lit("")), 256)

    def of_pass(one: ngrams.Pass, rows: DataFrame) -> DataFrame:
        model = df.sparkSession.sparkContext.broadcast((ngrams.loaded(models, one), one.keys))  # at most `block` entries
        width = len(rows.columns) - 2

        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, spans = model.value
            for b in batches:
                counts, texts = [], []
                for t, key in zip(map(pa.StringScalar.as_py, b.column(width)), b.column(width + 1).to_pylist()):
                    raw = (t or "").encode()
                    words = raw.split()
                    line = b" ".join(words).decode()
                    counts.append(features(raw, words, line))
                    texts.append((key, line))
                sums = ngrams.log_likelihoods(texts, known, spans)
                rows = [(*c, n, x) for c, (x, n) in zip(counts, sums)]
                new = [pa.array(c, f.type) for c, f in zip(zip(*rows), fields)] if rows else [pa.array([], f.type) for f in fields]
                yield pa.RecordBatch.from_arrays([*b.columns[:width], *new], [*b.schema.names[:width], *(f.name for f in fields)])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:width], *made]))

    rows = source if not later else source.select(*source.columns[:kept], digest.alias("_digest"), "_text", "_key")
    out = None
    elsewhere = [k for p in first[1:] for k in p.keys]
    for i, p in enumerate(first):
        mine = rows if len(first) == 1 else rows.where(F.col("_key").isin(list(p.keys)) if i else ~F.col("_key").isin(elsewhere))
        done = of_pass(p, mine)
        out = done if out is None else out.unionAll(done)
    if later:
        more = None
        for i, p in enumerate(later):
            again = source.where(F.col("_key").isin(list(p.keys))).select("_lang", digest.alias("_digest"), F.lit(i).alias("_pass"), "_text", "_key")
            again = of_pass(p, again).select("_lang", "_digest", "_pass", "_sum").dropDuplicates(["_lang", "_digest", "_pass"])
            more = again if more is None else more.unionAll(again)
        more = more.groupBy(F.col("_lang").alias("_l"), F.col("_digest").alias("_d")).agg(F.sum("_sum").alias("_more"))
        out = out.join(more, F.col("_lang").eqNullSafe(F.col("_l")) & (F.col("_digest") == F.col("_d")), "left").withColumn("_sum", F.col("_sum") + F.coalesce("_more", F.lit(0.0)))
    mean = F.when(F.col("symbols") > 0, -F.col("_sum") / F.col("symbols"))
    return out.select(*(f"_carry{i}" for i in range(len(carry))), "_lang", *FEATURES, "symbols", mean.alias("log_perplexity"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def bands(done: DataFrame) -> DataFrame:
    """_lang, _middle, _down and _up: the median log perplexity of each language, and how far a long text may lie from
    it. Rows that fail the base rules don't count, and equal values of equally long texts count once, so that copies
    don't narrow a band. With fewer than 20 values all of them are inside."""
    rows = done.where(~base_failed()).groupBy("_lang", "symbols", "log_perplexity").agg(F.count("*").alias("_n"))
    middle = rows.groupBy("_lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("_middle"))
    middle = middle.withColumnRenamed("_lang", "_l")
    apart = rows.join(middle, F.col("_lang").eqNullSafe(F.col("_l"))).select("_lang", "_middle", (scale() * (F.col("log_perplexity") - F.col("_middle"))).alias("_d"))
    ends = apart.groupBy("_lang", "_middle").agg(F.percentile_approx("_d", [TAIL, 1 - TAIL], 10000).alias("p"), F.min("_d").alias("a"), F.max("_d").alias("b"), F.count("*").alias("c"))
    few = F.col("c") < 20
    return ends.select(
        F.col("_lang").alias("_l"),
        "_middle",
        F.when(few, F.col("a")).otherwise(REACH * F.least(F.col("p")[0], F.lit(0.0))).alias("_down"),
        F.when(few, F.col("b")).otherwise(REACH * F.greatest(F.col("p")[1], F.lit(0.0))).alias("_up"),
    )


def scale() -> Column:
    return F.sqrt(F.col("symbols") / (F.col("symbols") + SHORT))


def quality(df: DataFrame, carry: list[str], text: str = "text", lang: str = "lang", block: int = ngrams.BLOCK) -> DataFrame:
    """Columns `carry` of every row, with the rules' counts, log_perplexity, the row's band, base_failed and kept.

    Rows without words have no perplexity and fail the base rules. Null texts count as empty, null languages as one
    language of their own. Repeated rows are judged like any.

    Texts are read twice: to count, and to score (once more for each further pass over a language whose model has more
    than `block` entries); the scores are written once and the bands are sketches over them."""
    models = ngrams.language_models(df, text, lang)
    done = stored(scored(df, text, lang, carry, models, block), "quality-scores").withColumn("base_failed", base_failed())
    done = done.join(bands(done), F.col("_lang").eqNullSafe(F.col("_l")), "left")  # one row for each language
    # the edges themselves are inside, whatever the rounding
    low, high = (F.col("_middle") + F.try_divide(F.col(end) + more, scale()) for end, more in (("_down", -1e-9), ("_up", 1e-9)))
    done = done.withColumn("band_low", low).withColumn("band_high", high)
    inside = F.coalesce(F.col("log_perplexity").between(F.col("band_low"), F.col("band_high")), F.lit(False))
    return done.select(
        *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)), *FEATURES, "log_perplexity", "band_low", "band_high", "base_failed", (~F.col("base_failed") & inside).alias("kept")
    )


def op10_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules and the verdict on every document."""
    return quality(table(spark, sf_dir, "documents"), ["doc_id"])


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they had."""
    names = [f"_doc{i}" for i in range(len(docs.columns))]
    done = quality(docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names))), names, names[docs.columns.index("text")], names[docs.columns.index("lang")])
    return done.where("kept").select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))
