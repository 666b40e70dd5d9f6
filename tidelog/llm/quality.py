"""Quality rules: counts of words, symbols and repetition, and n-gram perplexity.

Spark counts the n-grams of five bytes (A-Z lower-cased, nothing else folded) of
all texts.  Continuation counts, discounts and the weights of contexts of a
modified Kneser-Ney model are aggregations over these counts, so the model grows
with what the corpus holds: a table of packed keys (an n-gram of five bytes is
its own 40-bit hash) with their bits.  Tasks hold the part of it that most text
is made of, as a sorted array: n-grams of at least one HOT_NGRAMS-th of the
corpus, of which there are at most HOT_NGRAMS.  What a document holds of all
others is joined with the table.  No text is shuffled.

A document's bits (mean of -log2 p over its n-grams) are compared with a lower
and an upper band of its language: the median, less and plus some deviations.
The deviation of a language is drawn to that of all documents as if ``PRIOR``
more documents had it, so rare languages get a band too.

Null text: no words, so the base rules reject it.  Texts under five bytes have
no perplexity and are left to the base rules.  A null language is a group of
its own.  Repeated rows count as often as they occur; equal texts get equal
bits.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.shared import delete_table, hot_join, materialize
from tidelog.llm.text_arrays import Texts, by_batch, char_starts, is_space, slices

ORDER = 5
#: N-grams that tasks may hold (16 bytes each), and those counted before sending.
HOT_NGRAMS, HELD_NGRAMS = 1 << 21, 1 << 20
#: Documents that the deviation of all languages counts as.
PRIOR = 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def ngram_keys(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Packed keys of all n-grams and, for each row, the borders between them."""
    lower = texts.lowered().astype(np.int64)
    n = max(0, len(lower) - ORDER + 1)
    keys = np.zeros(n, np.int64)
    for k in range(ORDER):
        keys = (keys << 8) | lower[k : k + n]
    keep = np.ones(n, bool)
    for end in texts.offsets[1:].tolist():
        keep[max(0, end - ORDER + 1) : end] = False
    total = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    return keys[keep], total[np.minimum(texts.offsets, n)]


def text_counts(texts: Texts) -> dict[str, np.ndarray]:
    """The base counts of each row."""
    data = texts.data
    starts, ends = texts.words()
    borders = texts.of_rows(starts)
    n_words = np.diff(borders)
    inside = ~is_space(data)
    hashes = texts.hasher()
    row = np.repeat(np.arange(len(texts)), n_words).astype(np.uint64)
    # words in three-word windows that occur twice or more
    word = hashes(starts, ends)
    n = max(0, len(word) - 2)
    window = word[:n] * np.uint64(3) + word[1 : n + 1] * np.uint64(0x9E3779B97F4A7C15) + word[2 : n + 2] * np.uint64(0xC2B2AE3D27D4EB4F)
    whole = row[:n] == row[2 : n + 2]
    twice = np.zeros(n, bool)
    twice[whole] = pd.Series(window[whole] ^ (row[:n][whole] * np.uint64(0xD6E8FEB86659FD93))).duplicated(keep=False).to_numpy()
    repeated = np.zeros(len(word), bool)
    for k in range(3):
        repeated[k : n + k] |= twice
    counted = np.concatenate([[0], np.cumsum(repeated)])[borders]
    # lines with a word
    a, b = texts.lines()
    filled = np.concatenate([[0], np.cumsum(inside)])
    some = filled[b] > filled[a]
    a, b = a[some], b[some]
    line_row = np.repeat(np.arange(len(texts)), np.diff(texts.of_rows(a)))
    again = pd.Series(hashes(a, b) ^ (line_row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))).duplicated().to_numpy(bool)
    return {
        "n_words": n_words,
        "word_chars": texts.per_row(inside & char_starts(data)),
        "n_symbols": texts.per_row(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_row[again], minlength=len(texts)),
        "n_repeat_words": np.diff(counted),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
def _merged(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their times."""
    every, n = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *times])
    unique, place = np.unique(every, return_inverse=True)
    return unique, np.bincount(place, n, len(unique)).astype(np.int64)


def count_ngrams(texts: DataFrame) -> DataFrame:
    """(key, n): counts over every whole text (text); a task sends sums."""

    def run(batches):
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def sent():
            unique, n = _merged(keys, times)
            keys.clear()
            times.clear()
            for i in range(0, len(unique), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(unique[i : i + 65536]), pa.array(n[i : i + 65536])], names=["key", "n"])

        for batch in batches:
            for part in slices(batch.column(0)):
                unique, n = np.unique(ngram_keys(part)[0], return_counts=True)
                keys.append(unique)
                times.append(n)
                if len(keys) == 8:
                    keys[:], times[:] = ([x] for x in _merged(keys, times))
                    if len(keys[0]) > HELD_NGRAMS:
                        yield from sent()
        yield from sent()

    return texts.mapInArrow(by_batch(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _discounts(counted: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more."""
    n = counted.agg(*[F.greatest(F.lit(1), F.count_if(F.col("n") == k)) for k in range(1, 5)]).first()
    y = n[0] / (n[0] + 2 * n[1])
    return [min(k, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]


def kneser_ney(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, p) for every n-gram of ``counted`` (key, n; keys of ``order`` bytes).

    A context has at most 256 next bytes and an n-gram at most 256 bytes before
    it, so no group or join key is larger than that, whatever the corpus.
    """
    levels = [counted]
    for level in range(order - 1, 0, -1):  # lower orders count the distinct bytes before them
        shorter = levels[-1].groupBy(F.col("key").bitwiseAND((1 << 8 * level) - 1).alias("key")).agg(F.count("*").alias("n"))
        levels.append(materialize(shorter, "ngrams"))
    lower, done = None, []
    for level, table in zip(range(1, order + 1), reversed(levels), strict=True):
        one, two, more = _discounts(table)
        cut = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
        context = Window.partitionBy(F.shiftright("key", 8))
        mass, spare = F.sum("n").over(context), F.sum("cut").over(context)
        own = table.withColumn("cut", cut).withColumn("mass", mass).withColumn("spare", spare / mass)
        own = own.select("key", ((F.col("n") - F.col("cut")) / F.col("mass")).alias("seen"), "spare")
        if lower is None:
            lower = own.select("key", (F.col("seen") + F.col("spare") / 256).alias("p"))
        else:
            own = own.withColumn("suffix", F.col("key").bitwiseAND((1 << 8 * (level - 1)) - 1))
            lower = own.join(lower.withColumnsRenamed({"key": "suffix", "p": "less"}), "suffix").select("key", (F.col("seen") + F.col("spare") * F.col("less")).alias("p"))
        done.append(materialize(lower, "model"))
        lower = done[-1]
    for table in (*levels[1:], *done[:-1]):
        delete_table(table)
    return lower


def measure(docs: DataFrame, keep: list[str], lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(rid, text, lang, row, base counts, bits) of every document: ``row`` holds
    the columns of ``keep`` but the text's, bits the mean of -log2 p over the
    text's n-grams, null without any.  The text is null unless it is in ``keep``."""
    counted = materialize(count_ngrams(docs.select(text_col)), "ngrams")
    total = counted.agg(F.sum("n")).first()[0] or 0
    model = kneser_ney(counted).withColumn("bits", -F.log2("p"))
    model = materialize(model.join(counted, "key").select("key", "bits", (F.col("n") * HOT_NGRAMS >= total).alias("hot")), "bits")
    hot = model.filter("hot").select("key", "bits").orderBy("key").toArrow()  # at most HOT_NGRAMS rows
    shared = docs.sparkSession.sparkContext.broadcast((hot.column("key").to_numpy(), hot.column("bits").to_numpy()))
    with_text = text_col in keep
    row = F.struct(*[F.col(c) for c in keep if c != text_col] or [F.lit(0).alias("none")])
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), row.alias("row"))
    numbers = (*((c, pa.int64()) for c in COUNTS), ("ngrams", pa.int64()), ("known", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())))

    def score(batches):
        keys, bits = shared.value
        for batch in batches:
            for texts in slices(batch.column(0)):
                own, borders = ngram_keys(texts)
                unique, place = np.unique(own, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, unique), max(0, len(keys) - 1))
                found = keys[at] == unique if len(keys) else np.zeros(len(unique), bool)
                value = np.where(found, bits[at], 0.0) if len(keys) else np.zeros(len(unique))
                total = np.concatenate([[0.0], np.cumsum(value[place])])
                of_row = np.repeat(np.arange(len(texts)), np.diff(borders))
                rare = ~found[place]
                pairs, times = np.unique((of_row[rare].astype(np.int64) << 40) | own[rare], return_counts=True)
                cuts = pa.array(np.searchsorted(pairs, np.arange(len(texts) + 1, dtype=np.int64) << 40).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int64())) for x in (pairs & ((1 << 40) - 1), times)]
                counts = text_counts(texts)
                arrays = [c.slice(texts.first, len(texts)) for c in batch.columns]
                arrays += [pa.array(counts[c], pa.int64()) for c in COUNTS] + [pa.array(np.diff(borders), pa.int64()), pa.array(total[borders[1:]] - total[borders[:-1]]), *lists]
                if not with_text:
                    arrays[0] = pa.nulls(len(texts), arrays[0].type)
                yield pa.RecordBatch.from_arrays(arrays, names=["text", "lang", "row", *(n for n, _ in numbers)])

    fields = [*rows.schema.fields, *(T.StructField(n, T.LongType() if t == pa.int64() else T.DoubleType() if t == pa.float64() else T.ArrayType(T.LongType())) for n, t in numbers)]
    partly = materialize(rows.mapInArrow(by_batch(score), T.StructType(fields)).withColumn("rid", F.monotonically_increasing_id()), "measured")
    rare = partly.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("rid", F.col("r.rare").alias("key"), F.col("r.times").alias("times"))
    rest = rare.join(model.filter(~F.col("hot")).select("key", "bits"), "key").groupBy("rid").agg(F.sum(F.col("times") * F.col("bits")).alias("more"))
    bits = F.round(F.try_divide(F.col("known") + F.coalesce("more", F.lit(0.0)), F.col("ngrams")), 13)
    # sums first, from narrow rows; then rows of any width meet them once
    scores = materialize(partly.select("rid", "known", "ngrams").join(rest, "rid", "left").select("rid", bits.alias("bits")), "scores")
    delete_table(counted)
    delete_table(model)
    return partly.drop("known", "ngrams", "rare", "times").join(scores, "rid")


def language_bands(measured: DataFrame, width: float = 5.0, least_spread: float = 0.04) -> DataFrame:
    """(band, docs, low, high): bounds of bits for each language (``band``): its
    median less and plus ``width`` deviations."""
    whole = measured.agg(F.percentile_approx("bits", 0.5, 10000).alias("middle")).first()["middle"]
    middle = materialize(measured.groupBy("band").agg(F.coalesce(F.percentile_approx("bits", 0.5, 10000), F.lit(whole)).alias("middle"), F.count("*").alias("docs")), "middle")
    near = hot_join(measured.select("band", "bits"), middle.withColumn("rows", F.col("docs")), "band", "rows").select("band", "middle", "docs", F.abs(F.col("bits") - F.col("middle")).alias("off"))
    near = materialize(near, "off")
    every = near.agg(F.percentile_approx("off", 0.5, 10000).alias("off")).first()["off"] or 0.0
    spread = near.groupBy("band").agg(F.first("middle").alias("middle"), F.first("docs").alias("docs"), F.coalesce(F.percentile_approx("off", 0.5, 10000), F.lit(0.0)).alias("off"))
    drawn = (F.col("off") * F.col("docs") + every * PRIOR) / (F.col("docs") + PRIOR)
    reach = F.greatest(F.lit(least_spread), drawn * 1.4826) * width
    return spread.select("band", "docs", (F.col("middle") - reach).alias("low"), (F.col("middle") + reach).alias("high"))


def judge(docs: DataFrame, keep: list[str], lang_col: str = "lang", text_col: str = "text", least_words: int = 50, most_repeated: float = 0.5, width: float = 5.0) -> DataFrame:
    """(*keep, base counts, bits, perplexity, low, high, base_failed, kept).

    ``keep`` may hold any columns of ``docs``, the text too, under any names but
    those of the other results.  Bands come from the documents that the base
    rules pass; where there are none, nothing is rejected by perplexity.
    """
    band: Column = F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("lang").cast("string")))
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    measured = measure(docs, keep, lang_col, text_col).withColumn("band", band).withColumn("base_failed", failed)
    good = materialize(measured.filter(~failed & F.col("bits").isNotNull()).select("band", "bits"), "good")
    bands = language_bands(good, width)
    out = hot_join(measured, bands, "band", "docs", "left")
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(True))
    columns = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in keep]
    return out.select(*columns, *COUNTS, "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), "low", "high", "base_failed", (~F.col("base_failed") & inside).alias("kept"))
