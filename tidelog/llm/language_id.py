"""Language identification by cross-parsing against labelled text.

For every language a suffix automaton is built over a bounded sample of its
labelled texts.  A text is parsed greedily into the longest phrases that occur
in that sample; the language whose sample needs the fewest phrases, normalised
by the sample's length (phrases times log2 of its symbols, per symbol: the
cross-parsing entropy), is predicted.  Parsing starts anew every
``BLOCK`` symbols, so that all blocks of all texts advance together through
array look-ups and a long text never holds up a task.

Text is folded to lower-case letters, UTF-8 bytes and one blank for each run of
anything else.  ``und`` with score 0 where the text is null or has no letter
(Unicode categories L*), or where nothing was learned.  Of equal entropies the
smallest language name wins.  Null or unlabelled training rows are not used.
Repeated training rows count once for an id; repeated rows are predicted alike.
An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.text_arrays import Texts, by_batch, slices

BLOCK = 1024
_FOLD = np.full(256, 26, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        _FOLD[_b] = ord(chr(_b).lower()) - 97
    elif _b >= 0x80:
        _FOLD[_b] = _b - 101  # 27..154
BLANK = 26


def fold(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows, runs of blanks as one, and the rows' borders."""
    symbols = _FOLD[texts.data]
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != BLANK) | (symbols[:-1] != BLANK)
    total = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    return symbols[keep], total[texts.offsets]


class Automaton:
    """Suffix automaton of a symbol string as a dense transition table."""

    def __init__(self, symbols: np.ndarray):
        next_: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols.tolist():
            cur = len(next_)
            next_.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in next_[p]:
                next_[p][c] = cur
                p = link[p]
            if p >= 0:
                q = next_[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(next_)
                    next_.append(dict(next_[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and next_[p].get(c) == q:
                        next_[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.codes = np.zeros(256, np.int32)  # 0: not in the sample
        used = np.unique(symbols)
        self.codes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        table = np.full((len(next_) + 1, self.width), -1, np.int32)  # the last row: no phrase is open
        self.closed = len(next_) * self.width
        for state, arcs in enumerate(next_):
            for c, to in arcs.items():
                table[state, self.codes[c]] = to
        # A state is kept as the place of its row, so that a step is one look-up.
        self.table = np.where(table >= 0, table * self.width, -1).ravel().astype(np.int32)
        self.size = len(symbols)


def phrases(automaton: Automaton, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of each block; ``lengths`` must not rise."""
    codes, table = automaton.codes[symbols], automaton.table
    state = np.full(len(starts), automaton.closed, np.int32)
    count = np.zeros(len(starts), np.int64)
    active = len(starts)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        while active and lengths[active - 1] <= step:
            active -= 1
        code = codes[starts[:active] + step]
        to = table[state[:active] + code]
        ended = np.flatnonzero(to < 0)
        if len(ended):
            count[ended] += 1
            fresh = table[code[ended]]
            to[ended] = np.where(fresh < 0, automaton.closed, fresh)  # a symbol that was never seen is a phrase by itself
        state[:active] = to
    return count


class _Blocks:
    """The folded rows of a slice, cut into blocks, longest first."""

    def __init__(self, texts: Texts):
        self.symbols, borders = fold(texts)
        letters = np.concatenate([[0], np.cumsum(self.symbols != BLANK)])
        self.lettered = letters[borders[1:]] > letters[borders[:-1]]
        # bytes over 127 may be letters or not: only then ask Unicode
        plain = texts.per_row(np.isin(texts.data, _ASCII_LETTERS))
        for i in np.flatnonzero(self.lettered & (plain == 0)).tolist():
            self.lettered[i] = _LETTER.search(texts.text(i)) is not None
        blocks = -(-np.diff(borders) // BLOCK)
        row = np.repeat(np.arange(len(texts)), blocks)
        first = np.cumsum(blocks) - blocks
        starts = borders[:-1][row] + (np.arange(len(row)) - first[row]) * BLOCK
        lengths = np.minimum(borders[1:][row] - starts, BLOCK)
        order = np.argsort(-lengths, kind="stable")
        self.row, self.starts, self.lengths = row[order], starts[order], lengths[order]
        self.n = np.maximum(1, np.diff(borders))

    def entropy(self, automaton: Automaton) -> np.ndarray:
        """Normalised phrases per symbol of each row."""
        count = phrases(automaton, self.symbols, self.starts, self.lengths)
        return np.bincount(self.row, count, minlength=len(self.n)) * np.log2(automaton.size + 2) / self.n


_ASCII_LETTERS = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)
_LETTER = regex.compile(r"\p{L}")
#: Automata that a worker holds at a time; with more languages they take turns.
AUTOMATA_HELD = 8
_built: dict[tuple[str, str], Automaton] = {}


def _automaton(name: str, lang: str, text: bytes) -> Automaton:
    for key in [k for k in _built if k[0] != name]:
        del _built[key]
    if (name, lang) not in _built:
        while len(_built) >= AUTOMATA_HELD:
            del _built[next(iter(_built))]
        _built[name, lang] = automaton_of(text)
    return _built[name, lang]


def sample_texts(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", docs_per_language: int = 64, bytes_per_language: int = 49152) -> dict[str, bytes]:
    """Whole texts of each language: of at most ``docs_per_language`` rows, in the
    order of a hash of the id, those that fit into ``bytes_per_language`` bytes
    one after the other; the shortest text where none fits.  The two parameters
    bound what the automata are made from."""
    usable = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("language"), id_col).alias("pick"))
    usable = usable.filter("lang is not null and text is not null").withColumn("bytes", F.octet_length("text"))
    # a language of any size is ranked part by part, then among the parts' first rows
    parts = usable.filter(F.col("bytes") <= bytes_per_language).groupBy("lang", "pick").agg(F.min("bytes").alias("bytes")).withColumn("part", F.pmod("pick", F.lit(64)))
    for keys in (["lang", "part"], ["lang"]):
        parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("pick"))).filter(F.col("rank") <= docs_per_language)
    least = usable.groupBy("lang").agg(F.min_by(F.struct("pick", "bytes"), F.struct("bytes", "pick")).alias("least")).filter(F.col("least.bytes") > bytes_per_language)
    chosen = parts.select("lang", "pick").unionByName(least.select("lang", "least.pick"))
    texts = usable.join(F.broadcast(chosen), ["lang", "pick"]).groupBy("lang", "pick").agg(F.min_by("text", F.struct("bytes", "text")).alias("text"))
    out: dict[str, bytes] = {}
    for r in texts.orderBy("lang", "pick").collect():  # languages x docs_per_language rows
        have, more = out.get(r["lang"], b""), r["text"].encode() + b" "
        if not have or len(have) + len(more) <= bytes_per_language + docs_per_language:
            out[r["lang"]] = have + more
    return {k: v for k, v in sorted(out.items()) if v.strip()}


def automaton_of(text: bytes) -> Automaton:
    return Automaton(fold(Texts(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0))[0])


def predict(docs: DataFrame, sample: dict[str, bytes], keep: list[str], text_col: str = "text") -> DataFrame:
    """(*keep, lang_pred, score); score is 1 less the ratio of the best to the
    second best entropy, raised into 0..1 (1 with a single language)."""
    shared = docs.sparkSession.sparkContext.broadcast(sample)
    name = uuid.uuid4().hex
    chosen = docs.select(F.col(text_col).alias("text"), *keep)
    langs = np.array([*sample, "und"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_Blocks(texts) for texts in slices(batch.column(0), 4 << 20)]
            lettered = np.concatenate([np.zeros(0, bool), *[r.lettered for r in rows]])
            best, second = np.full(len(lettered), np.inf), np.full(len(lettered), np.inf)
            at = np.full(len(lettered), len(langs) - 1)
            for k, (lang, text) in enumerate(shared.value.items()):
                automaton = _automaton(name, lang, text)
                entropy = np.concatenate([np.zeros(0), *[r.entropy(automaton) for r in rows]])
                better = entropy < best
                second = np.where(better, best, np.minimum(second, entropy))
                at, best = np.where(better, k, at), np.minimum(best, entropy)
            sure = np.where(np.isfinite(second), 1 - best / np.where(np.isfinite(second), np.maximum(second, 1e-9), 1.0), 1.0)
            found = lettered & np.isfinite(best)
            at, score = np.where(found, at, len(langs) - 1), np.where(found, np.clip(np.nan_to_num(sure), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs[at].tolist(), pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    fields = [*chosen.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return chosen.mapInArrow(by_batch(run), T.StructType(fields))
