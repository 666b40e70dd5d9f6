"""Fill-in-the-middle: texts cut into prefix, middle and suffix, put in another order.

A text's units are its runs of ASCII letters and its other characters, one by
one.  Both cuts fall between units, at ranks that hashes of the row's key give.
Ranks are found from sparse events: one Aho-Corasick automaton reports where a
character changes the class (letter or other) and where a sentinel ends.
Between two events lies either one letter run, which is one unit, or other
characters only, each of which is one; so the units before an event are sums
over the gaps, and a rank is looked up among the events.

A text is left ``plain`` if it is empty, if it holds a sentinel, or if its hash
says so; otherwise it becomes ``psm`` (prefix, suffix, middle) or ``spm``
(suffix, prefix, middle), a sentinel before each part.  :func:`restored` undoes
this by DataFrame functions.

Null texts are empty texts; a null key counts as an empty one.  Rows are taken
one by one: repeated rows give equal results, an empty table an empty one.  A
long text needs its bytes, its output and eight bytes an event.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.text_arrays import by_batch, slices

SENTINELS = ("<P>", "<S>", "<M>")
#: Per cent of texts left plain, and of the others that become spm.
PLAIN, SPM = 10, 20
SEED = 1
_BEGIN, _END, _SENTINEL = 0, 1, 2


class EventScanner:
    """The automaton over symbols: each ASCII letter outside the sentinels reads
    as ``a``, other ASCII as a blank, a character beyond ASCII as ``u`` and
    continuation bytes ``c``; the sentinels' characters stay.  ``^`` opens a text."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        if not all(s and s.isascii() and not {*s} & {*"auc^"} for s in sentinels):
            raise ValueError("sentinels must be ASCII, and without any of a, u, c and ^")
        own = {c for s in sentinels for c in s}
        of = {b: chr(b) if chr(b) in own else "a" if chr(b).isalpha() else " " for b in range(128)}
        of |= {b: "c" if b < 0xC0 else "u" for b in range(128, 256)}
        self.symbols = bytes(ord(of[b]) for b in range(256))
        letters = {"a", *(c for c in own if c.isalpha())}
        others = {" ", "u", "c", *own} - letters
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for x in letters:
            for y in others:
                self.automaton.add_word(x + y, _END)
                self.automaton.add_word(y + x, _BEGIN)
            self.automaton.add_word("^" + x, _BEGIN)
        for s in sentinels:
            self.automaton.add_word(s, _SENTINEL)
        self.automaton.make_automaton()

    def events(self, raw: bytes) -> tuple[np.ndarray, bool]:
        """Where the class changes (byte positions, a letter run's begin first,
        begins and ends in turn), and whether a sentinel was met."""
        scan = self.automaton.iter("^" + raw.translate(self.symbols).decode("ascii"))
        found = np.fromiter(((at - 1) * 4 + kind for at, kind in scan), np.int64)
        changes = found[found & 3 != _SENTINEL] >> 2
        return changes, len(changes) < len(found)


class Units:
    """Units of one text, by its events."""

    def __init__(self, raw: bytes, changes: np.ndarray):
        self.raw = raw
        self.at = np.concatenate([[0], changes, [len(raw)]])
        self.ascii = raw.isascii()
        if self.ascii:
            chars = np.diff(self.at)
        else:
            first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
            self.before = np.concatenate([[0], np.cumsum(first)])
            chars = np.diff(self.before[self.at])
        # gaps hold other characters and a letter run in turn
        chars[1::2] = np.minimum(chars[1::2], 1)
        self.units = np.concatenate([[0], np.cumsum(chars)])
        self.count = int(self.units[-1])

    def position(self, rank: int) -> int:
        """The byte where the unit of this rank begins; the end for the count."""
        gap = int(np.searchsorted(self.units, rank, "right")) - 1
        more = rank - int(self.units[gap])
        if not more:
            return int(self.at[gap])
        if self.ascii:
            return int(self.at[gap]) + more
        return int(np.searchsorted(self.before, self.before[self.at[gap]] + more, "right")) - 1

    def chars(self, a: int, b: int) -> int:
        return b - a if self.ascii else int(self.before[b] - self.before[a])


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentinels: tuple[str, str, str] = SENTINELS, plain: int = PLAIN, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row."""
    p, s, m = (x.encode() for x in sentinels)

    def run(batches):
        scanner = EventScanner(sentinels)
        for batch in batches:
            keys, h = batch.column(0).to_pylist(), np.stack([c.to_numpy() for c in batch.columns[2:]])
            for texts in slices(batch.column(1)):
                out = []
                for i in range(len(texts)):
                    raw = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
                    changes, marked = scanner.events(raw)
                    units = Units(raw, changes)
                    row = texts.first + i
                    h1, h2, h3, h4 = h[:, row].tolist()
                    if marked or not raw or h3 % 100 >= 100 - plain:
                        out.append((keys[row], units.count, "plain", None, None, raw))
                        continue
                    a, b = (units.position(r) for r in sorted((h1 % (units.count + 1), h2 % (units.count + 1))))
                    form = "spm" if h4 % 100 < spm else "psm"
                    parts = (s, raw[b:], p, raw[:a], m, raw[a:b]) if form == "spm" else (p, raw[:a], s, raw[b:], m, raw[a:b])
                    out.append((keys[row], units.count, form, units.chars(0, a), units.chars(a, b), b"".join(parts)))
                *counts, outputs = zip(*out, strict=True)
                columns = [pa.array(list(c), f.type) for c, f in zip(counts, _SCHEMA, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(outputs), pa.binary()).cast(pa.string())], schema=_SCHEMA)

    key = F.col(id_col).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    sql = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(key.alias("doc_id"), F.col(text_col).alias("text"), *hashes).mapInArrow(by_batch(run), sql)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, rebuilt from the output and its form alone.  The parts
    hold no sentinel, and none begins in one part and ends in another, as long
    as no sentinel begins as another one ends."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        head = F.substring_index(output, m, 1)
        own = F.substring_index(head, second, 1).substr(F.lit(len(first) + 1), F.length(output))
        return own, F.substring_index(head, second, -1), F.substring_index(output, m, -1)

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
