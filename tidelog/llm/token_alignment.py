"""Cross-tokenizer alignment: which ids of tokenizer A cover the bytes of B's ids.

Both tokenizers read the same bytes, a space and the text.  A dangling-suffix
transducer walks both id sequences: its state is the side that leads and the
bytes that the other side hasn't matched yet.  From an empty residual A's next
id leads; otherwise the other side's next id is taken, overlaps the leading id
(a link), and what then dangles is the next state.  Transitions are memoised by
residual and id.  An empty residual closes a group of ids of equal bytes.

Texts are cut before single spaces, where both tokenizers always end an id, so
each distinct unit is encoded and walked once in a task and reused.  A block of
documents sends out its distinct id pairs with counts; Spark sums them over all
blocks, finds each B id's highest count, and joins both back to the blocks' own
pairs.  A pair has one row a block at most, so no key is hot, and nothing of the
corpus passes through the driver.

Texts that are null or empty, or whose ids don't spell the same bytes on both
sides, have no tokens: zeros, and an empty list of groups.  Rows are aligned one
by one; repeated rows count each time.  A long text is encoded unit by unit; a
text without spaces is one unit.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import delete_table, materialize
from tidelog.llm.text_arrays import Texts, by_batch, give_back, slices

#: A block: documents whose pairs a task sends out together.
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 1 << 17
#: Bytes of units that a task remembers, and transitions, before it starts afresh.
UNIT_BYTES, MEMO = 160 << 20, 1 << 19
_SPACE_MARK = "▁"
_MARK_BYTES = _SPACE_MARK.encode()


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the
    others, in order, as characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Side A: a byte-level BPE file of ``tokenizers``, read without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        symbols = _byte_of_symbol()
        self.bytes = {i: bytes(symbols[c] for c in token) for token, i in vocabulary.items() if all(c in symbols for c in token)}

    def encode(self, units: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]


class Pieces:
    """Side B: a ``sentencepiece`` model, which adds the space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: No piece has a space after another character, so none crosses a cut.
        self.cuts = not any(_SPACE_MARK in p.lstrip(_SPACE_MARK) for p in pieces)
        self.bytes = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE_MARK, " ").encode() for i, p in enumerate(pieces)}

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.model.encode(units, num_threads=1)


def _runs(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of all runs, one after another."""
    after = np.cumsum(sizes)
    return np.repeat(begin - (after - sizes), sizes) + np.arange(int(after[-1]) if len(after) else 0)


class Transducer:
    """State 2k (A leads) or 2k + 1 (B leads) stands for the k-th residual; 0 is
    the empty one.  Transitions are memoised as sorted keys of state and token,
    so that many units step at once."""

    def __init__(self, a_bytes: dict[int, bytes], b_bytes: dict[int, bytes]):
        self.token_bytes = (a_bytes, b_bytes)
        self.clear()

    def clear(self) -> None:
        self.residuals, self.number = [b""], {b"": 0}
        self.keys, self.targets = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _step(self, key: int) -> int:
        """The state after the lagging side (A, from the empty residual) took a
        token; -1 where the bytes differ."""
        state, token = key >> 20, key & 0xFFFFF
        side, residual = state & 1, self.residuals[state >> 1]
        own = self.token_bytes[1 - side if state else 0].get(token, b"")
        if not own or not (residual.startswith(own) or own.startswith(residual)):
            return -1
        if len(own) <= len(residual):
            return self._state(residual[len(own) :], side)
        return self._state(own[len(residual) :], 1 - side if state else 0)

    def _state(self, residual: bytes, side: int) -> int:
        k = self.number.setdefault(residual, len(self.residuals))
        if k == len(self.residuals):
            self.residuals.append(residual)
        return 2 * k + side if k else 0

    def after(self, keys: np.ndarray) -> np.ndarray:
        """The states after these transitions (state << 20 | token)."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if known.all():
            return self.targets[at]
        new = np.unique(keys[~known])
        every = np.concatenate([self.keys, new])
        order = np.argsort(every)
        self.keys, self.targets = every[order], np.concatenate([self.targets, np.array([self._step(k) for k in new.tolist()], np.int64)])[order]
        return self.targets[np.searchsorted(self.keys, keys)]

    def align(self, a: np.ndarray, cut_a: np.ndarray, b: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All units at once; unit u has a[cut_a[u]:cut_a[u + 1]] and b likewise.
        Returns which units' bytes agree, where groups end (flags of A and of B
        ids), and links with their units: (A id in the high half, B id in the
        low one).  What units that don't agree leave is to be ignored."""
        if len(self.keys) > MEMO:
            self.clear()
        i, j, last_a, last_b = cut_a[:-1].copy(), cut_b[:-1].copy(), cut_a[1:], cut_b[1:]
        state, leader, agree = (np.zeros(len(i), np.int64) for _ in range(3))
        end_a, end_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        links, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        run = np.arange(len(i))
        while len(run):
            takes_a = (state[run] == 0) | (state[run] & 1 == 1)
            over = np.where(takes_a, i[run] >= last_a[run], j[run] >= last_b[run])
            if over.any():
                done = run[over]
                agree[done] = (state[done] == 0) & (j[done] == last_b[done])
                run, takes_a = run[~over], takes_a[~over]
            by_a, by_b = run[takes_a], run[~takes_a]
            token = np.empty(len(run), np.int64)
            token[takes_a], token[~takes_a] = a[i[by_a]], b[j[by_b]]
            i[by_a] += 1
            j[by_b] += 1
            before = state[run]
            after = self.after(before << 20 | token)
            linked = before != 0
            links.append(np.where(takes_a, token << 32 | leader[run], leader[run] << 32 | token)[linked])
            owners.append(run[linked])
            leads = (before == 0) | (after & 1 != before & 1)
            leader[run[leads]] = token[leads]
            closed = run[linked & (after == 0)]
            end_a[i[closed] - 1] = end_b[j[closed] - 1] = True
            state[run] = after
            run = run[after >= 0]
        return agree.astype(bool), end_a, end_b, np.concatenate(links), np.concatenate(owners)


class GroupsText:
    """Group lists as text, each group ended by a semicolon, for many units at once."""

    def __init__(self, most: int):
        names = [b"%d" % i for i in range(most)]
        self.size = np.array([len(x) for x in names], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.digits = np.frombuffer(b"".join(names), np.uint8)

    def __call__(self, a: np.ndarray, end_a: np.ndarray, b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and how many each id takes, A's and B's ids merged by group."""
        group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        groups = int(end_a.sum())
        of_a, of_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        place_a = np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(of_a)[group_b]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[end_a]], mark[place_b[end_b]] = ord("|"), ord(";")
        sizes = self.size[ids] + 1
        after = np.cumsum(sizes)
        out = np.empty(int(after[-1]) if len(after) else 0, np.uint8)
        digit = np.ones(len(out), bool)
        digit[after - 1] = False
        out[after - 1] = mark
        out[digit] = self.digits[_runs(self.begin[ids], self.size[ids])]
        return out, sizes


#: Whether a byte begins no white space: ASCII, and leading bytes of characters that are none.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xE1] = True
_SOLID[0xE4:] = True


def units_of(texts: Texts, allowed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of units.  A unit begins after a space that stands between
    a byte that is no space and one that begins no white space."""
    data = texts.data
    heads = texts.offsets[:-1][texts.offsets[1:] > texts.offsets[:-1]]
    begins = np.zeros(len(data), bool)
    if allowed and len(data) > 2:
        begins[2:] = (data[1:-1] == 0x20) & (data[:-2] != 0x20) & _SOLID[data[2:]]
        begins[heads[heads + 1 < len(data)] + 1] = False  # a space that opens a text follows the space that is added
    cut = begins.copy()
    begins[heads], cut[heads] = True, False
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    ends = ends - np.append(cut[starts[1:]], False)[: len(starts)]
    return starts, ends


#: Units that are encoded as one text.
_JOINED = 500


class UnitTable:
    """Each distinct unit's A and B counts, groups and links, by the unit's hash."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b, self.transducer = a, b, Transducer(a.bytes, b.bytes)
        self.length = []
        for side in (a, b):
            sizes = np.zeros(max(side.bytes) + 1, np.int64)
            sizes[list(side.bytes)] = [len(x) for x in side.bytes.values()]
            self.length.append(sizes)
        self.groups_text = GroupsText(max(map(len, self.length)))
        self.clear()

    def clear(self) -> None:
        self.hash, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.counts = np.zeros((0, 4), np.int64)  # A, B, groups, whether the bytes agree
        self.text, self.text_begin, self.text_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.links, self.links_begin, self.n_links = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = 0

    def _encoded(self, side: int, units: list[bytes], plain: int) -> tuple[list[int], list[int]]:
        """Ids of all units, one after another, and where each one ends.  The
        first ``plain`` units are encoded in joined texts."""
        encode, length = (self.a, self.b)[side].encode, self.length[side]
        ids: list[int] = []
        cuts = [0]
        for i in range(0, plain, _JOINED):
            part = units[i : min(plain, i + _JOINED)]
            own = encode([b" ".join(part).decode("utf-8", "replace")])[0]
            ends, want = np.cumsum(length[own]), np.cumsum([len(u) + 1 for u in part])
            at = np.searchsorted(ends, want)
            if len(ends) and int(ends[-1]) == int(want[-1]) and (ends[np.minimum(at, len(ends) - 1)] == want).all():
                cuts += (at + 1 + len(ids)).tolist()
                ids += own
            else:  # a unit reads differently
                self._one_by_one(encode, part, ids, cuts)
        if plain < len(units):
            self._one_by_one(encode, units[plain:], ids, cuts)
        return ids, cuts

    @staticmethod
    def _one_by_one(encode: Callable, units: list[bytes], ids: list[int], cuts: list[int]) -> None:
        for own in encode([u.decode("utf-8", "replace") for u in units]):
            ids += own
            cuts.append(len(ids))

    def _learn(self, units: list[bytes], plain: int) -> None:
        (a, cut_a), (b, cut_b) = ([np.array(x, np.int64) for x in self._encoded(side, units, plain)] for side in (0, 1))
        agree, end_a, end_b, links, owners = self.transducer.align(a, cut_a, b, cut_b)
        n_a, n_b = np.diff(cut_a), np.diff(cut_b)
        good_a, good_b = np.repeat(agree, n_a), np.repeat(agree, n_b)
        end_a, end_b = end_a & good_a, end_b & good_b
        groups = np.concatenate([[0], np.cumsum(end_a)])
        groups = groups[cut_a[1:]] - groups[cut_a[:-1]]
        text, sizes = self.groups_text(a[good_a], end_a[good_a], b[good_b], end_b[good_b])
        after, ids = np.concatenate([[0], np.cumsum(sizes)]), np.cumsum(np.where(agree, n_a + n_b, 0))
        text_size = np.diff(after[np.concatenate([[0], ids])])
        owned = agree[owners]
        links, owners = links[owned], owners[owned]
        n_links = np.bincount(owners, minlength=len(units))
        links = links[np.argsort(owners, kind="stable")]
        self.text_begin = np.concatenate([self.text_begin, len(self.text) + np.cumsum(text_size) - text_size])
        self.links_begin = np.concatenate([self.links_begin, len(self.links) + np.cumsum(n_links) - n_links])
        self.text, self.links = np.concatenate([self.text, text]), np.concatenate([self.links, links])
        self.text_size, self.n_links = np.concatenate([self.text_size, text_size]), np.concatenate([self.n_links, n_links])
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, groups, agree], 1).astype(np.int64)])
        self.held = len(self.text) + 8 * len(self.links) + 100 * len(self.counts)

    def places(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of every unit."""
        hashes, first, inverse = np.unique(texts.hasher()(starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, hashes), max(0, len(self.hash) - 1))
        new = self.hash[at] != hashes if len(self.hash) else np.ones(len(hashes), bool)
        if new.any():
            raw, some = texts.data.tobytes(), first[new]
            units = [raw[x:y] for x, y in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
            odd = np.array([not (self.b.cuts and _SOLID[u[0]] and u[-1] != 0x20 and _MARK_BYTES not in u) for u in units])
            order = np.argsort(odd, kind="stable")
            place = np.empty(len(units), np.int64)
            place[order] = len(self.counts) + np.arange(len(units))
            self._learn([units[k] for k in order.tolist()], int((~odd).sum()))
            every = np.concatenate([self.hash, hashes[new]])
            order = np.argsort(every)
            self.hash, self.place = every[order], np.concatenate([self.place, place])[order]
            at = np.searchsorted(self.hash, hashes)
        return self.place[at][inverse] if len(hashes) else np.zeros(0, np.int64)

    def links_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of these units, one after another, and how many each has."""
        sizes = self.n_links[units]
        return self.links[_runs(self.links_begin[units], sizes)], sizes

    def text_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group lists of these units, one after another, and their sizes."""
        sizes = self.text_size[units]
        return self.text[_runs(self.text_begin[units], sizes)], sizes


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: the high ones are mostly zeros, and compress."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


_ROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()), ("units", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("unit_pairs", pa.binary()), ("unit_sizes", pa.binary())])
_ROW_SQL = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, units binary, pairs array<long>, counts array<long>, unit_pairs binary, unit_sizes binary"


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def _send(block: int, table: UnitTable, rows: list[tuple], used: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The block's documents, then its distinct pairs with their counts and, for
    each distinct unit, the places of its pairs.  Frequent units get low numbers."""
    times = np.bincount(np.concatenate([np.zeros(0, np.int64), *used]), minlength=len(table.counts))
    units = np.argsort(-times, kind="stable")[: int((times > 0).sum())]
    number = np.zeros(len(times), np.int64)
    number[units] = np.arange(len(units))
    out, size = [], 0
    for row, own in zip(rows, used, strict=True):
        out.append((block, *row, _planes(number[own]), None, None, None, None))
        size += 4 * len(own) + len(row[6] or b"") + 200
        if size > 8 << 20:
            yield _record(out)
            out, size = [], 0
    if out:
        yield _record(out)
    links, sizes = table.links_of(units)
    pairs, at = np.unique(links, return_inverse=True)
    counts = np.bincount(at, np.repeat(times[units], sizes), len(pairs)).astype(np.int64)
    yield _record([(block, *[None] * 8, pairs, counts, at.astype(np.uint32).tobytes(), sizes.astype(np.uint32).tobytes())])


def post(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Rows of documents (``units`` set) and of blocks (``pairs`` set)."""

    def run(batches):
        table = UnitTable(ByteLevel(a_path), Pieces(b_path))
        block, size = TaskContext.get().partitionId() << 24, 0
        rows: list[tuple] = []
        used: list[np.ndarray] = []
        for batch in batches:
            names = batch.column(0).to_pylist()
            for texts in slices(batch.column(1)):
                if rows and (size > BLOCK_BYTES or len(rows) + len(texts) > BLOCK_ROWS or table.held > UNIT_BYTES):
                    yield from _send(block, table, rows, used)
                    block, size, rows, used = block + 1, 0, [], []
                    if table.held > UNIT_BYTES:
                        table.clear()
                starts, ends = units_of(texts, table.b.cuts)
                places = table.places(texts, starts, ends)
                borders = texts.of_rows(starts)
                total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(table.counts[places], 0)])
                sums = total[borders[1:]] - total[borders[:-1]]
                written, sizes = table.text_of(places)
                written, at = written.tobytes(), np.concatenate([[0], np.cumsum(sizes)])[borders].tolist()
                for i, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)):
                    n_a, n_b, n_groups, agree = sums[i].tolist()
                    if a == b or agree < b - a:
                        rows.append((names[texts.first + i], 0, 0, 0, 0, "", "" if with_groups else None))
                        used.append(places[:0])
                        continue
                    text = written[at[i] : at[i + 1] - 1]  # no last semicolon
                    rows.append((names[texts.first + i], n_a, n_b, n_groups, n_a + n_b - n_groups, hashlib.sha256(text).hexdigest(), text.decode() if with_groups else None))
                    used.append(places[a:b].astype(np.int32))
                size += len(texts.data)
        if rows:
            yield from _send(block, table, rows, used)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(by_batch(run), _ROW_SQL)


_SUMS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string())])


def _summed(documents: pa.Table, answers: pa.Table) -> pa.Table:
    """One block: its documents with the sums over their links."""
    home = documents.filter(pc.is_valid(documents.column("unit_sizes")))
    rows = documents.filter(pc.is_valid(documents.column("units")))
    sizes = np.frombuffer(home.column("unit_sizes")[0].as_buffer(), np.uint32)
    at = np.frombuffer(home.column("unit_pairs")[0].as_buffer(), np.uint32)
    n, best = np.zeros(answers.num_rows, np.int64), np.zeros(answers.num_rows, np.int64)
    place = answers.column("at").to_numpy()
    n[place], best[place] = answers.column("total").to_numpy(), answers.column("best").to_numpy()
    ends = np.cumsum(sizes, dtype=np.int64)

    def by_unit(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values[at])])
        return total[ends] - total[ends - sizes]

    totals, bests = by_unit(n), by_unit(best)
    own = [_from_planes(u.as_buffer()) for u in rows.column("units")]
    columns = {c: rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")}
    columns |= {"n_best": pa.array([int(bests[u].sum()) for u in own], pa.int64()), "count_sum": pa.array([int(totals[u].sum()) for u in own], pa.int64())}
    out = pa.table({f.name: columns[f.name] for f in _SUMS}, schema=_SUMS)
    give_back()
    return out


def pair_counts(posted: DataFrame) -> DataFrame:
    """(pair, total, best): links of an id pair (A id in the high half) in the
    whole corpus, and 1 where no pair of the same B id has more."""
    own = posted.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    totals = own.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("total"))
    most = F.expr("max(total) OVER (PARTITION BY pair & 4294967295L)")  # at most as many rows as A has ids
    return totals.select("pair", "total", (F.col("total") == most).cast("long").alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256,
    groups) for every row; ``groups`` is null unless asked for."""
    posted = materialize(post(docs, a_path, b_path, id_col, text_col, with_groups), "posted")
    known = materialize(pair_counts(posted), "pairs")
    asked = posted.filter("pairs is not null").select(F.col("block").alias("asker"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(known, "pair").select("asker", "at", "total", "best")
    documents = posted.drop("pairs", "counts")
    sql = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    summed = documents.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(_summed, sql)
    out = materialize(summed, "aligned")
    delete_table(posted)
    delete_table(known)
    return out
