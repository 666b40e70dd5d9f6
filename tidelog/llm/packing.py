"""Packing: documents become token sequences of at most ``capacity`` ids.

A document's ids are cut into pieces: full windows, which are sequences by
themselves, and one remainder.  Remainders are dealt by hash into buckets of
about ``bucket_windows`` windows each (the bucket count follows the token count,
so a bucket always fits one task) and each bucket is packed by Karmarkar-Karp
multiway differencing: the two partial partitions with the largest spread are
merged so that the heaviest windows of one meet the lightest of the other.  The
number of windows starts at the least possible and rises until none exceeds the
capacity, so a bucket wastes about one window.

Null or empty texts still yield the end id.  Rows are packed one by one, so
repeated rows or ids are harmless; null ids stay null.  An empty table gives
an empty result.
"""

from __future__ import annotations

import bisect
import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import materialize
from tidelog.llm.text_arrays import Texts, by_batch, is_space, slices

_KIND = np.full(256, 3, np.uint8)
for _b in range(0x21, 0x7F):
    _KIND[_b] = 1 if chr(_b).isalpha() else 4 if chr(_b).isdigit() else 2
_KIND[0x27] = 3
#: Units that are encoded as one text, with blanks between.
_JOINED = 2000
#: Distinct units that a task remembers before it starts afresh.
CACHE_UNITS = 200_000
#: Items that one bucket may hold, whatever their size.
BUCKET_ITEMS = 1 << 17


def _reads_units(settings: dict) -> bool:
    """Whether a tokenizer file lower-cases, cuts texts by a pattern that never
    crosses white space, and marks the last piece of each cut."""
    normal, cut, model = (settings.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = {x.get("type") for x in normal.get("normalizers", [normal])}
    first = cut.get("pretokenizers", [cut])[0]
    return "Lowercase" in steps and first.get("type") == "Split" and first.get("behavior") == "Removed" and model.get("end_of_word_suffix") == "</w>"


class UnitEncoder:
    """Encodes texts by their distinct units.

    Where the file allows it (:func:`_reads_units`), texts are split at white
    space and between ASCII letters, digits and punctuation (apostrophes aside,
    as they start contractions).  Such borders are always borders of pre-tokens,
    so each distinct unit is encoded once and its ids reused; they are kept in
    arrays sorted by the unit's hash.  With any other file every text is encoded
    by itself.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.by_units = _reads_units(settings)
        self.special = [t["content"].encode() for t in settings.get("added_tokens", [])]
        if self.by_units:
            vocabulary = settings["model"]["vocab"]
            self.last = np.zeros(max([*vocabulary.values(), 0]) + 1 + len(self.special), bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.hash, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _pure(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and lengths of units of one kind of ASCII bytes; a piece that
        ends a word ends the unit."""
        sizes = ends - starts + 1
        after = np.cumsum(sizes)
        joined = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
        gap = np.zeros(len(joined), bool)
        gap[after - 1] = True
        joined[~gap] = data[np.repeat(starts - (after - sizes - np.arange(len(sizes))), sizes - 1) + np.arange(len(joined) - len(sizes))]
        cuts = [0, *after[_JOINED - 1 :: _JOINED].tolist()]
        cuts += [len(joined)] if cuts[-1] < len(joined) else []
        flat, lengths = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            coded = self.tokenizer.encode_batch_fast([joined[a:b].tobytes().decode("ascii")], add_special_tokens=False)[0]
            ids = np.array(coded.ids, np.int32)
            flat.append(ids)
            lengths.append(np.diff(np.flatnonzero(self.last[ids]), prepend=-1))
        return flat, lengths

    def _mixed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The same of any units, by the places of their pieces."""
        units = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        flat, lengths = [], []
        for i in range(0, len(units), _JOINED):
            part = units[i : i + _JOINED]
            coded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            heads = np.cumsum([0, *(len(u) + 1 for u in part[:-1])])
            place = np.array(coded.offsets, np.int64).reshape(-1, 2)[:, 0]
            lengths.append(np.bincount(np.searchsorted(heads, place, "right") - 1, minlength=len(part)))
            flat.append(np.array(coded.ids, np.int32))
        return flat, lengths

    def _learn(self, data: np.ndarray, kind: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        other = np.concatenate([[0], np.cumsum(kind == 3)])
        pure = other[ends] == other[starts]
        order = np.argsort(~pure, kind="stable")
        n = int(pure.sum())
        hashes, starts, ends = hashes[order], starts[order], ends[order]
        flat, lengths = self._pure(data, starts[:n], ends[:n])
        more, others = self._mixed(data, starts[n:], ends[n:])
        length = np.concatenate([np.zeros(0, np.int64), *lengths, *others])
        begin = len(self.flat) + np.cumsum(length) - length
        self.flat = np.concatenate([self.flat, *flat, *more])
        every = np.concatenate([self.hash, hashes])
        order = np.argsort(every)
        self.hash = every[order]
        self.begin = np.concatenate([self.begin, begin])[order]
        self.length = np.concatenate([self.length, length.astype(np.int32)])[order]

    def __call__(self, texts: Texts) -> list[np.ndarray]:
        if not self.by_units:
            return [self.plain(texts.text(i)) for i in range(len(texts))]
        data = texts.data
        kind = _KIND[data]
        inside = ~is_space(data)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | ((kind[1:] != kind[:-1]) & (kind[1:] != 3) & (kind[:-1] != 3)) | ((kind[1:] == 4) & (kind[:-1] == 4))
        filled = texts.offsets[1:] > texts.offsets[:-1]
        heads = texts.offsets[:-1][filled]
        begins[heads] = inside[heads]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return [self.flat[:0]] * len(texts)
        # a unit ends where the next one begins, less the white space between
        ends = np.concatenate([starts[1:], [len(data)]])
        blank = np.flatnonzero(~inside)
        if len(blank):
            at = np.searchsorted(blank, starts)
            ends = np.minimum(ends, np.where(at < len(blank), blank[np.minimum(at, len(blank) - 1)], len(data)))
        borders = texts.of_rows(starts)
        ends = np.minimum(ends, texts.offsets[1:][np.searchsorted(texts.offsets, starts, "right") - 1])
        # Composition after lower-casing may differ where combining marks occur.
        marks = ((data == 0xCC) | (data == 0xCD)).any()
        hashes = texts.hasher(data if marks else texts.lowered())(starts, ends)
        if marks:
            hashes = hashes ^ np.uint64(0x5555)
        order = np.argsort(hashes)
        first = np.ones(len(order), bool)
        ordered = hashes[order]
        first[1:] = ordered[1:] != ordered[:-1]
        unique, example = ordered[first], order[first]
        known = np.zeros(len(unique), bool)
        if len(self.hash):
            at = np.searchsorted(self.hash, unique)
            known = self.hash[np.minimum(at, len(self.hash) - 1)] == unique
        if not known.all():
            if len(self.hash) > CACHE_UNITS:
                self.clear()
                known[:] = False
            missing = example[~known]
            self._learn(data, kind, unique[~known], starts[missing], ends[missing])
        row = np.empty(len(order), np.int64)
        row[order] = np.searchsorted(self.hash, unique)[np.cumsum(first) - 1]
        lengths = self.length[row].astype(np.int64)
        after = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.begin[row] - (after - lengths), lengths) + np.arange(int(after[-1]))]
        cuts = np.concatenate([[0], after])[borders]
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        raw = data.tobytes()
        if any(x in raw for x in self.special):
            for i in range(len(texts)):
                if any(x in raw[texts.offsets[i] : texts.offsets[i + 1]] for x in self.special):
                    out[i] = self.plain(texts.text(i))
        return out


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, piece[, ids]) of all texts."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("piece", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if with_ids else []
    schema = pa.schema(fields)

    def run(batches):
        encode = UnitEncoder(tokenizer_path)  # the task's own: no worker holds on to it
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for texts in slices(batch.column(1)):
                out = []
                for i, ids in enumerate(encode(texts)):
                    ids = np.append(ids, np.int32(end_id)).astype("<i4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        out.append((ids_of[texts.first + i], start, len(piece), zlib.crc32(piece.tobytes()), len(ids), number, *([piece] if with_ids else [])))
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    sql = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(by_batch(run), sql)


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing of item sizes over ``windows``
    windows; the items (their positions) of each window.

    A partial partition holds only its filled windows, as sorted sums and their
    items' nodes: the memory follows the items, however many windows there are.
    """
    if windows == 1:
        return [list(range(len(sizes)))]
    left, right = list(range(len(sizes))), [-1] * len(sizes)  # nodes: items first, then joins
    heap = [(-sizes[i], i, [sizes[i]], [i]) for i in range(len(sizes))]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heap[0]
        if len(a) < len(b):
            a, a_nodes, b, b_nodes = b, b_nodes, a, a_nodes
        # a's heaviest windows meet b's empty ones; the rest meet b's in order
        meet = max(0, len(a) + len(b) - windows)
        sums, nodes = a[meet:], a_nodes[meet:]
        for k in range(meet):
            left.append(a_nodes[k])
            right.append(b_nodes[meet - 1 - k])
            at = bisect.bisect_right(sums, a[k] + b[meet - 1 - k]) if len(b) < 4 else len(sums)
            sums.insert(at, a[k] + b[meet - 1 - k])
            nodes.insert(at, len(left) - 1)
        if len(b) < 4:
            for k in range(meet, len(b)):
                at = bisect.bisect_right(sums, b[k])
                sums.insert(at, b[k])
                nodes.insert(at, b_nodes[k])
        else:
            sums, nodes = sums + b[meet:], nodes + b_nodes[meet:]
            order = sorted(range(len(sums)), key=sums.__getitem__)
            sums, nodes = [sums[i] for i in order], [nodes[i] for i in order]
        spread = sums[-1] - (sums[0] if len(sums) == windows else 0)
        heapq.heapreplace(heap, (-spread, count, sums, nodes))
        count += 1
    out = []
    for root in heap[0][3] if heap else []:
        items, stack = [], [root]
        while stack:
            node = stack.pop()
            if node < len(sizes):
                items.append(node)
            else:
                stack += [left[node], right[node]]
        out.append(sorted(items))
    return out


def near_equal_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The windows of :func:`difference` for the least count that keeps to the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        packed = [w for w in difference(sizes, windows) if w]
        if all(sum(sizes[i] for i in w) <= capacity for w in packed):
            return packed
        windows += 1 + windows // 200


def pack_pieces(pieces: DataFrame, capacity: int = 4096, bucket_windows: int = 256) -> DataFrame:
    """Adds sequence_id and offset.  ``pieces`` must be a stored table: its
    ``piece`` numbers the pieces.  Columns besides those of
    :func:`token_pieces` are passed on."""
    full = pieces.filter(F.col("length") == capacity)
    rest = pieces.filter(F.col("length") < capacity)
    whole = rest.agg(F.sum("length").alias("tokens"), F.count("*").alias("items")).first()
    buckets = max(1, round((whole["tokens"] or 0) / (capacity * bucket_windows)), -(-whole["items"] // BUCKET_ITEMS))
    # Sequence ids: even for packed windows (bucket and place), odd for full pieces.
    full = full.withColumn("sequence_id", F.col("piece") * 2 + 1)
    full = full.withColumn("offset", F.lit(0).cast("long"))
    narrow = rest.select("piece", "length", F.pmod(F.xxhash64("piece"), F.lit(buckets)).alias("bucket"))

    def pack_bucket(key, table):
        table = table.sort_by("piece")
        sizes = table.column("length").to_pylist()
        sequence, offset = [0] * len(sizes), [0] * len(sizes)
        for w, items in enumerate(near_equal_windows(sizes, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = ((key[0].as_py() << 32) + w) * 2, at
                at += sizes[i]
        return pa.table({"piece": table.column("piece"), "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})

    placed = narrow.groupBy("bucket").applyInArrow(pack_bucket, "piece long, sequence_id long, offset long")
    return full.unionByName(rest.join(placed, "piece").select(*full.columns))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, bucket_windows: int = 256, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset there; with
    ``with_ids`` also each piece's ids."""
    pieces = materialize(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids), "pieces")
    return pack_pieces(pieces, capacity, bucket_windows).drop("piece")


def padded_length(tokens: int, capacity: int = 4096) -> int:
    """What a sequence takes: a power of two as it is, anything else the capacity."""
    return tokens if tokens & (tokens - 1) == 0 else capacity
