"""N-gram Jaccard join: a size-aware heavy-light join over shingle sets.

A document's set holds the hashes of its distinct five-word shingles; two
documents link at Jaccard similarity of at least 3/4.  All steps are exact:

1. Equal sets are one class; only classes are joined.
2. Under a fixed order of hashes, documents that link share at least ``q``
   elements of their prefixes P (two fifths of a set).  P's elements are counted
   over the corpus in shards, as packed arrays.  A document with fewer than
   ``q`` elements that occur elsewhere has no partner and leaves.
3. The rest order P's shared elements by rarity and drop the q - 1 most common:
   linked documents share one of those that stay (two of them, if one more is
   kept).  Light sets, up to a size boundary, enumerate subsets of two elements;
   heavy sets are posted to inverted lists of single elements.  The boundary is
   where the estimated cost (subsets made, list entries scanned) is least.
4. Links are needed only between components.  First every class is compared
   with the hub that shares most of its lists.  Then short lists give their
   pairs of different components, each pair once however many lists it meets in.
   Of long lists, a class is compared with seeded hubs in a few rounds.  Classes
   whose lists still hold several components get new lists, from their whole sets
   (:func:`rare_lists`): under the order of rarity among themselves, the smaller
   of two linked sets has one of its rarest seventh within the larger's rarest
   quarter.  Text that many documents share, but that doesn't link them, is in
   neither.  There a class is compared with the nearest class of another
   component, then all pairs of different components are, block by block: rows of
   a list's largest component don't meet each other, so only the others are sent
   to several blocks.  Bitmaps bound the symmetric difference before the exact comparison of sets.

The number of shards follows the size of the texts, so that a shard stays as
small at any size.  Keys that may hold a large share of the rows (a list, a
class of copies, a component) are joined by :func:`hot_join`.

Null or empty texts, or texts without words, have an empty set and link with
nothing.  Repeated rows fall in one class.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import components
from tidelog.llm.shared import delete_table, hot_join, materialize
from tidelog.llm.text_arrays import by_batch, by_group, mix, shingles, slices

#: A block: the rows whose elements a task sends out together.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 1 << 16
ROUNDS, HUB_ROUNDS = 1, 2
CHUNK = 2048
#: Elements that a block of whole sets holds.
BLOCK_ELEMENTS = 1 << 19
#: Text bytes that a shard's elements come from, and the longest short list.
SHARD_BYTES, SHORT_LIST = 8 << 20, 64
#: Cost of one list entry (it is read in each round) and, in the same unit, of
#: comparing it with one other entry's bitmap.
ENTRY_COST, COMPARE_COST = ROUNDS + 3, 0.02
#: Bitmap sizes, for all sets and for those of over LARGE elements.
SHORT_BITS, LONG_BITS, LARGE = 1024, 4096, 700


def least_shared(n: np.ndarray) -> np.ndarray:
    """q: elements of P that linked sets share, given one set's size; it holds
    for partners down to three quarters of the size."""
    return np.maximum(1, 15 * (-(-3 * n // 4)) // 100)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (-(-3 * n // 4)) + np.maximum(1, 15 * n // 100)


def _class_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and 128 bits over each set's elements."""
    n = np.array([len(s) for s in sets], np.int64)
    if not len(sets):
        return n, n, n
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(n)])
    out = []
    for salt in (0x1B873593CC9E2D51, 0x38B34AE5A1E38B93):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(salt)))])
        out.append(mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)).view(np.int64))
    return n, *out


_POSTED = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("block", pa.int64()), ("shard", pa.int32()), ("keys", pa.binary()), ("idx", pa.binary()), ("count", pa.binary())])
_POSTED_SQL = "doc_id long, rid long, n long, c1 long, c2 long, block long, shard int, keys binary, idx binary, count binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _POSTED, strict=True)], schema=_POSTED)


def _send(block: int, ids: list, sets: list[np.ndarray], shards: int):
    """Rows of one block: its documents (shard null), its prefix elements by
    shard, and (shard -1) what stays for the way back: sizes, and further rows
    of elements that occur more than once in the block."""
    n, c1, c2 = _class_hashes(sets)
    yield _batch([(ids[i], (block << 16) + i, int(n[i]), int(c1[i]), int(c2[i]), None, None, None, None, None) for i in range(len(sets))])
    seen: set = set()
    keys, idx = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
    for i, (own, p) in enumerate(zip(sets, prefix_length(n).tolist(), strict=True)):
        mark = (int(n[i]), int(c1[i]), int(c2[i]))
        if len(own) and mark not in seen:
            seen.add(mark)
            keys.append(own[:p])
            idx.append(np.full(min(p, len(own)), i, np.uint16))
    key, row = np.concatenate(keys), np.concatenate(idx)
    shard = (key & np.uint64(shards - 1)).astype(np.int64)
    token = (key >> np.uint64(32)) | (shard.astype(np.uint64) << np.uint64(32))
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    at = np.flatnonzero(first)
    count = np.minimum(np.diff(np.append(at, len(token))), 65535).astype(np.uint16)
    yield _batch([(None, None, None, None, None, block, -1, token[~first].tobytes(), row[~first].tobytes(), n.astype(np.uint32).tobytes())])
    sent, own_row = token[at], row[at]
    cut = np.searchsorted(sent, np.arange(shards + 1, dtype=np.uint64) << np.uint64(32))
    rows = [(None, None, None, None, None, block, s, sent[a:b].astype(np.uint32).tobytes(), own_row[a:b].tobytes(), count[a:b].tobytes()) for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
    if rows:
        yield _batch(rows)


def post(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        block, size = TaskContext.get().partitionId() << 24, 0
        ids: list = []
        sets: list[np.ndarray] = []
        for batch in batches:
            names = batch.column(0).to_pylist()
            for texts in slices(batch.column(1)):
                if ids and (size > BLOCK_BYTES or len(ids) + len(texts) > BLOCK_ROWS):
                    yield from _send(block, ids, sets, shards)
                    block, size, ids, sets = block + 1, 0, [], []
                own = shingles(texts)
                for i in range(0, len(own), BLOCK_ROWS):  # a slice of empty texts may be long
                    if i:
                        yield from _send(block, ids, sets, shards)
                        block, size, ids, sets = block + 1, 0, [], []
                    ids += names[texts.first + i : texts.first + min(len(own), i + BLOCK_ROWS)]
                    sets += own[i : i + BLOCK_ROWS]
                size += len(texts.data)
        if ids:
            yield from _send(block, ids, sets, shards)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(by_batch(run), _POSTED_SQL)


def _shared_elements(table):
    """One shard: of each block's elements, those that occur twice or more in
    the corpus, with their counts."""
    blocks = table.column("block").to_pylist()
    keys = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    idx = [np.frombuffer(x, np.uint16) for x in table.column("idx").to_pylist()]
    count = [np.frombuffer(x, np.uint16) for x in table.column("count").to_pylist()]
    sizes = [len(k) for k in keys]
    key, at = np.concatenate(keys), np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.ones(len(key), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(first) - 1
    df = np.empty(len(key), np.int64)
    df[order] = np.bincount(group, np.concatenate(count)[order])[group]
    shard = table.column("shard")[0].as_py()
    rows = []
    for i, block in enumerate(blocks):
        some = df[at[i] : at[i + 1]] >= 2
        if some.any():
            token = keys[i][some].astype(np.uint64) | (np.uint64(shard) << np.uint64(32))
            rows.append((block, token.tobytes(), idx[i][some].tobytes(), df[at[i] : at[i + 1]][some].astype(np.uint32).tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table({"block": pa.array(columns[0], pa.int64()), "keys": pa.array(columns[1], pa.binary()), "idx": pa.array(columns[2], pa.binary()), "count": pa.array(columns[3], pa.binary())})


_CANDIDATES = "rid long, tokens array<long>, scan_cost double, subset_cost double"


def _candidates(table):
    """One block: its rows that may have a partner, their shared prefix elements
    by rarity (one more than single lists need), and the costs of both ways."""
    kept = table.column("shard").to_pylist()
    home = kept.index(-1)
    raw = {c: table.column(c).to_pylist() for c in ("keys", "idx", "count")}
    block = table.column("block")[0].as_py()
    size = np.frombuffer(raw["count"][home], np.uint32).astype(np.int64)
    back = [i for i, s in enumerate(kept) if s != -1]
    token = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(raw["keys"][i], np.uint64) for i in back]])
    row = np.concatenate([np.zeros(0, np.uint16), *[np.frombuffer(raw["idx"][i], np.uint16) for i in back]])
    df = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(raw["count"][i], np.uint32) for i in back]])
    order = np.argsort(token)
    token, row, df = token[order], row[order], df[order].astype(np.int64)
    more, more_row = np.frombuffer(raw["keys"][home], np.uint64), np.frombuffer(raw["idx"][home], np.uint16)
    token, row, df = np.concatenate([token, more]), np.concatenate([row, more_row]), np.concatenate([df, df[np.searchsorted(token, more)]]) if len(more) else df
    order = np.lexsort((token, df, row))
    token, row, df = token[order].view(np.int64), row[order], df[order]
    rows, starts = np.unique(row, return_index=True)
    out = []
    ends = np.append(starts[1:], len(row))[: len(starts)]  # none, if the block shares nothing
    for r, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
        n = int(size[r])
        q = int(least_shared(np.int64(n)))
        if b - a >= q:
            keep = b - a - q + 1
            two = min(keep + 1, b - a)
            scan = keep * ENTRY_COST + COMPARE_COST * int(df[a : a + keep].sum())
            out.append(((block << 16) + r, token[a : a + two], scan, two * (two - 1) // 2 * ENTRY_COST))
    columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
    return pa.table({"rid": pa.array(columns[0], pa.int64()), "tokens": pa.array(list(columns[1]), pa.list_(pa.int64())), "scan_cost": pa.array(columns[2], pa.float64()), "subset_cost": pa.array(columns[3], pa.float64())})


#: Sizes whose q is one have no two shared elements for certain.
LEAST_LIGHT = 18


def size_boundary(classes: DataFrame) -> int:
    """The largest size of light sets, where subsets of light sets and lists of
    heavy ones (and of sizes that may meet them) cost least together."""
    step = F.floor(F.log2("n") * 4)
    rows = classes.filter(F.col("n") >= LEAST_LIGHT).groupBy(step.alias("step")).agg(F.max("n").alias("most"), F.sum("scan_cost").alias("scan"), F.sum("subset_cost").alias("subset")).orderBy("step").collect()
    best, boundary = sum(r["scan"] for r in rows), LEAST_LIGHT - 1
    for i, r in enumerate(rows):
        cost = sum(x["subset"] for x in rows[: i + 1]) + sum(x["scan"] for x in rows if 4 * x["most"] > 3 * r["most"])
        if cost < best:
            best, boundary = cost, r["most"]
    return boundary


def inverted_lists(classes: DataFrame, boundary: int) -> DataFrame:
    """(token, rid, n): entries of element lists and of subset lists."""
    n = F.col("n")
    q = F.greatest(F.lit(1), F.floor(F.ceil(n * 3 / 4) * 15 / 100))
    light = (n >= LEAST_LIGHT) & (n <= boundary)
    single = (n * 3 < 4 * LEAST_LIGHT) | (n * 4 > 3 * boundary)
    # with q of 1 nothing was dropped, so no element is there for subsets alone
    elements = F.when(q > 1, F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(1)))).otherwise(F.col("tokens"))
    elements = classes.filter(single).select(F.explode(elements).alias("token"), "rid", "n")
    pairs = F.flatten(F.transform("tokens", lambda x, i: F.transform(F.slice("tokens", i + 2, F.size("tokens")), lambda y: F.xxhash64(x, y))))
    subsets = classes.filter(light).select(F.explode(pairs).alias("token"), "rid", "n")
    return elements.unionByName(subsets)


def _bitmap(elements: np.ndarray) -> bytes:
    """Parity of the elements by their low bits: SHORT_BITS, for large sets
    followed by LONG_BITS, of which the short ones are the fold."""
    size = LONG_BITS if len(elements) > LARGE else SHORT_BITS
    bits = np.bincount((elements & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    folded = bits.reshape(-1, SHORT_BITS).sum(0) & 1
    return np.packbits(folded).tobytes() + (np.packbits(bits).tobytes() if size > SHORT_BITS else b"")


#: Bits of the filter that tells which texts to read again: 2 MB at any size.
#: The more ids it holds, the more texts pass that the join on sets then drops.
FILTER_BITS = 1 << 24


def _id_filter(ids: DataFrame) -> np.ndarray:
    """Bits of the ids (id) by three hashes; null counts as an id."""
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), F.coalesce(F.col("id"), F.lit(-1))), F.lit(FILTER_BITS)) for k in range(3)]))
    words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits"))
    found = words.toArrow()  # at most FILTER_BITS / 32 rows
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


def _set_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(c1, c2, elements, bitmap): sets of the documents with the given ids and
    perhaps of others."""
    shared = docs.sparkSession.sparkContext.broadcast(_id_filter(ids))
    at = [F.pmod(F.xxhash64(F.lit(k), F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(FILTER_BITS)).alias(f"h{k}") for k in range(3)]

    def run(batches):
        bits = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for k in range(3):
                h = batch.column(k).to_numpy()
                keep &= (bits[h >> 5] >> (h & 31).astype(np.uint32)) & 1 == 1
            for texts in slices(batch.column(3).filter(pa.array(keep))):
                sets = shingles(texts)
                n, c1, c2 = _class_hashes(sets)
                yield pa.RecordBatch.from_arrays([pa.array(c1), pa.array(c2), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(map(_bitmap, sets), pa.binary())], names=["c1", "c2", "elements", "bitmap"])

    return docs.select(*at, "text").mapInArrow(by_batch(run), "c1 long, c2 long, elements binary, bitmap binary")


class _Bitmaps:
    def __init__(self, raw: list[bytes]):
        short = SHORT_BITS // 8
        self.short = np.frombuffer(b"".join(r[:short] for r in raw), np.uint64).reshape(len(raw), -1)
        self.place = np.cumsum([len(r) > short for r in raw]) - 1
        self.large = np.array([len(r) > short for r in raw], bool)
        self.long = np.frombuffer(b"".join(r[short:] for r in raw), np.uint64).reshape(-1, LONG_BITS // 64)

    def apart(self, x: np.ndarray, other: _Bitmaps, y: np.ndarray) -> np.ndarray:
        """A lower bound of the symmetric difference of sets x and y."""
        out = np.bitwise_count(self.short[x] ^ other.short[y]).sum(1).astype(np.int64)
        both = np.flatnonzero(self.large[x] & other.large[y])
        if len(both):
            out[both] = np.bitwise_count(self.long[self.place[x[both]]] ^ other.long[other.place[y[both]]]).sum(1)
        return out


def _with_ends(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("rid").alias(end), F.col(column).alias(f"{column}_{end}")), end)
    return pairs


def _near_enough(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b, n_a, n_b), those that bitmaps don't rule out."""

    def near(batches):
        for t in batches:
            x, y = (_Bitmaps(t.column(f"bitmap_{end}").to_pylist()) for end in "ab")
            every = np.arange(t.num_rows)
            keep = 7 * x.apart(every, y, every) <= t.column("n_a").to_numpy() + t.column("n_b").to_numpy()
            yield t.select(["a", "b"]).filter(pa.array(keep))

    return _with_ends(pairs, sets, "bitmap").select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b").mapInArrow(by_batch(near), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sets link."""

    def linked(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column("elements_a"), t.column("elements_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialize(pairs, "pairs")
    return materialize(_with_ends(pairs, sets, "elements").select("a", "b", "elements_a", "elements_b").mapInArrow(by_batch(linked), "a long, b long"), "verified")


def _pairs_in_lists(nearest: bool):
    """Pairs of different components that meet in a list (or in two chunks of
    it) and that sizes and bitmaps do not rule out: all of them, or for each
    row the nearest one."""

    def pairs(table):
        table = table.sort_by([("token", "ascending"), ("i", "ascending"), ("j", "ascending")])
        token, i, j, rid, n, label, side = (table.column(c).to_numpy() for c in ("token", "i", "j", "rid", "n", "label", "side"))
        outer = table.column("outer").to_numpy(zero_copy_only=False)
        bitmaps = _Bitmaps(table.column("bitmap").to_pylist())
        border = np.flatnonzero((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        found = [np.zeros((0, 3), np.int64)]
        for a, b in zip([0, *border.tolist()], [*border.tolist(), len(token)], strict=True):
            one = i[a] == j[a]
            rows = np.arange(a, b)
            left, right = (rows, rows) if one else (rows[side[a:b] == 0], rows[side[a:b] == 1])
            for k in range(0, len(left), 128):
                x = left[k : k + 128]
                meet = (label[x][:, None] != label[right]) & (4 * np.minimum(n[x][:, None], n[right]) >= 3 * np.maximum(n[x][:, None], n[right]))
                p, q = np.nonzero(meet)
                p, q = x[p], right[q]
                first = (n[p] < n[q]) | ((n[p] == n[q]) & (rid[p] < rid[q]))
                may_link = ~np.where(first, outer[p], outer[q])  # the smaller set's element is one of its rarest seventh
                p, q = p[may_link], q[may_link]
                if one and not nearest:
                    p, q = p[p < q], q[p < q]
                apart = bitmaps.apart(p, bitmaps, q)
                may = 7 * apart <= n[p] + n[q]
                found.append(np.stack([rid[p[may]], rid[q[may]], apart[may]], 1))
        out = np.concatenate(found)
        if nearest:
            out = out[np.lexsort((out[:, 1], out[:, 2], out[:, 0]))]
            out = out[np.unique(out[:, 0], return_index=True)[1]]
        else:
            out = np.unique(np.stack([out[:, :2].min(1), out[:, :2].max(1), out[:, 2]], 1), axis=0) if len(out) else out
        return pa.table({c: pa.array(out[:, k], pa.int64()) for k, c in enumerate(("a", "b", "apart"))})

    return pairs


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """``lists`` with (label, length): those that hold different components."""
    own = lists.join(labels.withColumnRenamed("node", "rid"), "rid")
    held = own.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("length")).filter("low <> high")
    return materialize(hot_join(own, held.select("token", "length", F.col("length").alias("entries")), "token", "entries"), "open")


def _pairs_of_short(opened: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) of different components and sizes that may link, from
    lists of at most SHORT_LIST entries; each pair once."""
    rows = opened.filter(F.col("length") <= SHORT_LIST).groupBy("token").agg(F.collect_list(F.struct("rid", "n", "label")).alias("rows"))

    def may(x, y):
        return (x["label"] != y["label"]) & (F.least(x["n"], y["n"]) * 4 >= F.greatest(x["n"], y["n"]) * 3)

    def pair(x, y):
        first = x["rid"] < y["rid"]
        return F.struct(*[F.when(first, u[c]).otherwise(v[c]).alias(name) for name, c, u, v in (("a", "rid", x, y), ("b", "rid", y, x), ("n_a", "n", x, y), ("n_b", "n", y, x))])

    pairs = F.flatten(F.transform("rows", lambda x, i: F.transform(F.filter(F.slice("rows", i + 2, F.size("rows")), lambda y: may(x, y)), lambda y: pair(x, y))))
    return rows.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def _pairs_of_long(opened: DataFrame, sets: DataFrame, nearest: bool) -> DataFrame:
    """(a, b, apart) of longer lists, whose rows meet chunk by chunk.  Rows of a
    list's largest component stand in one chunk each; the others meet each of
    these chunks, and each other."""
    parts = opened.groupBy("token", "label").agg(F.count("*").alias("rows"))
    most = parts.groupBy("token").agg(F.max_by("label", F.struct("rows", "label")).alias("major"), F.max("rows").alias("many"), (F.sum("rows") - F.max("rows")).alias("few"), F.sum("rows").alias("weight"))
    rows = hot_join(opened, most, "token", "weight").join(sets.select("rid", "bitmap"), "rid")
    place, keys = F.xxhash64("rid"), ("token", "i", "j", "side", "rid", "n", "label", "outer", "bitmap")
    chunks = lambda c: F.ceil(F.col(c) / CHUNK).cast("int")
    large = rows.filter("label = major").withColumns({"i": -1 - F.pmod(place, chunks("many")).cast("int"), "j": F.lit(0), "side": F.lit(0)})
    small = rows.filter("label <> major")
    across = small.withColumn("i", F.explode(F.sequence(-chunks("many"), F.lit(-1)))).withColumns({"j": F.lit(0), "side": F.lit(1)})
    own = small.withColumn("own", F.pmod(place, chunks("few")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks("few") - 1)))
    own = own.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    every = large.select(*keys).unionByName(across.select(*keys)).unionByName(own.select(*keys))
    groups = (parts.agg(F.sum("rows")).first()[0] or 0) // 10_000 + 1
    every = every.withColumn("group", F.pmod(F.xxhash64("token", "i", "j"), F.lit(groups)))
    return every.groupBy("group").applyInArrow(by_group(_pairs_in_lists(nearest)), "a long, b long, apart long")


_ELEMENTS_SQL = "block long, shard int, rids binary, keys binary, count binary"


def _elements(shards: int):
    """Blocks of sets (rid, elements): one row with the sets as they are (shard
    -1), and for each shard the block's different elements with their counts."""

    def sent(block: int, rids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(sets)
        rows = [(block, -1, np.array(rids, np.int64).tobytes(), flat.tobytes(), np.array([len(s) for s in sets], np.uint32).tobytes())]
        key, count = np.unique(flat, return_counts=True)
        shard = key & np.uint64(shards - 1)
        order = np.argsort(shard, kind="stable")
        key, count, cut = key[order], count[order].astype(np.uint32), np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
        rows += [(block, s, None, key[a:b].tobytes(), count[a:b].tobytes()) for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "shard", "rids", "keys", "count"])

    def run(batches):
        block, size = TaskContext.get().partitionId() << 24, 0
        rids: list = []
        sets: list[np.ndarray] = []
        for t in batches:
            for rid, own in zip(t.column(0).to_pylist(), t.column(1), strict=True):
                rids.append(rid)
                sets.append(np.frombuffer(own.as_py(), np.uint64))
                size += len(sets[-1])
                if size >= BLOCK_ELEMENTS or len(sets) >= BLOCK_ROWS:
                    yield sent(block, rids, sets)
                    block, size, rids, sets = block + 1, 0, [], []
        if sets:
            yield sent(block, rids, sets)

    return run


def _repeated(table):
    """One shard: of each block's elements, those that occur twice or more, with
    their counts over all blocks."""
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    count = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("count").to_pylist()])
    _, group = np.unique(np.concatenate(keys), return_inverse=True)
    df = np.bincount(group, count)[group].astype(np.uint32)
    rows, at = [], 0
    for block, own in zip(table.column("block").to_pylist(), keys, strict=True):
        some = df[at : at + len(own)]
        if (some > 1).any():
            rows.append((block, own[some > 1].tobytes(), some[some > 1].tobytes()))
        at += len(own)
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.table({"block": pa.array(columns[0], pa.int64()), "keys": pa.array(columns[1], pa.binary()), "count": pa.array(columns[2], pa.binary())})


def _rarest(table):
    """One block: the list entries of its sets, by the counts of all shards."""
    shard = table.column("shard").to_pylist()
    home, back = shard.index(-1), [i for i, s in enumerate(shard) if s != -1]
    raw = {c: table.column(c).to_pylist() for c in ("keys", "count")}
    flat, size = np.frombuffer(raw["keys"][home], np.uint64), np.frombuffer(raw["count"][home], np.uint32).astype(np.int64)
    rid = np.frombuffer(table.column("rids")[home].as_py(), np.int64)
    key = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(raw["keys"][i], np.uint64) for i in back]])
    count = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(raw["count"][i], np.uint32) for i in back]])
    order = np.argsort(key)
    key, count = np.append(key[order], np.uint64(0)), np.append(count[order], np.uint32(1))
    place = np.searchsorted(key[:-1], flat)
    df = np.where(key[place] == flat, count[place], np.uint32(1))
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((flat, df, row))
    flat, df = flat[order], df[order]
    at = np.arange(len(flat)) - (np.cumsum(size) - size)[row]
    inner, outer = (size - (-(-k * size // m)) + 1 for k, m in ((6, 7), (3, 4)))
    keep = (df > 1) & (at < outer[row])
    row, at = row[keep], at[keep]
    return pa.table({"token": pa.array(flat[keep].view(np.int64)), "rid": pa.array(rid[row]), "n": pa.array(size[row]), "outer": pa.array(at >= inner[row])})


def rare_lists(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """(token, rid, n, outer): for the classes in ``chosen`` (rid), lists of the
    rarest elements of their whole sets, counted among these classes.

    Of two sets that link, the smaller has at most a seventh of its elements
    outside the other one, the larger at most a quarter.  So the rarest element
    that they share is among the smaller's ``n - ceil(6n/7) + 1`` rarest and the
    larger's ``n - ceil(3n/4) + 1`` rarest; ``outer`` marks what only a larger
    set may be met by.  Elements that occur once make no list.

    Elements are counted as packed arrays, by block and shard as those of the
    prefixes: only entries of lists become rows."""
    own = materialize(sets.join(chosen, "rid", "left_semi").select("rid", "n", "elements"), "own")
    size = own.agg(F.sum("n")).first()[0] or 0
    shards = 1 << max(3, (8 * size // SHARD_BYTES).bit_length())
    posted = materialize(own.select("rid", "elements").mapInArrow(by_batch(_elements(shards)), _ELEMENTS_SQL), "elements")
    delete_table(own)
    counted = posted.filter("shard >= 0").select("block", "shard", "keys", "count").groupBy("shard").applyInArrow(by_group(_repeated), "block long, keys binary, count binary")
    both = posted.filter("shard = -1").unionByName(counted.withColumns({"shard": F.lit(0), "rids": F.lit(None).cast("binary")}))
    lists = materialize(both.groupBy("block").applyInArrow(by_group(_rarest), "token long, rid long, n long, outer boolean"), "rare")
    delete_table(posted)
    return lists


def _with_hubs(opened: DataFrame, turn: int) -> DataFrame:
    """(a, b): every class with that hub of another component which it shares
    most lists with; a list's hub is picked by a seeded hash."""
    pick = F.xxhash64(F.lit(turn), "rid")
    hubs = opened.groupBy("token").agg(F.min_by(F.struct("rid", "n", "label"), pick).alias("hub"), F.count("*").alias("weight"))
    met = hot_join(opened, hubs, "token", "weight").filter((F.col("label") != F.col("hub.label")) & (F.least("n", "hub.n") * 4 >= F.greatest("n", "hub.n") * 3))
    best = met.groupBy("rid", F.col("hub.rid").alias("hub")).count().groupBy("rid").agg(F.max_by("hub", F.struct("count", "hub")).alias("b"))
    return best.select(F.col("rid").alias("a"), "b")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after new links: components are found among labels alone."""
    if links.isEmpty():
        return labels
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end)
    moved = components(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
    sizes = labels.groupBy("label").agg(F.count("*").alias("nodes"))
    moved = moved.select(F.col("node").alias("label"), F.col("label").alias("new")).join(sizes, "label")
    return materialize(hot_join(labels, moved, "label", "nodes", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def _join_lists(lists: DataFrame, sets: DataFrame, rounds: int) -> DataFrame:
    """(node, label): the component of every class."""
    # stored: labels outlive the sets
    alone = materialize(sets.select(F.col("rid").alias("node"), F.col("rid").alias("label")), "labels")
    every = lists.withColumn("label", F.col("rid"))
    labels = _relabelled(alone, _verified(_with_hubs(every, 0), sets))
    opened = _open_lists(lists, labels)
    labels = _relabelled(labels, _verified(_near_enough(_pairs_of_short(opened), sets), sets))
    long = materialize(opened.filter(F.col("length") > SHORT_LIST).select("token", "rid", "n"), "long")
    delete_table(opened)
    for turn in range(1, HUB_ROUNDS + 1):
        opened = _open_lists(long, labels)
        if opened.isEmpty():
            return labels
        labels = _relabelled(labels, _verified(_with_hubs(opened, turn), sets))
        delete_table(opened)
    opened = _open_lists(long, labels)
    delete_table(long)
    if opened.isEmpty():
        return labels
    lists = rare_lists(sets, opened.select("rid").distinct())
    delete_table(opened)
    for turn in range(rounds + 1):
        opened = _open_lists(lists, labels)
        pairs = _pairs_of_long(opened, sets, nearest=turn < rounds)
        if turn < rounds:
            pairs = pairs.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        labels = _relabelled(labels, _verified(pairs, sets))
        delete_table(opened)
    delete_table(lists)
    return labels


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every row of ``docs``.

    ``class_id`` is the smallest doc_id with the same set, ``component_id`` the
    smallest that links lead to.  Both are the own doc_id for an empty set.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(3, (size // SHARD_BYTES).bit_length())
    posted = materialize(post(docs, shards), "posted")
    rows = materialize(posted.filter("rid is not null").select("doc_id", "rid", "n", "c1", "c2"), "rows")
    classes = materialize(rows.filter("n > 0").groupBy("n", "c1", "c2").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "classes")
    elements = posted.filter("shard >= 0").select("block", "shard", "keys", "idx", "count")
    shared = elements.groupBy("shard").applyInArrow(by_group(_shared_elements), "block long, keys binary, idx binary, count binary")
    home = posted.filter("shard = -1").select("block", "shard", "keys", "idx", "count")
    both = home.unionByName(shared.select("block", F.lit(0).alias("shard"), "keys", "idx", "count"))
    maybe = both.groupBy("block").applyInArrow(by_group(_candidates), _CANDIDATES)
    maybe = materialize(maybe.join(rows, "rid").select("n", "c1", "c2", "tokens", "scan_cost", "subset_cost"), "maybe")
    delete_table(posted)
    # of a class whose rows lie in several blocks, one row goes on
    once = maybe.groupBy("n", "c1", "c2").agg(F.first("tokens").alias("tokens"), F.first("scan_cost").alias("scan_cost"), F.first("subset_cost").alias("subset_cost"))
    once = once.join(classes, ["n", "c1", "c2"])
    once = materialize(once.select(F.col("rep").alias("rid"), "n", "c1", "c2", "class_id", "tokens", "scan_cost", "subset_cost"), "survivors")
    delete_table(maybe)
    lists = materialize(inverted_lists(once, size_boundary(once)), "entries")
    several = lists.groupBy("token").agg(F.count("*").alias("entries")).filter("entries > 1")
    entries, lists = lists, materialize(hot_join(lists, several, "token", "entries").select("token", "rid", "n"), "lists")
    delete_table(entries)
    chosen = once.join(lists.select("rid").distinct(), "rid", "left_semi")
    chosen = materialize(chosen.select("rid", "n", "c1", "c2", "class_id"), "chosen")
    delete_table(once)
    sets = _set_rows(docs, chosen.select(F.col("class_id").alias("id"))).join(chosen.drop("class_id"), ["c1", "c2"])
    sets = materialize(sets.groupBy("rid", "n").agg(F.first("elements").alias("elements"), F.first("bitmap").alias("bitmap")), "sets")
    labels = _join_lists(lists, sets, rounds)
    for table in (lists, sets, chosen):
        delete_table(table)
    placed = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    lowest = placed.groupBy("label").agg(F.min("class_id").alias("component_id"), F.count("*").alias("classes"))
    placed = materialize(hot_join(placed, lowest, "label", "classes").select("n", "c1", "c2", "class_id", "component_id", "copies"), "placed")
    keyed = placed.withColumn("key", F.struct("n", "c1", "c2")).select("key", "class_id", "component_id", "copies")
    out = hot_join(rows.withColumn("key", F.struct("n", "c1", "c2")), keyed, "key", "copies", "left")
    own = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
