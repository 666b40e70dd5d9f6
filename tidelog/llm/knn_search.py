"""Exact top-k search by a Voronoi kNN join under the inner product.

Vectors are assigned to the nearest of some pivots, whose number grows with the
root of the rows (up to PIVOT_BYTES of them, which tasks hold).  A summary
holds each cell's count and radius.  Queries are first answered within their own
cell, which gives each a score to beat; the summary then bounds what another
cell can offer (pivot score plus query length times radius), and a query goes on
to just the cells that may beat or tie it.  Cells and their queries are split
into blocks, so a cell may hold any share of the rows.  Each block pair is
solved locally by one matrix product.

Components are ``floor(scale * x)``; vectors that are null or hold null or
non-finite components take no part; shorter vectors count as filled up with
zeros.  Ties go to the smaller id.  A query is not its own answer: rows with its
id are left out.  Of repeated ids each row counts: each query row has its own k
answers, and an id can be an answer by several rows.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.shared import materialize

#: Rows that a pivot is made from, and bytes of all pivots.
ROWS_A_PIVOT, PIVOT_BYTES = 16, 8 << 20
#: Scores of rows against pivots, and components of rows sent on, at a time.
SCORES, SENT = 1 << 22, 1 << 21
DATA_BLOCK, QUERY_BLOCK = 16384, 8192
_SOLVED = "ask long, query_id long, vec_id long, score long"


def _chunks(rows: int, width: int, most: int = SCORES) -> Iterator[slice]:
    step = max(1, most // max(1, width))
    return (slice(i, min(i + step, rows)) for i in range(0, rows, step))


def nearest(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of each vector's nearest pivot, the first of equals."""
    out, half = np.zeros(len(vectors), np.int32), (pivots**2).sum(1) / 2
    for part in _chunks(len(vectors), len(pivots)):
        out[part] = (half - vectors[part] @ pivots.T).argmin(1)
    return out


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of the sample after a few rounds of k-means.  The sample is at most
    ROWS_A_PIVOT times the pivots, and scored SCORES at a time."""
    centres = sample[:: max(1, len(sample) // max(1, count))][:count].astype(np.float64)
    for _ in range(5):
        near = nearest(sample, centres)
        order, sizes = np.argsort(near, kind="stable"), np.bincount(near, minlength=len(centres))
        used = np.flatnonzero(sizes)
        sums = np.add.reduceat(sample[order], (np.cumsum(sizes) - sizes)[used], axis=0)
        centres[used] = sums / sizes[used, None]
    return centres


def _vectors(column, dims: int) -> np.ndarray:
    """(rows x dims) integers of a list column, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(lists), dims))
    out[np.arange(dims) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _solve(asks, query_ids, queries, least, vec_ids, vectors, k: int):
    """Best k of the block for each query, of at least its least score."""
    order = np.argsort(vec_ids, kind="stable")
    vec_ids, vectors = vec_ids[order], vectors[order]
    whole = max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1]) < 2**53
    own_from, own_to = (np.searchsorted(vec_ids, query_ids, side) for side in ("left", "right"))
    out_v, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    counts = np.zeros(len(queries), np.int64)
    for a in range(0, len(queries), 256):
        part = queries[a : a + 256]
        scores = part @ vectors.T if whole else (part.astype(np.int64) @ vectors.astype(np.int64).T)
        for i, row in enumerate(scores):
            q = a + i
            others = np.ones(len(row), bool)
            others[own_from[q] : own_to[q]] = False
            rest = row[others] if own_to[q] > own_from[q] else row
            bound = max(np.partition(rest, len(rest) - k)[len(rest) - k], least[q]) if len(rest) > k else least[q]
            at = np.flatnonzero((row >= bound) & others)
            at = at[np.argsort(-row[at], kind="stable")[:k]]
            counts[q] = len(at)
            out_v.append(vec_ids[at])
            out_s.append(row[at].astype(np.int64))
    return pa.table({"ask": np.repeat(asks, counts), "query_id": np.repeat(query_ids, counts), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})


def _solver(k: int, dims: int):
    def solve(queries, data):
        if not queries.num_rows or not data.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("ask", "query_id", "vec_id", "score")})
        asks, ids = queries.column("ask").to_numpy(), queries.column("query_id").to_numpy()
        return _solve(asks, ids, _vectors(queries.column("vector"), dims), queries.column("least").to_numpy(), data.column("vec_id").to_numpy(), _vectors(data.column("vector"), dims), k)

    return solve


def _in_blocks(queries: DataFrame, data: DataFrame, cells: DataFrame, k: int, dims: int) -> DataFrame:
    """Solves queries (ask, query_id, vector, least, cell) against data (row,
    vec_id, vector, cell) of the same cell, block by block.  ``cells`` has the
    rows and queries of each cell that is asked (cell, n, asked), a row a pivot."""

    def blocks(count: str, most: int) -> Column:
        return F.ceil(F.col(count) / most).cast("int")

    cells = F.broadcast(cells.select("cell", blocks("n", DATA_BLOCK).alias("dbs"), blocks("asked", QUERY_BLOCK).alias("qbs")))
    data = data.join(cells, "cell").withColumn("db", F.pmod(F.xxhash64("row"), "dbs").cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)))
    queries = queries.join(cells, "cell").withColumn("qb", F.pmod(F.xxhash64("ask"), "qbs").cast("int")).withColumn("db", F.explode(F.sequence(F.lit(0), F.col("dbs") - 1)))
    keys = ["cell", "db", "qb"]
    # both sides come from one table: the data's columns get names of their own
    queries, data = queries.select(*keys, "ask", "query_id", "vector", "least"), data.select(*[F.col(c).alias(c) for c in (*keys, "vec_id", "vector")])
    return queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(_solver(k, dims), _SOLVED)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query row."""
    spark = vectors.sparkSession
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    usable = vectors.filter(x.isNotNull() & F.col(id_col).isNotNull()).filter(finite)
    usable = usable.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"))
    facts = usable.agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("dims")).first()
    rows, dims = facts["rows"], facts["dims"] or 0
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    count = int(np.clip(np.sqrt(rows) / 8, 1, max(1, PIVOT_BYTES // (8 * max(1, dims)))))
    sample = usable.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(count * ROWS_A_PIVOT).toArrow()
    pivots = pivots_of(_vectors(sample.column("vector"), dims), count)

    def assign(batches):
        for t in batches:
            v = _vectors(t.column(1), dims)
            cell = nearest(v, pivots)
            away = np.sqrt(((v - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(cell), pa.array(away)], names=["vec_id", "vector", "asks", "row", "cell", "away"])

    placed = materialize(usable.mapInArrow(assign, "vec_id long, vector array<double>, asks boolean, row long, cell int, away double"), "cells")
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked"), F.max("away").alias("radius")).collect()  # a row for each pivot
    cells = spark.createDataFrame([(r["cell"], r["n"], r["asked"]) for r in summary], "cell int, n long, asked long")
    radius = np.full(len(pivots), -1.0)
    for r in summary:
        radius[r["cell"]] = r["radius"]
    data = placed.select("row", "vec_id", "vector", "cell")
    queries = placed.filter("asks").select(F.col("row").alias("ask"), F.col("vec_id").alias("query_id"), "vector", "cell")
    near = _in_blocks(queries.withColumn("least", F.lit(float("-inf"))), data, cells.filter("asked > 0"), k, dims)
    near = materialize(_best(near, k).drop("rank"), "own_cell")
    beat = near.groupBy("ask").agg(F.count("*").alias("have"), F.min("score").alias("low"))
    beat = beat.select("ask", F.when(F.col("have") >= k, F.col("low").cast("double")).alias("low"))

    def further(batches):
        for t in batches:
            v = _vectors(t.column(1), dims)
            least = t.column(3).to_numpy(zero_copy_only=False)
            own = t.column(2).to_numpy()
            length = np.sqrt((v**2).sum(1))
            for part in _chunks(len(v), len(pivots)):
                reach = v[part] @ pivots.T + length[part, None] * radius
                # a hair of slack for rounding; the bound only decides where to look
                may = (reach * (1 + 1e-9 * np.sign(reach)) + 1e-6 >= least[part, None]) & (radius >= 0)
                may[np.arange(len(may)), own[part]] = False
                asks, cell = np.nonzero(may)
                asks += part.start
                for some in _chunks(len(asks), dims, SENT):
                    q, to = pa.array(asks[some]), pa.array(cell[some].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([t.column(0).take(q), t.column(1).take(q), pa.array(least[asks[some]]), to, t.column(4).take(q)], names=["query_id", "vector", "least", "cell", "ask"])

    asking = queries.join(beat, "ask", "left").select("query_id", "vector", "cell", F.coalesce("low", F.lit(float("-inf"))).alias("least"), "ask")
    sent = materialize(asking.mapInArrow(further, "query_id long, vector array<double>, least double, cell int, ask long"), "sent")
    asked = cells.drop("asked").join(sent.groupBy("cell").agg(F.count("*").alias("asked")), "cell")
    found = near.unionByName(_in_blocks(sent, data, asked, k, dims))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
