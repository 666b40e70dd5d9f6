"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the sorted set of sources that
hold them).  A pattern offers its words once for free, a second time at cost 1
and a third time at cost 2 (convex repetition costs, ``max_repeats`` tiers); a
source asks for its quota.  Patterns that share sources form components, which
Spark solves apart, each by :func:`min_cost_flow`; their input is the aggregated
table only, and a component needs memory for its own arcs.  Each pattern's
words are then taken from its documents in a seeded order: whole passes first,
then documents until the rest is filled, the last one in part (or, with
``whole_documents``, when half of it or more fits).

Null text: size 0.  A null source is a source of its own, sorted last.  A
document of size 0 is kept with 0 words.  Repeated rows count as separate
documents.  An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.components import components
from tidelog.llm.shared import hot_join, materialize
from tidelog.llm.text_arrays import by_batch, by_group, slices

#: Documents of a block, blocks of a stretch, and arcs that are solved in one task.
BLOCK_DOCS, STRETCH, TASK_ARCS = 4096, 4096, 10_000


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """(doc_id, size, *keep): the number of words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    fields = [f for f in chosen.schema.fields if f.name != "text"]

    def run(batches):
        for batch in batches:
            sizes = [np.diff(t.of_rows(t.words()[0])) for t in slices(batch.column(1))]
            columns = [batch.column(0), *[batch.column(i + 2) for i in range(len(keep))]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([*sizes, np.zeros(0, np.int64)]), pa.int64())], names=["doc_id", *keep, "size"])

    return chosen.mapInArrow(by_batch(run), T.StructType([*fields, T.StructField("size", T.LongType())]))


def ranked_sources(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source_key, source_size, target).  Sources in code point order get
    ``weights`` in turn and share all words; a target stops at ``max_repeats``
    times its source's size and the excess is shared again by weight."""
    # Numbers by range partitions: nothing is sorted in one task.
    ordered = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size")).orderBy("source_key")
    ordered = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = ordered.groupBy(part.alias("p")).count().collect()  # a row for each partition
    before, total = {}, 0
    for r in sorted(counts, key=lambda r: r["p"]):
        before[r["p"]] = total
        total += r["count"]
    starts = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.lit(None)
    number = (starts[part] + F.col("at").bitwiseAND((1 << 33) - 1)) if before else F.lit(0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    out = materialize(ordered.select("source_key", "source_size", weight.alias("weight")), "weights")
    level, words = 0.0, float(out.agg(F.sum("source_size")).first()[0] or 0)
    while True:  # ends: a source that has reached its limit never leaves it
        cap = F.col("source_size") * float(max_repeats)
        full = cap <= F.col("weight") * level
        got = out.agg(F.sum(F.when(full, cap)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not got["open"]:
            break
        new = (words - (got["held"] or 0.0)) / got["open"]
        if new <= level * (1 + 1e-12):
            break
        level = new
    return out.select("source_key", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


def min_cost_flow(supply: list[float], members: list[list[int]], quotas: list[float], tiers: int = 3) -> list[float]:
    """How many words to take from each pattern.

    ``supply``: words of a pattern, offered ``tiers`` times at rising cost;
    ``members``: the sources that a pattern can serve; ``quotas``: of sources.
    Costs lie on the supply arcs alone, so successive shortest paths means
    raising all supplies tier by tier and augmenting to a maximum flow each time.
    """
    n, m = len(supply), len(quotas)
    source, sink = n + m, n + m + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, c: float) -> int:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(0.0)
        return len(to) - 2

    offered = [arc(source, p, 0.0) for p in range(n)]
    for p, own in enumerate(members):
        for s in own:
            arc(p, n + s, float("inf"))
    for s, quota in enumerate(quotas):
        arc(n + s, sink, quota)
    for _ in range(tiers):
        for p, e in enumerate(offered):
            cap[e] += supply[p]
        while True:
            depth, queue = {source: 0}, deque([source])
            while queue:
                a = queue.popleft()
                for e in out[a]:
                    if cap[e] > 1e-9 and to[e] not in depth:
                        depth[to[e]] = depth[a] + 1
                        queue.append(to[e])
            if sink not in depth:
                break
            at = [0] * len(out)
            path: list[int] = []
            while True:
                a = to[path[-1]] if path else source
                if a == sink:
                    flow = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                    path = []
                elif at[a] < len(out[a]):
                    e = out[a][at[a]]
                    if cap[e] > 1e-9 and depth.get(to[e]) == depth[a] + 1:
                        path.append(e)
                    else:
                        at[a] += 1
                elif path:
                    at[to[path.pop() ^ 1]] += 1
                else:
                    break
    return [cap[e ^ 1] for e in offered]


def _take_from_patterns(patterns: DataFrame, sources: DataFrame, max_repeats: int) -> DataFrame:
    """(pattern, take): the flow of every component of patterns and sources."""
    steps = F.transform(F.slice("pattern", 2, F.size("pattern")), lambda s, i: F.struct(F.element_at("pattern", i + 1).alias("a"), s.alias("b")))
    links = patterns.filter(F.size("pattern") > 1).select(F.explode(steps).alias("l")).select("l.a", "l.b").distinct()
    labels = components(links).withColumnRenamed("node", "source_key")
    quotas = sources.join(labels, "source_key", "left").select("source_key", "target", F.coalesce("label", "source_key").alias("component"))
    arcs = materialize(patterns.select("pattern", "pattern_words", F.explode("pattern").alias("source_key")).join(quotas, "source_key"), "arcs")
    tasks = max(1, arcs.count() // TASK_ARCS)
    arcs = arcs.withColumn("task", F.pmod(F.xxhash64("component"), F.lit(tasks)))

    def solve(table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("component", "pattern", "source_key", "pattern_words", "target")), strict=True))
        kept, takes = [], []
        for _, own in itertools.groupby(rows, key=lambda r: r[0]):
            own = list(own)
            quota = {r[2]: float(r[4]) for r in own}
            place = {k: i for i, k in enumerate(sorted(quota))}
            supply = {tuple(r[1]): float(r[3]) for r in own}
            members: dict[tuple, list[int]] = {}
            for r in own:
                members.setdefault(tuple(r[1]), []).append(place[r[2]])
            keys = sorted(supply)
            kept += [list(k) for k in keys]
            takes += min_cost_flow([supply[k] for k in keys], [sorted(members[k]) for k in keys], [quota[k] for k in sorted(quota)], max_repeats)
        return pa.table({"pattern": pa.array(kept, pa.list_(pa.string())), "take": pa.array(takes, pa.float64())})

    solved = arcs.groupBy("task").applyInArrow(by_group(solve), "pattern array<string>, take double")
    return solved.select("pattern", F.round("take", 6).alias("take"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 17, whole_documents: bool = False) -> tuple[DataFrame, DataFrame]:
    """Mixes ``docs`` (doc_id, sources array<string>, size).

    Documents are taken in the order of a column ``order`` (long), or of a seeded
    hash of id and size.  Returns the documents with ``taken`` (words, repeats
    counted; never over ``max_repeats`` times the size), their block and the
    whole passes over their pattern, and the sources (source_key, source_size,
    target).  Source keys are ``1`` + name, or ``2`` for null.
    """
    key = F.transform("sources", lambda s: F.coalesce(F.concat(F.lit("1"), s), F.lit("2")))
    docs = docs.withColumn("pattern", F.array_sort(F.array_distinct(key)))
    if "order" not in docs.columns:
        docs = docs.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "size"))
    docs = materialize(docs, "sizes")
    sources = materialize(ranked_sources(docs.select(F.explode("pattern").alias("source_key"), "size"), weights, max_repeats), "targets")
    patterns = docs.groupBy("pattern").agg(F.sum("size").alias("pattern_words"), F.count("*").alias("pattern_docs"))
    takes = materialize(patterns.join(_take_from_patterns(patterns, sources, max_repeats), "pattern"), "takes")

    # Seeded blocks of about BLOCK_DOCS documents spread a large pattern over tasks.
    blocks = F.ceil(F.col("pattern_docs") / BLOCK_DOCS)
    pattern_id = F.xxhash64("pattern")
    rest = F.floor(F.col("take")) - F.floor(F.try_divide(F.col("take"), F.col("pattern_words"))) * F.col("pattern_words")
    info = takes.select(pattern_id.alias("pattern_id"), blocks.alias("blocks"), F.coalesce(F.floor(F.try_divide(F.col("take"), F.col("pattern_words"))), F.lit(0)).alias("passes"), F.coalesce(rest, F.lit(0)).alias("rest"))
    info = info.join(takes.select(pattern_id.alias("pattern_id"), F.col("pattern_docs").alias("weight")), "pattern_id")
    spread = hot_join(docs.withColumn("pattern_id", pattern_id), info, "pattern_id", "weight").withColumn("block", F.pmod("order", "blocks"))
    spread = materialize(spread, "blocks")
    # words before a block: those of earlier stretches, then of earlier blocks of its own
    ahead = spread.groupBy("pattern_id", "block").agg(F.sum("size").alias("words")).withColumn("stretch", F.floor(F.col("block") / STRETCH))
    ahead = materialize(ahead, "ahead")
    earlier = Window.partitionBy("pattern_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = ahead.groupBy("pattern_id", "stretch").agg(F.sum("words").alias("words")).select("pattern_id", "stretch", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("pattern_id", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.withColumn("within", F.coalesce(F.sum("words").over(within), F.lit(0))).join(stretches, ["pattern_id", "stretch"])
    ahead = ahead.select("pattern_id", "block", (F.col("earlier") + F.col("within")).alias("before"))
    run = Window.partitionBy("pattern_id", "block").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("inner", F.coalesce(F.sum("size").over(run), F.lit(0))).join(ahead, ["pattern_id", "block"])
    room = F.col("rest") - F.col("inner") - F.coalesce("before", F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), room))
    if whole_documents:
        part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(0)
    taken = (F.col("passes") * F.col("size") + part).cast("long").alias("taken")
    return placed.select(*docs.columns, "block", "blocks", "passes", taken), sources


def seeded_order(id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> Column:
    """The place of a row in its source's order, from its id and text."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def _mixed_single(docs: DataFrame, text_col: str, source_col: str, seed: int, **options) -> tuple[DataFrame, DataFrame]:
    rows = docs.select("doc_id", F.col(text_col).alias("text"), F.col(source_col).alias("source"), seeded_order("doc_id", text_col, seed).alias("order"))
    sizes = count_words(rows, keep=("source", "order"))
    return mix(sizes.withColumn("sources", F.array("source")), seed=seed, **options)


def mix_single(docs: DataFrame, text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """Mixes documents that have one source each: (doc_id, size, source,
    source_size, target, taken)."""
    mixed, sources = _mixed_single(docs, text_col, source_col, seed, **options)
    out = mixed.withColumn("source_key", F.element_at("pattern", 1)).join(sources, "source_key")
    return out.select("doc_id", "size", "source", "source_size", "target", "taken")


def repeat_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, whole.

    In a source's order the rows that are taken once more than the source's
    whole passes come first, so one row for each source (its passes and the
    last such place) tells how often each document is taken; texts stay where
    they are.  Rows with the same id and text are taken alike.
    """
    mixed, _ = _mixed_single(docs, text_col, source_col, seed, whole_documents=True, **options)
    further = F.when((F.col("taken") > F.col("passes") * F.col("size")), F.struct("block", "order"))
    cuts = mixed.groupBy("source").agg(F.first("passes").alias("_passes"), F.first("blocks").alias("_blocks"), F.max(further).alias("_cut"))
    cuts = materialize(cuts.withColumnRenamed("source", "_source"), "cuts")
    order = seeded_order("doc_id", text_col, seed)
    met = docs.join(cuts, F.col(source_col).eqNullSafe(F.col("_source")))
    place = F.struct(F.pmod(order, F.col("_blocks")).alias("block"), order.alias("order"))
    times = F.col("_passes") + F.coalesce(place <= F.col("_cut"), F.lit(False)).cast("int")
    has_words = F.coalesce(F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    times = F.when(has_words, times).otherwise(0).cast("int")
    return met.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))).select(*[docs[c] for c in docs.columns])
