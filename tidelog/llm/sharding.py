"""Sharding by rendezvous hashing of a stable record key.

Every shard draws a number from the hash of the key and the shard; the shard of
the largest ``-weight / ln(draw)`` takes the record.  A record's draws don't
depend on other shards, so a shard that is added takes records only into itself,
one that is removed gives up only its own, and a weight that rises only draws
records in.  Shares are proportional to the weights.

``slot`` numbers a shard's records without gaps, in the order of key, size and
checksum.  It comes from one range partitioning of narrow rows by (shard, key):
Spark sorts each range by itself and only the ranges' counts, one row a range
and shard, are summed up.  Rows that are equal in all of these are dealt out by
their place in the input, so a key that many rows share is cut as well.

The law is ``key``: the key and the shards alone decide.  Rows of one key meet
in one shard; rows of equal texts do only where they share the key.  A null key
is hashed as an empty one and stands first.  Null texts have a size of 1, the
checksum of no bytes, and stand after no others.  Repeated rows get slots of
their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import materialize

#: Hexadecimal digits of a draw; 52 bits are exact in a double.
DIGITS = 13
#: Rows of a range that one task sorts, and the most ranges: their counts are broadcast.
RANGE_ROWS, MOST_RANGES = 1 << 18, 1 << 14


def draw(key: Column, shard: int, weight: float) -> Column:
    """A shard's claim to a key; the largest wins."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, DIGITS), 16, 10).cast("double")
    return F.lit(-float(weight)) / F.log((bits + 0.5) / float(16**DIGITS))


def _largest(claims: list[Column]) -> Column:
    """The place of the largest; the first among equals."""
    ranked = F.array_max(F.array(*[F.struct(c.alias("claim"), F.lit(-i).alias("at")) for i, c in enumerate(claims)]))
    return (-ranked["at"]).cast("int")


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among shards 0 to len(weights) - 1."""
    if not weights or min(weights) <= 0:
        raise ValueError("give every shard a weight above zero")
    return _largest([draw(F.coalesce(key.cast("string"), F.lit("")), i, w) for i, w in enumerate(weights)])


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * 8, grown_weight: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): size in bytes
    plus one, and the shard that one more shard, of ``grown_weight``, would leave."""
    key = F.col(id_col).cast("long")
    text = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    rows = docs.select(key.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), weights)).withColumn("grown_shard", shard_of(F.col("doc_id"), [*weights, grown_weight]))
    placed = materialize(rows.withColumn("place", F.monotonically_increasing_id()), "placed")
    ranges = min(MOST_RANGES, placed.count() // RANGE_ROWS + 2)
    order = ["shard", "doc_id", "size", "text_crc32", "place"]
    ordered = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ordered = materialize(ordered.select("doc_id", "size", "text_crc32", "shard", "grown_shard", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "ordered")
    counts = ordered.groupBy("part", "shard").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.expr("sum(rows) OVER (PARTITION BY shard ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    starts = counts.select("part", "shard", (before - F.col("first")).cast("long").alias("start"))
    out = ordered.join(F.broadcast(starts), ["part", "shard"])  # at most ranges + shards rows
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("row") + F.col("start")).alias("slot"), "grown_shard")
