"""Shared folder handling: lineage is cut by tables that every executor can read."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset and the master
    is local (tests), a temporary one that is then set on the context."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and return the table as read back.

    Keeps retries and later jobs from recomputing Python stages, and makes ids
    that depend on the partitioning stable.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    for made in _open[-1:]:
        made.append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


#: Paths of the tables made so far in each open :func:`scratch`.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized within the block are deleted at its end.
    What is needed later must be materialized outside it, or by :func:`kept`."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def delete_table(table: DataFrame) -> None:
    """Deletes a table of :func:`materialize` that nothing needs any more."""
    delete(table.sparkSession, table.stored_at)


#: A key is hot from this share of all rows, so at most so many keys are.
HOT_KEYS = 1000


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) with ``keyed``, which has one row
    for each key and, as ``weight``, how many rows the key may meet; the weight
    is dropped.  Keys of at least one HOT_KEYS-th of all weights are at most
    HOT_KEYS many: these are broadcast, so that their rows stay spread over all
    tasks, and only the rest is shuffled by key.  Rows are told apart by a filter
    on the hashes of the hot keys, so each row goes through one join; a key that
    shares such a hash counts as hot."""
    keyed = materialize(keyed, "keyed")
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    found = keyed.filter((F.col(weight) * HOT_KEYS >= max(1, total)) & (F.col(weight) > 1)).select(F.xxhash64(key)).distinct().collect()
    kind, given = keyed.schema[key].dataType, keyed.drop(weight)
    names = list(dict.fromkeys([*rows.columns, *given.columns]))
    if not found:
        return rows.join(given, key, how).select(*names)
    hashes = ", ".join(f"{r[0]}L" for r in found)
    hot, is_hot = F.expr(f"xxhash64(`{key}`) IN ({hashes})"), F.expr(f"xxhash64(cast(`{key}` AS {kind.simpleString()})) IN ({hashes})")
    met = rows.filter(is_hot).join(F.broadcast(given.filter(hot)), key, how).select(*names)
    return met.unionByName(rows.filter(~is_hot).join(given.filter(~hot), key, how).select(*names))


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame, name: str = "t") -> DataFrame:
    """As :func:`materialize`, but the table outlives the enclosing scratch."""
    held, _open[:] = list(_open), []
    try:
        return materialize(df, name)
    finally:
        _open[:] = held
