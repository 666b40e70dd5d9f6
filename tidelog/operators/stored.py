"""Intermediate tables that are written once, to cut lineage in loops."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; where that is unset
    and the master is local (tests), in a temporary one that is then set on the
    context."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.sparkContext.setCheckpointDir(top)
    return os.path.join(top.rstrip("/"), f"stored-{uuid.uuid4().hex}")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table at a path of its own."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
