"""Batches of raw observations: validated whole or rejected whole, and appended
once however often they are delivered.  Refused rows go to a table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog import schema as S
from tidelog.operators.quality import COMPANION_TYPES
from tidelog.operators.scans import append
from tidelog.sources import validation

#: Limits of one batch.
MOST_ROWS, MOST_BYTES = 1000, 2 << 20


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of JSON arrays or lines; payload objects stay JSON text."""
    return spark.read.schema(S.RAW_DDL).json(path, multiLine=True)


def check(raw: DataFrame, deletion_provider: str | None = None) -> DataFrame:
    """Raw rows with ``problem``: why a row may not be ingested, or null.  Each
    row is judged by its own payload, whatever other rows share its id.  Only
    ``deletion_provider``, if given, may send deletions."""
    rows = validation.judged(raw)
    problem = (
        F.when(F.col("id").isNull() | F.col("ts").isNull() | F.col("data_type").isNull(), "missing envelope")
        .when(~F.col("confidence").between(0, 1) | F.isnan("confidence") | F.col("confidence").isNull(), "confidence")
        .when(~F.col("data_type").isin(*COMPANION_TYPES), "type not allowed")
    )
    if deletion_provider is not None:
        problem = problem.when((F.col("data_type") == S.DELETION) & ~F.col("provider_id").eqNullSafe(deletion_provider), "provider of a deletion")
    return rows.select(*raw.columns, problem.otherwise(F.col("payload_problem")).alias("problem"))


def reviewed(raw: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch, rows, bytes, reason) of every batch; reason is null where it may
    be ingested, else the limit that it exceeds or its first row's problem."""
    checked = check(raw)
    first = F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("id")))
    sums = checked.groupBy(batch).agg(F.count("*").alias("rows"), F.sum(F.octet_length("payload")).alias("bytes"), F.coalesce(first, F.min("problem")).alias("problem"))
    reason = F.when(F.col("rows") > MOST_ROWS, f"over {MOST_ROWS} rows").when(F.col("bytes") > MOST_BYTES, f"over {MOST_BYTES} bytes").otherwise(F.col("problem"))
    return sums.select(batch, "rows", "bytes", reason.alias("reason"))


def accepted(raw: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows of the batches that have no reason against them."""
    good = reviewed(raw, batch).filter("reason is null")
    return raw.join(good.select(batch), batch, "left_semi")


def refused(raw: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows of the batches that have a reason against them, with that reason as
    ``batch_reason`` and their own ``problem``, if they have one."""
    bad = reviewed(raw, batch).filter("reason is not null").select(batch, F.col("reason").alias("batch_reason"))
    return check(raw).join(bad, batch)


def ingest_stream(spark: SparkSession, landing: str, table: str, checkpoint: str, files: int = 16, quarantine: str | None = None) -> StreamingQuery:
    """Lands JSON-lines batches (a file each) in the table, once; what is refused
    lands in ``quarantine``, a folder for each micro-batch that a repeated one
    replaces."""
    source = spark.readStream.schema(S.RAW_DDL).option("maxFilesPerTrigger", files).json(landing)

    def land(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("batch_id", F.input_file_name())
        if quarantine:
            refused(rows).write.mode("overwrite").parquet(f"{quarantine}/epoch={epoch}")
        append(accepted(rows).drop("batch_id"), table)

    return source.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
