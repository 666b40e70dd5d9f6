"""Streams with keyed state: deduplication and 28-day vitals.

Both keep their state by subject in RocksDB (:func:`keyed_state` sets it up) and
drop it by event-time timers, so a silent subject leaves nothing behind.

* :func:`first_wins`: a row passes if no row that passed before, in this or an
  earlier batch, has its id or its content.
* :func:`vital_history`: the rows that vitals are computed from.  Later rows
  replace those of the same id, deletions by the same provider take rows away,
  also ones that come later, and what is older than 28 days before the
  subject's latest row goes.  For each subject that a batch touches all of its
  retained rows come out, so that :func:`vitals_query` can apply the batch
  definitions to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tidelog import schema as S
from tidelog.operators.quality import content_key
from tidelog.operators.stored import stored
from tidelog.plans import vitals
from tidelog.plans.windows import DAY

HISTORY = 28 * DAY
#: The types that vitals are made of.
VITAL_TYPES = (S.RESTING_HR, S.HRV, S.SLEEP, S.SPO2, S.RESPIRATORY, S.WRIST_TEMPERATURE)
#: How late a row may be, in seconds.
LATENESS = 2 * DAY


def keyed_state(spark: SparkSession) -> None:
    """The state store that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _timed(stream: DataFrame, lateness: int) -> DataFrame:
    return stream.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", f"{lateness} seconds")


class _FirstWins(StatefulProcessor):
    """Ids and contents of the rows that passed, with their times."""

    def __init__(self, columns: list[str], lateness: int):
        self.columns, self.lateness = columns, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getMapState("ids", "id string", "ts bigint")
        self.contents = handle.getMapState("contents", "content string", "ts bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["created_at", "id", "content"], kind="stable")
        passed = []
        for at, i, content, ts in zip(batch.index, batch["id"], batch["content"], batch["ts"], strict=True):
            if not self.ids.containsKey((i,)) and not self.contents.containsKey((content,)):
                self.ids.updateValue((i,), (int(ts),))
                self.contents.updateValue((content,), (int(ts),))
                passed.append(at)
        if passed:
            self.handle.registerTimer((int(batch["ts"].max()) + self.lateness + 1) * 1000)
        yield batch.loc[passed, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Copies of a row as old as the watermark would be dropped as late."""
        gone = timerValues.getCurrentWatermarkInMs() // 1000
        for state in (self.ids, self.contents):
            for k in [k for k, v in state.iterator() if v[0] < gone]:
                state.removeKey(k)
        yield pd.DataFrame(columns=self.columns)


def first_wins(stream: DataFrame, lateness: int = LATENESS) -> DataFrame:
    """Raw rows whose id and content are new to their subject.  A copy may come
    up to ``lateness`` seconds after the latest row; later ones are dropped as late."""
    keyed_state(stream.sparkSession)
    kinds = stream.schema
    rows = _timed(stream.withColumn("content", content_key()), lateness)
    return rows.groupBy("subject_id").transformWithStateInPandas(_FirstWins(stream.columns, lateness), outputStructType=kinds, outputMode="Append", timeMode="EventTime")


class _VitalHistory(StatefulProcessor):
    """A subject's retained rows by id, and deletions by target and provider."""

    def __init__(self, schema: StructType, history: int):
        self.schema, self.history = schema, history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "id string", self.schema)
        self.deleted = handle.getMapState("deleted", "target string, provider string", "ts bigint")
        self.latest = handle.getValueState("latest", "ts bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = self.schema.names
        id_at, ts_at, provider_at = names.index("id"), names.index("ts"), names.index("provider_id")
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["created_at", "id"], kind="stable")
        latest = self.latest.get()[0] if self.latest.exists() else None
        for row in batch[[*names, "data_type", "target_id"]].itertuples(index=False, name=None):
            *values, kind, target = (None if pd.isna(v) else v for v in row)
            if kind == S.DELETION:
                self.deleted.updateValue((target, values[provider_at]), (int(values[ts_at]),))
            else:
                self.rows.updateValue((values[id_at],), tuple(values))
                latest = max(values[ts_at], latest if latest is not None else values[ts_at])
        if latest is None:
            yield pd.DataFrame(columns=names)
            return
        kept = []
        for row_id, row in list(self.rows.iterator()):
            if row[ts_at] < latest - self.history or self.deleted.containsKey((row_id[0], row[provider_at])):
                self.rows.removeKey(row_id)
            else:
                kept.append(tuple(row))
        for mark, at in list(self.deleted.iterator()):
            if at[0] < latest - 2 * self.history:
                self.deleted.removeKey(mark)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.latest.update((int(latest),))
        self.handle.registerTimer((int(latest) + self.history + 1) * 1000)
        yield pd.DataFrame(kept, columns=names).astype(object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Any row that can still come is over 28 days later than what is kept."""
        for state in (self.rows, self.deleted, self.latest):
            state.clear()
        yield pd.DataFrame(columns=self.schema.names)


#: What vitals read; other columns come out as nulls.
_VITAL_COLUMNS = ("id", "subject_id", "ts", "provider_id", "data_type", "confidence", "created_at", "src_kind", "bpm", "rmssd_ms", "sdnn_ms", "hrv_method", "start_s", "end_s", "stage", "spo2_percent", "breaths_per_min", "celsius")


def vital_history(stream: DataFrame, history: int = HISTORY, lateness: int = LATENESS) -> DataFrame:
    """Of a stream of typed observations: all retained vital rows of each subject
    that a micro-batch touches."""
    keyed_state(stream.sparkSession)
    rows = _timed(stream.filter(F.col("data_type").isin(*VITAL_TYPES, S.DELETION)), lateness)
    schema = stream.select(*_VITAL_COLUMNS).schema
    return rows.groupBy("subject_id").transformWithStateInPandas(_VitalHistory(schema, history), outputStructType=schema, outputMode="Update", timeMode="EventTime")


def all_vitals(rows: DataFrame) -> dict[str, DataFrame]:
    """The daily vitals by name."""
    makers = (vitals.resting_heart_rate, vitals.hrv_vs_baseline, vitals.sleep_stages, vitals.night_spo2, vitals.respiratory_rate, vitals.wrist_temperature)
    return {f.__name__: f(rows) for f in makers}


def vitals_query(stream: DataFrame, out: str, checkpoint: str, every: str | None = None, history: int = HISTORY, lateness: int = LATENESS) -> StreamingQuery:
    """Writes the vitals of the subjects that each micro-batch touched, a table
    ``<out>/<vital>`` each, in a folder of the batch that a repeated batch
    replaces.  A subject's latest batch holds its current vitals."""

    def step(batch: DataFrame, epoch: int) -> None:
        rows = stored(batch)
        if rows.isEmpty():
            return
        for name, found in all_vitals(rows).items():
            found.write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")

    writer = vital_history(stream, history, lateness).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def current_vitals(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A vital's rows of each subject's latest batch."""
    rows = spark.read.parquet(f"{out}/{name}")
    last = rows.groupBy("subject_id").agg(F.max("epoch").alias("epoch"))
    return rows.join(last, ["subject_id", "epoch"], "left_semi").drop("epoch")
