"""Structured Streaming forms: windows, deduplication, stateful trends, merges of batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators.graph import use_checkpoints
from tidewire.streaming.tables import DeltaTable


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder that all executors share."""
    use_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4()}"


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Files of a folder or pattern as a stream; the checkpoint is the cursor."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    df = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)
    local = [f.name for f in schema if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else df


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs what is there, then gives the written rows as a table.  A continuous job
    uses the same stream with ``trigger(processingTime=...)``."""
    spark = stream.sparkSession
    out = shared_folder(spark, name)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def upsert_stream(stream: DataFrame, name: str, step: Callable[[DataFrame], DataFrame], keys: list[str], rules: dict[str, str] | None = None, mode: str = "append", folder: str | None = None, every: str | None = None) -> DataFrame:
    """What ``step`` makes of each batch, one row a key, is merged into a keyed table; late rows merge like any other.

    A batch writes its own keys only (:class:`DeltaTable`).  ``folder`` names the place of the job's state: a
    run that finds one there goes on from the last file seen.  A batch that runs again after a
    failure has its effect once.  ``every`` runs the job on an interval until all input is done, else what is there runs at once.
    """
    spark = stream.sparkSession
    out = folder or shared_folder(spark, name)
    table = DeltaTable(spark, f"{out}/table", keys, rules or {})

    def merge(batch: DataFrame, number: int) -> None:
        table.write(step(batch), number)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{out}/state").outputMode(mode)
    query = writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()
    if every:
        query.processAllAvailable()
        query.stop()
    query.awaitTermination()
    return table.read()


def windowed_counts(stream: DataFrame, time: str, width: str, slide: str | None, *keys: str, late: str = "90 minutes") -> DataFrame:
    """Tumbling or sliding counts with a watermark."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    by = stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def distinct_within(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def seen(batch: DataFrame, key: str, time: str) -> DataFrame:
    """First and last time of each key of a batch; the table keeps the least and the greatest."""
    return batch.groupBy(key).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))


SEEN = {"first_seen": "least", "last_seen": "greatest"}
HOUR = 3_600_000


class Trend(StatefulProcessor):
    """The scores of a key over the last ``keep`` hours.

    A score is compared with the one kept nearest to ``back`` hours before it (the older of equal ones), if that
    is within half of ``back``.  A key is forgotten when the watermark is ``keep`` hours past its last score.
    """

    def __init__(self, key: str, step: float, back: int, keep: int) -> None:
        self.key, self.step, self.back, self.keep = key, step, back * HOUR, keep * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "at array<long>, score array<double>")

    def _kept(self) -> list[tuple[int, float]]:
        have = self.memory.get() if self.memory.exists() else None
        return list(zip(have[0], have[1])) if have else []

    @staticmethod
    def _scores(frame: pd.DataFrame) -> list[tuple[int, float]]:
        """(milliseconds, score) of rows key, time, milliseconds, score; by place, as names don't all arrive."""
        return [(int(t), float(s)) for t, s in zip(frame.iloc[:, -2], frame.iloc[:, -1], strict=True)]

    def _keep(self, rows: list[tuple[int, float]]) -> None:
        rows = [r for r in rows if r[0] >= rows[-1][0] - self.keep]
        self.memory.update(([r[0] for r in rows], [r[1] for r in rows]))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(rows[-1][0] + self.keep)

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame([(key[0], *r) for r in rows], columns=[self.key, "ms", "score", "trend"])
        return frame.astype({"ms": "int64", "score": "float64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted(x for frame in rows for x in self._scores(frame))
        kept, out = self._kept(), []
        for at, value in new:
            near = min(kept, key=lambda r: (abs(at - self.back - r[0]), r[0]), default=None)
            delta = value - near[1] if near is not None and abs(at - self.back - near[0]) <= self.back / 2 else None
            out.append((at, value, "new" if delta is None else "rising" if delta > self.step else "falling" if delta < -self.step else "stable"))
            kept = sorted([*[r for r in kept if r[0] >= at - self.keep], (at, value)])
        self._keep(kept)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self._kept()
        self.memory.clear()
        yield self._rows(key, [(kept[-1][0], kept[-1][1], "expired")] if kept else [])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        self._keep(sorted([*self._kept(), *self._scores(initialState)]))


def trends(stream: DataFrame, key: str, score: str, time: str, step: float, back: int = 24, keep: int = 48, late: str = "0 seconds", initial: DataFrame | None = None) -> DataFrame:
    """(key, at, score, trend) of each score of a key: new, rising, falling or stable against the one ``back``
    hours before; and ``expired`` with its last score when a key is forgotten.

    ``initial`` (key, time, score) is what an earlier job kept.  Scores of a key within one batch are taken
    in order of time; a score older than the watermark (``late`` behind the newest) is dropped, as a stateful stream must.
    """
    ms = F.unix_millis(time).alias("_ms")
    rows = stream.withWatermark(time, late).select(key, time, ms, F.col(score).cast("double").alias(score))
    before = initial.select(key, time, ms, F.col(score).cast("double").alias(score)).groupBy(key) if initial is not None else None
    kind = dict(stream.dtypes)[key]
    out = rows.groupBy(key).transformWithStateInPandas(Trend(key, step, back, keep), f"{key} {kind}, ms bigint, score double, trend string", "Append", "EventTime", before)
    return out.select(key, F.timestamp_millis("ms").alias("at"), "score", "trend")
