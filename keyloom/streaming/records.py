"""Typing records as a stream: attempts are appended, taken back and resumed, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from . import runs

PRESS, UNDO, RESTART, ACCEPT, SKIP, TAKE_BACK = "press", "undo", "restart", "accept", "skip", "take_back"
ROW = "source string, at int, pad string, target string, keys string, times array<long>"
LOG = f"{ROW}, kept boolean, nth int"


class Recorder(StatefulProcessor):
    """One source. Presses gather until they are accepted as the attempt at the present phrase; then, or when it is skipped,
    the next phrase is on. Taking back goes to the phrase before: its row is retracted, and its presses are in hand
    again, moved so that the last of them is now. At the first phrase there is nothing to take back."""

    def init(self, handle) -> None:
        self.hand = handle.getValueState("hand", "position int, nth int, keys string, times array<long>")
        self.rows = handle.getMapState("rows", "at int", "keys string, times array<long>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Rows that were recorded before: the sitting resumes one past the last of them."""
        r = initialState
        self.rows.updateValue((r.at,), (r.keys, list(r.times)))
        at = self.hand.get()[0] if self.hand.exists() else 0
        self.hand.update((max(at, r.at + 1), 0, "", []))

    def handleInputRows(self, key, rows, timerValues):
        position, nth, keys, times = self.hand.get() if self.hand.exists() else (0, 0, "", [])
        times = list(times)
        for r in sorted(rows, key=lambda r: (r.ms, r.event_id)):
            if r.kind == PRESS:
                keys, times = keys + r.digit, [*times, r.ms]
            elif r.kind == UNDO:
                keys, times = keys[:-1], times[:-1]
            elif r.kind == RESTART:
                keys, times = "", []
            elif r.kind in (ACCEPT, SKIP):
                if keys and r.kind == ACCEPT:
                    nth += 1
                    self.rows.updateValue((position,), (keys, times))
                    yield Row(source=key[0], at=position, pad=r.pad, target=r.target, keys=keys, times=times, kept=True, nth=nth)
                position, keys, times = position + 1, "", []
            elif r.kind == TAKE_BACK and position:
                position, keys, times = position - 1, "", []
                if self.rows.exists() and self.rows.containsKey((position,)):
                    keys, old = self.rows.getValue((position,))
                    self.rows.removeKey((position,))
                    times = [t + r.ms - old[-1] for t in old]
                    nth += 1
                    yield Row(source=key[0], at=position, pad=None, target=None, keys=None, times=None, kept=False, nth=nth)
        self.hand.update((position, nth, keys, times))


def recorded(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """events(source, event_id, ms, kind, digit, pad, target) as a stream of log rows. before: records() that are there
    when the stream first starts. The events of a batch count in order of ms, those of later batches as later."""
    start = before.groupBy("source") if before is not None else None
    return events.groupBy("source").transformWithState(Recorder(), LOG, "append", "none", start)


def appended(log: DataFrame, at: str) -> None:
    """Runs the stream to its present end. Each batch is one folder under its number, and a batch that is run again, as
    after a failure, replaces its own: no row is there twice, and none is lost."""
    spark = log.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/log/batch={number}")

    before = spark.conf.get(runs.PROVIDER, None)
    spark.conf.set(runs.PROVIDER, runs.ROCKS)
    try:
        log.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(runs.PROVIDER, before) if before else spark.conf.unset(runs.PROVIDER)


def records(spark: SparkSession, at: str) -> DataFrame:
    """What the log says now: of each phrase of a source its last row, unless that was taken back."""
    log = spark.read.schema(f"{LOG}, batch long").parquet(f"{at}/log")
    last = log.groupBy("source", "at").agg(F.max_by(F.struct("pad", "target", "keys", "times", "kept"), F.struct("batch", "nth")).alias("r"))
    return last.where("r.kept").select("source", "at", "r.pad", "r.target", "r.keys", "r.times")


def gaps(times):
    """Milliseconds before each press; 0 before the first."""
    return F.transform(times, lambda t, i: F.when(i == 0, F.lit(0)).otherwise(t - F.get(times, i - 1)))


def resumed(rows: DataFrame) -> DataFrame:
    """Where a sitting of each source goes on: one past the last phrase that is recorded, however many were skipped."""
    return rows.groupBy("source").agg((F.max("at") + 1).alias("position"))
