"""Progress of running conversions: a listener that turns query progress into counters, and ordered release of frames from a stream.

The event-time parts are an extension; the batch operators know no event time.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType


@dataclass(frozen=True)
class Snapshot:
    """Counters that never fall."""

    rows: int
    batches: int
    rate: float


class Progress(StreamingQueryListener):
    """Calls observe(Snapshot) after each batch. If it raises, the query is stopped and the error is kept."""

    def __init__(self, spark, observe: Callable[[Snapshot], None]):
        self.spark, self.observe, self.error = spark, observe, None
        self.rows = self.batches = 0
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        with self.lock:
            self.rows += event.progress.numInputRows
            self.batches += 1
            snapshot = Snapshot(self.rows, self.batches, event.progress.processedRowsPerSecond)
        try:
            self.observe(snapshot)
        except Exception as e:  # the observer's own error cancels the run
            self.error = e
            query = self.spark.streams.get(str(event.progress.id))
            if query is not None:
                query.stop()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


class Heartbeat:
    """Calls beat(files done, files running, seconds) each interval while a job of files runs, from Spark's own counts of tasks, and once at the end. A task is a file.

    with Heartbeat(spark, print): convert(...).collect()
    """

    def __init__(self, spark, beat: Callable[[int, int, float], None], interval: float = 0.25):
        self.context, self.beat, self.interval = spark.sparkContext, beat, interval
        self.group, self.ended = f"wavegrid-{id(self)}", threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _counts(self) -> tuple[int, int]:
        tracker, done, live = self.context.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else []:
                s = tracker.getStageInfo(stage)
                done, live = done + (s.numCompletedTasks if s else 0), live + (s.numActiveTasks if s else 0)
        return done, live

    def _run(self) -> None:
        while not self.ended.wait(self.interval):
            self.beat(*self._counts(), time.monotonic() - self.began)

    def __enter__(self) -> Heartbeat:
        self.began = time.monotonic()
        self.context.setJobGroup(self.group, "files")
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.ended.set()
        self.thread.join()
        self.beat(*self._counts(), time.monotonic() - self.began)
        self.context.setLocalProperty("spark.jobGroup.id", None)


class _Ordered(StatefulProcessor):
    """Holds frames until all before them have come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", StructType([StructField("frame", LongType())]))
        self.held = handle.getMapState("held", StructType([StructField("frame", LongType())]), StructType([StructField("samples", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        for pdf in rows:
            for frame, samples in zip(pdf["frame"].tolist(), pdf["samples"].tolist(), strict=True):
                self.held.updateValue((int(frame),), (int(samples),))
        at = self.next.get()[0] if self.next.exists() else 0
        out = []
        while self.held.containsKey((at,)):
            out.append((key[0], at, self.held.getValue((at,))[0]))
            self.held.removeKey((at,))
            at += 1
        self.next.update((at,))
        yield pd.DataFrame(out, columns=["stream", "frame", "samples"])

    def close(self) -> None:
        pass


def ordered_drain(frames: DataFrame) -> DataFrame:
    """A stream of (stream string, frame, samples) in any order, as the same rows in each stream's order; a frame that never comes holds back those after it."""
    return frames.groupBy("stream").transformWithStateInPandas(_Ordered(), "stream string, frame long, samples long", "append", "none")


def windowed(events: DataFrame, width: str, late: str, time: str = "ts", value: str = "x") -> DataFrame:
    """Counts and sums of a stream's samples by event-time windows; what comes later than late is dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), "stream")
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("stream", F.col("window.start").alias("start"), "n", "total")
