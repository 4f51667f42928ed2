"""Streams that end themselves: flags are looked at when a batch has ended, and stop the query between two batches.

``Patience`` follows a score from batch to batch, in ``foreachBatch``; its memory is a small file in a shared folder, so a query that is started
again from its checkpoint goes on waiting where it was. ``stop_when`` watches any flag, as a control file. Batches that are under way
end first: nothing is lost, and a later start goes on behind them.
"""

from __future__ import annotations

import json
import math
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class _Watcher(StreamingQueryListener):
    def __init__(self, query: StreamingQuery, flag: Callable[[int], bool]):
        self.query, self.flag = query, flag

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) == str(self.query.id) and self.flag(event.progress.batchId):
            # A listener must not wait for the query that waits for it.
            threading.Thread(target=self.query.stop, daemon=True).start()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def stop_when(query: StreamingQuery, flag: Callable[[int], bool]) -> StreamingQueryListener:
    """Stop a query after the first batch whose number ``flag`` answers with true; the listener, for ``spark.streams.removeListener``."""
    watcher = _Watcher(query, flag)
    SparkSession.active().streams.addListener(watcher)
    return watcher


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def flagged(spark: SparkSession, path: str) -> Callable[[int], bool]:
    """Whether a control file is there, in any store that Spark writes."""

    def look(_: int) -> bool:
        system, place = _store(spark, path)
        return system.exists(place)

    return look


class Patience:
    """Counts the batches in a row whose score didn't better the best by more than ``least_gain``; ``memory`` is a file in a shared folder."""

    def __init__(self, spark: SparkSession, memory: str, score: Column, patience: int = 10, least_gain: float = 0.0, maximise: bool = False):
        self.spark, self.memory, self.score = spark, memory, score
        self.patience, self.least_gain, self.sign = patience, least_gain, 1.0 if maximise else -1.0
        self.ended = False

    def state(self) -> dict:
        system, place = _store(self.spark, self.memory)
        if not system.exists(place):
            return {"best": None, "waited": 0, "batch": -1}
        stream = system.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def watch(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``. A batch that comes again counts once; one without a score betters nothing, an empty one doesn't count."""
        row = batch.selectExpr("count(*) AS n").first(), batch.agg(self.score.alias("score")).first()
        held = self.state()
        if number <= held["batch"] or not row[0]["n"]:
            return
        score = row[1]["score"]
        better = score is not None and not math.isnan(score) and (held["best"] is None or self.sign * (score - held["best"]) > self.least_gain)
        held = {"best": score if better else held["best"], "waited": 0 if better else held["waited"] + 1, "batch": number}
        system, place = _store(self.spark, self.memory)
        stream = system.create(place, True)
        try:
            stream.write(bytearray(json.dumps(held).encode()))
        finally:
            stream.close()
        self.ended = self.ended or held["waited"] >= self.patience

    def over(self, _: int = 0) -> bool:
        """Whether the patience has ended, even if a batch that was under way then has bettered the best."""
        return self.ended
