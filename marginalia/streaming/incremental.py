"""Incremental scoring and job journals with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..operators.aggregate import GROUP
from ..operators.metrics import score
from ..schema import HISTORY_KEY, OUTPUTS
from ..sources.history_store import History

NEXT = {"PENDING": ("RUNNING", "CANCELLED"), "RUNNING": ("DONE", "FAILED", "CANCELLED")}


def output_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(OUTPUTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_stream(outputs: DataFrame, references: DataFrame, metrics=("cer",), view: str = "text") -> DataFrame:
    """Scores of new outputs against the static references (doc_id, ref)."""
    joined = outputs.join(references, "doc_id").select(F.lit(view).alias("view"), "pipeline", "doc_id", "ref", F.col("content").alias("hyp"))
    return score(joined, metrics)


def running_micro(scores: DataFrame) -> DataFrame:
    """Sums that the micro average is made of; they add up over batches, so state is one row a group."""
    w = F.coalesce("weight", F.lit(0))
    sums = scores.groupBy(*GROUP).agg(F.sum(F.col("value") * w).alias("edits"), F.sum(F.when(F.col("value").isNotNull(), w)).alias("weight"), F.count("value").alias("support"))
    return sums.withColumn("value", F.when(F.col("weight") > 0, F.col("edits") / F.col("weight")))


def upsert_batches(records: DataFrame, path: str, checkpoint: str, key=HISTORY_KEY, every: int = 20) -> StreamingQuery:
    """Each batch once, under its number, into a ``History``; a replayed batch is the same batch."""

    def write(batch: DataFrame, number: int) -> None:
        History(batch.sparkSession, path, tuple(key), every=every).upsert(batch, number)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_records(spark: SparkSession, path: str, key=HISTORY_KEY) -> DataFrame | None:
    return History(spark, path, tuple(key)).latest()


def journal(events: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Events of jobs numbered from 1 in order."""
    from pyspark.sql import Window

    return events.withColumn("seq", F.row_number().over(Window.partitionBy(job).orderBy(*order)))


def replay(journal_rows: DataFrame, job_id, after: int, job: str = "job_id") -> DataFrame:
    """Events of a job after the one with that number."""
    return journal_rows.filter((F.col(job) == job_id) & (F.col("seq") > after)).orderBy("seq")


def with_state_store(spark: SparkSession) -> None:
    """Streams that keep state of their own need the store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Jobs(StatefulProcessor):
    """Status and number of the last event of each job; open jobs have a timer if idle ones are closed."""

    def __init__(self, idle: int | None) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, seq long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, seq, timer = self.job.get() if self.job.exists() else ("", 0, -1)
        out = []
        for new in pd.concat(rows).sort_values(["ts", "event_id"], kind="stable")["status"]:
            if new in NEXT.get(status, ()) or (not status and new == "PENDING"):
                status, seq = new, seq + 1
                out.append((key[0], seq, new))
        if self.idle is not None and out:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = -1
            if status in NEXT:
                timer = timerValues.getCurrentProcessingTimeInMs() + 1000 * self.idle
                self.handle.registerTimer(timer)
        self.job.update((status, seq, timer))
        yield _events(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, seq, timer = self.job.get() if self.job.exists() else ("", 0, -1)
        if timer != expiredTimerInfo.getExpiryTimeInMs() or status not in NEXT:
            yield _events([])
            return
        self.job.update(("CANCELLED", seq + 1, -1))
        yield _events([(key[0], seq + 1, "CANCELLED")])

    def close(self) -> None:
        pass


def _events(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"job_id": pd.Series([r[0] for r in rows], dtype="int64"), "seq": pd.Series([r[1] for r in rows], dtype="int64"), "status": pd.Series([r[2] for r in rows], dtype="object")})


def job_states(events: DataFrame, idle: int | None = None) -> DataFrame:
    """State machine of jobs over a stream of (job_id, status): each accepted event with its number, others dropped.

    A job that is open and has had no accepted event for ``idle`` seconds of processing time
    is cancelled by a timer. State is a row a job.
    """
    with_state_store(events.sparkSession)
    mode = "None" if idle is None else "ProcessingTime"
    return events.groupBy("job_id").transformWithStateInPandas(_Jobs(idle), "job_id long, seq long, status string", "Append", mode)


class _Cache(StatefulProcessor):
    """Keys that were asked for; each is forgotten by the store itself when its time is over."""

    def __init__(self, key: str, ttl: int) -> None:
        self.key, self.ttl = key, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "n long", 1000 * self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = sum(len(frame) for frame in rows)
        known = self.known.exists()
        if not known:
            self.known.update((n,))
        yield pd.DataFrame({self.key: [key[0]], "hits": [n - (not known)], "missed": [not known]})

    def close(self) -> None:
        pass


def cached(requests: DataFrame, key: str, ttl: int = 300) -> DataFrame:
    """Of each batch of requests and each key: how many a cache answers, and whether it had to be filled.

    An entry is forgotten ``ttl`` seconds of processing time after it was made.
    """
    with_state_store(requests.sparkSession)
    kind = requests.schema[key].dataType.simpleString()
    return requests.groupBy(key).transformWithStateInPandas(_Cache(key, ttl), f"`{key}` {kind}, hits long, missed boolean", "Append", "ProcessingTime")


def rate_limited(requests: DataFrame, most: int, seconds: int = 60, key: str = "client", ts: str = "ts") -> DataFrame:
    """Requests a client makes in each fixed window, and how many are over the limit; late windows are dropped after one more."""
    source = requests.withWatermark(ts, f"{seconds} seconds") if requests.isStreaming else requests
    counted = source.groupBy(F.window(ts, f"{seconds} seconds"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("window.start").alias("start"), "n", F.greatest(F.lit(0), F.col("n") - most).alias("refused"))


def progress(units: DataFrame, by: str, order: tuple[str, ...]) -> DataFrame:
    """Finished units with how many of their run are ``done`` and how many there are in ``total``."""
    from pyspark.sql import Window

    run = Window.partitionBy(by)
    return units.withColumns({"done": F.row_number().over(run.orderBy(*order)), "total": F.count(F.lit(1)).over(run)})


class ProgressLog(StreamingQueryListener):
    """Counts the rows that streams have taken in: query name to (batches, rows); hand it to ``spark.streams.addListener``."""

    def __init__(self):
        self.seen: dict[str, tuple[int, int]] = {}

    def onQueryStarted(self, event) -> None:
        self.seen.setdefault(event.name or str(event.id), (0, 0))

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or str(event.progress.id)
        batches, rows = self.seen.get(name, (0, 0))
        self.seen[name] = (batches + 1, rows + event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def sessions(events: DataFrame, key: str, ts: str = "ts", idle: int = 30) -> DataFrame:
    """A client's events between pauses of ``idle`` seconds: start, end (the pause included) and number."""
    source = events.withWatermark(ts, f"{idle} seconds") if events.isStreaming else events
    rows = source.groupBy(F.session_window(ts, f"{idle} seconds").alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def misses(requests: DataFrame, key: str, ts: str = "ts", ttl: int = 300) -> DataFrame:
    """Of a stream of requests those that a cache, which forgets after ``ttl`` seconds of event time, has no answer for."""
    return requests.withWatermark(ts, f"{ttl} seconds").dropDuplicatesWithinWatermark([key])
