"""Streams with state of their own: timers by processing time and entries that expire."""

import time

import pytest

from marginalia.streaming import incremental

EVENTS = "job_id long, ts long, event_id long, status string"


class Feed:
    """A stream over a folder that a test adds rows to, and what it has put out."""

    def __init__(self, spark, folder, kinds, made):
        self.spark, self.folder, self.kinds, self.out, self.n = spark, folder, kinds, [], 0
        (folder / "in").mkdir()
        rows = spark.readStream.schema(kinds).parquet(str(folder / "in"))
        keep = lambda df, _: self.out.extend(map(tuple, df.collect()))
        self.query = made(rows).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", str(folder / "cp")).trigger(processingTime="500 milliseconds").start()

    def add(self, *rows):
        self.n += 1
        self.spark.createDataFrame(list(rows), self.kinds).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def wait(self, wanted, seconds=60):
        """Until the output is as wanted, or the time is over; batches without rows go on for the timers' sake."""
        end = time.time() + seconds
        while time.time() < end and not wanted(self.out):
            time.sleep(0.3)
        return wanted(self.out)


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)


def test_idle_jobs_are_cancelled(few_partitions, tmp_path):
    feed = Feed(few_partitions, tmp_path, EVENTS, lambda rows: incremental.job_states(rows, idle=6))
    try:
        feed.add((1, 0, 0, "PENDING"), (2, 0, 1, "PENDING"), (2, 1, 2, "RUNNING"), (2, 2, 4, "DONE"), (1, 1, 5, "DONE"), (3, 0, 3, "RUNNING"))
        first = [(1, 1, "PENDING"), (2, 1, "PENDING"), (2, 2, "RUNNING"), (2, 3, "DONE")]
        assert feed.wait(lambda out: sorted(out)[:4] == first)
        # job 1 is left open, job 2 is done, job 3 never began
        assert feed.wait(lambda out: (1, 2, "CANCELLED") in out)
        feed.add((1, 2, 6, "RUNNING"), (4, 0, 7, "PENDING"))  # too late for job 1
        assert feed.wait(lambda out: (4, 1, "PENDING") in out)
        assert [x for x in feed.out if x[0] == 1] == [(1, 1, "PENDING"), (1, 2, "CANCELLED")] and len([x for x in feed.out if x[0] == 2]) == 3
    finally:
        feed.query.stop()


def test_states_go_on_after_a_restart(few_partitions, tmp_path):
    out = []
    for rows in ([(1, 0, 0, "PENDING"), (1, 1, 1, "RUNNING")], [(1, 2, 2, "DONE")]):
        few_partitions.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = few_partitions.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        query = incremental.job_states(events).writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(90)
    assert out == [(1, 1, "PENDING"), (1, 2, "RUNNING"), (1, 3, "DONE")]


def test_cache_entries_expire(few_partitions, tmp_path):
    feed = Feed(few_partitions, tmp_path, "client string, n long", lambda rows: incremental.cached(rows, "client", ttl=8))
    try:
        feed.add(("a", 1), ("a", 2), ("b", 1))
        assert feed.wait(lambda out: sorted(out) == [("a", 1, True), ("b", 0, True)])
        time.sleep(9)
        feed.add(("a", 4))
        assert feed.wait(lambda out: out[2:] == [("a", 0, True)])
        feed.add(("a", 5))
        assert feed.wait(lambda out: len(out) == 4)
    finally:
        feed.query.stop()
