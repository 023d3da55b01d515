"""The queue over restarts of its stream."""

import time
from datetime import datetime, timedelta

import pytest

from larkspur.streaming import queue

BEGIN = datetime(2024, 1, 1)


class Driven:
    """A queue stream that reads event files and appends its commands."""

    def __init__(self, spark, root, **options):
        self.spark, self.root, self.options, self.n = spark, root, options, 0
        (root / "events").mkdir()

    def send(self, *events):
        rows = [(e[0].split("/")[0], e[0], e[1], e[2] if len(e) > 2 else None, BEGIN + timedelta(seconds=self.n * 100 + i)) for i, e in enumerate(events)]
        self.spark.createDataFrame(rows, queue.EVENT).coalesce(1).write.mode("append").parquet(f"{self.root}/events")
        self.n, self.sent = self.n + 1, len(rows)

    def start(self, every):
        stream = self.spark.readStream.schema(queue.EVENT).parquet(f"{self.root}/events")
        out = queue.commands(stream, **self.options).writeStream.format("parquet").option("checkpointLocation", f"{self.root}/state")
        return out.trigger(processingTime=every).start(f"{self.root}/commands")

    def run(self):
        """Process all that is there, and stop."""
        q, end = self.start(every="200 milliseconds"), time.monotonic() + 60
        try:
            while sum(p["numInputRows"] for p in q.recentProgress) < self.sent and q.isActive and time.monotonic() < end:
                time.sleep(0.3)
        finally:
            q.stop()
        assert q.exception() is None
        return self.told()

    def told(self):
        rows = self.spark.read.schema(queue.COMMAND).parquet(f"{self.root}/commands").collect()
        return {(r["file_id"], r["action"], r["tries"], r["error"]) for r in rows}


@pytest.fixture
def driven(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", queue.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield lambda **options: Driven(spark, tmp_path, **options)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_order_workers_tries_and_restarts(driven):
    q = driven(workers=2, tries=2, limit=900)
    q.send(*[(f"a/{i}", "enqueue") for i in range(4)], ("a/0", "enqueue"), ("b/9", "enqueue"))
    first = {("a/0", "start", 1, None), ("a/1", "start", 1, None), ("b/9", "start", 1, None)}
    assert q.run() == first
    q.send(("a/0", "done"), ("a/7", "done"))  # each run is a restart from the checkpoint
    second = first | {("a/2", "start", 1, None)}
    assert q.run() == second
    q.send(("a/1", "failed", "bad bytes"), ("a/2", "done"))
    third = second | {("a/3", "start", 1, None), ("a/1", "start", 2, None)}
    assert q.run() == third
    q.send(("a/1", "failed", "bad bytes"), ("a/3", "done"), ("b/9", "failed"))
    last = third | {("a/1", "failed", 2, "bad bytes"), ("b/9", "start", 2, None)}
    assert q.run() == last
    q.send(("a/0", "enqueue"), ("b/9", "failed"))
    assert q.run() == last | {("a/0", "start", 1, None), ("b/9", "failed", 2, "Unexpected ingestion error")}


def test_silent_files_fail_by_deadline(driven):
    q = driven(workers=1, tries=3, limit=2)
    q.send(("a/0", "enqueue"), ("a/1", "enqueue"))
    stream = q.start(every="500 milliseconds")
    try:
        end = time.monotonic() + 90
        want = {("a/0", "failed", 1, "Ingestion timed out after 2s"), ("a/1", "failed", 1, "Ingestion timed out after 2s")}
        while not want <= q.told() and time.monotonic() < end:
            time.sleep(1)
    finally:
        stream.stop()
    assert q.told() == want | {("a/0", "start", 1, None), ("a/1", "start", 1, None)}
