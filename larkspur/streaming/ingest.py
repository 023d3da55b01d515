"""Incremental ingestion: a file stream is the work queue, its checkpoint the queue's state."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.operators.packing import chunk_hierarchy
from larkspur.sources.scratch import held, written
from larkspur.sources.versioned import Change, Store, delete, merge, replace


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, bytes_per_batch: int = 4 << 30):
    """Chunk pending files as they come and publish them: chunks first, then the ready marker.

    Each batch writes to its own folder, replaced if the batch is run again, so
    a restart neither loses nor repeats rows.  A batch is bounded by its bytes, not by a number of
    files, so it has work for all executors and the number of batches doesn't follow that of
    files.  Returns the started query.
    """
    pending = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(source).where("status = 'pending'")

    def publish(batch: DataFrame, number: int) -> None:
        chunks = chunk_hierarchy(batch.select("file_id", F.col("content").alias("text")))
        chunks.write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
        ready = batch.select("file_id").join(spark.read.parquet(f"{target}/chunks/batch={number}").select("file_id").distinct().withColumn("ok", F.lit(True)), "file_id", "left")
        status = F.when(F.col("ok"), "ready").otherwise("failed")
        ready.select("file_id", status.alias("status")).write.mode("overwrite").parquet(f"{target}/files/batch={number}")

    return pending.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bases_to_compile(ready: DataFrame, members: DataFrame) -> DataFrame:
    """Knowledge bases that hold a file which has just become ready."""
    return members.join(ready.where("status = 'ready'"), "file_id", "left_semi").select("kb_id").distinct()


def watch(updates: DataFrame, minutes: float = 10) -> DataFrame:
    """``file_id, status`` of files whose status hasn't moved on from ``processing`` in time.

    ``updates`` is a stream of ``file_id string, status string``.  Run it with a
    processing-time trigger: a timer that waits keeps an ``availableNow`` run open.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"file_id": [key[0]], "status": ["pending"]})
            return
        last = None
        for batch in rows:
            last = batch["status"].iloc[-1]
        if last == "processing":
            state.update((last,))
            state.setTimeoutDuration(int(minutes * 60_000))
        elif state.exists:
            state.remove()

    return updates.groupBy("file_id").applyInPandasWithState(step, "file_id string, status string", "status string", "append", GroupStateTimeout.ProcessingTimeTimeout)


PENDING = "file_id string, filename string, content string, created_at timestamp"
KEYS = {"files": ["file_id"], "chunks": ["file_id"], "triggers": ["kb_id", "batch"], "members": ["kb_id", "file_id"], "batches": ["batch"]}


class _Limited:
    """Runs a job under a limit of seconds; past it, the job is cancelled and fails."""

    def __init__(self, spark: SparkSession, limit: float) -> None:
        self.spark, self.context, self.limit, self.group, self.late = spark, spark.sparkContext, limit, f"ingest-{uuid.uuid4().hex}", False

    def __enter__(self) -> _Limited:
        self.before = self.context.getLocalProperty("spark.jobGroup.id")
        self.context.setJobGroup(self.group, "ingest", interruptOnCancel=True)
        self.timer = threading.Timer(self.limit, self._cancel)
        self.timer.start()
        return self

    def _cancel(self) -> None:
        self.late = True
        self.context.cancelJobGroup(self.group)

    def __exit__(self, *error) -> None:
        self.timer.cancel()
        self.context.setLocalProperty("spark.jobGroup.id", self.before)
        if self.late:
            _settle(self.spark)


def _settle(spark: SparkSession, quiet: int = 3, most: int = 40) -> None:
    """Small Python jobs until ``quiet`` of them have run in a row.

    A cancelled task may leave a Python worker half closed to the next one, which then fails.  With one try a
    task, as on a local master, that would be another job's failure.
    """
    rows = spark.range(0, 64, 1, 2 * spark.sparkContext.defaultParallelism)
    done = 0
    for _ in range(most):
        try:
            rows.mapInPandas(lambda batches: batches, rows.schema).write.format("noop").mode("overwrite").save()
            done += 1
        except Py4JJavaError:
            done = 0
        if done == quiet:
            return


def isolated(
    batch: DataFrame, chunk: Callable[[DataFrame], DataFrame], stage: Callable[[DataFrame], Change], limit: float = 900, depth: int = 40
) -> tuple[list[Change], list[tuple[str, str]]]:
    """Chunks of the files of ``batch``, written by ``stage``, and ``file_id, error`` of those that can't be chunked.

    All files are tried together; a part that fails, or takes over ``limit`` seconds, is halved by the hash of
    its ids until the bad file is alone.
    """
    spark = batch.sparkSession
    made: list[Change] = []
    bad: list[tuple[str, str]] = []
    parts = [(batch, 0)]
    while parts:
        part, level = parts.pop()
        watch = _Limited(spark, limit)
        try:
            with watch:
                made.append(stage(chunk(part)))
            continue
        except Exception as failed:
            error = f"Ingestion timed out after {limit:g}s" if watch.late else _first_line(failed)
        ids = [r["file_id"] for r in part.select("file_id").distinct().limit(2).collect()]
        if len(ids) < 2 or level == depth:
            bad += [(i, error) for i in ids[:1]] if len(ids) < 2 else [(r["file_id"], error) for r in part.select("file_id").distinct().collect()]
            continue
        side = F.shiftrightunsigned(F.xxhash64("file_id"), level).bitwiseAND(1)
        parts += [(part.where(side == s), level + 1) for s in (0, 1)]
    return made, bad


def _first_line(failed: Exception) -> str:
    found = re.findall(r"^(?:Caused by: )?(?:\S+(?:Exception|Error): )(?:\[\S+\] )?(.+)$", str(failed), re.M)
    return (found[-1] if found else str(failed).splitlines()[0])[:500]


def ingest_batch(store: Store, batch: DataFrame, number: int, chunk: Callable[[DataFrame], DataFrame], limit: float = 900, most_tries: int = 3) -> bool:
    """One batch as one version of ``store``: chunks, states of files, and the bases to compile; whether it was new.

    The version holds the batch's number, so a batch that is run again after a restart changes nothing.  A bad
    file gets its error and one try more; it is ``pending`` again until its tries are used up.
    """
    spark, manifest = batch.sparkSession, store.manifest()
    if store.read("batches", manifest=manifest).where(F.col("batch") == number).head(1):
        return False
    known = store.read("files", manifest=manifest)
    tried = batch.join(known.select("file_id", "tries"), "file_id", "left").select("file_id", (F.coalesce("tries", F.lit(0)) + 1).alias("tries"))
    tried = written(tried, "ingest-files")
    made, bad = isolated(batch, chunk, lambda rows: store.staged("chunks", rows), limit)
    some = reduce(DataFrame.unionByName, [m.rows.select("file_id") for m in made]).distinct() if made else spark.createDataFrame([], "file_id string")
    failed = spark.createDataFrame(bad, "file_id string, error string")
    told = tried.join(some.withColumn("ok", F.lit(True)), "file_id", "left").join(failed, "file_id", "left")
    error = F.when(F.col("ok"), F.lit(None)).otherwise(F.coalesce("error", F.lit("No content")))
    again = F.col("error").isNotNull() & (F.col("tries") < most_tries)
    status = F.when(F.col("ok"), "ready").when(again, "pending").otherwise("failed")
    states = written(told.select("file_id", status.alias("status"), "tries", error.alias("error")), "ingest-states")
    bases = bases_to_compile(states, store.read("members", manifest=manifest)).withColumn("batch", F.lit(number).cast("long"))
    changes = {"files": merge(states), "triggers": merge(bases), "batches": merge(spark.createDataFrame([(number,)], "batch long"))}
    if made:  # chunks of a file that is read again take the place of the old ones; those of new files touch no bucket
        changes["chunks"] = [delete(some.join(known, "file_id", "left_semi")), *made]
    store.commit(changes, f"batch {number}", onto=manifest["version"])
    return True


def new_store(spark: SparkSession, path: str, chunk_columns: str, members: DataFrame, buckets: int = 16) -> Store:
    """A store with the tables that ingestion fills; ``members (kb_id, file_id)`` says who asks for files."""
    store = Store(spark, path, KEYS, buckets)
    none = lambda shape: replace(spark.createDataFrame([], shape))
    store.commit({
        "files": none("file_id string, status string, tries int, error string"), "chunks": none(chunk_columns), "triggers": none("kb_id string, batch long"),
        "members": replace(members.select("kb_id", "file_id")), "batches": none("batch long"),
    }, "new")
    return store


def ingest_into(store: Store, pending: DataFrame, checkpoint: str, chunk: Callable[[DataFrame], DataFrame], limit: float = 900, within: str = "1 hour"):
    """Start ingesting a stream of ``PENDING`` rows; a file that comes twice ``within`` a time is read once.

    Publication, states and the bases to compile are one version a batch.
    """
    once = pending.withWatermark("created_at", within).dropDuplicatesWithinWatermark(["file_id"])

    def run(batch: DataFrame, number: int) -> None:
        with held(batch, "ingest-batch") as rows:
            ingest_batch(store, rows, number, chunk, limit)

    return once.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
