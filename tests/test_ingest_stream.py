"""Ingestion into versioned tables: one bad file, one slow file, replays, and the bases to compile."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.operators.packing import chunk_hierarchy
from larkspur.streaming import ingest

CHUNKS = "file_id string, parent_index int, child_index int, parent string, parent_tokens int, child string, child_tokens int"
BEGIN = datetime(2024, 1, 1)


def one(text):
    if text == "slow":
        time.sleep(60)
    if text.startswith("bad"):
        raise ValueError(f"cannot read {text}")
    return text


def chunk(files):
    checked = F.pandas_udf(lambda texts: texts.map(one), "string")
    return chunk_hierarchy(files.select("file_id", checked("content").alias("text")))


def rows(spark, *files):
    made = [(i, f"{i}.txt", c, BEGIN + timedelta(minutes=n)) for n, (i, c) in enumerate(files)]
    return spark.createDataFrame(made, ingest.PENDING)


@pytest.fixture
def store(spark, tmp_path):
    members = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("c", "3")], "kb_id string, file_id string")
    return ingest.new_store(spark, f"file://{tmp_path}/store", CHUNKS, members, buckets=2)


def states(store):
    return {r["file_id"]: (r["status"], r["tries"], r["error"]) for r in store.read("files").collect()}


def triggers(store):
    return sorted((r["kb_id"], r["batch"]) for r in store.read("triggers").collect())


def test_a_bad_file_fails_alone_and_tries_again(spark, store):
    batch = rows(spark, ("1", "One."), ("2", "Two."), ("3", "bad bytes"), ("4", ""), *[(str(i), "More.") for i in range(10, 14)])
    assert ingest.ingest_batch(store, batch, 0, chunk)
    got = states(store)
    assert got.pop("3") == ("pending", 1, "cannot read bad bytes") and got.pop("4") == ("failed", 1, "No content")
    assert set(got.values()) == {("ready", 1, None)} and len(got) == 6
    assert triggers(store) == [("a", 0), ("b", 0)] and store.read("chunks").count() == 6
    for n in (1, 2):
        ingest.ingest_batch(store, rows(spark, ("3", "bad bytes")), n, chunk)
    assert states(store)["3"] == ("failed", 3, "cannot read bad bytes") and store.read("chunks").count() == 6


def test_a_slow_file_is_stopped(spark, store):
    ingest.ingest_batch(store, rows(spark, ("1", "One."), ("2", "slow")), 0, chunk, limit=3)
    assert states(store) == {"1": ("ready", 1, None), "2": ("pending", 1, "Ingestion timed out after 3s")}


def test_a_batch_run_again_changes_nothing(spark, store):
    batch = rows(spark, ("1", "One."), ("3", "Three."))
    assert ingest.ingest_batch(store, batch, 7, chunk)
    before, version = triggers(store), store.version()
    assert not ingest.ingest_batch(store, batch, 7, chunk)
    assert (triggers(store), store.version(), store.read("chunks").count()) == (before, version, 2) and before == [("a", 7), ("c", 7)]


def test_a_batch_cut_off_before_its_commit_is_whole_after_replay(spark, store, monkeypatch):
    batch = rows(spark, ("1", "One."), ("2", "Two."))
    monkeypatch.setattr(store, "_publish", lambda m: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ingest.ingest_batch(store, batch, 0, chunk)
    monkeypatch.undo()
    assert states(store) == {} and store.read("chunks").count() == 0
    assert ingest.ingest_batch(store, batch, 0, chunk) and store.read("chunks").count() == 2 and triggers(store) == [("a", 0), ("b", 0)]


def test_stream_drops_repeats_and_goes_on_after_a_restart(spark, store, tmp_path):
    source = f"{tmp_path}/in"

    def send(*files):
        rows(spark, *files).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(ingest.PENDING).option("maxFilesPerTrigger", 1).parquet(source)
        ingest.ingest_into(store, stream, f"{tmp_path}/state", chunk).awaitTermination(120)

    send(("1", "One."), ("2", "bad"))
    send(("1", "One."), ("3", "Three."))
    run()
    assert states(store) == {"1": ("ready", 1, None), "2": ("pending", 1, "cannot read bad"), "3": ("ready", 1, None)}
    version = store.version()
    run()
    assert store.version() <= version + 1
    send(("4", "Four."))
    run()
    assert states(store)["4"] == ("ready", 1, None) and store.read("chunks").count() == 3
    assert [k for k, _ in triggers(store)] == ["a", "c"]
