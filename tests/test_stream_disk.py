"""What ingestion into versioned tables puts on disk: chunks once, no copies that stay, old buckets as they are."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larkspur.operators.packing import chunk_hierarchy
from larkspur.plans.demo import Demo
from larkspur.streaming import ingest
from larkspur.streaming.ingest import ingest_batch, ingest_into, new_store

CHUNKS = "file_id string, parent_index int, child_index int, parent string, parent_tokens int, child string, child_tokens int"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def chunk(files):
    return chunk_hierarchy(files.select("file_id", F.col("content").alias("text")))


def rows(spark, *files):
    made = [(i, f"{i}.txt", c, datetime(2024, 1, 1) + timedelta(minutes=n)) for n, (i, c) in enumerate(files)]
    return spark.createDataFrame(made, ingest.PENDING)


def long_files(first, last):
    rng = random.Random(first)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    return [(str(i), " ".join(f"A{' '.join(word() for _ in range(20))}." for _ in range(150))) for i in range(first, last)]


@pytest.fixture
def store(spark, tmp_path):
    members = spark.createDataFrame([("a", str(i)) for i in range(60)], "kb_id string, file_id string")
    return new_store(spark, f"file://{tmp_path}/store", CHUNKS, members, buckets=3)


def stages(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    context = spark.sparkContext
    found = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.length())]


def moved(done, after):
    """Bytes written, shuffled and spilled by the stages after a number."""
    return sum(s.outputBytes() + s.shuffleWriteBytes() + s.diskBytesSpilled() for s in done if s.stageId() > after)


def shared(spark):
    return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).iterdir()}


def folders(store):
    return {p for ps in store.manifest()["tables"]["chunks"]["files"].values() for p in ps}


def test_chunks_of_a_batch_are_written_once_and_not_shuffled(spark, store, tmp_path):
    batch = rows(spark, *long_files(0, 40)).coalesce(4)
    before, scratch = max(s.stageId() for s in stages(spark)), shared(spark)
    assert ingest_batch(store, batch, 0, chunk)
    size = sum(p.stat().st_size for p in (tmp_path / "store" / "chunks").rglob("*.parquet"))
    assert size > 500_000 and moved(stages(spark), before) < 1.5 * size
    assert not [n for n in shared(spark) - scratch if n.startswith("ingest-chunks")]
    got, wanted = store.read("chunks"), chunk(batch)
    assert got.count() == wanted.count() > 100 and got.exceptAll(wanted).count() == wanted.exceptAll(got).count() == 0
    for b in range(3):
        assert store.read("chunks", buckets=[b]).where(store.bucket_of("chunks") != b).count() == 0
    assert sum(store.read("chunks", buckets=[b]).count() for b in range(3)) == got.count()
    assert spark.conf.get(WRITERS) == "0"


def test_staged_rows_are_not_sorted(spark, store):
    """A sort of more than ten rows would spill here, also the one that Spark turns to when it has too many files open."""
    batch = rows(spark, *long_files(0, 40)).coalesce(2)
    conf, limit = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    before = max(s.stageId() for s in stages(spark))
    conf.set(limit, "10")
    try:
        made = store.staged("chunks", chunk(batch))
    finally:
        conf.remove(limit)
    assert sum(s.diskBytesSpilled() + s.memoryBytesSpilled() for s in stages(spark) if s.stageId() > before) == 0
    assert len(made.made) == 3 and made.rows.count() == chunk(batch).count()


def test_new_files_leave_old_buckets_as_they_are(spark, store):
    ingest_batch(store, rows(spark, *long_files(0, 6)), 0, chunk)
    old = folders(store)
    ingest_batch(store, rows(spark, *long_files(6, 12)), 1, chunk)
    assert old and old < folders(store)
    ingest_batch(store, rows(spark, ("3", "Short now."), ("20", "New.")), 2, chunk)
    got = store.read("chunks").groupBy("file_id").agg(F.max("child").alias("child"), F.count("*").alias("n"))
    said = {r["file_id"]: (r["child"], r["n"]) for r in got.collect()}
    assert said["3"] == ("Short now.", 1) and said["20"] == ("New.", 1) and set(said) == {*map(str, range(12)), "20"}
    assert all(n > 1 for i, (_, n) in said.items() if i not in ("3", "20"))


def test_chunks_that_fail_leave_no_folder(spark, store, tmp_path):
    bad = F.pandas_udf(lambda texts: texts.map(lambda t: 1 // 0), "string")
    with pytest.raises(Exception, match="ZeroDivision"):
        store.staged("chunks", chunk(rows(spark, ("1", "One.")).withColumn("content", bad("content"))))
    made = [p for p in (tmp_path / "store" / "chunks").iterdir() if "/".join(p.parts[-2:]) not in folders(store)]
    assert len(made) == 1 and not list(made[0].rglob("*.parquet")) and spark.conf.get(WRITERS) == "0"  # the first commit's empty one


def test_a_stream_keeps_no_copy_of_its_batches(spark, store, sf_dir, tmp_path):
    scratch = shared(spark)
    pending = Demo(spark, sf_dir).files(Demo(spark, sf_dir).stream("documents")).select(F.col("file_id").cast("string"), "filename", "content", "created_at")
    ingest_into(store, pending, f"file://{tmp_path}/state", chunk).awaitTermination(120)
    assert not [n for n in shared(spark) - scratch if n.startswith(("ingest-batch", "ingest-chunks"))]
    assert store.read("files").count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_the_query_writes_no_copy_of_its_input(spark, sf_dir):
    from larkspur.queries import queries

    scratch = shared(spark)
    assert queries()["stream_versions"](spark, sf_dir).count() > 0
    made = [n for n in shared(spark) - scratch if n.startswith("stream-")]
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    assert made and not [n for n in made if (root / n / "in").exists()]
