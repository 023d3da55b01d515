"""The object store: ranges, bounds, commits and deletions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from larkspur.sources import objects

ROWS = [("t1", "f1", "a b.txt", b"no line end"), ("t1", "f2", "n.bin", bytes(range(256)) * 50), ("t2", "f1", "e", b"")]


@pytest.fixture
def root(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    objects.put(spark.createDataFrame(ROWS, "tenant_id string, file_id string, filename string, content binary").repartition(3), path)
    return path


def whole(df):
    out = {}
    for r in df.orderBy("offset").collect():
        key = (r["tenant_id"], r["file_id"], r["filename"])
        out[key] = out.get(key, b"") + bytes(r["piece"])
    return out


def test_one_object_per_row_comes_back(spark, root, tmp_path):
    assert whole(objects.pieces(spark, root, piece=1000, task=3000)) == {r[:3]: r[3] for r in ROWS}
    assert (tmp_path / "store/tenants/t1/files/f1/a b.txt").read_bytes() == b"no line end"
    assert not list((tmp_path / "store").glob("_staged/*"))
    rows = objects.pieces(spark, root, piece=1000, task=3000).where("filename = 'n.bin'")
    assert [(r["offset"], len(r["piece"])) for r in rows.orderBy("offset").collect()] == [(i, min(1000, 12_800 - i)) for i in range(0, 12_800, 1000)]


def test_listing_and_bounds(spark, root):
    got = sorted(map(tuple, objects.objects(spark, root).collect()))
    assert got == sorted((*r[:3], len(r[3])) for r in ROWS)
    assert {r["file_id"] for r in objects.objects(spark, root, tenant_id="t1").collect()} == {"f1", "f2"}
    assert objects.objects(spark, root, tenant_id="t1", file_id="f2").count() == 1 and objects.objects(spark, root, filename="e").count() == 1
    assert objects.objects(spark, root, tenant_id="none").collect() == [] and objects.objects(spark, root + "-none").collect() == []


def test_pushed_filters_bound_the_listing(spark, root):
    reader = objects.PushingReader({"path": root})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("tenant_id",), "t2"), GreaterThan(("size",), 3)]))
    assert rest == [GreaterThan(("size",), 3)] and [p.key for p in reader.partitions()] == [("t2", "f1", "e")]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert {r["tenant_id"] for r in objects.pieces(spark, root).where("tenant_id = 't1'").collect()} == {"t1"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_large_object_is_read_by_several_tasks(spark, tmp_path):
    """One gigabyte of zeros: rows of a megabyte from sixteen tasks."""
    folder = tmp_path / "store/tenants/t/files/big"
    folder.mkdir(parents=True)
    with open(folder / "zeros", "wb") as out:
        out.truncate(1 << 30)
    df = objects.pieces(spark, f"file://{tmp_path}/store", piece=1 << 20)
    assert df.rdd.getNumPartitions() == 16
    got = df.select(F.spark_partition_id().alias("p"), F.length("piece").alias("n"), F.md5("piece").alias("h")).groupBy("p").agg(F.sum("n").alias("n"), F.collect_set("h").alias("h")).collect()
    assert sum(r["n"] for r in got) == 1 << 30 and len(got) == 16 and {h for r in got for h in r["h"]} == {hashlib.md5(bytes(1 << 20)).hexdigest()}


def test_a_failed_write_leaves_nothing(spark, root, tmp_path):
    rows = spark.range(4).select(F.lit("t9").alias("tenant_id"), F.col("id").alias("file_id"), F.lit("x").alias("filename"), F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise("y").alias("content"))
    with pytest.raises(Exception, match="lost"):
        objects.put(rows, root)
    assert objects.objects(spark, root, tenant_id="t9").collect() == [] and objects.objects(spark, root).count() == 3
    objects.clear_staged(root)
    assert not list((tmp_path / "store").glob("_staged/*"))


def test_deletion_as_rows(spark, root):
    gone = spark.createDataFrame([("t1", "f2", "n.bin"), ("t1", "f9", "z")], "tenant_id string, file_id string, filename string")
    assert sorted((r["file_id"], r["deleted"]) for r in objects.delete(gone, root).collect()) == [("f2", True), ("f9", False)]
    assert objects.objects(spark, root).count() == 2
