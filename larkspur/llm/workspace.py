"""Shared scratch space and small column helpers used by several operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z, for lower-casing ASCII letters only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it.  Only where that is unset, and only on a
    local master, a temporary folder is made and set, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Where new paths are noted, besides: lists of ``recorded`` blocks that are open.
_NOTED: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when Python exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    for noted in _NOTED:
        noted.append(path)
    return path


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Note the scratch paths that are made inside in ``paths``."""
    _NOTED.append(paths)
    try:
        yield
    finally:
        _NOTED.remove(paths)


def release(paths: list[str], still_read: DataFrame) -> None:
    """Remove the noted scratch tables, except those that ``still_read`` reads."""
    files = still_read.inputFiles() if paths else []
    kept = [p for p in paths if any(p.rsplit("/", 1)[-1] in f for f in files)]
    for path in paths:
        if path not in kept:
            _remove(still_read.sparkSession, path)
    paths[:] = kept


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended already
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage; the files are in storage that outlives an executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch = path
    return found


def forget(*tables: DataFrame) -> None:
    """Remove what ``written`` has written for these, which nothing reads any more."""
    for t in tables:
        for path in [t.scratch] if isinstance(t.scratch, str) else t.scratch:
            _remove(t.sparkSession, path)


def united(tables: list[DataFrame]) -> DataFrame:
    """One table of written ones; ``forget`` removes them all."""
    out = reduce(DataFrame.unionByName, tables)
    out.scratch = [t.scratch for t in tables]
    return out


def join_by_hot(rows: DataFrame, side: DataFrame, keys: list[str], share: int = 1_000) -> DataFrame:
    """Inner join of ``rows`` to ``side``, which has one row per key and ``n``, the number of rows with that key.

    Keys that hold over one in ``share`` of all rows that ``side`` counts are fewer than
    ``share``; they are broadcast, and their rows stay where they are.  All
    others are shuffled.
    """
    total = side.agg(F.sum("n").alias("n")).first()["n"] or 0
    is_hot = F.col("n") * share > total
    hot, cold = side.where(is_hot), side.where(~is_hot)
    there = rows.join(F.broadcast(hot), keys)
    return there.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)).drop("n")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character kept."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def key128(value: Column) -> Column:
    """A 128-bit key of a string: two 64-bit hashes with unrelated seeds."""
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))
