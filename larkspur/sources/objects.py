"""An object store as a data source: byte ranges as rows, one object per written row.

Objects lie at ``tenants/<tenant>/files/<file>/<name>`` below the option ``path``.
Reading plans ranges of ``task`` bytes, so a large object is read by several tasks, and
gives rows of ``piece`` bytes, so none is held whole.  Filters by tenant, file and name
are pushed down to the listing where Spark offers them; the options ``tenant_id``, ``file_id`` and
``filename`` always bound it.  Writing stages each row's object; only when all
tasks are done are the staged objects moved to their places; after a failure they are removed, those
of tasks that end later by ``clear_staged``.

Stores are reached through ``pyarrow.fs`` by the path's scheme.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage

KEYS = ("tenant_id", "file_id", "filename")
ROWS = "tenant_id string, file_id string, filename string, size bigint, offset bigint, piece binary"
STAGED = "_staged"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path with or without a scheme, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def object_key(tenant: str, file_id: str, filename: str) -> str:
    return posixpath.join("tenants", tenant, "files", file_id, filename)


def listed(path: str, bounds: dict[str, str]) -> Iterator[tuple[str, str, str, str, int]]:
    """``tenant, file, name``, path in the store and size of the objects within ``bounds``; only folders that can hold some are listed."""
    store, root = place(path)
    depth = [bounds.get(k) for k in KEYS[:2]]
    base = posixpath.join(root, "tenants", *([depth[0], "files", *([depth[1]] if depth[1] else [])] if depth[0] else []))
    for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
        if info.type != fs.FileType.File:
            continue
        parts = posixpath.relpath(info.path, root).split("/")
        if len(parts) != 5 or parts[0] != "tenants" or parts[2] != "files":
            continue
        found = dict(zip(KEYS, (parts[1], parts[3], parts[4]), strict=True))
        if all(found[k] == v for k, v in bounds.items()):
            yield parts[1], parts[3], parts[4], info.path, info.size


@dataclass
class Range(InputPartition):
    key: tuple[str, str, str]
    path: str
    size: int
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.piece, self.task = options["path"], int(options.get("piece", 256 << 10)), int(options.get("task", 64 << 20))
        self.bounds = {k: options[k] for k in KEYS if k in options}
        self.contents = options.get("contents", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        step = max(self.piece, self.task // self.piece * self.piece)
        out: list[InputPartition] = []
        for *key, path, size in listed(self.path, self.bounds):
            ends = range(0, max(size, 1), step) if self.contents else [0]
            out += [Range(tuple(key), path, size, a, min(a + step, size) if self.contents else 0) for a in ends]
        return out or [Range(("", "", ""), "", -1, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.size < 0:
            return
        if partition.start == partition.end:  # an empty object, or a listing
            yield (*partition.key, partition.size, 0, None if partition.size else b"")
            return
        with place(self.path)[0].open_input_file(partition.path) as source:
            for at in range(partition.start, partition.end, self.piece):
                yield (*partition.key, partition.size, at, source.read_at(min(self.piece, partition.end - at), at))


class PushingReader(Reader):
    """For sessions that offer filters: Spark refuses a reader that takes them elsewhere."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in KEYS and f.attribute[0] not in self.bounds:
                self.bounds[f.attribute[0]] = f.value
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    objects: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.path, self.names, self.run = options["path"], names, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        store, root = place(self.path)
        done = []
        for row in rows:
            given = row.asDict()
            staged = posixpath.join(root, STAGED, self.run, uuid.uuid4().hex)
            store.create_dir(posixpath.dirname(staged), recursive=True)
            with store.open_output_stream(staged) as out:
                out.write(bytes(given["content"] or b""))
            done.append((staged, posixpath.join(root, object_key(*(str(given[k]) for k in KEYS)))))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = place(self.path)
        for message in messages:
            for staged, final in message.objects if message else ():
                store.create_dir(posixpath.dirname(final), recursive=True)
                store.move(staged, final)
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*place(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        folder = posixpath.join(root, STAGED, self.run)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class Objects(DataSource):
    """``spark.read.format("objects").option("path", ...)``; ``write`` takes ``tenant_id, file_id, filename, content``."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> Reader:
        return (PushingReader if self.options.get("push") == "true" else Reader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema.names)


def _read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(Objects)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("objects").options(path=path, push=push, **options).load()


def pieces(spark: SparkSession, path: str, piece: int = 256 << 10, task: int = 64 << 20, **bounds: str) -> DataFrame:
    """Rows of ``ROWS``: the bytes of all objects, or of a tenant's, a file's or a name's."""
    return _read(spark, path, piece=piece, task=task, **bounds)


def objects(spark: SparkSession, path: str, **bounds: str) -> DataFrame:
    """``tenant_id, file_id, filename, size`` of the objects; contents aren't read."""
    return _read(spark, path, contents="false", **bounds).select(*KEYS, "size")


def put(rows: DataFrame, path: str) -> None:
    """One object per row of ``tenant_id, file_id, filename, content``; all of them or none."""
    rows.sparkSession.dataSource.register(Objects)
    told: list[Column] = [F.col(k).cast("string").alias(k) for k in KEYS]
    rows.select(*told, F.col("content").cast("binary").alias("content")).write.format("objects").mode("append").option("path", path).save()


def clear_staged(path: str) -> None:
    """Remove what tasks that outlived a failed write have staged; no write may be under way."""
    store, root = place(path)
    folder = posixpath.join(root, STAGED)
    if store.get_file_info(folder).type == fs.FileType.Directory:
        store.delete_dir(folder)


def delete(rows: DataFrame, path: str) -> DataFrame:
    """``tenant_id, file_id, filename, deleted`` for each of ``rows``; objects that aren't there stay false.  Deletes when it is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = place(path)
        for batch in batches:
            paths = [posixpath.join(root, object_key(*key)) for key in batch[list(KEYS)].itertuples(index=False)]
            there = [i.type == fs.FileType.File for i in store.get_file_info(paths)] if paths else []
            for p, known in zip(paths, there, strict=True):
                if known:
                    store.delete_file(p)
            yield batch.assign(deleted=there)

    return rows.select(*KEYS).mapInPandas(run, "tenant_id string, file_id string, filename string, deleted boolean")
