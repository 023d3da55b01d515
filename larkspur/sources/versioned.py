"""Tables with versions: Parquet below a folder, and a manifest per version that names what belongs to it.

A store holds several tables.  Each is dealt into buckets by the hash of its key.  A
commit first writes new data to folders that no manifest names yet, then publishes the
next manifest by a rename that fails if that version exists.  So a commit changes all
its tables or none, a torn write is never seen, readers keep the version they began with,
and of two writers one gets ``Conflict``.  Changes by key rewrite only the buckets that
they touch.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

BUCKET = "__bucket"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def _has_map(kind: DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


class Conflict(Exception):
    """Another writer has published the version that this commit was to become."""


@dataclass(frozen=True)
class Change:
    """``kind`` is replace, append, merge (rows with new values for their keys) or delete (keys).

    ``dealt`` rows hold their bucket, lie in tasks by it and are written from there.
    ``made`` names the folders of rows that ``Store.staged`` has written already, by bucket.
    """

    kind: str
    rows: DataFrame
    dealt: bool = False
    made: dict[str, list[str]] | None = None


def replace(rows: DataFrame) -> Change:
    return Change("replace", rows)


def append(rows: DataFrame, dealt: bool = False) -> Change:
    return Change("append", rows, dealt)


def merge(rows: DataFrame) -> Change:
    """Rows that take the place of those with their key, or are new; each key once."""
    return Change("merge", rows)


def delete(keys: DataFrame) -> Change:
    return Change("delete", keys)


class Store:
    """Tables below ``path``; ``keys`` names the key columns of each, ``buckets`` how many parts it has.

    A bucket is written by up to ``spread`` tasks, so that a key which repeats often isn't one task's work.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, Sequence[str]] | None = None, buckets: int = 16, spread: int = 4) -> None:
        self.spark, self.path, self.spread = spark, path.rstrip("/"), spread
        self.keys, self.buckets = {k: list(v) for k, v in (keys or {}).items()}, buckets
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._jvm, self._at = jvm, lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self._fs = self._at("").getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), conf)

    # ---- versions

    def versions(self) -> list[int]:
        place = self._at("_versions")
        if not self._fs.exists(place):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(place)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The last version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}}
        stream = self._fs.open(self._at(f"_versions/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def history(self) -> list[dict]:
        """``version, note, at`` and the changed tables of every version that is still there."""
        told = [self.manifest(v) for v in self.versions()]
        return [{k: m[k] for k in ("version", "note", "at", "changed")} for m in told]

    def _publish(self, manifest: dict) -> None:
        temporary, final = self._at(f"_versions/.{uuid.uuid4().hex}"), self._at(f"_versions/{manifest['version']:012d}.json")
        out = self._fs.create(temporary, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._context.rename(temporary, final, options)
        except Exception as failed:
            self._fs.delete(temporary, False)
            if self._fs.exists(final):
                raise Conflict(f"version {manifest['version']} of {self.path} is another writer's") from failed
            raise

    # ---- reading

    def bucket_of(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*self.keys[table]), F.lit(self.buckets)).cast("int")

    def buckets_of(self, table: str, keys: DataFrame) -> list[int]:
        """The buckets that hold ``keys``: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket_of(table)).distinct().collect())

    def read(self, table: str, version: int | None = None, buckets: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table at a version, or some buckets of it; a table that isn't there is an error."""
        found = (manifest or self.manifest(version))["tables"][table]
        schema = StructType.fromJson(found["schema"])
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.path}/{p}" for b, ps in found["files"].items() if wanted is None or b in wanted for p in ps]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ---- writing

    def _write(self, table: str, rows: DataFrame, dealt: bool = False) -> dict[str, list[str]]:
        """Write rows to a new folder, by bucket; the folders by bucket number."""
        name = f"{table}/{uuid.uuid4().hex}"
        if dealt:
            rows.write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
            return self._made(name)
        keyed = rows.withColumn(BUCKET, self.bucket_of(table))
        spread = F.pmod(F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in rows.columns if not _has_map(rows.schema[c].dataType)]), F.lit(self.spread))
        keyed.repartition(BUCKET, spread).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        return self._made(name)

    def _made(self, name: str) -> dict[str, list[str]]:
        made = [s.getPath().getName() for s in self._fs.listStatus(self._at(name))]
        return {n.split("=")[1]: [f"{name}/{n}"] for n in made if n.startswith(BUCKET)}

    def staged(self, table: str, rows: DataFrame) -> Change:
        """An append of ``rows`` to a table, written now to a folder that no version names before the change's commit.

        Each task writes the rows it makes to files of their buckets, several at a time, so wide rows are neither
        shuffled nor sorted.  ``rows`` of the change reads them back.
        """
        schema, name = self.manifest()["tables"][table]["schema"], f"{table}/{uuid.uuid4().hex}"
        columns = [F.col(f"`{f['name']}`") for f in schema["fields"]]
        conf = rows.sparkSession.conf
        before = conf.get(_WRITERS)
        conf.set(_WRITERS, max(int(before), self.buckets + 1))  # a task that reaches the number sorts its other rows
        try:
            keyed = rows.select(*columns).withColumn(BUCKET, self.bucket_of(table))
            keyed.write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.path}/{name}")
        except Exception:
            self._fs.delete(self._at(name), True)
            raise
        finally:
            conf.set(_WRITERS, before)
        made = self._made(name)
        return Change("append", self.read(table, manifest={"tables": {table: {"schema": schema, "files": made}}}), made=made)

    def _changed(self, table: str, change: Change, before: dict) -> dict:
        known = before.get("files", {})
        if change.made is not None:
            return {"schema": before["schema"], "files": {b: known.get(b, []) + change.made.get(b, []) for b in {*known, *change.made}}}
        if change.kind in ("replace", "append"):
            rows = change.rows
            if change.kind == "append" and before:
                rows = rows.select(*[F.col(f["name"]) for f in before["schema"]["fields"]], *([BUCKET] if change.dealt else []))
            made = self._write(table, rows, change.dealt)
            old = known if change.kind == "append" else {}
            files = {b: old.get(b, []) + made.get(b, []) for b in {*old, *made}}
            schema = before["schema"] if change.kind == "append" and before else rows.drop(BUCKET).schema.jsonValue()
            return {"schema": schema, "files": files}
        keys = self.keys[table]
        if change.kind == "merge" and change.rows.groupBy(*keys).count().where("count > 1").head(1):
            raise ValueError(f"rows to merge into {table} hold a key more than once")
        if not before:
            if change.kind == "delete":
                raise KeyError(table)
            return self._changed(table, replace(change.rows), before)
        touched = [str(b) for b in self.buckets_of(table, change.rows)]
        if not touched:
            return before
        old = self.read(table, buckets=touched, manifest={"tables": {table: before}})
        same = reduce(Column.__and__, [old[k].eqNullSafe(change.rows[k]) for k in keys])
        rows = old.join(change.rows.select(*keys).distinct() if change.kind == "delete" else change.rows, same, "left_anti")
        if change.kind == "merge":
            rows = rows.unionByName(change.rows.select(*old.columns))
        made = self._write(table, rows)
        kept = {b: p for b, p in known.items() if b not in touched}
        return {"schema": before["schema"], "files": kept | {b: made[b] for b in touched if b in made}}

    def commit(self, changes: dict[str, Change | list[Change]], note: str = "", onto: int | None = None) -> int:
        """Publish all changes, several of a table in their order, as one version and return its number.

        ``onto`` is the version that the changes were made from; if another one has come
        since, or comes meanwhile, the commit is a ``Conflict`` and nothing is changed.
        """
        manifest = self.manifest()
        if onto is not None and manifest["version"] != onto:
            raise Conflict(f"{self.path} is at version {manifest['version']}, not {onto}")
        tables = dict(manifest["tables"])
        for name, listed in changes.items():
            for change in listed if isinstance(listed, list) else [listed]:
                tables[name] = self._changed(name, change, tables.get(name, {}))
        following = {"version": manifest["version"] + 1, "note": note, "at": time.time(), "changed": sorted(changes), "tables": tables}
        self._publish(following)
        return following["version"]

    def rewrite(self, table: str, buckets: Iterable[str], rows: DataFrame, note: str = "rewrite", onto: int | None = None, dealt: bool = False) -> int:
        """Publish ``rows``, whose keys all belong to ``buckets``, in place of what those hold."""
        manifest = self.manifest()
        if onto is not None and manifest["version"] != onto:
            raise Conflict(f"{self.path} is at version {manifest['version']}, not {onto}")
        found, gone = manifest["tables"][table], {str(b) for b in buckets}
        files = {b: p for b, p in found["files"].items() if b not in gone} | self._write(table, rows.select(*[f["name"] for f in found["schema"]["fields"]], *([BUCKET] if dealt else [])), dealt)
        tables = manifest["tables"] | {table: found | {"files": files}}
        self._publish({"version": manifest["version"] + 1, "note": note, "at": time.time(), "changed": [table], "tables": tables})
        return manifest["version"] + 1

    def size_of(self, folder: str) -> int:
        """Bytes of the files in a folder that a manifest names."""
        return int(self._fs.getContentSummary(self._at(folder)).getLength())

    def compact(self, table: str, most: int = 4, note: str = "compact") -> int:
        """Rewrite the buckets of a table that lie in more than ``most`` folders, each into one."""
        manifest = self.manifest()
        found = manifest["tables"][table]
        many = [b for b, paths in found["files"].items() if len(paths) > most]
        if not many:
            return manifest["version"]
        return self.rewrite(table, many, self.read(table, buckets=many, manifest=manifest), note, onto=manifest["version"])

    def vacuum(self, keep: int = 10, older_than: float = 86_400) -> list[str]:
        """Drop all but the last ``keep`` versions, and folders older than ``older_than`` seconds that none of those names."""
        versions = self.versions()
        for v in versions[:-keep]:
            self._fs.delete(self._at(f"_versions/{v:012d}.json"), False)
        manifests = [self.manifest(v) for v in versions[-keep:]]
        used = {"/".join(p.split("/")[:2]) for m in manifests for t in m["tables"].values() for ps in t["files"].values() for p in ps}
        gone = []
        for t in self._fs.listStatus(self._at("")):
            name = t.getPath().getName()
            if name.startswith("_"):
                continue
            for s in self._fs.listStatus(t.getPath()):
                folder = f"{name}/{s.getPath().getName()}"
                if folder not in used and s.getModificationTime() / 1000 < time.time() - older_than:
                    self._fs.delete(s.getPath(), True)
                    gone.append(folder)
        return sorted(gone)


def with_retry(store: Store, make, note: str = "", times: int = 5) -> int:
    """Commit ``make(version)``, made again from the new version after a conflict."""
    for last in range(times):
        version = store.version()
        try:
            return store.commit(make(version), note, onto=version)
        except Conflict:
            if last == times - 1:
                raise
    raise ValueError("times must be positive")
