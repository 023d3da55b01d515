"""Versions of tables: what a reader sees, what a failed writer leaves, and what a commit rewrites."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import kb, writeback
from larkspur.sources import versioned
from larkspur.sources.versioned import Conflict, Store, append, delete, merge, replace


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", {"t": ["id"], "u": ["id", "part"]}, buckets=8)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "id long, v string")


def seen(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_delete_and_time_travel(spark, store):
    assert store.version() == 0 and store.history() == []
    store.commit({"t": replace(rows(spark, [(1, "a"), (2, "b"), (None, "n")]))}, "first")
    store.commit({"t": merge(rows(spark, [(2, "B"), (3, "c"), (None, "N")]))})
    store.commit({"t": delete(spark.createDataFrame([(1,), (9,)], "id long"))})
    store.commit({"t": append(rows(spark, [(4, "d")]))})
    assert seen(store.read("t")) == seen(rows(spark, [(2, "B"), (3, "c"), (None, "N"), (4, "d")]))
    assert seen(store.read("t", 1)) == seen(rows(spark, [(1, "a"), (2, "b"), (None, "n")]))
    assert seen(store.read("t", 2)) == seen(rows(spark, [(1, "a"), (2, "B"), (3, "c"), (None, "N")]))
    assert [(h["version"], h["note"], h["changed"]) for h in store.history()] == [(1, "first", ["t"]), (2, "", ["t"]), (3, "", ["t"]), (4, "", ["t"])]
    with pytest.raises(ValueError, match="more than once"):
        store.commit({"t": merge(rows(spark, [(5, "x"), (5, "y")]))})
    assert store.version() == 4


def test_only_touched_buckets_are_rewritten(spark, store):
    store.commit({"t": replace(spark.range(1000).select("id", F.lit("a").alias("v")))})
    store.commit({"t": merge(rows(spark, [(7, "b")]))})
    first, second = (store.manifest(v)["tables"]["t"]["files"] for v in (1, 2))
    assert sum(first[b] != second[b] for b in first) == 1 and len(first) == 8
    assert store.read("t").where("v = 'b'").count() == 1 and store.read("t").count() == 1000
    bucket = store.buckets_of("t", rows(spark, [(7, "")]))
    assert store.read("t", buckets=bucket).where("id = 7").first()["v"] == "b"
    assert store.read("t", buckets=bucket).count() < 250


def test_a_torn_write_stays_invisible(spark, store, monkeypatch):
    store.commit({"t": replace(rows(spark, [(1, "a")])), "u": replace(rows(spark, [(1, "x")]).withColumn("part", F.lit(0)))})
    bad = rows(spark, [(1, "b")]).withColumn("v", F.when(F.col("id") == 1, F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"u": delete(spark.createDataFrame([(1, 0)], "id long, part int")), "t": merge(bad)})
    assert store.version() == 1 and seen(store.read("u")) == [(1, "x", 0)] and seen(store.read("t")) == [(1, "a")]
    monkeypatch.setattr(store, "_publish", lambda manifest: (_ for _ in ()).throw(OSError("cut off")))
    with pytest.raises(OSError):
        store.commit({"t": append(rows(spark, [(2, "b")]))})
    monkeypatch.undo()
    assert store.version() == 1 and seen(store.read("t")) == [(1, "a")]
    assert len(store.vacuum(older_than=-10)) == 2 and seen(store.read("t")) == [(1, "a")]


def test_of_two_writers_one_conflicts(spark, store):
    store.commit({"t": replace(rows(spark, [(1, "a")]))})
    other = Store(spark, store.path, store.keys, 8)
    late = other.manifest()
    store.commit({"t": append(rows(spark, [(2, "b")]))})
    with pytest.raises(Conflict):
        other._publish(late | {"version": 2, "note": "late"})
    with pytest.raises(Conflict):
        other.commit({"t": append(rows(spark, [(3, "c")]))}, onto=1)
    tried = []

    def make(version):
        tried.append(version)
        if len(tried) == 1:
            store.commit({"t": append(rows(spark, [(4, "d")]))})
        return {"t": append(rows(spark, [(3, "c")]))}

    assert versioned.with_retry(other, make) == 4 and tried == [2, 3]
    assert [r[0] for r in seen(store.read("t"))] == [1, 2, 3, 4]


def test_compaction_keeps_rows(spark, store):
    for i in range(6):
        store.commit({"t": append(spark.range(100 * i, 100 * i + 100).select("id", F.lit("a").alias("v")))})
    files = lambda: max(len(p) for p in store.manifest()["tables"]["t"]["files"].values())
    assert files() == 6
    store.compact("t")
    assert files() == 1 and store.read("t").distinct().count() == 600
    assert store.compact("t") == store.version() == 7


def test_cascade_of_a_base_commits_every_table_at_once(spark, tmp_path):
    """Deleting a base changes five tables in one version; write-back then changes one."""
    keys = {"bases": ["kb_id"], "members": ["kb_id", "file_id"], "articles": ["article_id"], "sources": ["article_id", "chunk_id"], "links": ["src", "dst"], "chunks": ["file_id", "chunk_index"]}
    store = Store(spark, f"file://{tmp_path}/kb", keys, buckets=4)
    make = spark.createDataFrame
    tables = {
        "bases": make([(1,), (2,)], "kb_id int"), "members": make([(1, 1), (2, 1), (2, 2)], "kb_id int, file_id int"),
        "articles": make([(10, 1), (20, 2), (21, 2)], "article_id int, kb_id int"), "sources": make([(10, 5), (20, 5)], "article_id int, chunk_id int"),
        "links": make([(20, 21), (10, 20), (10, 10)], "src int, dst int"), "chunks": make([(1, 0, "old"), (1, 1, "old")], "file_id int, chunk_index int, context_prefix string"),
    }
    store.commit({k: replace(v) for k, v in tables.items()})
    now = {k: store.read(k) for k in tables}
    left = kb.delete_bases(make([(2,)], "kb_id int"), *(now[k] for k in ("bases", "members", "articles", "sources", "links")))
    gone = {k: delete(now[k].join(left[k], keys[k], "left_anti")) for k in left}
    store.commit(gone, "base 2")
    assert {k: seen(store.read(k)) for k in left} == {"bases": [(1,)], "members": [(1, 1)], "articles": [(10, 1)], "sources": [(10, 5)], "links": [(10, 10)]}
    store.commit({"chunks": merge(writeback.write_back(store.read("chunks"), make([(1, 1, "new"), (1, 0, "")], "file_id int, chunk_index int, prefix string")))})
    assert seen(store.read("chunks")) == [(1, 0, "old"), (1, 1, "new")]
    assert store.read("articles", 1).count() == 3 and store.version() == 3
