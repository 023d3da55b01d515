"""One life of the engine: upload, ingest, search, bases, compilation, removal, health, repair, deletion."""

import pytest

from larkspur.engine import Engine
from larkspur.operators import models


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, f"file://{tmp_path_factory.mktemp('engine')}/e", models.hashed_embedder(64), dims=16, buckets=2)


FILES = [
    ("t", "1", "mill.txt", "The old mill turns by the river. Its stones grind wheat."),
    ("t", "2", "flood.md", "# Floods\nThe river floods the mill in spring.\n## Dams\nA dam holds the river back."),
    ("t", "3", "data.csv", "town,river\nAx,Bo\nCy,Du"),
    ("t", "4", "code.py", "def grind(wheat):\n    return wheat"),
    ("u", "5", "other.txt", "Another tenant's river."),
    ("t", "6", "photo.png", "x"),
]


def test_life(spark, engine):
    engine.upload(spark.createDataFrame(FILES, "tenant_id string, file_id string, filename string, content string"))
    assert {r["status"] for r in engine.files("t").collect()} == {"pending"}
    kb = engine.create_base("t", "rivers")
    with pytest.raises(ValueError, match="rivers"):
        engine.create_base("t", "rivers")
    engine.add_files(kb, ["1", "2", "5", "1"])
    assert sorted(r["file_id"] for r in engine.table("members").collect()) == ["1", "2"]  # not the other tenant's
    engine.ingest()
    state = {r["file_id"]: (r["status"], r["content_type"]) for r in engine.files().collect()}
    assert state == {"1": ("ready", "text"), "2": ("ready", "markdown"), "3": ("ready", "csv"), "4": ("ready", "code"), "5": ("ready", "text"), "6": ("failed", "image")}
    assert engine.to_compile() == [kb] and engine.to_compile(since=1) == []
    assert engine.ingest() == engine.store.version()  # nothing waits

    hits = engine.search("river mill", "t", k=3).collect()
    assert {r["file_id"] for r in hits} & {"1", "2"} and all(r["file_id"] != "5" for r in hits) and hits[0]["parent_content"]
    assert [r["file_id"] for r in engine.search("tenant river", "u", k=1).collect()] == ["5"]
    assert {r["content_type"] for r in engine.search("grind wheat", "t", content_types=["code"], k=9).where("content_type = 'code'").collect()} == {"code"}
    first = hits[0]["chunk_id"]
    assert engine.chunk(first).first()["content"] == hits[0]["content"]

    engine.compile([kb], per_kb=4)
    assert [(r["kb_id"], r["status"]) for r in engine.bases("t").collect()] == [(kb, "active")]
    made = {r["title"] for r in engine.articles(kb).collect()}
    assert len(made) == 4
    engine.derive(kb, "mine", "What I know of mills.", [first, 99])
    with pytest.raises(ValueError, match="words"):
        engine.derive(kb, "long", "word " * 9, [], max_tokens=5)
    assert {r["result_type"] for r in engine.search_kb(kb, "river", k=9).collect()} == {"article", "chunk"}
    assert {r["result_type"] for r in engine.search_kb(kb, "river", articles_only=True).collect()} == {"article"}
    assert engine.articles(kb, "derived").first()["title"] == "mine"

    before = engine.health().first()["score"]
    engine.remove_files(kb, ["1"])
    stale = {r["title"] for r in engine.articles(kb).where("status = 'stale'").collect()}
    assert stale and engine.health().first()["score"] <= before and engine.table("members").count() == 1
    engine.repair(kb)
    assert {r["title"] for r in engine.articles(kb).collect()} == (made | {"mine"}) - stale
    version = engine.store.version()
    engine.delete_files(["2"])
    assert engine.search("floods spring dam", "t").where("file_id = '2'").count() == 0 and engine.files(version=version).where("file_id = '2'").count() == 1
    engine.delete_base(kb)
    assert engine.bases().count() == engine.articles().count() == engine.table("links").count() == 0 and engine.table("uploads").count() == 5


def test_an_engine_is_found_again(spark, engine):
    again = Engine(spark, engine.store.path, models.hashed_embedder(64), dims=16, buckets=2)
    assert again.store.version() == engine.store.version() and again.files().count() == 5
