"""Operators that SQL can't express, row by row against plain Python."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

import larkspur.queries as library
from larkspur.functions import text as tx
from larkspur.operators import chunkers, models, packing, retrieval
from larkspur.plans.demo import Demo
from larkspur.sources import files
from larkspur.streaming.ingest import bases_to_compile, watch


def n_tokens(text):
    return len(re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]", text))


def hierarchy(text, parent_max=1500, child_max=300, min_child=50, overlap=30):
    """Parents with their children, sentence by sentence."""
    text = (text or "").strip(" \t\r\n\x0b\f")
    if not text:
        return []
    sentences = [s.strip(" ") for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text)]
    sentences = [s for s in sentences if s]
    if n_tokens(text) <= child_max or not sentences:
        return [(text, [text])]
    children, held = [], []
    for s in sentences:
        if held and sum(map(n_tokens, held)) + n_tokens(s) > child_max:
            children.append(held)
            tail = []
            for t in reversed(held):
                if sum(map(n_tokens, tail)) + n_tokens(t) > overlap:
                    break
                tail.insert(0, t)
            held = tail
        held = [*held, s]
    children.append(held)
    texts = [" ".join(c) for c in children]
    if len(texts) > 1 and n_tokens(texts[-1]) < min_child:
        texts[-2:] = [texts[-2] + " " + texts[-1]]
    parents, held = [], []
    for c in texts:
        if held and sum(map(n_tokens, held)) + n_tokens(c) > parent_max:
            parents.append(held)
            held = []
        held = [*held, c]
    parents.append(held)
    return [(" ".join(p), p) for p in parents]


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_hierarchy(spark, sf_dir):
    got = {tuple(r) for r in library.queries()["chunk_children"](spark, sf_dir).collect()}
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        number = 0
        for i, (parent, children) in enumerate(hierarchy(r["text"])):
            for c in children:
                want.add((r["doc_id"], i, number, n_tokens(c), n_tokens(parent), md5(c), md5(parent)))
                number += 1
    assert got == want


@pytest.mark.parametrize("sizes", [(60, 20, 8, 5), (10, 5, 3, 2), (1500, 300, 50, 30)])
def test_hierarchy_of_small_budgets(spark, sizes):
    texts = ["One two. Three four five! Six? Seven eight nine ten eleven twelve. A.", "no sentence end here at all", " ", None, "Word. " * 200, "A b c d e f g h i j. K. L m n o p q r s t u v w x y z."]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    out = packing.chunk_hierarchy(rows, "text", *sizes).orderBy("doc_id", "child_index").collect()
    for i, t in enumerate(texts):
        want = [(p, c) for p, cs in hierarchy(t, *sizes) for c in cs]
        assert [(r["parent"], r["child"]) for r in out if r["doc_id"] == i] == want


def test_chunk_text_tidies_paragraphs(spark):
    made = spark.createDataFrame([(1, "n.txt", "  a b. \n\n\n\n c d.  "), (2, "m.js", " x \n\n\n\n y ")], "file_id int, filename string, content string")
    got = chunkers.chunk_text(made.where("file_id = 1")).collect()[0]
    assert (got["prefix"], got["child"], got["parent"], got["content_type"]) == ("File: n.txt", "a b.\n\nc d.", "a b.\n\nc d.", "text")
    assert chunkers.chunk_text(made.where("file_id = 2"), "code").collect()[0]["child"] == "x \n\n\n\n y"


def test_python_code(spark, sf_dir):
    got = library.queries()["chunk_python_code"](spark, sf_dir).orderBy("file_id", "part").collect()
    want = []
    for k in sorted(str(i) for i in range(25)):
        want += [
            (k, 0, None, None, "import os", "File: a.py"), (k, 1, None, f"f{k}", f"@wrap\ndef f{k}(x):\n    return x", f"File: a.py | Function: f{k}"),
            (k, 2, "K", "m", "    def m(self):\n        pass", "File: a.py | Class: K | Function: m"), (k, 3, "K", "n", "    async def n(self):\n        pass", "File: a.py | Class: K | Function: n"),
            (k, 4, None, None, "X = 1", "File: a.py"),
        ]
    assert [tuple(r) for r in got] == want
    for source, parts in [("x = (", [(None, None, "x = (")]), ("", [(None, None, "")]), ("class A:\n    x = 1\n", [("A", None, "class A:\n    x = 1")])]:
        assert chunkers.python_parts(source) == parts


def test_structured_files():
    assert chunkers.structured_parts("a.toml", "x = 1") == [("x", '{\n  "x": 1\n}')]
    assert chunkers.structured_parts("a.toml", "x = ") == [(None, "x = ")]
    assert chunkers.structured_parts("a.json", "3") == [(None, "3")]
    pytest.importorskip("yaml")
    assert chunkers.structured_parts("a.yml", "a: 1\nb:\n  - é\n") == [("a", '{\n  "a": 1\n}'), ("b", '{\n  "b": [\n    "é"\n  ]\n}')]
    assert chunkers.structured_parts("a.yaml", "a: [") == [(None, "a: [")]


def test_stream_gives_every_file_its_chunks(spark, sf_dir):
    got = {r["file_id"]: (r["status"], r["n_chunks"]) for r in library.queries()["stream_ingest"](spark, sf_dir).collect()}
    want = {}
    for r in Demo(spark, sf_dir).files().select("file_id", "content").collect():
        n = sum(len(cs) for _, cs in hierarchy(r["content"]))
        want[str(r["file_id"])] = ("ready", n) if n else ("failed", None)
    assert got == want


def test_bases_of_ready_files(spark):
    ready = spark.createDataFrame([(1, "ready"), (2, "failed")], "file_id int, status string")
    members = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "kb_id string, file_id int")
    assert [r["kb_id"] for r in bases_to_compile(ready, members).collect()] == ["a"]


def test_postings_table_is_read_by_bucket(spark, sf_dir):
    texts = Demo(spark, sf_dir).texts()
    index = retrieval.save_postings(retrieval.postings(texts), "postings_of_texts", 8)
    try:
        described = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE EXTENDED postings_of_texts").collect()}
        assert described["Num Buckets"] == "8" and "term" in described["Bucket Columns"]
        found = retrieval.postings_search(index, retrieval.corpus_stats(texts), "the with", 20).collect()
        plain = retrieval.text_search(texts, "the with", 20).collect()
        assert [(r["chunk_id"], round(r["score"], 6)) for r in found] == [(r["chunk_id"], round(r["score"], 6)) for r in plain]
    finally:
        spark.sql("DROP TABLE postings_of_texts")


def test_files_keep_their_bytes_and_names(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = [("t1", "f1", "a b.txt", b"no line end"), ("t1", "f2", "n.bin", b"\x00\xff\n\n"), ("t2", "f1", "e", b"")]
    files.write_files(spark.createDataFrame(rows, "tenant_id string, file_id string, filename string, content binary"), root)
    got = {(r["tenant_id"], r["file_id"], r["filename"], bytes(r["content"]), r["path"]) for r in files.stored_files(spark, root).collect()}
    assert got == {(t, f, n, c, f"tenants/{t}/files/{f}/{n}") for t, f, n, c in rows}
    (tmp_path / "tenants" / "t" / "files" / "x").mkdir(parents=True)
    (tmp_path / "tenants" / "t" / "files" / "x" / "big.txt").write_bytes(b"0123456789" * 100)
    one = f"file://{tmp_path}/tenants/t/files/x/big.txt"
    assert list(files.stream_bytes(spark, one, 300)) == [(b"0123456789" * 100)[i : i + 300] for i in range(0, 1000, 300)]
    read = files.read_files(spark, f"file://{tmp_path}/tenants", "*.txt").collect()
    assert [(r["tenant_id"], r["file_id"], r["filename"], r["content_type"], r["file_size"]) for r in read] == [("t", "x", "big.txt", "text", 1000)]
    assert files.exists(spark, one) and files.total_size(spark, f"file://{tmp_path}/tenants") >= 1000
    assert files.delete_prefix(spark, f"file://{tmp_path}/tenants/t") and not files.exists(spark, one)
    with pytest.raises(FileNotFoundError):
        next(files.stream_bytes(spark, one))


def test_models_are_called_in_batches(spark):
    seen = spark.sparkContext.accumulator(0)

    def embedder(texts, mode, model):
        seen.add(1)
        assert len(texts) <= 64
        return [[float(len(texts)), float(model == "code")] for _ in texts]

    rows = spark.range(130).coalesce(1).select(F.col("id").alias("chunk_id"), F.lit("").alias("context_prefix"), F.lit("x").alias("content"), F.when(F.col("id") == 64, "code").otherwise("text").alias("content_type"))
    got = [tuple(r["embedding"]) for r in models.embed_chunks(rows, embedder, 2).collect()]
    assert got == [(64.0, 0.0)] * 64 + [(64.0, 1.0)] * 64 + [(2.0, 0.0)] * 2 and seen.value == 3


def test_local_embedder_is_the_expression(spark):
    from larkspur.functions import vectors as vx

    texts = ["The river, the mill", "", "é 12 a12"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    column = [list(r[0]) for r in rows.select(vx.hashed_embedding(tx.terms(F.col("t")), 16)).collect()]
    assert models.hashed_embedder(16)(texts, "query", "text") == column


def test_timeouts_of_a_stream(spark, tmp_path):
    rows = [("a", "processing"), ("b", "ready"), ("c", "processing")]
    spark.createDataFrame(rows, "file_id string, status string").write.parquet(f"{tmp_path}/updates")
    updates = spark.readStream.schema("file_id string, status string").parquet(f"{tmp_path}/updates")
    late = watch(updates, minutes=0.02).writeStream.format("memory").queryName("late_files").outputMode("append")
    query = late.trigger(processingTime="1 second").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        end = time.monotonic() + 90
        while spark.table("late_files").count() < 2 and time.monotonic() < end:
            time.sleep(1)
    finally:
        query.stop()
    assert sorted(tuple(r) for r in spark.table("late_files").collect()) == [("a", "pending"), ("c", "pending")]
