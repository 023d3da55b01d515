"""Steps whose cost must follow the input: batches of a stream, token counts, shuffles of postings, scans of joined chunks."""

import re

import pytest
from pyspark.sql import functions as F

import larkspur.queries as library
from larkspur.operators import many, retrieval
from larkspur.operators.packing import chunk_hierarchy, longer
from larkspur.operators.text_index import blocks_of
from larkspur.streaming.ingest import ingest


def test_batches_do_not_follow_the_number_of_files(spark, tmp_path):
    schema = "file_id string, content string, status string"
    rows = [(str(i), f"Text {i}.", "pending") for i in range(12)]
    spark.createDataFrame(rows, schema).repartition(12).write.parquet(f"{tmp_path}/in")
    query = ingest(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    assert len([p for p in (tmp_path / "out" / "files").iterdir() if p.name.startswith("batch=")]) == 1
    assert spark.read.parquet(f"{tmp_path}/out/files").where("status = 'ready'").count() == 12


def test_a_small_bound_makes_several_batches(spark, tmp_path):
    schema = "file_id string, content string, status string"
    spark.createDataFrame([(str(i), f"Text {i}.", "pending") for i in range(6)], schema).repartition(3).write.parquet(f"{tmp_path}/in")
    ingest(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state", bytes_per_batch=1).awaitTermination(120)
    assert len([p for p in (tmp_path / "out" / "files").iterdir() if p.name.startswith("batch=")]) == 3
    assert spark.read.parquet(f"{tmp_path}/out/files").count() == 6


def test_tokens_of_sentences_are_counted_once(spark):
    """Beside them only the beginning and the whole of a text are counted, not pieces made of sentences."""
    made = chunk_hierarchy(spark.createDataFrame([(1, "One. Two.")], "file_id long, text string"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("regexp_extract_all", plan)) <= 3


def test_token_counts_are_those_of_the_pieces(spark):
    words = ["Word", "x1", "é!", "a\x0bb", "\x0c", "don't", "😀", "No.", "\x0b Then", "(see)"]
    texts = [(n, (" \x0b\n" if n % 2 else " ").join(words[(i * (n + 1)) % 10] + (".\x0c" if i % 13 == 0 else "") for i in range(n * 97))) for n in range(12)]
    texts += [(20, "a" * 5000), (21, "a" * 5000 + " b" * 400), (22, "\x0b. A" * 301), (23, "x " * 300), (24, "x " * 301)]
    from larkspur.functions.text import count_tokens

    rows = spark.createDataFrame(texts, "file_id long, text string")
    wrong = chunk_hierarchy(rows).where((count_tokens(F.col("child")) != F.col("child_tokens")) | (count_tokens(F.col("parent")) != F.col("parent_tokens")))
    assert wrong.count() == 0
    assert rows.where(longer(F.col("text"), 300, 64) != (count_tokens(F.col("text")) > 300)).count() == 0


def test_postings_are_not_shuffled_and_blocks_once(spark):
    texts = [(1, "b a, B a a"), (2, None), (3, ""), (4, "!"), (5, "z"), (6, " ".join(f"t{i % 7}" for i in range(1000)))]
    entries = retrieval.postings(spark.createDataFrame(texts, "chunk_id long, content string"))
    assert "Exchange" not in entries._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, entries.collect()))
    assert got == sorted([("a", 1, 3, 5), ("b", 1, 2, 5), ("z", 5, 1, 1), *[(f"t{i}", 6, 143 if i < 6 else 142, 1000) for i in range(7)]])
    made = blocks_of(entries, 3.0, 2, F.pmod(F.xxhash64("term"), F.lit(4)).cast("int"), 4, share=3)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    back = made.select("term", F.explode("docs").alias("d")).select("term", "d.chunk_id", "d.tf", "d.dl")
    assert sorted(map(tuple, back.collect())) == got


def test_blocks_hold_what_follows_by_weight(spark):
    """Frequent terms dealt to several tasks: blocks stay full, hold one term, and know their bounds."""
    rows = [(("hot", "warm")[i % 5 == 0], i, 1 + i % 9, 20) for i in range(1000)] + [(f"r{i}", i, 1, 9) for i in range(50)]
    entries = spark.createDataFrame(rows, "term string, chunk_id long, tf int, dl int")
    got = blocks_of(entries, 15.0, 16, F.pmod(F.xxhash64("term"), F.lit(3)).cast("int"), 3, share=100).collect()
    assert sum(r["n"] for r in got) == 1050 and all(r["n"] == len(r["docs"]) <= 16 for r in got)
    assert sum(r["term"] == "hot" for r in got) <= 50 + 8 + 1 and all(sum(r["term"] == f"r{i}" for r in got) == 1 for i in range(50))
    for r in got:
        weights = [d["tf"] / (0.25 + 0.75 * d["dl"] / 15.0) for d in r["docs"]]
        assert abs(min(weights) - r["low"]) < 1e-12 and abs(max(weights) - r["high"]) < 1e-12
    assert len({r["__bucket"] for r in got if r["term"] == "hot"}) == 1


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["many_hybrid", "kb_compile_links"])
def test_joined_chunks_are_written_before_they_are_scanned(spark, sf_dir, monkeypatch, name):
    def seen(queries, chunks, **options):
        raise Seen(chunks._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(many, "search_texts", seen)
    with pytest.raises(Seen) as told:
        library.queries()[name](spark, sf_dir)
    assert "Relation" in str(told.value) and "Join" not in str(told.value)


def test_statistics_of_texts_without_terms(spark):
    """They come from the postings, and texts without terms still count."""
    given = []
    texts = spark.createDataFrame([(1, "a b a", [1.0]), (2, "!", [1.0]), (3, None, None)], "chunk_id long, content string, embedding array<double>")
    asked = spark.createDataFrame([(0, "a", [1.0])], "query_id long, query string, vector array<double>")
    whole = many.search_many
    try:
        many.search_many = lambda q, c, e, n, avgdl, **o: given.append((n, avgdl)) or whole(q, c, e, n, avgdl, **o)
        assert [r["chunk_id"] for r in many.search_texts(asked, texts).orderBy("rank").collect()] == [1, 2]
        many.search_texts(asked, texts.where("chunk_id = 3")).collect()
    finally:
        many.search_many = whole
    assert given == [(3, 1.0), (1, 0.0)]
