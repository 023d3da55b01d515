import time

from larkspur.llm import line_dedup
from larkspur.llm.queries import op4_line_dedup
from tests.llm.brute import lines_kept, sha256

COMMON = [(i, f"  SHARED Line\r\nown {i}\n\nshared line\t") for i in range(20, 32)]
ROWS = [(1, None), (2, ""), (3, "\n\n"), (4, "ÄÖ\nshared line\nÄÖ"), (4, "ÄÖ\nshared line\nÄÖ"), (None, "shared LINE\nx"), (5, "own\n" * 50_000 + "shared line"), (6, "\x0bshared line\x1f\n\x00"), *COMMON]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 9, "q", 1) for i, t in ROWS], "doc_id long, text string, n_lines int, a string, k int")
    out = line_dedup.dedup_lines(docs, min_docs=10)
    assert set(out.columns) == {"doc_id", "text", "n_lines", "a", "k", "n_dropped"}
    got = sorted((r["doc_id"] or -1, r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect())
    assert got == sorted((i or -1, n, n - len(ls), "\n".join(ls)) for (i, _), (n, ls) in zip(ROWS, lines_kept(ROWS), strict=True))


def test_short_keys_stay(spark):
    docs = spark.createDataFrame([(i, "ab\nabc") for i in range(12)], "doc_id long, text string")
    assert {r["text"] for r in line_dedup.dedup_lines(docs, min_docs=10, min_chars=3).collect()} == {"ab"}


def test_time_is_linear_in_the_lines_of_a_text(spark):
    """A text of 200,000 different lines, half of which ten others share."""
    shared = [f"shared {i}" for i in range(100_000)]
    own = [f"own {i}" for i in range(100_000)]
    rows = [(0, "\n".join(x for pair in zip(shared, own, strict=True) for x in pair))] + [(1 + i, "\n".join(shared)) for i in range(9)]
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 60
    assert got == {0: "\n".join(own)} | {1 + i: "" for i in range(9)}


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in op4_line_dedup(spark, sf_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()}
    assert got == {(i, n, n - len(ls), sha256("\n".join(ls))) for (i, _), (n, ls) in zip(rows, lines_kept(rows), strict=True)}
