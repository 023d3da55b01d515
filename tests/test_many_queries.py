"""Many queries in one plan against one search each, and compilation into versioned tables."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import compilation, many, models, retrieval
from larkspur.plans.demo import Demo
from larkspur.sources.versioned import Store, replace

ASKED = ["the with", "und: der", "re", "nosuchword", "", "the: "]


@pytest.fixture(scope="module")
def chunks(spark):
    return Demo(spark, "/root/testdata/sf0.01").chunks().select("chunk_id", "file_id", "content", "embedding").cache()


def queries_of(spark, chunks, asked):
    vectors = {r["chunk_id"]: r["embedding"] for r in chunks.where(F.col("chunk_id") < len(asked)).collect()}
    rows = [(i, q, None if i % 5 == 4 else vectors.get(i)) for i, q in enumerate(asked)]
    return spark.createDataFrame(rows, "query_id long, query string, vector array<float>"), rows


def test_each_query_has_the_hits_of_its_own_search(spark, chunks):
    queries, rows = queries_of(spark, chunks, ASKED)
    got = many.search_texts(queries, chunks, k=10, query_block=4)
    assert got.columns == ["query_id", "rank", "score", "chunk_id", "file_id", "content"]
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["chunk_id"], r["rank"]))
    for i, q, v in rows:
        if v is None:
            own = retrieval.text_search(chunks, q, 50) if retrieval.query_terms(q) else chunks.limit(0).withColumn("score", F.lit(0.0))
            own = retrieval.rerank(chunks.join(retrieval.fuse([own], limit=20).select("chunk_id"), "chunk_id"), q, 10) if retrieval.query_terms(q) else own
        elif retrieval.query_terms(q):
            own = retrieval.hybrid_search(chunks, q, v, k=10)
        else:
            near = retrieval.fuse([retrieval.vector_search(chunks, v)], limit=20).select("chunk_id")
            own = chunks.join(near, "chunk_id").withColumn("score", F.lit(0.0)).orderBy("chunk_id").limit(10)
        want = [(r["chunk_id"], n + 1) for n, r in enumerate(own.collect())]
        assert found.get(i, []) == want, (i, q)


def test_allowed_chunks_bound_the_hits(spark, chunks):
    queries, _ = queries_of(spark, chunks, ASKED)
    allowed = chunks.where("chunk_id % 7 = 3").select("chunk_id")
    got = many.search_texts(queries, chunks, k=10, allowed=allowed)
    assert got.where("chunk_id % 7 <> 3").count() == 0 and got.where("query_id = 0").count() == 10
    assert many.search_texts(queries.limit(0), chunks).collect() == []


def test_jobs_do_not_grow_with_queries(spark, chunks):
    def jobs(n):
        queries, _ = queries_of(spark, chunks, (ASKED * n)[:n])
        spark.sparkContext.setJobGroup(f"many-{n}", "")
        try:
            many.search_texts(queries, chunks).count()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"many-{n}"))

    assert jobs(60) <= jobs(3) + 2


def test_equal_vectors_tie_by_id(spark):
    rows = spark.createDataFrame([(i, [0.1, 0.7, 0.3]) for i in range(50, 0, -1)] + [(99, [0.0, 0.0, 0.0]), (98, None)], "chunk_id long, embedding array<double>")
    got = many.ranked(many.near_many(rows.repartition(4), [(1, [0.2, 1.4, 0.6]), (2, [0.0, 0.0, 0.0])], 5), 5).collect()
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, i, i) for i in range(1, 6)]


KEYS = {"bases": ["kb_id"], "members": ["kb_id", "file_id"], "summaries": ["file_id"], "chunks": ["chunk_id"], "articles": ["kb_id", "title"], "sources": ["kb_id", "title", "chunk_id"], "links": ["kb_id", "src", "dst"]}


@pytest.fixture
def store(spark, tmp_path):
    embedder = models.hashed_embedder(8)
    texts = [(1, 1, "Mills turn by the river. Stones grind."), (2, 2, "The river floods the mills."), (3, 3, "Stars and moons.")]
    make = spark.createDataFrame
    chunks = models.embed_chunks(make(texts, "chunk_id long, file_id long, content string").withColumn("context_prefix", F.lit("")), embedder, 4).drop("embedding_full", "context_prefix")
    tables = {
        "bases": make([("a", "new"), ("b", "new"), ("c", "new")], "kb_id string, status string"),
        "members": make([("a", 1), ("a", 2), ("b", 3)], "kb_id string, file_id long"),
        "summaries": make([(i, t) for i, _, t in texts], "file_id long, summary string"),
        "chunks": chunks,
        "articles": make([("a", "old", "concept", "published", "x"), ("a", "mine", "manual", "published", "y"), ("b", "other", "concept", "published", "z")], "kb_id string, title string, article_type string, status string, content string")
        .selectExpr("*", "cast(null as array<double>) embedding_full", "cast(null as array<double>) embedding"),
        "sources": make([("a", "old", 1), ("b", "other", 3)], "kb_id string, title string, chunk_id long"),
        "links": make([("a", "old", "mine", "related"), ("b", "other", "q", "related")], "kb_id string, src string, dst string, link_type string"),
    }
    made = Store(spark, f"file://{tmp_path}/kb", KEYS, buckets=2)
    made.commit({k: replace(v) for k, v in tables.items()})
    return made


def seen(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_compilation_commits_all_results_at_once(store):
    version = compilation.compile_into(store, ["a", "c"], models.hashed_embedder(8), dims=4, per_kb=3)
    assert version == 3 and [h["note"] for h in store.history()] == ["", "compiling", "compiled"]
    assert seen(store.read("bases", 2), "kb_id", "status") == [("a", "compiling"), ("b", "new"), ("c", "compiling")]
    assert seen(store.read("bases"), "kb_id", "status") == [("a", "active"), ("b", "new"), ("c", "error")]
    titles = {t for k, t in seen(store.read("articles"), "kb_id", "title") if k == "a"}
    assert "old" not in titles and "mine" in titles and len(titles) == 4
    assert {t for k, t, _ in seen(store.read("sources"), "kb_id", "title", "chunk_id") if k == "a"} == titles - {"mine"}
    assert ("a", "old", "mine") not in seen(store.read("links"), "kb_id", "src", "dst")
    assert seen(store.read("articles").where("kb_id = 'b'"), "title") == [("other",)] and ("b", "other", "q") in seen(store.read("links"), "kb_id", "src", "dst")
    assert seen(store.read("articles", 1).where("kb_id = 'a'"), "title") == [("mine",), ("old",)]


def test_a_failed_compilation_leaves_all_but_the_state(store):
    def broken(term, texts):
        return F.raise_error(F.lit("no model")).cast("string")

    with pytest.raises(Exception, match="no model"):
        compilation.compile_into(store, ["a"], models.hashed_embedder(8), dims=4, write=broken)
    assert seen(store.read("bases").where("kb_id = 'a'"), "status") == [("error",)]
    assert seen(store.read("articles"), "kb_id", "title") == [("a", "mine"), ("a", "old"), ("b", "other")]
