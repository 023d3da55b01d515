"""Registered queries over dispatch, model seams, write-back, compilation and service state, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions import vectors as vx
from larkspur.operators import chunkers, compilation, enrich, kb, many, models, retrieval, similar, state, writeback
from larkspur.operators.packing import chunk_hierarchy
from larkspur.operators.text_index import TextIndex
from larkspur.operators.vector_cells import VectorCells
from larkspur.plans.demo import Demo
from larkspur.queries import _COS, _TERMS, ASKED, _bm25
from larkspur.registry import register
from larkspur.sources import files
from larkspur.sources.scratch import new_folder, written
from larkspur.sources.versioned import Store, delete, merge, replace
from larkspur.streaming import ingest

NL = "chr(10)"


def _pick(number: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names)).cast("int") + 1)


# ---- retrieval seams -----------------------------------------------------------


@register("SELECT chunk_id, file_id FROM v_chunks c WHERE file_id IN (SELECT file_id FROM v_files WHERE status = 'ready' AND tenant_id = 'src7')")
def scope_tenant(d: Demo) -> DataFrame:
    return retrieval.scope(d.chunks(), d.files(), tenant="src7").select("chunk_id", "file_id")


@register("SELECT file_id FROM v_files WHERE tenant_id = 'src2'")
def optional_filters(d: Demo) -> DataFrame:
    """One filter that is given and one that isn't."""
    return retrieval.keep(None, retrieval.keep(F.col("tenant_id") == "src2", d.files())).select("file_id")


_DOT = "list_sum(list_transform(list_zip(embedding, q.v), lambda z: z[1] * z[2]))"
_NORM = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
_SIMILAR = f"{_DOT} / ({_NORM('embedding')} * {_NORM('q.v')})"


@register(f""", q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT chunk_id, chunk_id // 4 AS parent_chunk_id, embedding, v FROM v_chunks, q ORDER BY list_cosine_similarity(embedding[1:16], v[1:16]) DESC, chunk_id LIMIT 50),
t AS (SELECT chunk_id, parent_chunk_id, {_SIMILAR.replace("q.v", "v")} AS score FROM s)
SELECT chunk_id, parent_chunk_id, round(score, 9) AS score FROM t QUALIFY row_number() OVER (PARTITION BY parent_chunk_id ORDER BY score DESC, chunk_id) = 1""")
def rescore_one_per_parent(d: Demo) -> DataFrame:
    """Found by the first 16 dimensions, ordered by all 64."""
    chunks = d.chunks().withColumns({"parent_chunk_id": F.floor(F.col("chunk_id") / 4), "embedding_full": F.col("embedding"), "embedding": vx.head(F.col("embedding"), 16)})
    hits = retrieval.vector_search(chunks, d.query_vector()[:16])
    best = retrieval.one_per_parent(retrieval.rescore(hits, d.query_vector()))
    return best.select("chunk_id", "parent_chunk_id", F.round("score", 9).alias("score"))


@register("SELECT chunk_id, 1e0 / (1 + length(content)) AS score FROM v_texts ORDER BY score DESC, chunk_id LIMIT 7")
def rerank_model(d: Demo) -> DataFrame:
    """A rerank model that prefers short texts."""
    model = models.scorer(lambda query, contents: [1.0 / (1 + len(c)) for c in contents], "any")
    return retrieval.rerank(d.texts(), "any", 7, score=model).select("chunk_id", "score")


_HASHED = lambda text, n: f"list_transform(range(0, {n}), lambda i: len(list_filter(list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % {n}), lambda b: b = i))::DOUBLE)"


@register(f"SELECT item_id, array_to_string(list_transform(({_HASHED("'p' || chr(10) || text", 16)})[1:8], lambda x: x::INT), ',') AS vector FROM benchmark")
def embed_documents(d: Demo) -> DataFrame:
    rows = d.table("benchmark").select("item_id", F.lit("p").alias("context_prefix"), F.col("text").alias("content"))
    return models.embed_chunks(rows, models.hashed_embedder(16), 8).select("item_id", _whole("embedding"))


def _whole(vector: str) -> Column:
    return F.array_join(F.transform(vector, lambda x: x.cast("int")), ",").alias("vector")


@register(f"""SELECT conv_id * 100 + turn AS alias_id, array_to_string(list_transform({_HASHED('text', 8)}, lambda x: x::INT), ',') AS vector
FROM conversations WHERE role = 'user' AND conv_id % 3 = 1""")
def embed_alias_batch(d: Demo) -> DataFrame:
    c = d.table("conversations")
    aliases = c.where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("alias_id"), F.col("conv_id").alias("chunk_id"), F.col("text").alias("question"))
    chunks = c.select(F.col("conv_id").alias("chunk_id"), (F.col("conv_id") % 3).alias("batch_id")).distinct()
    return models.embed_aliases(aliases, chunks, models.hashed_embedder(8), 1, 8).select("alias_id", F.array_join(F.transform("alias_embedding", lambda x: x.cast("int")), ",").alias("vector"))


@register(f""", q AS (SELECT {_HASHED("'the with of'", 8)} AS v), e AS (SELECT item_id, {_HASHED('text', 8)} AS embedding FROM benchmark)
SELECT item_id, round({_SIMILAR}, 9) AS score FROM e, q WHERE list_sum(embedding) > 0 ORDER BY {_SIMILAR} DESC, item_id LIMIT 10""".replace(", q AS", "WITH q AS", 1))
def embed_query_search(d: Demo) -> DataFrame:
    embedder = models.hashed_embedder(8)
    rows = models.embed_chunks(d.table("benchmark").select("item_id", F.lit("").alias("context_prefix"), F.col("text").alias("content")), embedder, 8)
    near = retrieval.vector_search(rows.where(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x) > 0), models.embed_query("The WITH of", embedder, 8), 10, ident="item_id")
    return near.select("item_id", F.round("score", 9).alias("score"))


@register("""SELECT item_id, '[' || array_to_string([(item_id % 7)::DOUBLE::VARCHAR, (item_id / 4e0)::VARCHAR], ',') || ']' AS vector, (item_id / 4e0) AS second FROM benchmark WHERE item_id < 1000""")
def vector_text(d: Demo) -> DataFrame:
    made = d.table("benchmark").where("item_id < 1000").withColumn("vector", vx.to_text(F.array((F.col("item_id") % 7).cast("double"), F.col("item_id") / 4.0)))
    return made.select("item_id", "vector", vx.from_text(F.col("vector"))[1].alias("second"))


# ---- indexes and versions ------------------------------------------------------


def _folder(d: Demo, name: str) -> str:
    return new_folder(d.spark, name)


@register(f", {_bm25('v_texts')} SELECT chunk_id, round(score, 6) AS score FROM txt")
def bm25_index(d: Demo) -> DataFrame:
    """An index written in two batches, merged and searched."""
    index, texts = TextIndex(d.spark, _folder(d, "text-index"), buckets=16), d.texts()
    for part in (0, 1):
        index.add(texts.where(F.col("chunk_id") % 2 == part))
    index.merge()
    return index.search(ASKED).select("chunk_id", F.round("score", 6).alias("score"))


@register(f"SELECT chunk_id, round({_COS}, 6) AS score FROM v_chunks ORDER BY {_COS} DESC, chunk_id LIMIT 50")
def vec_cells(d: Demo) -> DataFrame:
    """Vectors stored by learned cell, and an exact search over the cells that can hold a hit."""
    cells = VectorCells(d.spark, _folder(d, "cells"), 16)
    cells.build(d.chunks(), rounds=3)
    return cells.search(d.query_vector(), 50).select("chunk_id", F.round("score", 6).alias("score"))


@register(f"""
, qs AS (SELECT vec_id AS query_id, ['the with', 'und der', 're'][(vec_id % 3)::INT + 1] AS q, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 30),
qt AS (SELECT query_id, unnest(string_split(q, ' ')) AS term, len(string_split(q, ' ')) AS m FROM qs),
tm AS (SELECT chunk_id, {_TERMS} AS ts FROM v_chunks), av AS (SELECT avg(len(ts)) AS avgdl, count(*)::DOUBLE AS n FROM tm),
po AS (SELECT chunk_id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM tm) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
sc AS (SELECT query_id, chunk_id, sum(ln((n - df + 5e-1) / (df + 5e-1) + 1e0) * (tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * dl / avgdl)))) AS score
  FROM qt JOIN po USING (term) JOIN df USING (term), av GROUP BY query_id, chunk_id, m HAVING count(*) = m),
li AS (SELECT query_id, chunk_id, 1 AS l, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rn FROM sc
  UNION ALL SELECT query_id, chunk_id, 0, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(embedding, v) DESC, chunk_id) FROM qs, v_chunks),
fu AS (SELECT query_id, chunk_id, sum(1e0 / (60 + rn)) AS s, min(l * 1000 + rn) AS f FROM li WHERE rn <= 50 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, f) <= 20),
re AS (SELECT fu.query_id, fu.chunk_id, len(list_intersect(string_split(q, ' '), ts)) / len(string_split(q, ' '))::DOUBLE AS score FROM fu JOIN qs USING (query_id) JOIN tm USING (chunk_id))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank, chunk_id, score FROM re QUALIFY rank <= 10""")
def many_hybrid(d: Demo) -> DataFrame:
    """Thirty queries at once."""
    queries = d.table("embeddings").where("vec_id < 30").select(F.col("vec_id").alias("query_id"), _pick(F.col("vec_id"), ["the with", "und der", "re"]).alias("query"), F.col("embedding").alias("vector"))
    found = many.search_texts(queries, written(d.chunks().select("chunk_id", "content", "embedding"), "chunks"), k=10)
    return found.select("query_id", "rank", "chunk_id", "score")


@register("""
SELECT 1 AS version, o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 < 2
UNION ALL SELECT 2, o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE 'merged' END FROM orders
UNION ALL SELECT 3, o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE 'merged' END FROM orders WHERE o_orderkey % 7 > 0""")
def table_versions(d: Demo) -> DataFrame:
    """All rows of three versions: written, merged by key, and some keys deleted."""
    orders = d.table("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    store, key = Store(d.spark, _folder(d, "versions"), {"orders": ["o_orderkey"]}, buckets=4), F.col("o_orderkey")
    store.commit({"orders": replace(orders.where(key % 3 < 2))})
    store.commit({"orders": merge(orders.where(key % 3 != 1).withColumn("status", F.lit("merged")))})
    store.commit({"orders": delete(orders.where(key % 7 == 0).select("o_orderkey"))})
    rows = [store.read("orders", v).withColumn("version", F.lit(v)) for v in (1, 2, 3)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@register(f"""
WITH e AS (SELECT item_id, item_id % 3 AS kb_id, {_HASHED('text', 32)} AS v FROM benchmark),
s AS (SELECT a.kb_id, a.item_id AS low_id, b.item_id AS high_id, list_cosine_similarity(a.v, b.v) AS x FROM e AS a JOIN e AS b ON a.kb_id = b.kb_id AND a.item_id < b.item_id WHERE list_sum(a.v) > 0 AND list_sum(b.v) > 0)
SELECT kb_id, low_id, high_id, round(x, 9) AS similarity FROM s WHERE x >= 0.4321""")
def similar_articles(d: Demo) -> DataFrame:
    """Pairs of a base's articles whose term vectors are similar."""
    rows = d.table("benchmark").select("item_id", (F.col("item_id") % 3).alias("kb_id"), vx.hashed_embedding(tx.terms(F.col("text")), 32).alias("embedding"))
    found = similar.similar_pairs(rows, 0.4321, "item_id")
    return found.select("kb_id", F.col("left").alias("low_id"), F.col("right").alias("high_id"), F.round("similarity", 9).alias("similarity"))


@register(r"""
SELECT doc_id::VARCHAR AS file_id, CASE WHEN regexp_matches(coalesce(text, ''), '[^ \t\r\n\x0b\f]') THEN 'ready' ELSE 'failed' END AS status, 1 AS tries,
  CASE WHEN regexp_matches(coalesce(text, ''), '[^ \t\r\n\x0b\f]') THEN NULL ELSE 'No content' END AS error, lang AS kb_id FROM documents""")
def stream_versions(d: Demo) -> DataFrame:
    """Documents through the stream into versioned tables: states of files, each with the base that is to be compiled for it."""
    root = _folder(d, "stream")
    pending = d.files(d.stream("documents")).select(F.col("file_id").cast("string"), "filename", "content", "created_at")
    members = d.members().withColumn("file_id", F.col("file_id").cast("string"))
    shape = "file_id string, parent_index int, child_index int, parent string, parent_tokens int, child string, child_tokens int"
    store = ingest.new_store(d.spark, f"{root}/store", shape, members, buckets=4)
    ingest.ingest_into(store, pending, f"{root}/state", lambda rows: chunk_hierarchy(rows.select("file_id", F.col("content").alias("text")))).awaitTermination()
    wanted = store.read("triggers").select("kb_id").distinct()
    return store.read("files").join(members, "file_id").join(wanted, "kb_id", "left_semi").select("file_id", "status", "tries", "error", "kb_id")


@register("""SELECT event_id, k AS key, CASE WHEN json_type(props, '$.k') IN ('VARCHAR') THEN 'text' ELSE 'number' END AS kind, json_extract(props, '$.k')::VARCHAR AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def json_values(d: Demo) -> DataFrame:
    return files.json_values(d.table("events").select("event_id", F.col("props").alias("content"))).select("event_id", "key", "kind", "value")


# ---- compilation ---------------------------------------------------------------

_CONCEPTS = r"""sm AS (SELECT lang AS kb_id, doc_id AS file_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+([A-Z])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda x: trim(x)), lambda x: x <> '')[1:2], ' ') AS summary FROM documents),
wo AS (SELECT kb_id, file_id, unnest(regexp_extract_all(lower(summary), '[a-z0-9]+')) AS term FROM sm),
tf AS (SELECT kb_id, term, count(*) AS tf, count(DISTINCT file_id) AS df FROM wo GROUP BY 1, 2), nn AS (SELECT kb_id, count(*) AS n FROM sm GROUP BY 1),
ck AS (SELECT kb_id, term, row_number() OVER (PARTITION BY kb_id ORDER BY tf * ln((n + 1e0) / (df + 5e-1)) DESC, term) AS rank FROM tf JOIN nn USING (kb_id) QUALIFY rank <= 10),
old AS (SELECT DISTINCT 'en' AS kb_id, lower(split_part(title, ' ', 1)) AS term FROM v_articles),
con AS (SELECT ck.kb_id, ck.term, ck.rank::INT AS rank, old.term IS NULL AS is_new FROM ck LEFT JOIN old ON ck.kb_id = old.kb_id AND ck.term = old.term)"""

_COMPILED = _CONCEPTS + r""",
cv AS (SELECT * FROM v_chunks),
tm AS (SELECT chunk_id, regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+') AS ts FROM cv), av AS (SELECT avg(len(ts)) AS avgdl, count(*)::DOUBLE AS n FROM tm),
po AS (SELECT term, chunk_id, any_value(dl) AS dl, count(*) AS tf FROM (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM tm) WHERE term IN (SELECT term FROM con) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
tx AS (SELECT kb_id, con.term, chunk_id, row_number() OVER (PARTITION BY kb_id, con.term
    ORDER BY ln((n - df + 5e-1) / (df + 5e-1) + 1e0) * (tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * dl / avgdl))) DESC, chunk_id) AS rn
  FROM con JOIN po ON po.term = con.term JOIN df ON df.term = con.term, av QUALIFY rn <= 50),
qv AS (SELECT kb_id, term, embedding::DOUBLE[] AS v FROM con JOIN embeddings ON vec_id = rank),
ve AS (SELECT kb_id, term, chunk_id, row_number() OVER (PARTITION BY kb_id, term ORDER BY list_cosine_similarity(cv.embedding, v) DESC, chunk_id) AS rn FROM qv, cv QUALIFY rn <= 50),
fl AS (SELECT kb_id, term, chunk_id, sum(1e0 / (60 + rn)) AS s, min(l * 1000 + rn) AS f FROM (SELECT *, 0 AS l FROM ve UNION ALL SELECT *, 1 FROM tx) GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY kb_id, term ORDER BY s DESC, f) <= 20),
rr AS (SELECT fl.kb_id, fl.term, fl.chunk_id, row_number() OVER (PARTITION BY fl.kb_id, fl.term ORDER BY (po.chunk_id IS NOT NULL)::INT DESC, fl.chunk_id) AS hit
  FROM fl LEFT JOIN po ON po.term = fl.term AND po.chunk_id = fl.chunk_id QUALIFY hit <= 10),
hi AS (SELECT con.kb_id, con.term, con.is_new, hit, doc_id, text FROM con JOIN rr ON con.kb_id = rr.kb_id AND con.term = rr.term JOIN documents d ON d.doc_id = rr.chunk_id AND d.lang = con.kb_id)"""


def _summaries(d: Demo) -> DataFrame:
    return d.table("documents").select(F.col("doc_id").alias("file_id"), enrich.first_sentences(F.coalesce("text", F.lit(""))).alias("summary"))


def _titles(d: Demo) -> DataFrame:
    return d.articles().select(F.lit("en").alias("kb_id"), F.split("title", " ")[0].alias("title"))


@register(f", {_CONCEPTS} SELECT * FROM con")
def kb_concepts(d: Demo) -> DataFrame:
    return kb.concepts(compilation.kb_summaries(d.members(), _summaries(d)), _titles(d))


def _compiled(d: Demo) -> compilation.Compiled:
    bases = d.members().select("kb_id").distinct().unionByName(d.spark.createDataFrame([("none",)], "kb_id string"))
    given = d.table("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    ask = lambda asked: asked.join(given, F.col("rank") == F.col("vec_id")).select("query_id", "vector")
    chunks = written(d.chunks(), "chunks")  # else its join would be made again for each scan
    return compilation.compile_bases(bases, d.members(), _summaries(d), _titles(d), chunks, models.hashed_embedder(8), dims=4, ask=ask)


@register(f""", {_COMPILED}, ar AS (SELECT kb_id, term AS title, is_new, string_agg(substr(text, 1, 80), {NL} ORDER BY hit) AS content FROM hi GROUP BY ALL)
SELECT kb_id, title, CASE WHEN is_new THEN 'concept' ELSE 'summary' END AS article_type, md5(content) AS content_md5,
  array_to_string(list_transform(({_HASHED(f"title || {NL} || {NL} || content", 8)})[1:4], lambda x: x::INT), ',') AS vector FROM ar""")
def kb_compile_articles(d: Demo) -> DataFrame:
    return _compiled(d).articles.select("kb_id", "title", "article_type", F.md5("content").alias("content_md5"), _whole("embedding"))


@register(f", {_COMPILED} SELECT kb_id, term AS title, doc_id AS chunk_id FROM hi")
def kb_compile_sources(d: Demo) -> DataFrame:
    return _compiled(d).sources


@register(f", {_COMPILED} SELECT DISTINCT a.kb_id, a.term AS src, b.term AS dst, 'related' AS link_type FROM hi a JOIN hi b ON a.kb_id = b.kb_id AND a.doc_id = b.doc_id AND a.term <> b.term")
def kb_compile_links(d: Demo) -> DataFrame:
    return _compiled(d).links


@register(f", {_COMPILED} SELECT kb_id, CASE WHEN kb_id IN (SELECT kb_id FROM hi) THEN 'active' ELSE 'error' END AS status FROM (SELECT DISTINCT lang AS kb_id FROM documents UNION ALL SELECT 'none')")
def kb_compile_status(d: Demo) -> DataFrame:
    return _compiled(d).bases


# ---- enrichment ----------------------------------------------------------------


@register(f"""SELECT c_custkey, c_name || {NL} || 'First of ' || c_custkey || '. Second one.' AS document_summary, c_name || ': First of ' || c_custkey || '. | Part: More here.' AS sections FROM customer""")
def document_outline(d: Demo) -> DataFrame:
    text = F.concat(F.lit("# "), "c_name", F.lit("\nFirst of "), F.col("c_custkey").cast("string"), F.lit(". Second one. Third.\n## Part\nMore here. And more."))
    made = d.table("customer").select("c_custkey", tx.document_outline(text).alias("o"))
    return made.select("c_custkey", "o.document_summary", tx.section_digest(F.col("o.section_summaries")).alias("sections"))


@register(f"""SELECT o_custkey AS file_id, CASE WHEN count(*) <= 3 THEN 1 ELSE (count(*) + 1) // 2 END AS n_groups,
  'Order ' || min(o_orderkey) || {NL} || 'Done by ' || arg_min(o_orderpriority, o_orderkey) || '. Rest.' AS document_summary,
  string_agg('Order ' || o_orderkey || ': Done by ' || o_orderpriority || '.', ' | ' ORDER BY o_orderkey) AS sections FROM orders GROUP BY o_custkey""")
def group_outlines(d: Demo) -> DataFrame:
    """Files of up to three orders as a whole, others by groups of two."""
    text = F.concat(F.lit("# Order "), F.col("o_orderkey").cast("string"), F.lit("\nDone by "), "o_orderpriority", F.lit(". Rest."))
    parents = d.table("orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("parent_index"), text.alias("content"), F.lit(100).cast("long").alias("token_count"))
    out = enrich.document_outlines(parents, whole_max=300, group_max=200)
    return out.select("file_id", F.col("n_groups").cast("long").alias("n_groups"), "document_summary", tx.section_digest(F.col("section_summaries")).alias("sections"))


@register(rf"""
WITH w AS (SELECT conv_id, turn, text, coalesce(list(substr(text, 1, 500)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS b,
  coalesce(list(substr(text, 1, 500)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []) AS a FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 2 = 1 OR length(text) % 2 = 0 THEN 'old'
  ELSE 'S' || conv_id || ' | H: x | ' || length(array_to_string(list_concat(b, a), chr(10) || '---' || chr(10))) END AS prefix FROM w""")
def two_pass_context(d: Demo) -> DataFrame:
    """Prefixes of documents with a summary; the model has no answer for texts of even length."""
    c = d.table("conversations")
    chunks = c.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"), F.lit("old").alias("context_prefix"))
    sections = F.array(F.struct(F.lit("H").alias("heading"), F.lit("x").alias("summary")))
    summaries = c.where("conv_id % 2 = 0").select(F.col("conv_id").alias("file_id"), F.concat(F.lit("S"), F.col("conv_id").cast("string")).alias("summary"), sections.alias("sections")).dropDuplicates(["file_id"])

    def model(summary: Column, digest: Column, near: Column, content: Column) -> Column:
        return F.when(F.length(content) % 2 == 0, "").otherwise(F.concat_ws(" | ", summary, digest, F.length(near).cast("string")))

    out = writeback.two_pass(chunks, summaries, model)
    return out.select(F.col("file_id").alias("conv_id"), F.col("chunk_index").alias("turn"), F.col("context_prefix").alias("prefix"))


@register("""
WITH d AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS document FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, CASE WHEN length(text) % 3 > 0 THEN 'at ' || strpos(document, text) || ' of ' || length(document) || ': ' || substr(text, 1, 9) ELSE 'old' END AS prefix
FROM conversations JOIN d USING (conv_id)""")
def whole_document_context(d: Demo) -> DataFrame:
    """Each turn in its whole conversation; every third length gets an empty answer."""
    c = d.table("conversations").select(F.col("conv_id").alias("file_id"), "turn", F.col("text").alias("content"), F.lit("old").alias("context_prefix"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"])
    whole = c.groupBy("file_id").agg(F.array_join(listed, "\n").alias("content"))

    def model(document: Column, chunk: Column) -> Column:
        place = F.concat(F.lit("at "), F.instr(document, chunk).cast("string"), F.lit(" of "), F.length(document).cast("string"), F.lit(": "), F.substring(chunk, 1, 9))
        return F.when(F.length(chunk) % 3 > 0, place).otherwise("")

    return writeback.whole_document_context(c, whole, model).select(F.col("file_id").alias("conv_id"), "turn", F.col("context_prefix").alias("prefix"))


@register("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'new ' || doc_id ELSE 'old' END AS prefix FROM documents")
def prefix_write_back(d: Demo) -> DataFrame:
    ident = F.col("doc_id")
    chunks = d.table("documents").select("doc_id", F.floor(ident / 4).alias("file_id"), (ident % 4).alias("chunk_index"), F.lit("old").alias("context_prefix"))
    prefix = F.when(ident % 3 == 1, F.concat(F.lit("new "), ident.cast("string"))).otherwise("")
    enriched = chunks.where("doc_id % 3 < 2").select("file_id", "chunk_index", prefix.alias("prefix"))
    return writeback.write_back(chunks, enriched).select("doc_id", F.col("context_prefix").alias("prefix"))


@register("""SELECT doc_id // 4 AS parent_chunk_id, '' AS prefix, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id % 4) AS children, md5(string_agg(text, '|' ORDER BY doc_id % 4)) AS texts_md5
FROM documents GROUP BY ALL""")
def group_reconstruct(d: Demo) -> DataFrame:
    docs, ident = d.table("documents"), F.col("doc_id")
    parent = F.floor(ident / 4).alias("parent_chunk_id")
    parents = docs.where("doc_id % 4 = 0").select(F.lit(0).alias("file_id"), parent, ident.alias("created_at"), F.col("text").alias("content"))
    children = docs.select(parent, (ident % 4).cast("int").alias("chunk_index"), ident.alias("chunk_id"), F.col("text").alias("content"), F.lit("p").alias("context_prefix"))
    out = writeback.groups(parents, children)
    ids, texts = F.transform("children", lambda c: c["chunk_id"].cast("string")), F.transform("children", lambda c: c["content"])
    return out.select("parent_chunk_id", F.col("context_prefix").alias("prefix"), F.array_join(ids, ",").alias("children"), F.md5(F.array_join(texts, "|")).alias("texts_md5"))


# ---- chunkers ------------------------------------------------------------------

_NAMES = ["a.txt", "a.md", "a.py", "a.js", "a.json", "a.csv", "a.ipynb", "a.png"]
_KINDS = ["text", "markdown", "code", "code", "json", "csv", "notebook", "image"]


def _mixed(d: Demo) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("c_name")
    texts = [
        F.concat(name, F.lit(" here.")), F.concat(F.lit("# "), name, F.lit("\nBody of it.")), F.concat(F.lit("def f():\n    return '"), name, F.lit("'\n")), F.concat(F.lit("let x = '"), name, F.lit("';")),
        F.concat(F.lit('{"k": "'), name, F.lit('"}')), F.concat(F.lit("k,v\n1,"), name), F.concat(F.lit('{"cells":[{"cell_type":"markdown","source":["# '), name, F.lit('"]},{"cell_type":"code","source":["x"]}]}')), name,
    ]
    content = F.element_at(F.array(*texts), (key % 8).cast("int") + 1)
    return d.table("customer").select(key.alias("file_id"), _pick(key, _NAMES).alias("filename"), _pick(key, _KINDS).alias("content_type"), content.alias("content"))


@register(f"""
WITH n AS (SELECT c_custkey AS k, c_name AS name, c_custkey % 8 AS m FROM customer)
SELECT k::VARCHAR AS file_id, ['text', 'text', 'code', 'code', 'json', 'csv', 'code'][m + 1] AS content_type, 0::BIGINT AS part,
  ['File: a.txt', 'File: a.md | ' || name, 'File: a.py | Function: f', 'File: a.js', 'File: a.json | Path: k', 'File: a.csv | Columns: k, v', 'Notebook: a.ipynb | Section: ' || name || ' | Cell: 1'][m + 1] AS prefix,
  [name || ' here.', '# ' || name || {NL} || 'Body of it.', 'def f():' || {NL} || '    return ''' || name || '''', 'let x = ''' || name || ''';', '{{' || {NL} || '  "k": "' || name || '"' || {NL} || '}}',
   '| k | v |' || {NL} || '| --- | --- |' || {NL} || '| 1 | ' || name || ' |', '# ' || name || {NL} || {NL} || '```python' || {NL} || 'x' || {NL} || '```'][m + 1] AS child FROM n WHERE m < 7""")
def chunk_dispatch(d: Demo) -> DataFrame:
    return chunkers.chunk_files(_mixed(d)).select("file_id", "content_type", "part", "prefix", "child")


@register("SELECT c_custkey::VARCHAR AS file_id, 'image' AS content_type, 'no chunker for image' AS error FROM customer WHERE c_custkey % 8 = 7")
def unreadable_files(d: Demo) -> DataFrame:
    return chunkers.unreadable(_mixed(d))


@register(f"""
SELECT c_custkey AS file_id, 0::BIGINT AS group_no, 'File: c.md | ' || c_name AS prefix, c_name AS title, '# ' || c_name || {NL} || 'Intro words.' AS child FROM customer
UNION ALL SELECT c_custkey, 1, 'File: c.md | ' || c_name || ' > Part A', c_name, '## Part A' || {NL} || 'Text of ' || c_custkey || '.' FROM customer""")
def chunk_markdown(d: Demo) -> DataFrame:
    text = F.concat(F.lit("---\ntitle: "), "c_name", F.lit("\n---\n# "), "c_name", F.lit("\nIntro words.\n## Part A\nText of "), F.col("c_custkey").cast("string"), F.lit("."))
    made = d.table("customer").select(F.col("c_custkey").alias("file_id"), F.lit("c.md").alias("filename"), text.alias("content"))
    out = chunkers.chunk_markdown(made, min_tokens=1)
    return out.select("file_id", "group_no", "prefix", F.col("metadata")["title"].alias("title"), "child")


@register(f"""
WITH n AS (SELECT c_custkey AS k, c_name AS name, c_custkey % 5 AS m FROM customer)
SELECT k AS file_id, 0 AS part, 'File: a.toml | Path: a' AS prefix, '{{' || {NL} || '  "a": 1' || {NL} || '}}' AS content FROM n WHERE m = 0
UNION ALL SELECT k, 1, 'File: a.toml | Path: t', '{{' || {NL} || '  "t": {{' || {NL} || '    "b": "' || name || '"' || {NL} || '  }}' || {NL} || '}}' FROM n WHERE m = 0
UNION ALL SELECT k, 0, 'File: b.json | Path: q"''q', '{{' || {NL} || '  "q\\"''q": "' || name || '"' || {NL} || '}}' FROM n WHERE m = 1
UNION ALL SELECT k, 0, '', '{{oops ' || name FROM n WHERE m = 2 UNION ALL SELECT k, 0, '', '[' || {NL} || '  "' || name || '"' || {NL} || ']' FROM n WHERE m = 3 UNION ALL SELECT k, 0, '', '{{}}' FROM n WHERE m = 4""")
def chunk_structured(d: Demo) -> DataFrame:
    """TOML, JSON with an odd key, broken JSON, a list, and an empty object."""
    key, name = F.col("c_custkey"), F.col("c_name")
    texts = [F.concat(F.lit('a = 1\n[t]\nb = "'), name, F.lit('"\n')), F.concat(F.lit('{"q\\"\'q": "'), name, F.lit('"}')), F.concat(F.lit("{oops "), name), F.concat(F.lit('["'), name, F.lit('"]')), F.lit("{}")]
    content = F.element_at(F.array(*texts), (key % 5).cast("int") + 1)
    made = d.table("customer").select(key.alias("file_id"), _pick(key, ["a.toml", "b.json", "c.json", "d.json", "e.json"]).alias("filename"), content.alias("content"))
    return chunkers.chunk_structured(made).select("file_id", "part", "prefix", "content")


@register(f"""SELECT n_nationkey AS file_id, 'File: n.csv | Columns: key, note' AS prefix, '| key | note |' || {NL} || '| --- | --- |' || {NL} || '| ' || n_nationkey || ' | two' || {NL} || 'lines "of" ' || n_name || ' | extra |' || {NL} || '|  |  |' AS content FROM nation""")
def chunk_csv_quoted(d: Demo) -> DataFrame:
    """Cells with line ends and quotes, a row with more cells than the header, and a blank line."""
    text = F.concat(F.lit("key,note\r\n"), F.col("n_nationkey").cast("string"), F.lit(',"two\nlines ""of"" '), "n_name", F.lit('",extra\r\n\r\n'))
    made = d.table("nation").select(F.col("n_nationkey").alias("file_id"), F.lit("n.csv").alias("filename"), text.alias("content"))
    return chunkers.chunk_csv(made).select("file_id", "prefix", "content")


@register("""
WITH p AS (SELECT p_partkey, p_size * 20 AS n, p_partkey % 2 = 0 AS stored FROM part),
s AS (SELECT *, CASE WHEN stored AND n > 30 THEN 500 ELSE 30 END AS size FROM p)
SELECT p_partkey, CASE WHEN stored AND n > 30 THEN 'batch' ELSE 'online' END AS route,
  unnest(list_transform(range(0, n, size), lambda i: (i + 1) || '-' || least(i + size, n))) AS page_range FROM s""")
def pdf_jobs(d: Demo) -> DataFrame:
    jobs = d.table("part").select("p_partkey", F.explode(chunkers.pdf_jobs(F.col("p_size") * 20, F.col("p_partkey") % 2 == 0)).alias("j"))
    return jobs.select("p_partkey", "j.route", "j.page_range")


@register(f"""SELECT n_nationkey::VARCHAR AS file_id, 'File: p.pdf | ' || n_name AS prefix, '# ' || n_name || {NL} || {NL} || 'Pages 1-30' || {NL} || {NL} || '- item' || {NL} || {NL} || '| a | b |' || {NL} || '| --- | --- |' || {NL} || '| 1 |  |'
  || CASE WHEN n_nationkey % 2 = 1 THEN {NL} || {NL} || {NL} || '# ' || n_name || {NL} || {NL} || 'Pages 31-40' || {NL} || {NL} || '- item' || {NL} || {NL} || '| a | b |' || {NL} || '| --- | --- |' || {NL} || '| 1 |  |' ELSE '' END AS child FROM nation""")
def pdf_layout(d: Demo) -> DataFrame:
    """Layouts of one or two online jobs: headings, lists, tables, and headers that go with what they hold."""

    def parse(content: Column, pages: Column) -> Column:
        head = F.concat(F.lit('[{"type":"header","text":"x","blocks":[{"type":"paragraph","text":"gone"}]},{"type":"title","text":"'), content, F.lit('","blocks":[{"type":"paragraph","text":"Pages '))
        return F.concat(head, pages, F.lit('"},{"type":"list-item","text":" item "}]},{"type":"table","rows":[["a","b"],[1]]},{"type":"footer","text":"y"}]'))

    n = F.when(F.col("n_nationkey") % 2 == 1, 40).otherwise(30)
    made = d.table("nation").select(F.col("n_nationkey").alias("file_id"), F.lit("p.pdf").alias("filename"), F.lit("pdf").alias("content_type"), F.col("n_name").alias("content"), n.alias("n_pages"), F.lit(False).alias("is_stored"))
    out = chunkers.chunk_pdf(made, parse)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "child"))), lambda x: x["child"]), "\n\n")
    return out.groupBy(F.col("file_id").cast("string").alias("file_id")).agg(F.min("prefix").alias("prefix"), whole.alias("child"))


@register("""SELECT c_custkey, c_name AS title, 'given' AS kind, CASE WHEN c_custkey % 2 = 0 THEN 'own' END AS extra FROM customer""")
def metadata_merge(d: Demo) -> DataFrame:
    """The given values win over the front matter's."""
    front = F.create_map(F.lit("title"), F.col("c_name"), F.lit("kind"), F.lit("front"))
    given = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("kind"), F.lit("given"), F.lit("extra"), F.lit("own"))).otherwise(F.create_map(F.lit("kind"), F.lit("given")))
    m = d.table("customer").select("c_custkey", tx.merged_metadata(front, given).alias("m"))
    return m.select("c_custkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("title", "kind", "extra")])


@register("SELECT doc_id, (i // 1000)::INT AS piece_no, md5(encode(text)[(i + 1):(i + 1000)]::BLOB) AS piece_md5 FROM (SELECT doc_id, text, unnest(range(0, strlen(text), 1000)) AS i FROM documents WHERE length(text) = strlen(text))")
def byte_pieces(d: Demo) -> DataFrame:
    """Pieces of 1,000 bytes of the texts that hold ASCII only."""
    docs = d.table("documents").where("length(text) = octet_length(text)").select("doc_id", F.col("text").cast("binary").alias("content"))
    return files.byte_pieces(docs, 1000).select("doc_id", "piece_no", F.md5("piece").alias("piece_md5"))


# ---- service state -------------------------------------------------------------


@register("SELECT c_custkey, c_custkey % 2 = 0 AS is_uuid FROM customer")
def uuid_check(d: Demo) -> DataFrame:
    h = F.md5("c_name")
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return d.table("customer").select("c_custkey", tx.is_uuid(F.when(F.col("c_custkey") % 2 == 0, uuid).otherwise(F.concat(uuid, F.lit("0")))).alias("is_uuid"))


@register("SELECT c_custkey, substr(md5(c_name), 1, 8) AS key_prefix FROM customer WHERE substr(md5(c_name), 1, 8) = (SELECT substr(md5(c_name), 1, 8) FROM customer WHERE c_custkey = 8)")
def key_by_prefix(d: Demo) -> DataFrame:
    start = F.lit("2024-01-01").cast("timestamp")
    keys = d.table("customer").select("c_custkey", tx.key_prefix(F.concat(F.lit("sk_"), F.md5("c_name")), "sk_").alias("key_prefix"), F.lit(None).cast("timestamp").alias("revoked_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    asked = keys.where("c_custkey = 8").first()["key_prefix"]
    return state.valid_keys(keys, asked, start).select("c_custkey", "key_prefix")


@register("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50")
def oldest_first(d: Demo) -> DataFrame:
    return kb.page(d.table("orders"), ["o_orderdate", "o_orderkey"], 50).select("o_orderkey", "o_custkey")


@register("SELECT *, count(*) OVER () AS total FROM (SELECT article_id, title FROM v_articles WHERE category = 'c2' ORDER BY title, article_id LIMIT 7 OFFSET 3)")
def page_total(d: Demo) -> DataFrame:
    return kb.page_with_total(d.articles().where("category = 'c2'").select("article_id", "title"), ["title", "article_id"], 7, 3)


_UUID_SQL = "regexp_replace(md5(lang || source), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"


def _named_bases(d: Demo) -> DataFrame:
    h = F.md5(F.concat("lang", "source"))
    uuid = F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    made = d.table("documents").groupBy("lang", "source").agg(F.min("doc_id").alias("created_at"))
    return made.select(uuid.alias("kb_id"), F.col("lang").alias("name"), F.col("source").alias("tenant_id"), "created_at")


@register(f"""WITH b AS (SELECT {_UUID_SQL} AS kb_id, lang AS name, source AS tenant_id FROM documents GROUP BY lang, source)
SELECT 'name' AS asked, * FROM b WHERE name = 'de' AND tenant_id = 'src1' UNION ALL SELECT 'id', * FROM b WHERE name = 'en' AND tenant_id = 'src0'""")
def kb_resolve(d: Demo) -> DataFrame:
    bases = _named_bases(d).drop("created_at")
    ident = bases.where("name = 'en' AND tenant_id = 'src0'").first()
    by_id = kb.resolve(bases, ident["kb_id"] if ident else "none")
    return kb.resolve(bases, "de", "src1").select(F.lit("name").alias("asked"), "*").unionByName(by_id.select(F.lit("id").alias("asked"), "*"))


@register(f"SELECT {_UUID_SQL} AS kb_id, lang AS name, min(doc_id) AS created_at FROM documents WHERE source = 'src1' GROUP BY lang, source")
def kb_list(d: Demo) -> DataFrame:
    return kb.listed(_named_bases(d), "src1").select("kb_id", "name", "created_at")


@register("""
, lost AS (SELECT article_id FROM v_articles WHERE kb_id IN (1, 3))
SELECT 'bases' AS kept, count(*) AS n FROM (SELECT DISTINCT kb_id FROM v_articles WHERE kb_id NOT IN (1, 3))
UNION ALL SELECT 'members', count(*) FROM documents WHERE doc_id % 5 NOT IN (1, 3) UNION ALL SELECT 'articles', count(*) FROM v_articles WHERE kb_id NOT IN (1, 3)
UNION ALL SELECT 'sources', count(*) FROM v_sources WHERE article_id NOT IN (SELECT article_id FROM lost)
UNION ALL SELECT 'links', count(*) FROM v_links WHERE src NOT IN (SELECT article_id FROM lost) AND dst NOT IN (SELECT article_id FROM lost)""")
def kb_delete_cascade(d: Demo) -> DataFrame:
    gone = d.spark.createDataFrame([(1,), (3,)], "kb_id long")
    members = d.table("documents").select((F.col("doc_id") % 5).alias("kb_id"), F.col("doc_id").alias("file_id"))
    return _counts(kb.delete_bases(gone, d.bases(), members, d.articles(), d.sources(), d.links()))


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [t.agg(F.lit(name).alias("kept"), F.count(F.lit(1)).alias("n")) for name, t in tables.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


@register("""
, gone AS (SELECT file_id FROM v_files WHERE status = 'failed')
SELECT 'files' AS kept, count(*) AS n FROM v_files WHERE file_id NOT IN (SELECT file_id FROM gone) UNION ALL SELECT 'chunks', count(*) FROM v_texts WHERE file_id NOT IN (SELECT file_id FROM gone)
UNION ALL SELECT 'sources', count(*) FROM v_sources WHERE chunk_id NOT IN (SELECT file_id FROM gone) UNION ALL SELECT 'aliases', count(*) FROM embeddings WHERE label % 2 = 0 AND vec_id // 2 NOT IN (SELECT chunk_id FROM v_texts WHERE file_id IN (SELECT file_id FROM gone))
UNION ALL SELECT 'summaries', count(*) FROM v_files WHERE file_id NOT IN (SELECT file_id FROM gone)""")
def file_delete_cascade(d: Demo) -> DataFrame:
    gone = d.files().where("status = 'failed'").select("file_id")
    return _counts(kb.delete_files(gone, d.files(), d.texts(), d.sources(), d.aliases(), summaries=_summaries(d)))
