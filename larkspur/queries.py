"""Registered queries over the retrieval engine's operators, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions import vectors as vx
from larkspur.operators import chunkers, enrich, kb, markdown, packing, retrieval, state
from larkspur.plans.demo import Demo
from larkspur.registry import ORACLES, QUERIES, Query, register
from larkspur.sources import detect, files

ASKED = "the with"


# ---- sources and scopes --------------------------------------------------------

_NAMES = ["a.ipynb", "b.PY", "c.md", "d.toml", "e.yml", "f.csv", "g.xls", "h.jpeg", "i.rst", "j", "k.bin", "l.vue"]
_MIMES = ["application/pdf", "image/tiff", "text/x-yaml", "application/json", "text/plain"]


@register("""
WITH p AS (SELECT p_partkey, ['a.ipynb','b.PY','c.md','d.toml','e.yml','f.csv','g.xls','h.jpeg','i.rst','j','k.bin','l.vue'][(p_partkey % 12)::INT + 1] AS filename,
  ['application/pdf','image/tiff','text/x-yaml','application/json','text/plain'][(p_partkey % 5)::INT + 1] AS mime FROM part)
SELECT p_partkey, filename, mime, CASE
  WHEN filename LIKE '%.ipynb' THEN 'notebook' WHEN filename IN ('b.PY', 'l.vue') THEN 'code' WHEN filename = 'c.md' THEN 'markdown'
  WHEN filename = 'd.toml' THEN 'json' WHEN filename = 'e.yml' THEN 'yaml' WHEN filename = 'f.csv' THEN 'csv' WHEN filename = 'g.xls' THEN 'xlsx'
  WHEN filename = 'h.jpeg' THEN 'image' WHEN filename = 'i.rst' THEN 'text' WHEN mime LIKE '%pdf%' THEN 'pdf' WHEN mime LIKE '%image%' THEN 'image'
  WHEN mime LIKE '%json%' THEN 'json' WHEN mime LIKE '%yaml%' THEN 'yaml' ELSE 'text' END AS content_type FROM p""")
def detect_type(d: Demo) -> DataFrame:
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names)).cast("int") + 1)
    named = d.table("part").select("p_partkey", pick(_NAMES).alias("filename"), pick(_MIMES).alias("mime"))
    return named.withColumn("content_type", detect.content_type(F.col("filename"), F.col("mime")))


@register("SELECT tenant_id, count(*) AS n_files, sum(n_chars)::BIGINT AS n_chars FROM v_files WHERE status = 'ready' GROUP BY tenant_id")
def scope_ready(d: Demo) -> DataFrame:
    return d.files().where("status = 'ready'").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chars").alias("n_chars"))


@register("SELECT file_id, tenant_id FROM v_files f WHERE EXISTS (SELECT 1 FROM v_members m WHERE m.file_id = f.file_id AND m.kb_id = 'fr')")
def scope_kb_semi(d: Demo) -> DataFrame:
    return d.files().join(d.members().where("kb_id = 'fr'"), "file_id", "left_semi").select("file_id", "tenant_id")


@register("SELECT chunk_id, c.file_id, tenant_id, content_type FROM v_chunks c JOIN v_files f ON c.file_id = f.file_id WHERE status = 'ready'")
def chunk_file_join(d: Demo) -> DataFrame:
    ready = d.files().where("status = 'ready'").select("file_id", "tenant_id")
    return d.chunks().join(ready, "file_id").select("chunk_id", "file_id", "tenant_id", "content_type")


@register("SELECT c.chunk_id, f.tenant_id, c.content_type FROM v_chunks c JOIN v_files f ON c.file_id = f.file_id WHERE c.chunk_id = 7 AND f.tenant_id = (SELECT source FROM documents WHERE doc_id = 7)")
def chunk_lookup(d: Demo) -> DataFrame:
    owner = d.table("documents").where("doc_id = 7").select(F.col("source").alias("tenant_id"))
    found = d.chunks().where("chunk_id = 7").join(d.files().select("file_id", "tenant_id"), "file_id")
    return found.join(owner, "tenant_id", "left_semi").select("chunk_id", "tenant_id", "content_type")


@register("""
, w AS (SELECT kb_id, file_id FROM v_members UNION SELECT 'all', file_id FROM v_files)
SELECT DISTINCT w.kb_id, w.file_id FROM w JOIN v_files f ON w.file_id = f.file_id
WHERE NOT EXISTS (SELECT 1 FROM v_members m WHERE m.kb_id = w.kb_id AND m.file_id = w.file_id)""")
def anti_not_linked(d: Demo) -> DataFrame:
    wanted = d.members().unionByName(d.files().select(F.lit("all").alias("kb_id"), "file_id"))
    return kb.add_files(d.members(), wanted, d.files())


# ---- retrieval -----------------------------------------------------------------

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_COS = f"list_cosine_similarity(embedding, {_Q})"


def _hits(rows: DataFrame, ident: str = "chunk_id") -> DataFrame:
    return rows.select(ident, F.round("score", 6).alias("score"))


@register(f"SELECT chunk_id, round({_COS}, 6) AS score FROM v_chunks c JOIN v_files f ON c.file_id = f.file_id AND status = 'ready' ORDER BY {_COS} DESC, chunk_id LIMIT 50")
def vec_topk(d: Demo) -> DataFrame:
    return _hits(retrieval.vector_search(retrieval.scope(d.chunks(), d.files()), d.query_vector()))


@register(f"""SELECT chunk_id, round({_COS}, 6) AS score FROM v_chunks c JOIN v_files f ON c.file_id = f.file_id AND status = 'ready'
WHERE content_type = 'code' AND EXISTS (SELECT 1 FROM v_members m WHERE m.file_id = c.file_id AND kb_id = 'en') ORDER BY {_COS} DESC, chunk_id LIMIT 20""")
def vec_topk_filtered(d: Demo) -> DataFrame:
    scoped = retrieval.scope(d.chunks(), d.files(), kb_files=d.members().where("kb_id = 'en'"), content_types=["code"])
    return _hits(retrieval.vector_search(scoped, d.query_vector(), 20))


@register(f"""
, s AS (SELECT chunk_id, list_cosine_similarity(embedding[1:16], {_Q}[1:16]) AS score FROM v_chunks)
SELECT chunk_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, chunk_id LIMIT 50""")
def vec_truncated(d: Demo) -> DataFrame:
    short = d.chunks().withColumn("embedding", vx.head(F.col("embedding"), 16))
    return _hits(retrieval.vector_search(short, d.query_vector()[:16]))


@register(f"""
, s AS (SELECT chunk_id, {_COS} AS score FROM v_chunks),
m AS (SELECT chunk_id, score FROM s ORDER BY score DESC, chunk_id LIMIT 50),
a AS (SELECT vec_id AS alias_id, vec_id // 2 AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS score FROM embeddings
      WHERE label % 2 = 0 AND vec_id // 2 IN (SELECT chunk_id FROM v_chunks)),
b AS (SELECT chunk_id, max(score) AS score FROM (SELECT * FROM a ORDER BY score DESC, alias_id LIMIT 50) GROUP BY chunk_id),
u AS (SELECT * FROM m UNION ALL SELECT * FROM b WHERE chunk_id NOT IN (SELECT chunk_id FROM m))
SELECT chunk_id, round(score, 6) AS score FROM u ORDER BY u.score DESC, chunk_id LIMIT 50""")
def vec_alias_merge(d: Demo) -> DataFrame:
    scoped = d.chunks().drop("content")
    hits = retrieval.vector_search(scoped, d.query_vector())
    return _hits(retrieval.with_alias_hits(hits, d.aliases(), scoped, d.query_vector()))


@register(f"""
, s AS (SELECT article_id, title, list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS score FROM v_articles JOIN embeddings ON vec_id = article_id WHERE status = 'published')
SELECT article_id, title, round(score, 6) AS score FROM s ORDER BY s.score DESC, article_id LIMIT 50""")
def article_vec(d: Demo) -> DataFrame:
    rows = d.articles().where("status = 'published'").join(d.table("embeddings"), F.col("article_id") == F.col("vec_id"))
    return retrieval.vector_search(rows, d.query_vector(), ident="article_id").select("article_id", "title", F.round("score", 6).alias("score"))


_TERMS = "regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+')"


def _bm25(source: str, ident: str = "chunk_id", limit: int = 50) -> str:
    idf = "ln((n - df{0} + 0.5e0) / (df{0} + 0.5e0) + 1e0)"
    gain = "tf{0} * 2.2e0 / (tf{0} + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))"
    score = " + ".join(f"{idf} * {gain}".format(i) for i in (0, 1))
    return f"""
t AS (SELECT {ident}, len(w) AS dl, len(list_filter(w, lambda x: x = 'the')) AS tf0, len(list_filter(w, lambda x: x = 'with')) AS tf1
      FROM (SELECT {ident}, {_TERMS} AS w FROM {source})),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, (count(*) FILTER (WHERE tf0 > 0))::DOUBLE AS df0, (count(*) FILTER (WHERE tf1 > 0))::DOUBLE AS df1 FROM t),
txt AS (SELECT {ident}, {score} AS score FROM t, st WHERE tf0 > 0 AND tf1 > 0 ORDER BY score DESC, {ident} LIMIT {limit})"""


@register(f", {_bm25('v_texts')} SELECT chunk_id, round(score, 6) AS score FROM txt")
def bm25_topk(d: Demo) -> DataFrame:
    return _hits(retrieval.text_search(d.texts(), ASKED))


@register(f", {_bm25('v_texts')} SELECT chunk_id, round(score, 6) AS score FROM txt")
def bm25_postings(d: Demo) -> DataFrame:
    return _hits(retrieval.postings_search(retrieval.postings(d.texts()), retrieval.corpus_stats(d.texts()), ASKED))


@register(f""", k AS (SELECT c.* FROM v_texts c JOIN v_files f ON c.file_id = f.file_id AND status = 'ready' AND c.file_id IN (SELECT file_id FROM v_members WHERE kb_id = 'en')),
{_bm25('k')} SELECT chunk_id, round(score, 6) AS score FROM txt""")
def bm25_kb(d: Demo) -> DataFrame:
    return _hits(retrieval.text_search(retrieval.scope(d.texts(), d.files(), kb_files=d.members().where("kb_id = 'en'")), ASKED))


@register(f", pub AS (SELECT * FROM v_articles WHERE status = 'published'), {_bm25('pub', 'article_id')} SELECT article_id, round(score, 6) AS score FROM txt")
def article_text(d: Demo) -> DataFrame:
    return _hits(retrieval.text_search(d.articles().where("status = 'published'"), ASKED, ident="article_id"), "article_id")


@register(f"SELECT count(*) AS n_docs, round(avg(len({_TERMS})), 6) AS avgdl FROM v_texts")
def corpus_stats(d: Demo) -> DataFrame:
    return retrieval.corpus_stats(d.texts()).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@register(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TERMS})) AS term FROM v_texts) GROUP BY term")
def document_frequency(d: Demo) -> DataFrame:
    return retrieval.document_frequency(d.texts())


_VEC = f"vec AS (SELECT chunk_id, {_COS} AS score FROM v_chunks ORDER BY score DESC, chunk_id LIMIT 50)"
_FUSED = """r AS (SELECT chunk_id, 0 AS l, row_number() OVER (ORDER BY score DESC, chunk_id) AS rn FROM vec
  UNION ALL SELECT chunk_id, 1, row_number() OVER (ORDER BY score DESC, chunk_id) FROM txt),
fu AS (SELECT chunk_id, sum(1e0 / (60 + rn)) AS score, min(l * 1000 + rn) AS first FROM r GROUP BY chunk_id ORDER BY score DESC, first LIMIT 20)"""


@register(f", {_VEC}, {_bm25('v_chunks')}, {_FUSED} SELECT chunk_id, round(score, 9) AS score FROM fu")
def rrf_two_lists(d: Demo) -> DataFrame:
    lists = [retrieval.vector_search(d.chunks(), d.query_vector()), retrieval.text_search(d.chunks(), ASKED)]
    return retrieval.fuse(lists).select("chunk_id", F.round("score", 9).alias("score"))


_COVER = f"len(list_intersect(['the', 'with'], {_TERMS})) / 2e0"


@register(f"SELECT chunk_id, {_COVER} AS score FROM v_texts ORDER BY score DESC, chunk_id LIMIT 5")
def rerank_coverage(d: Demo) -> DataFrame:
    return retrieval.rerank(d.texts(), ASKED).select("chunk_id", "score")


_PARENTS = "par AS (SELECT doc_id // 4 AS parent_chunk_id, text AS content, n_chars AS token_count FROM documents WHERE doc_id % 4 = 0)"


def _parents(d: Demo) -> DataFrame:
    firsts = d.table("documents").where("doc_id % 4 = 0")
    return firsts.select(F.floor(F.col("doc_id") / 4).alias("parent_chunk_id"), F.col("text").alias("content"), F.col("n_chars").alias("token_count"))


@register(f", {_PARENTS} SELECT chunk_id, t.parent_chunk_id, md5(par.content) AS parent_md5, par.token_count AS parent_token_count FROM v_texts t LEFT JOIN par ON t.parent_chunk_id = par.parent_chunk_id")
def parent_attach(d: Demo) -> DataFrame:
    out = retrieval.attach_parents(d.texts(), _parents(d))
    return out.select("chunk_id", "parent_chunk_id", F.md5("parent_content").alias("parent_md5"), "parent_token_count")


@register(f""", rc AS (SELECT c.*, c.chunk_id // 4 AS parent_chunk_id FROM v_chunks c JOIN v_files f ON c.file_id = f.file_id AND status = 'ready'),
vec AS (SELECT chunk_id, {_COS} AS score FROM rc ORDER BY score DESC, chunk_id LIMIT 50), {_bm25('rc')}, {_FUSED}, {_PARENTS},
top AS (SELECT rc.*, {_COVER} AS score FROM rc WHERE chunk_id IN (SELECT chunk_id FROM fu) ORDER BY score DESC, chunk_id LIMIT 5)
SELECT chunk_id, score, md5(par.content) AS parent_md5 FROM top LEFT JOIN par ON top.parent_chunk_id = par.parent_chunk_id""")
def hybrid_search(d: Demo) -> DataFrame:
    scoped = retrieval.scope(d.chunks().withColumn("parent_chunk_id", F.floor(F.col("chunk_id") / 4)), d.files())
    out = retrieval.hybrid_search(scoped, ASKED, d.query_vector(), parents=_parents(d))
    return out.select("chunk_id", "score", F.md5("parent_content").alias("parent_md5"))


@register(f""", pub AS (SELECT * FROM v_articles WHERE status = 'published'), {_bm25('pub', 'article_id', 5).replace('txt AS', 'arts AS').replace('t AS', 'ta AS', 1).replace('FROM t,', 'FROM ta,').replace('FROM t)', 'FROM ta)').replace('st AS', 'sa AS').replace(', st ', ', sa ')},
{_bm25('v_texts', limit=5)}
SELECT 'chunk' AS result_type, txt.chunk_id AS id, round(score, 6) AS score, NULL AS title FROM txt
UNION ALL SELECT 'article', a.article_id, round(score, 6), title FROM arts a JOIN pub ON a.article_id = pub.article_id""")
def kb_search(d: Demo) -> DataFrame:
    arts = retrieval.text_search(d.articles().where("status = 'published'"), ASKED, 5, ident="article_id")
    out = retrieval.tagged(retrieval.text_search(d.texts(), ASKED, 5), arts)
    return out.select("result_type", "id", F.round("score", 6).alias("score"), "title")


_KB = 1  # of articles by their kb_id, of files by the id's remainder, as in kb_counts


def _kb_parts(d: Demo) -> tuple[DataFrame, DataFrame]:
    """Published articles and chunks of ready files of one knowledge base, with vectors."""
    vectors = d.table("embeddings").select(F.col("vec_id").alias("article_id"), "embedding")
    articles = retrieval.article_scope(d.articles(), _KB).join(vectors, "article_id", "left")
    members = d.table("documents").where(F.col("doc_id") % 5 == _KB).select(F.col("doc_id").alias("file_id"))
    return articles, retrieval.scope(d.chunks().withColumn("parent_chunk_id", F.floor(F.col("chunk_id") / 4)), d.files(), kb_files=members)


_KB_LISTS = f"""kba AS (SELECT a.*, e.embedding::DOUBLE[] AS embedding FROM v_articles a LEFT JOIN embeddings e ON vec_id = article_id WHERE status = 'published' AND kb_id = {_KB}),
kbc AS (SELECT c.*, chunk_id // 4 AS parent_chunk_id FROM v_chunks c JOIN v_files f ON c.file_id = f.file_id AND status = 'ready' WHERE c.file_id % 5 = {_KB}),
av AS (SELECT article_id AS id, {_COS} AS score FROM kba WHERE embedding IS NOT NULL ORDER BY score DESC, id LIMIT 50),
cv AS (SELECT chunk_id AS id, {_COS} AS score FROM kbc ORDER BY score DESC, id LIMIT 50),
{re.sub(r"\b(t|st|txt)\b", r"\1_a", _bm25("kba", "article_id"))}, {_bm25("kbc")},
li AS (SELECT 'article' AS result_type, id, 0 AS l, score FROM av UNION ALL SELECT 'article', article_id, 1, score FROM txt_a
  UNION ALL SELECT 'chunk', id, 2, score FROM cv UNION ALL SELECT 'chunk', chunk_id, 3, score FROM txt),
ra AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, id) AS rn FROM li),
fu AS (SELECT result_type, id, sum(1e0 / (60 + rn)) AS score, min(l * 1000 + rn) AS first FROM ra GROUP BY result_type, id ORDER BY score DESC, first LIMIT 20)"""


@register(f", {_KB_LISTS} SELECT result_type, id, round(score, 9) AS score FROM fu")
def rrf_four_lists(d: Demo) -> DataFrame:
    lists = retrieval.kb_lists(*_kb_parts(d), ASKED, d.query_vector())
    return retrieval.fuse(lists, ident="hit").select("hit.*", F.round("score", 9).alias("score"))


@register(f""", {_KB_LISTS}, {_PARENTS},
al AS (SELECT 'article' AS result_type, article_id AS id, {_COVER} AS score, title, category, NULL AS file_id, NULL AS parent_chunk_id FROM kba
  UNION ALL SELECT 'chunk', chunk_id, {_COVER}, NULL, NULL, file_id, parent_chunk_id FROM kbc),
top AS (SELECT al.* FROM al JOIN fu ON al.result_type = fu.result_type AND al.id = fu.id ORDER BY al.score DESC, al.result_type, al.id LIMIT 5)
SELECT result_type, id, score, title, category, file_id, md5(par.content) AS parent_md5 FROM top LEFT JOIN par ON top.parent_chunk_id = par.parent_chunk_id""")
def kb_hybrid_search(d: Demo) -> DataFrame:
    out = retrieval.kb_search(*_kb_parts(d), ASKED, d.query_vector(), parents=_parents(d))
    return out.select("result_type", "id", "score", "title", "category", "file_id", F.md5("parent_content").alias("parent_md5"))


# ---- text functions ------------------------------------------------------------


@register(r"""SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS joined_md5 FROM (
SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)""")
def sentences(d: Demo) -> DataFrame:
    s = d.table("documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("joined_md5"))


_TOKENS = r"regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]')"


@register(f"SELECT doc_id, len({_TOKENS}) AS n_tokens, len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) AS n_words FROM documents")
def token_count(d: Demo) -> DataFrame:
    return d.table("documents").select("doc_id", tx.count_tokens(F.col("text")).cast("long").alias("n_tokens"), tx.word_count(F.col("text")).cast("long").alias("n_words"))


@register(rf"""SELECT doc_id, md5(CASE WHEN len({_TOKENS}) <= 40 THEN text ELSE rtrim(regexp_extract(text, '^[ \t\r\n]*') ||
 array_to_string(regexp_extract_all(text, '([A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n])[ \t\r\n]*')[1:40], '')) END) AS cut_md5 FROM documents""")
def token_truncate(d: Demo) -> DataFrame:
    return d.table("documents").select("doc_id", F.md5(tx.truncate_to_tokens(F.col("text"), 40)).alias("cut_md5"))


@register("""
SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'File: ' || n_name || ' | Class: K | Function: f' WHEN 1 THEN 'File: ' || n_name || ' | Path: K'
  WHEN 2 THEN 'File: ' || n_name || ' | Sheet: K | Columns: f' WHEN 3 THEN 'Notebook: ' || n_name || ' | Section: K | Cell: f'
  ELSE 'File: ' || n_name || ' | Top > ' || n_name END AS prefix FROM nation""")
def context_prefix(d: Demo) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["code", "json", "csv", "notebook", "markdown"])), F.col("n_regionkey") + 1)
    crumbs = F.array(F.lit("Top"), F.col("n_name"))
    return d.table("nation").select("n_nationkey", tx.context_prefix(kind, F.col("n_name"), F.lit("K"), F.lit("f"), crumbs).alias("prefix"))


@register("SELECT s_suppkey, s_name AS title, (s_nationkey)::VARCHAR AS nation FROM supplier")
def front_matter(d: Demo) -> DataFrame:
    made = F.concat(F.lit("---\ntitle: "), "s_name", F.lit("\nnation : "), F.col("s_nationkey").cast("string"), F.lit("\nno colon here\n---\n# Body\n"))
    m = d.table("supplier").select("s_suppkey", tx.front_matter(made).alias("m"))
    return m.select("s_suppkey", F.col("m")["title"].alias("title"), F.col("m")["nation"].alias("nation"))


def _order_notes(d: Demo) -> DataFrame:
    """One markdown file per customer, a section per order, with headings inside fences."""
    o = d.table("orders")
    part = F.concat(F.lit("## Order "), F.col("o_orderkey").cast("string"), F.lit("\n### Detail\n"), "o_orderpriority", F.lit("\n```\n# not a heading\n```"))
    lines = F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("p"))))
    body = F.array_join(F.transform(lines, lambda x: x["p"]), "\n")
    return o.groupBy(F.col("o_custkey").alias("file_id")).agg(F.concat(F.lit("# Customer "), F.col("file_id").cast("string"), F.lit("\n"), body).alias("content"))


_PART = "'## Order ' || o_orderkey || chr(10) || '### Detail' || chr(10) || o_orderpriority || chr(10) || '```' || chr(10) || '# not a heading' || chr(10) || '```'"
_SECTIONS = f"""sec AS (
  SELECT DISTINCT o_custkey AS file_id, 1::BIGINT AS section_no, 'Customer ' || o_custkey AS h1, NULL AS h2, '# Customer ' || o_custkey AS text FROM orders
  UNION ALL SELECT o_custkey, 1 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 'Customer ' || o_custkey, 'Order ' || o_orderkey, {_PART} FROM orders)"""


@register(f"WITH {_SECTIONS} SELECT * FROM sec")
def markdown_sections(d: Demo) -> DataFrame:
    return markdown.sections(_order_notes(d))


_TOK_OF = r"len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]'))"


@register(f"""WITH {_SECTIONS}, b AS (SELECT *, CASE WHEN {_TOK_OF} >= 21 THEN 1 ELSE 0 END AS big FROM sec),
g AS (SELECT *, coalesce(sum(big) OVER (PARTITION BY file_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS group_no FROM b)
SELECT file_id, group_no, count(*) AS n_sections, arg_min(h1, (1 - big) * 1000000 + section_no) AS h1,
  arg_min(coalesce(h2, '-'), (1 - big) * 1000000 + section_no) AS h2, md5(string_agg(text, chr(10) || chr(10) ORDER BY section_no)) AS text_md5 FROM g GROUP BY ALL""")
def tiny_section_merge(d: Demo) -> DataFrame:
    out = markdown.join_small_sections(markdown.sections(_order_notes(d)), min_tokens=21)
    return out.select("file_id", "group_no", "n_sections", "h1", F.coalesce("h2", F.lit("-")).alias("h2"), F.md5("text").alias("text_md5"))


@register("SELECT c_custkey, c_custkey % 3 = 0 AS is_table FROM customer")
def is_table(d: Demo) -> DataFrame:
    table = F.concat(F.lit("| a | b |\n| --- | :-: |\n| "), "c_name", F.lit(" | 1 |\n| x | 2 |"))
    prose = F.concat("c_name", F.lit(" a | b | c\nno rule\n`| x | y |`"))
    text = F.when(F.col("c_custkey") % 3 == 0, table).otherwise(prose)
    return d.table("customer").select("c_custkey", tx.is_table(text).alias("is_table"))


@register(r"""SELECT conv_id, turn, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(x), '^[0-9.\-) ]+', '')), lambda x: length(x) > 5)) AS question FROM conversations WHERE role = 'user'""")
def question_cleanup(d: Demo) -> DataFrame:
    return d.table("conversations").where("role = 'user'").select("conv_id", "turn", F.explode(tx.clean_questions(F.col("text"))).alias("question"))


@register("SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(replace(text, '. ', chr(10) || chr(10)), chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(13) || chr(10))), lambda p: p <> ''), chr(10) || chr(10))) AS text_md5 FROM documents")
def paragraph_normalise(d: Demo) -> DataFrame:
    spaced = F.replace(F.col("text"), F.lit(". "), F.lit("\n\n"))
    return d.table("documents").select("doc_id", F.md5(tx.normalise_paragraphs(spaced)).alias("text_md5"))


@register("SELECT c_custkey, c_name || ': ' || c_mktsegment || ' | total: ' || c_nationkey AS digest FROM customer")
def section_digest(d: Demo) -> DataFrame:
    pair = lambda h, s: F.struct(h.alias("heading"), s.cast("string").alias("summary"))
    parts = F.array(pair(F.col("c_name"), F.col("c_mktsegment")), pair(F.lit("total"), F.col("c_nationkey")))
    return d.table("customer").select("c_custkey", tx.section_digest(parts).alias("digest"))


# ---- chunkers ------------------------------------------------------------------


@register("""
WITH n AS (SELECT s_nationkey, s_suppkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 3 AS chunk_no, '| ' || s_suppkey || ' | ' || s_name || ' |' AS line FROM supplier)
SELECT s_nationkey, chunk_no::INT AS chunk_no, count(*) AS n_rows, '| s_suppkey | s_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY s_suppkey) AS content FROM n GROUP BY ALL""")
def row_batches_markdown(d: Demo) -> DataFrame:
    return chunkers.table_rows(d.table("supplier"), "s_nationkey", "s_suppkey", ["s_suppkey", "s_name"], 3)


@register("""SELECT file_id, 0 AS chunk_index, 'File: n.csv | Columns: key, name' AS prefix, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || file_id || ' | ' || name || ', x |' || chr(10) || '| z |  |' AS content
FROM (SELECT n_nationkey AS file_id, n_name AS name FROM nation)""")
def chunk_csv(d: Demo) -> DataFrame:
    text = F.concat(F.lit("key,name\n"), F.col("n_nationkey").cast("string"), F.lit(',"'), "n_name", F.lit(', x"\nz\n'))
    made = d.table("nation").select(F.col("n_nationkey").alias("file_id"), F.lit("n.csv").alias("filename"), text.alias("content"))
    return chunkers.chunk_csv(made).select("file_id", "chunk_index", "prefix", "content")


@register("SELECT event_id, k AS key, json_extract_string(props, '$.\"' || k || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_top_level(d: Demo) -> DataFrame:
    out = files.json_top_level(d.table("events").select("event_id", F.col("props").alias("content")))
    return out.select("event_id", "key", "value")


@register("""
WITH c AS (SELECT *, lead(role) OVER w AS nt, lead(text) OVER w AS nx, lag(role) OVER w AS bt FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND nt = 'assistant' THEN text || chr(10) || chr(10) || '```python' || chr(10) || nx || chr(10) || '```' ELSE text END AS content FROM c
  WHERE (role = 'user' AND nt = 'assistant') OR (role = 'assistant' AND coalesce(bt, '') <> 'user' AND trim(text) <> ''))
SELECT conv_id, turn AS cell_no, md5(content) AS content_md5, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS chunk_no FROM k""")
def notebook_pairs(d: Demo) -> DataFrame:
    kind = F.when(F.col("role") == "user", "markdown").otherwise("code")
    cells = d.table("conversations").where("role <> 'system'").select("conv_id", F.col("turn").alias("cell_no"), kind.alias("cell_type"), F.col("text").alias("source"))
    return chunkers.notebook_chunks(cells, "conv_id").select("conv_id", "cell_no", F.md5("content").alias("content_md5"), "chunk_no")


@register(rf"""
WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]'))) AS ts FROM documents),
r AS (SELECT doc_id, 1 AS i, ts[1] AS total, 0 AS g FROM l
  UNION ALL SELECT r.doc_id, i + 1, CASE WHEN total + ts[i + 1] > 200 THEN ts[i + 1] ELSE total + ts[i + 1] END, CASE WHEN total + ts[i + 1] > 200 THEN g + 1 ELSE g END
  FROM r JOIN l ON r.doc_id = l.doc_id WHERE i < len(ts))
SELECT doc_id, g::INT AS group_no, min(i)::INT - 1 AS first, max(i)::INT - 1 AS last FROM r GROUP BY doc_id, g""")
def greedy_pack(d: Demo) -> DataFrame:
    counted = d.table("documents").select("doc_id", F.transform(F.split("text", "\n"), tx.count_tokens).alias("t"))
    grouped = counted.select("doc_id", F.posexplode(packing.greedy_groups(F.col("t"), 200)).alias("group_no", "r"))
    return grouped.select("doc_id", "group_no", "r.first", "r.last")


_NTOK = r"len(regexp_extract_all({}, '[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]'))"
_BLANKS = "' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12)"
#: Children as pieces of sentences with an overlap, a short last one joined to that before, and their parents.
_CHILDREN = rf"""
b AS (SELECT doc_id, trim(coalesce(text, ''), {_BLANKS}) AS t FROM documents),
se AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+([A-Z])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM b WHERE t <> ''),
l AS (SELECT doc_id, CASE WHEN {_NTOK.format("t")} <= 300 OR len(ss) = 0 THEN [t] ELSE ss END AS ss FROM se),
n AS (SELECT doc_id, ss, list_transform(ss, lambda x: {_NTOK.format("x")}) AS ts FROM l),
w AS (SELECT doc_id, 1 AS i, 1 AS first, ts[1] AS total, 0 AS c FROM n
  UNION ALL SELECT doc_id, i + 1, CASE WHEN over THEN i + 1 - k ELSE first END, CASE WHEN over THEN coalesce(list_sum(ts[i + 1 - k:i + 1]), 0) ELSE total + ts[i + 1] END, c + over::INT
  FROM (SELECT w.*, ts, total + ts[i + 1] > 300 AS over,
          CASE WHEN total + ts[i + 1] > 300 THEN len(list_filter(range(first, i + 1), lambda s: list_sum(ts[s::INT:i]) <= 30)) ELSE 0 END AS k
        FROM w JOIN n ON n.doc_id = w.doc_id WHERE i < len(ts))),
ra AS (SELECT doc_id, c, any_value(first) AS first, max(i) AS last FROM w GROUP BY doc_id, c),
ch AS (SELECT ra.doc_id, c, array_to_string(ss[first:last], ' ') AS child, max(c) OVER (PARTITION BY ra.doc_id) AS top FROM ra JOIN n ON n.doc_id = ra.doc_id),
ta AS (SELECT doc_id, child FROM ch WHERE c = top AND c > 0 AND {_NTOK.format("child")} < 50),
jo AS (SELECT ch.doc_id, c, ch.child || CASE WHEN ta.doc_id IS NOT NULL AND c = top - 1 THEN ' ' || ta.child ELSE '' END AS child
  FROM ch LEFT JOIN ta ON ta.doc_id = ch.doc_id WHERE ta.doc_id IS NULL OR c < top),
ct AS (SELECT doc_id, list({_NTOK.format("child")} ORDER BY c) AS ts FROM jo GROUP BY doc_id),
g AS (SELECT doc_id, 0 AS c, ts[1] AS total, 0 AS p FROM ct
  UNION ALL SELECT g.doc_id, c + 1, CASE WHEN total + ts[c + 2] > 1500 THEN ts[c + 2] ELSE total + ts[c + 2] END, p + (total + ts[c + 2] > 1500)::INT FROM g JOIN ct ON ct.doc_id = g.doc_id WHERE c + 1 < len(ts)),
pa AS (SELECT g.doc_id, p, string_agg(child, ' ' ORDER BY g.c) AS parent FROM g JOIN jo ON jo.doc_id = g.doc_id AND jo.c = g.c GROUP BY g.doc_id, p)"""


@register(f"""WITH RECURSIVE {_CHILDREN}
SELECT g.doc_id, g.p::INT AS parent_index, g.c::INT AS child_index, {_NTOK.format("child")}::INT AS child_tokens, {_NTOK.format("parent")}::INT AS parent_tokens, md5(child) AS child_md5, md5(parent) AS parent_md5
FROM g JOIN jo ON jo.doc_id = g.doc_id AND jo.c = g.c JOIN pa ON pa.doc_id = g.doc_id AND pa.p = g.p""")
def chunk_children(d: Demo) -> DataFrame:
    out = packing.chunk_hierarchy(d.table("documents").select("doc_id", "text"))
    return out.select("doc_id", "parent_index", "child_index", "child_tokens", "parent_tokens", F.md5("child").alias("child_md5"), F.md5("parent").alias("parent_md5"))


@register(r"""
WITH p AS (SELECT n_nationkey::VARCHAR AS file_id, unnest([
  {'part': 0, 'class_name': NULL, 'function_name': NULL, 'content': 'import os', 'prefix': 'File: a.py'},
  {'part': 1, 'class_name': NULL, 'function_name': 'f' || n_nationkey, 'content': '@wrap' || chr(10) || 'def f' || n_nationkey || '(x):' || chr(10) || '    return x', 'prefix': 'File: a.py | Function: f' || n_nationkey},
  {'part': 2, 'class_name': 'K', 'function_name': 'm', 'content': '    def m(self):' || chr(10) || '        pass', 'prefix': 'File: a.py | Class: K | Function: m'},
  {'part': 3, 'class_name': 'K', 'function_name': 'n', 'content': '    async def n(self):' || chr(10) || '        pass', 'prefix': 'File: a.py | Class: K | Function: n'},
  {'part': 4, 'class_name': NULL, 'function_name': NULL, 'content': 'X = 1', 'prefix': 'File: a.py'}]) AS x FROM nation)
SELECT file_id, x.part AS part, x.class_name AS class_name, x.function_name AS function_name, x.content AS content, x.prefix AS prefix FROM p""")
def chunk_python_code(d: Demo) -> DataFrame:
    code = F.concat(F.lit("import os\n\n@wrap\ndef f"), F.col("n_nationkey").cast("string"), F.lit("(x):\n    return x\n\nclass K:\n    def m(self):\n        pass\n\n    async def n(self):\n        pass\n\nX = 1\n"))
    made = d.table("nation").select(F.col("n_nationkey").alias("file_id"), F.lit("a.py").alias("filename"), code.alias("content"))
    return chunkers.chunk_python(made)


@register("""SELECT p_partkey, unnest(list_transform(range(0, (p_size * 100 - 1) // 500 + 1), lambda i: (i * 500 + 1) || '-' || least(i * 500 + 500, p_size * 100))) AS page_range FROM part""")
def page_ranges(d: Demo) -> DataFrame:
    return d.table("part").select("p_partkey", F.explode(chunkers.page_ranges(F.col("p_size") * 100)).alias("page_range"))


@register("""SELECT o_custkey AS file_id, string_agg(CASE o_orderstatus WHEN 'O' THEN '# ' WHEN 'F' THEN '- ' ELSE '' END || o_orderpriority, chr(10) || chr(10) ORDER BY o_orderkey) AS content FROM orders GROUP BY o_custkey""")
def layout_markdown(d: Demo) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "O", "title").when(F.col("o_orderstatus") == "F", "list-item").otherwise("paragraph")
    blocks = d.table("orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("pos"), kind.alias("kind"), F.col("o_orderpriority").alias("text"))
    furniture = blocks.select("file_id", (-F.col("pos")).alias("pos"), F.lit("footer").alias("kind"), "text")
    return chunkers.layout_markdown(blocks.unionByName(furniture))


# ---- enrichment ----------------------------------------------------------------


@register(r"""
WITH w AS (SELECT conv_id, turn, list(substr(text, 1, 500)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b,
  list(substr(text, 1, 500)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a FROM conversations)
SELECT conv_id, turn, md5(array_to_string(list_concat(coalesce(b, []), coalesce(a, [])), chr(10) || '---' || chr(10))) AS context_md5 FROM w""")
def neighbours(d: Demo) -> DataFrame:
    out = enrich.neighbours(d.table("conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", "turn", F.md5("context").alias("context_md5"))


@register(rf"""
WITH p AS (SELECT conv_id, turn, text, len({_TOKENS}) AS n FROM conversations),
f AS (SELECT conv_id AS file_id, sum(n)::BIGINT AS tokens, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t FROM p GROUP BY conv_id)
SELECT file_id, tokens, tokens > 300 AS large, CASE WHEN tokens <= 300 THEN md5(t) END AS whole_md5 FROM f""")
def summary_gate(d: Demo) -> DataFrame:
    parents = d.table("conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("parent_index"), F.col("text").alias("content"), tx.count_tokens(F.col("text")).cast("long").alias("token_count"))
    out = enrich.document_summaries(parents, lambda t: t, whole_max=300, group_max=100)
    large = F.col("tokens") > 300
    return out.select("file_id", "tokens", large.alias("large"), F.when(~large, F.md5("summary")).alias("whole_md5"))


@register(rf"""
WITH RECURSIVE p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, text, len({_TOKENS}) AS n FROM conversations),
r AS (SELECT conv_id, i, n AS total, 0 AS g FROM p WHERE i = 1 AND conv_id IN (SELECT conv_id FROM p GROUP BY conv_id HAVING sum(n) > 300)
  UNION ALL SELECT r.conv_id, p.i, CASE WHEN total + n > 100 THEN n ELSE total + n END, CASE WHEN total + n > 100 THEN g + 1 ELSE g END
  FROM r JOIN p ON p.conv_id = r.conv_id AND p.i = r.i + 1),
s AS (SELECT r.conv_id, g, string_agg(text, chr(10) || chr(10) ORDER BY r.i) AS t FROM r JOIN p ON p.conv_id = r.conv_id AND p.i = r.i GROUP BY r.conv_id, g)
SELECT conv_id AS file_id, count(*) AS n_groups, md5(string_agg(t, ' ' ORDER BY g)) AS summary_md5 FROM s GROUP BY conv_id""")
def summary_groups(d: Demo) -> DataFrame:
    """Summaries of the files that summary_gate leaves null, by groups."""
    parents = d.table("conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("parent_index"), F.col("text").alias("content"), tx.count_tokens(F.col("text")).cast("long").alias("token_count"))
    out = enrich.document_summaries(parents, lambda t: t, whole_max=300, group_max=100).where("tokens > 300")
    return out.select("file_id", F.col("n_groups").cast("long").alias("n_groups"), F.md5("summary").alias("summary_md5"))


@register(r"""
WITH t AS (SELECT item_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % 16) AS b FROM benchmark)
SELECT item_id, unnest(range(0, 16)) AS dim, unnest(list_transform(range(0, 16), lambda i: len(list_filter(b, lambda x: x = i))))::DOUBLE AS weight FROM t""")
def embed_hash(d: Demo) -> DataFrame:
    out = enrich.embed(d.table("benchmark").withColumn("prefix", F.lit("")), "prefix", "text", 8, 16)
    return out.select("item_id", F.posexplode("embedding_full").alias("dim", "weight")).withColumn("dim", F.col("dim").cast("long"))


@register("SELECT c_custkey AS chunk_id, 'What is ' || c_name || '?' AS question FROM customer WHERE c_custkey % 3 = 0")
def table_aliases(d: Demo) -> DataFrame:
    table = F.concat(F.lit("| a | b |\n| --- | --- |\n| "), "c_name", F.lit(" | 1 |"))
    rows = d.table("customer").select(F.col("c_custkey").alias("chunk_id"), F.when(F.col("c_custkey") % 3 == 0, table).otherwise(F.col("c_name")).alias("content"))
    return enrich.table_aliases(rows, lambda c: F.concat(F.lit("1. What is "), F.regexp_extract(c, r"\| (Customer[^ ]*|[^ |]+) \| 1", 1), F.lit("?\n2) no")))


# ---- knowledge bases -----------------------------------------------------------


@register("""
, f AS (SELECT (doc_id % 5) AS kb_id, count(*) AS n_files FROM documents GROUP BY 1), a AS (SELECT kb_id, count(*) AS n_articles FROM v_articles GROUP BY 1)
SELECT kb_id, coalesce(n_files, 0) AS n_files, n_articles FROM a LEFT JOIN f USING (kb_id)""")
def kb_counts(d: Demo) -> DataFrame:
    members = d.table("documents").select((F.col("doc_id") % 5).alias("kb_id"), F.col("doc_id").alias("file_id"))
    return kb.counts(d.bases(), members, d.articles())


@register("""
, s AS (SELECT article_id, list(chunk_id ORDER BY chunk_id) AS ids FROM v_sources GROUP BY article_id)
SELECT a.article_id, title, category, array_to_string(coalesce(ids, []), ',') AS chunk_ids FROM v_articles a LEFT JOIN s USING (article_id) WHERE category = 'c1' ORDER BY title, article_id LIMIT 5 OFFSET 2""")
def article_page(d: Demo) -> DataFrame:
    out = kb.page(kb.with_sources(d.articles().where("category = 'c1'"), d.sources()), ["title", "article_id"], 5, 2)
    return out.select("article_id", "title", "category", F.array_join("chunk_ids", ",").alias("chunk_ids"))


_GONE = "gone AS (SELECT doc_id % 5 AS kb_id, doc_id AS file_id FROM documents WHERE source = 'src1')"


def _removal(d: Demo) -> kb.Removal:
    members = d.table("documents").select((F.col("doc_id") % 5).alias("kb_id"), F.col("doc_id").alias("file_id"), "source")
    gone = members.where("source = 'src1'").drop("source")
    return kb.remove_files(members.drop("source"), d.sources(), d.articles(), d.texts(), gone)


@register(f""", {_GONE}, hit AS (SELECT DISTINCT s.article_id FROM v_sources s JOIN v_articles a USING (article_id) WHERE chunk_id IN (SELECT file_id FROM gone) AND kb_id IN (SELECT kb_id FROM gone))
SELECT article_id, CASE WHEN article_id IN (SELECT article_id FROM hit) THEN 'stale' ELSE status END AS status FROM v_articles""")
def remove_file_staleness(d: Demo) -> DataFrame:
    return _removal(d).articles.select("article_id", "status")


@register(f""", {_GONE} SELECT article_id, chunk_id FROM v_sources s WHERE NOT (chunk_id IN (SELECT file_id FROM gone)
  AND EXISTS (SELECT 1 FROM v_articles a WHERE a.article_id = s.article_id AND kb_id IN (SELECT kb_id FROM gone)))""")
def remove_file_sources(d: Demo) -> DataFrame:
    return _removal(d).sources.select("article_id", "chunk_id")


@register("""SELECT doc_id AS article_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) AS token_count FROM documents
WHERE len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) <= 300""")
def derive_article_gate(d: Demo) -> DataFrame:
    proposed = d.table("documents").select(F.col("doc_id").alias("article_id"), F.col("text").alias("content"), F.array("doc_id").alias("chunk_ids"))
    accepted, _ = kb.derive(proposed, d.texts(), 300)
    return accepted.select("article_id", F.col("token_count").cast("long").alias("token_count"))


@register("""
, t AS (SELECT title, max(article_id) AS id FROM v_articles GROUP BY title),
p AS (SELECT a.article_id AS pos, x.id AS src, y.id AS dst, ['related','extends','contradicts','odd'][(a.article_id % 4)::INT + 1] AS k FROM v_articles a JOIN v_articles b ON b.article_id = a.article_id + 2
  JOIN t x ON x.title = a.title JOIN t y ON y.title = b.title WHERE x.id <> y.id),
q AS (SELECT src, dst, arg_min(CASE WHEN k = 'odd' THEN 'related' ELSE k END, pos) AS k, min(pos) AS pos FROM p GROUP BY src, dst),
n AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM v_links l WHERE l.src = q.src AND l.dst = q.dst)),
u AS (SELECT src, dst, k, pos * 2 AS o FROM n UNION ALL SELECT dst, src, k, pos * 2 + 1 FROM n WHERE k IN ('related', 'contradicts'))
SELECT src, dst, arg_min(k, o) AS link_type FROM u WHERE NOT EXISTS (SELECT 1 FROM v_links l WHERE l.src = u.src AND l.dst = u.dst) GROUP BY src, dst""")
def link_symmetrise(d: Demo) -> DataFrame:
    a = d.articles()
    b = a.select((F.col("article_id") - 2).alias("article_id"), F.col("title").alias("target_title"))
    kind = F.element_at(F.array(*map(F.lit, ["related", "extends", "contradicts", "odd"])), (F.col("article_id") % 4).cast("int") + 1)
    proposed = a.join(b, "article_id").select(F.col("article_id").alias("pos"), F.col("title").alias("source_title"), "target_title", kind.alias("link_type"))
    return kb.links(a, proposed, d.links())


_ISSUES = """iss AS (
  SELECT kb_id, article_id, 'no_sources' AS issue, NULL AS action FROM v_articles WHERE article_type NOT IN ('derived', 'manual') AND article_id NOT IN (SELECT article_id FROM v_sources)
  UNION ALL SELECT kb_id, article_id, 'stale', 'recompile' FROM v_articles WHERE status = 'stale'
  UNION ALL SELECT kb_id, article_id, 'orphan', 'link' FROM v_articles a WHERE (SELECT count(*) FROM v_articles b WHERE b.kb_id = a.kb_id) > 1
    AND article_id NOT IN (SELECT src FROM v_links UNION SELECT dst FROM v_links))"""


@register(f", {_ISSUES} SELECT * FROM iss")
def kb_health_issues(d: Demo) -> DataFrame:
    return kb.issues(d.articles(), d.sources(), d.links())


@register(f""", {_ISSUES}, n AS (SELECT kb_id, count(*) AS n_articles FROM v_articles GROUP BY kb_id), b AS (SELECT kb_id, count(DISTINCT article_id) AS n_bad FROM iss GROUP BY kb_id)
SELECT kb_id, n_articles, coalesce(n_bad, 0) AS n_bad, round_even((n_articles - coalesce(n_bad, 0)) / n_articles, 2) AS score FROM n LEFT JOIN b USING (kb_id)""")
def kb_health_score(d: Demo) -> DataFrame:
    return kb.health(d.bases(), d.articles(), kb.issues(d.articles(), d.sources(), d.links()))


@register("SELECT article_id, title FROM v_articles WHERE status = 'stale'")
def repair_stale(d: Demo) -> DataFrame:
    return kb.repair(d.articles())[1].select("article_id", "title")


@register("SELECT chunk_id, file_id FROM v_chunks WHERE file_id NOT IN (SELECT file_id FROM v_files WHERE status = 'failed')")
def cascade_delete(d: Demo) -> DataFrame:
    return kb.cascade(d.chunks(), d.files().where("status = 'failed'"), "file_id").select("chunk_id", "file_id")


@register("SELECT DISTINCT lang AS name, source AS tenant_id FROM documents d WHERE NOT (lang = 'en' AND source = 'src0')")
def kb_create(d: Demo) -> DataFrame:
    wanted = d.table("documents").select(F.col("lang").alias("name"), F.col("source").alias("tenant_id"))
    taken = d.spark.createDataFrame([("src0", "en")], "tenant_id string, name string")
    return kb.create(taken, wanted).select("name", "tenant_id")


# ---- state ---------------------------------------------------------------------


def _batches(d: Demo) -> DataFrame:
    l = d.table("lineitem")
    done = lambda c, n: F.when(F.col(c) % n == 0, "pending").otherwise("completed")
    return l.select(
        F.col("l_orderkey").alias("file_id"),
        done("l_partkey", 97).alias("chunking_status"),
        done("l_partkey", 13).alias("enrichment_status"),
        done("l_partkey", 7).alias("embedding_status"),
        (F.col("l_linenumber") - 1).cast("long").alias("chunk_count"),
    )


_PROGRESS = """pr AS (SELECT l_orderkey AS file_id, count(*) AS total_batches, count(*) FILTER (WHERE l_partkey % 7 <> 0) AS completed_batches,
  bool_and(l_partkey % 97 <> 0) AS chunked, bool_and(l_partkey % 13 <> 0) AS enriched, bool_and(l_partkey % 7 <> 0) AS embedded, sum(l_linenumber - 1)::BIGINT AS n_chunks FROM lineitem GROUP BY 1)"""


@register(f"WITH {_PROGRESS} SELECT * FROM pr")
def batch_progress(d: Demo) -> DataFrame:
    return state.progress(_batches(d))


@register(f"""WITH {_PROGRESS} SELECT file_id, CASE WHEN NOT chunked THEN 'chunk' WHEN n_chunks = 0 THEN 'failed' WHEN file_id % 5 = 0 THEN 'summarise'
  WHEN NOT enriched THEN 'enrich' WHEN NOT embedded THEN 'embed' ELSE 'ready' END AS phase FROM pr""")
def resume_plan(d: Demo) -> DataFrame:
    return state.progress(_batches(d)).select("file_id", state.next_phase(F.col("file_id") % 5 != 0).alias("phase"))


@register("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 10 MINUTE THEN 'reset'
  WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 24 HOUR THEN 'delete' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'enqueue' END AS action FROM orders""")
def reaper_actions(d: Demo) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "processing").when(F.col("o_orderstatus") == "O", "uploading").otherwise("pending")
    at = F.col("o_orderdate").cast("timestamp")
    return d.table("orders").select("o_orderkey", state.reaper_action(status, at, at, F.lit("1996-01-01").cast("timestamp")).alias("action"))


@register("SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0 AND (c_custkey % 5 = 0 OR TIMESTAMP '2024-01-01' + to_days(c_custkey::INT) > TIMESTAMP '2025-01-01')")
def key_validity(d: Demo) -> DataFrame:
    c = F.col("c_custkey")
    start = F.lit("2024-01-01").cast("timestamp")
    keys = d.table("customer").select(
        "c_custkey",
        tx.key_prefix(F.concat(F.lit("sk_"), F.md5("c_name")), "sk_").alias("key_prefix"),
        F.when(c % 7 == 0, start).alias("revoked_at"),
        F.when(c % 5 != 0, F.timestamp_add("DAY", c, start)).alias("expires_at"),
    )
    return state.valid_keys(keys, None, F.lit("2025-01-01").cast("timestamp")).select("c_custkey")


@register("SELECT file_id, status, created_at::VARCHAR AS created FROM v_files ORDER BY created_at DESC, file_id LIMIT 20 OFFSET 5")
def newest_files(d: Demo) -> DataFrame:
    out = kb.page(d.files(), [F.desc("created_at"), "file_id"], 20, 5)
    return out.select("file_id", "status", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@register(f"""WITH RECURSIVE {_CHILDREN}
SELECT d.doc_id::VARCHAR AS file_id, CASE WHEN count(g.c) > 0 THEN 'ready' ELSE 'failed' END AS status, nullif(count(g.c), 0) AS n_chunks
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id""")
def stream_ingest(d: Demo) -> DataFrame:
    """Documents through the streaming path: chunk counts and final status per file."""
    from larkspur.sources.scratch import new_folder
    from larkspur.streaming.ingest import ingest

    spark = d.spark
    base = new_folder(spark, "stream")
    d.files().select(F.col("file_id").cast("string"), "content", F.lit("pending").alias("status")).write.option("maxRecordsPerFile", 2000).parquet(f"{base}/in")
    query = ingest(spark, f"{base}/in", "file_id string, content string, status string", f"{base}/out", f"{base}/state")
    query.awaitTermination()
    chunks = spark.read.parquet(f"{base}/out/chunks").groupBy("file_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return spark.read.parquet(f"{base}/out/files").drop("batch").join(chunks, "file_id", "left")


def queries() -> dict[str, Query]:
    import larkspur.ingest_queries  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    import larkspur.ingest_queries  # noqa: F401

    return dict(ORACLES)
