"""One registered query per operator, with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import conversations, decontaminate, divergence, html_main, line_dedup, mixing, pii, pivot_index, simhash, suffix_dedup, topk, toxicity, warc

REJECT_AT = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.fit_and_score(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), keep=["doc_id"])
    return scored.select(
        "doc_id",
        (~toxicity.in_training(F.col("doc_id"))).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= REJECT_AT).cast("int").alias("predicted"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.deduplicated_pages(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _joined(spans: str) -> Column:
    texts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(texts, ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, pii.KINDS),
        _sha256(_joined("base")).alias("base_sha256"),
        _joined("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("text")).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", _sha256(F.col("kept")).alias("kept_sha256"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), radius=3, size=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_main.extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.find_contamination(docs, items, width=10)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", _sha256(names).alias("items_sha256"), "contaminated")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix_sources(docs, seed=17)
    return mixed.select("doc_id", "source", "copy_no", _sha256(F.coalesce("text", F.lit(""))).alias("text_sha256"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversations.repair_reports(conversations.damaged(rows))
    ids = rows.select("conv_id").distinct()
    every = ids.join(found, ids["conv_id"].eqNullSafe(found["conv_id"]), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")]
    return every.select(ids["conv_id"], *zero, *nothing)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents").select("lang", "source", "text"), min_docs=3, top=200)


def op13_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_toxicity, op2_warc, op3_pii, op4_line_dedup, op5_suffix_dedup, op6_topk, op7_simhash, op8_html, op9_decontaminate, op10_mixing,
        op11_conversations, op12_divergence, op13_pivot_index, pipeline,
    )
    return {f.__name__: f for f in every}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2_SQL = """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages
), e AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (1 + ((('0x' || substr(x, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31))::INT, 1)), '') AS payload_digest
  FROM d
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM e
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM g
"""

OP4_SQL = f"""
WITH s AS (
  SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT row, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM s
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10
), m AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY row, doc_id
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9_SQL = f"""
WITH b AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: list_slice(w, i, i + 9))
                                       WHEN len(w) > 0 THEN [w] ELSE [] END) AS p FROM b
), d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), n AS (
  SELECT DISTINCT len(p) AS n FROM p
), x AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n
), h AS (
  SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS p FROM x) JOIN p USING (p)
), c AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP10_SQL = """
WITH c AS (
  SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source
), r AS (
  SELECT source, 1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM c) * (SELECT sum(n) FROM c) / n AS rate FROM c
), k AS (
  SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 25)::BIGINT + 1)) AS k FROM r
), f AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k
), u AS (
  SELECT doc_id, source, text, ('0x' || substr(md5('17:' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents
), m AS (
  SELECT doc_id, u.source, text, count(*) FILTER (WHERE cdf <= u) AS copies FROM u JOIN f ON u.source = f.source GROUP BY ALL
)
SELECT doc_id, source, unnest(range(0, copies))::INT AS copy_no, sha256(coalesce(text, '')) AS text_sha256 FROM m
"""


def _paid(way: str, cost: str, edit: str) -> str:
    """A way is its cost in nine digits and its audit, so that the least string is the cheapest way."""
    return f"lpad((substr({way}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({way}, 10) || '{edit}'"


_I = [_paid(f"b{q}", "2", "I") for q in range(4)]
_D, _K, _R = ([_paid(f"n{q}", cost, edit) for q in range(4)] for cost, edit in (("3", "D"), ("late", "K"), ("2 + late", "R")))
_ADDED = f"""SELECT conv_id, i, b0 AS n0, b1 AS n1, least(b2, {_I[0]}, {_I[1]}, {_I[3]}) AS n2,
    least(b3, {_paid(f"least(b2, {_I[0]}, {_I[1]}, {_I[3]})", "2", "I")}) AS n3 FROM"""

OP11_SQL = f"""
WITH RECURSIVE k AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i::INT, 1))::BIGINT)),
           lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, w: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS f
  FROM k
), d AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(0, CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c
), e AS (
  SELECT *, substr(role, 1, 1) AS ini, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again
  FROM d
), r AS (
  SELECT *, CASE WHEN last = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN last IN ('.', '!', '?') THEN '' ELSE 't' END AS fault,
         lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev
  FROM e
), w(conv_id, i, b0, b1, b2, b3) AS (
  SELECT DISTINCT conv_id, 1::BIGINT, '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM r
  UNION ALL
  SELECT conv_id, i + 1, {_D[0]}, least({_D[1]}, CASE WHEN ok AND ini = 's' THEN {_K[0]} END),
         least({_D[2]}, CASE WHEN ok AND ini = 'u' THEN least({_K[0]}, {_K[1]}, {_K[3]}) END, CASE WHEN ok THEN least({_R[0]}, {_R[1]}, {_R[3]}) END),
         least({_D[3]}, CASE WHEN ok AND ini = 'a' THEN {_K[2]} END, CASE WHEN ok THEN {_R[2]} END)
  FROM (
    SELECT n.*, ini, fault NOT IN ('b', 'd') AS ok, (fault = 't')::BIGINT AS late
    FROM ({_ADDED} w) AS n JOIN r ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.i = n.i
  )
), z AS (
  SELECT conv_id, least(n0, n3) AS way FROM ({_ADDED} w)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), a AS (
  SELECT conv_id, substr(way, 10) AS audit, unnest(range(1, length(way) - 8)) AS pos FROM z
), x AS (
  SELECT conv_id, pos, substr(audit, pos::INT, 1) AS edit,
         count(*) FILTER (WHERE substr(audit, pos::INT, 1) <> 'I') OVER o AS i, count(*) FILTER (WHERE substr(audit, pos::INT, 1) <> 'D') OVER o AS p,
         count(*) FILTER (WHERE substr(audit, pos::INT, 1) <> 'D') OVER (PARTITION BY conv_id) AS n
  FROM a WINDOW o AS (PARTITION BY conv_id ORDER BY pos)
), h AS (
  SELECT x.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN r.role WHEN (n - p) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' ||
           CASE WHEN edit = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY p)) AS repaired_sha256
  FROM x LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = x.i WHERE edit <> 'D' GROUP BY x.conv_id
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id
), o AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(substr(way, 1, 9)::BIGINT, 0) AS cost,
       coalesce(substr(way, 10), '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM o LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""

OP12_SQL = f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), o AS (
  SELECT lang, source, rid, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 3
), v AS (
  SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o GROUP BY lang, source, term
), x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::BIGINT AS n
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), t AS (
  SELECT lang, source, sum(n)::BIGINT AS total FROM x GROUP BY lang, source
), p AS (
  SELECT x.*, 1 + (1000000000 * (x.n + 1)) // (total + v) AS p FROM x JOIN t USING (lang, source) JOIN v USING (lang)
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), e AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), q AS (
  SELECT k.lang, k.term, 1 + (1000000000 * (k.n + 1)) // (v.n + v) AS q FROM k JOIN v USING (lang)
), f AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM e UNION ALL SELECT * FROM f)
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""

OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, len(embedding) AS dim, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM v AS a JOIN v AS b ON a.label = b.label AND a.dim = b.dim AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(src, dst) AS (
  SELECT src, dst FROM l UNION SELECT r.src, l.dst FROM r JOIN l ON r.dst = l.src
), n AS (
  SELECT src, count(*) AS n_links FROM l GROUP BY src
), c AS (
  SELECT src, min(dst) AS low FROM r GROUP BY src
), m AS (
  SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id
  FROM embeddings LEFT JOIN n ON n.src = vec_id LEFT JOIN c ON c.src = vec_id
)
SELECT *, vec_id = component_id AS kept FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op4_line_dedup": OP4_SQL, "op6_topk": OP6_SQL, "op9_decontaminate": OP9_SQL, "op10_mixing": OP10_SQL, "op11_conversations": OP11_SQL, "op12_divergence": OP12_SQL, "op13_pivot_index": OP13_SQL}
