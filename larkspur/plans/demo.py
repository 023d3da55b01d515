"""Entities of the retrieval engine as views over the driver's tables, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Common table expressions, by view, for DuckDB; each equals the method of its name.
SQL = {
    "v_files": """SELECT doc_id AS file_id, source AS tenant_id, 'doc_' || doc_id || '.txt' AS filename, text AS content, n_chars,
        CASE doc_id % 20 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' ELSE 'ready' END AS status,
        TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at FROM documents""",
    "v_members": "SELECT lang AS kb_id, doc_id AS file_id FROM documents",
    "v_chunks": """SELECT vec_id AS chunk_id, doc_id AS file_id, text AS content, embedding::DOUBLE[] AS embedding,
        CASE WHEN vec_id % 10 = 0 THEN 'code' ELSE 'text' END AS content_type FROM embeddings JOIN documents ON vec_id = doc_id""",
    "v_texts": "SELECT doc_id AS chunk_id, doc_id AS file_id, text AS content, 'text' AS content_type, doc_id // 4 AS parent_chunk_id FROM documents",
    "v_articles": """SELECT item_id AS article_id, item_id % 5 AS kb_id, text AS content, array_to_string(string_split(text, ' ')[1:5], ' ') AS title,
        ['concept','summary','connection','question','derived','manual'][(item_id % 6)::INT + 1] AS article_type,
        ['draft','published','stale'][(item_id % 3)::INT + 1] AS status, 'c' || (item_id % 4) AS category FROM benchmark""",
    "v_sources": "SELECT (doc_id * 8) % 60 AS article_id, doc_id AS chunk_id FROM documents",
    "v_links": "SELECT item_id AS src, item_id + 1 AS dst FROM benchmark WHERE item_id % 5 = 1",
}


def with_views(sql: str) -> str:
    """``sql`` after the views that it names."""
    used = [v for v in SQL if v in sql]
    return "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in used) + "\n" + sql if used else sql


class Demo:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A table's files as a stream, without a copy of them; only as a pattern may the path be that of one file."""
        return self.spark.readStream.schema(self.table(name).schema).parquet(f"{self.sf_dir}/{name}[.]parquet")

    def files(self, documents: DataFrame | None = None) -> DataFrame:
        d = self.table("documents") if documents is None else documents
        status = F.when(F.col("doc_id") % 20 == 0, "failed").when(F.col("doc_id") % 20 == 1, "processing").otherwise("ready")
        created = F.timestamp_add("MINUTE", F.col("doc_id"), F.lit("2024-01-01").cast("timestamp"))
        name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return d.select(F.col("doc_id").alias("file_id"), F.col("source").alias("tenant_id"), name.alias("filename"), F.col("text").alias("content"), "n_chars", status.alias("status"), created.alias("created_at"))

    def members(self) -> DataFrame:
        return self.table("documents").select(F.col("lang").alias("kb_id"), F.col("doc_id").alias("file_id"))

    def chunks(self) -> DataFrame:
        joined = self.table("embeddings").join(self.table("documents"), F.col("vec_id") == F.col("doc_id"))
        kind = F.when(F.col("vec_id") % 10 == 0, "code").otherwise("text")
        return joined.select(F.col("vec_id").alias("chunk_id"), F.col("doc_id").alias("file_id"), F.col("text").alias("content"), "embedding", kind.alias("content_type"))

    def texts(self) -> DataFrame:
        d = self.table("documents")
        return d.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("file_id"), F.col("text").alias("content"), F.lit("text").alias("content_type"), F.floor(F.col("doc_id") / 4).alias("parent_chunk_id"))

    def aliases(self) -> DataFrame:
        e = self.table("embeddings").where("label % 2 = 0")
        return e.select(F.col("vec_id").alias("alias_id"), F.floor(F.col("vec_id") / 2).alias("chunk_id"), F.col("embedding").alias("alias_embedding"))

    def articles(self) -> DataFrame:
        b, i = self.table("benchmark"), F.col("item_id")
        pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (i % n).cast("int") + 1)
        return b.select(
            i.alias("article_id"),
            (i % 5).alias("kb_id"),
            F.col("text").alias("content"),
            F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("title"),
            pick(["concept", "summary", "connection", "question", "derived", "manual"], 6).alias("article_type"),
            pick(["draft", "published", "stale"], 3).alias("status"),
            F.concat(F.lit("c"), (i % 4).cast("string")).alias("category"),
        )

    def bases(self) -> DataFrame:
        return self.table("benchmark").select((F.col("item_id") % 5).alias("kb_id")).distinct()

    def sources(self) -> DataFrame:
        return self.table("documents").select(((F.col("doc_id") * 8) % 60).alias("article_id"), F.col("doc_id").alias("chunk_id"))

    def links(self) -> DataFrame:
        return self.table("benchmark").where("item_id % 5 = 1").select(F.col("item_id").alias("src"), (F.col("item_id") + 1).alias("dst"))

    def query_vector(self, ident: int = 0) -> list[float]:
        """One vector, on the driver as a model's answer would be."""
        return list(self.table("embeddings").where(F.col("vec_id") == ident).first()["embedding"])
