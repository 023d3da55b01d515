"""The engine over one folder of versioned tables: files, search, knowledge bases.

Every change is one version of the store; every question is answered from the last one,
or from the one that is asked for.  Answers are DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators import chunkers, compilation, enrich, kb, models, retrieval
from larkspur.sources.detect import content_type
from larkspur.sources.scratch import written
from larkspur.sources.versioned import Store, delete, merge, replace
from larkspur.streaming import ingest

VECTORS = "embedding_full array<double>, embedding array<double>"
TABLES = {
    "uploads": (["file_id"], "file_id string, tenant_id string, filename string, content_type string, content string, created_at timestamp"),
    "files": (["file_id"], "file_id string, status string, tries int, error string"),
    "chunks": (["file_id"], f"file_id string, chunk_id bigint, parent_chunk_id bigint, chunk_index int, content_type string, context_prefix string, content string, token_count int, parent_content string, {VECTORS}"),
    "summaries": (["file_id"], "file_id string, summary string"),
    "triggers": (["kb_id", "batch"], "kb_id string, batch bigint"),
    "batches": (["batch"], "batch bigint"),
    "bases": (["kb_id"], "kb_id string, tenant_id string, name string, status string, created_at timestamp"),
    "members": (["kb_id", "file_id"], "kb_id string, file_id string"),
    "articles": (["kb_id", "title"], f"kb_id string, title string, article_type string, status string, content string, {VECTORS}"),
    "sources": (["kb_id", "title", "chunk_id"], "kb_id string, title string, chunk_id bigint"),
    "links": (["kb_id", "src", "dst"], "kb_id string, src string, dst string, link_type string"),
}


def article_id(title: str = "title") -> Column:
    return F.xxhash64("kb_id", title)


class Engine:
    def __init__(self, spark: SparkSession, path: str, embedder: models.Embedder | None = None, dims: int = 256, buckets: int = 16) -> None:
        self.spark, self.embedder, self.dims = spark, embedder or models.hashed_embedder(1024), dims
        self.store = Store(spark, path, {name: keys for name, (keys, _) in TABLES.items()}, buckets)
        if not self.store.version():
            self.store.commit({name: replace(spark.createDataFrame([], shape)) for name, (_, shape) in TABLES.items()}, "new")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.store.read(name, version)

    # ---- files

    def upload(self, rows: DataFrame) -> int:
        """New or changed files: ``tenant_id, file_id, filename, content``; they wait to be ingested."""
        kind = content_type(F.col("filename"), F.lit(None))
        ready = rows.select("file_id", "tenant_id", "filename", kind.alias("content_type"), "content", F.current_timestamp().alias("created_at"))
        ready = written(ready, "uploads")
        pending = ready.select("file_id", F.lit("pending").alias("status"), F.lit(0).alias("tries"), F.lit(None).cast("string").alias("error"))
        return self.store.commit({"uploads": merge(ready), "files": merge(pending)}, "upload")

    def files(self, tenant: str | None = None, version: int | None = None) -> DataFrame:
        """Files with their state, newest first."""
        known = self.table("uploads", version).drop("content").join(self.table("files", version), "file_id")
        return retrieval.keep(None if tenant is None else F.col("tenant_id") == tenant, known).orderBy(F.desc("created_at"), "file_id")

    def delete_files(self, file_ids: Sequence[str]) -> int:
        """Files with all that hangs on them; the articles that used them turn stale."""
        gone = self.spark.createDataFrame([(i,) for i in file_ids], "file_id string")
        held = self.table("members").join(gone, "file_id", "left_semi")
        changes = self._removal(held) | {t: delete(gone) for t in ("uploads", "files", "chunks", "summaries")}
        return self.store.commit(changes, "delete files")

    def _chunked(self, rows: DataFrame) -> DataFrame:
        parts = chunkers.chunk_files(rows)
        ident = ["file_id", "part", "parent_index"]
        chunks = parts.select(
            "file_id", F.xxhash64(*ident, "child_index").alias("chunk_id"), F.xxhash64(*ident).alias("parent_chunk_id"), F.col("child_index").alias("chunk_index"),
            "content_type", F.col("prefix").alias("context_prefix"), F.col("child").alias("content"), tx.count_tokens(F.col("child")).alias("token_count"), F.col("parent").alias("parent_content"),
        )
        made = models.embed_chunks(written(chunks, "chunks"), self.embedder, self.dims)
        return made.select(*[f.split()[0] for f in TABLES["chunks"][1].split(", ")])

    def ingest(self, limit: float = 900) -> int:
        """Chunk, embed and summarise the waiting files; bad ones fail alone.  Returns the version."""
        waiting = self.table("uploads").join(self.table("files").where("status = 'pending'").select("file_id"), "file_id", "left_semi")
        batch = written(waiting, "waiting")
        number = (self.table("batches").agg(F.max("batch")).first()[0] or 0) + 1
        if not batch.head(1):
            return self.store.version()
        ingest.ingest_batch(self.store, batch, number, self._chunked, limit)
        ready = self.table("files").where("status = 'ready'").join(batch.select("file_id"), "file_id", "left_semi")
        own = self.table("chunks").join(ready, "file_id", "left_semi").select("file_id", "parent_chunk_id", F.col("parent_content").alias("content")).dropDuplicates(["file_id", "parent_chunk_id"])
        parents = own.select("file_id", F.col("parent_chunk_id").alias("parent_index"), "content", tx.count_tokens(F.col("content")).alias("token_count"))
        return self.store.commit({"summaries": merge(enrich.document_summaries(parents).select("file_id", "summary"))}, f"summaries {number}")

    def to_compile(self, since: int = 0) -> list[str]:
        """Bases with files that have become ready in batches after ``since``."""
        return sorted(r["kb_id"] for r in self.table("triggers").where(F.col("batch") > since).select("kb_id").distinct().collect())

    # ---- search

    def _scope(self, tenant: str | None, kb_id: str | None = None) -> DataFrame:
        files = self.table("uploads").select("file_id", "tenant_id").join(self.table("files").select("file_id", "status"), "file_id")
        members = None if kb_id is None else self.table("members").where(F.col("kb_id") == kb_id)
        return retrieval.scope(self.table("chunks"), files, tenant, members)

    def search(self, query: str, tenant: str | None = None, k: int = 5, content_types: Sequence[str] | None = None, with_parents: bool = True) -> DataFrame:
        """Chunks of ready files by hybrid search, with the text of their parents."""
        hits = retrieval.hybrid_search(self._scope(tenant), query, models.embed_query(query, self.embedder, self.dims), k, content_types=content_types)
        return hits.drop("embedding", "embedding_full", *([] if with_parents else ["parent_content"]))

    def search_kb(self, kb_id: str, query: str, k: int = 5, articles_only: bool = False) -> DataFrame:
        """Articles and chunks of a knowledge base by hybrid search."""
        articles = retrieval.article_scope(self.articles(kb_id).withColumn("category", F.lit(None).cast("string")), kb_id)
        scoped = self._scope(None, kb_id)
        return retrieval.kb_search(articles, scoped, query, models.embed_query(query, self.embedder, self.dims), k, articles_only=articles_only)

    def chunk(self, chunk_id: int) -> DataFrame:
        return self.table("chunks").where(F.col("chunk_id") == chunk_id).drop("embedding", "embedding_full")

    # ---- knowledge bases

    def create_base(self, tenant: str, name: str) -> str:
        """The id of a new base; a name that the tenant has is an error."""
        wanted = self.spark.createDataFrame([(tenant, name)], "tenant_id string, name string")
        made = kb.create(self.table("bases"), wanted).withColumns({"kb_id": F.uuid(), "status": F.lit("new"), "created_at": F.current_timestamp()})
        made = written(made.select("kb_id", "tenant_id", "name", "status", "created_at"), "bases")
        found = made.first()
        if found is None:
            raise ValueError(f"{tenant} has a base named {name}")
        self.store.commit({"bases": merge(made)}, "create base")
        return found["kb_id"]

    def bases(self, tenant: str | None = None) -> DataFrame:
        return kb.listed(self.table("bases"), tenant)

    def add_files(self, kb_id: str, file_ids: Sequence[str]) -> int:
        wanted = self.spark.createDataFrame([(kb_id, i) for i in file_ids], "kb_id string, file_id string")
        owner = self.table("bases").where(F.col("kb_id") == kb_id).first()["tenant_id"]
        return self.store.commit({"members": merge(kb.add_files(self.table("members"), wanted, self.table("uploads"), owner).select("kb_id", "file_id"))}, "add files")

    def _removal(self, gone: DataFrame) -> dict:
        """Changes that take ``gone (kb_id, file_id)`` out of their bases: memberships, sources, and articles that turn stale."""
        articles, sources = self.table("articles").withColumn("article_id", article_id()), self.table("sources").withColumn("article_id", article_id())
        left = kb.remove_files(self.table("members"), sources, articles, self.table("chunks").select("file_id", "chunk_id"), gone.select("kb_id", "file_id"))
        lost = sources.join(left.sources.select("article_id", "chunk_id"), ["article_id", "chunk_id"], "left_anti")
        stale = left.articles.where("status = 'stale'").select(*self.table("articles").columns)
        return {"members": delete(gone.select("kb_id", "file_id")), "sources": delete(lost.select("kb_id", "title", "chunk_id")), "articles": merge(stale)}

    def remove_files(self, kb_id: str, file_ids: Sequence[str]) -> int:
        return self.store.commit(self._removal(self.spark.createDataFrame([(kb_id, i) for i in file_ids], "kb_id string, file_id string")), "remove files")

    def delete_base(self, kb_id: str) -> int:
        """A base with its memberships, articles, sources and links; files stay."""
        names = ("bases", "members", "articles", "sources", "links")
        return self.store.commit({n: delete(self.table(n).where(F.col("kb_id") == kb_id).select(*TABLES[n][0])) for n in names}, "delete base")

    def articles(self, kb_id: str | None = None, article_type: str | None = None) -> DataFrame:
        known = self.table("articles").withColumn("article_id", article_id())
        return retrieval.keep(None if kb_id is None else F.col("kb_id") == kb_id, retrieval.keep(None if article_type is None else F.col("article_type") == article_type, known))

    def derive(self, kb_id: str, title: str, content: str, chunk_ids: Sequence[int], max_tokens: int = 8192) -> int:
        """An article of a caller, with its sources; one that is too long is an error."""
        proposed = self.spark.createDataFrame([(0, kb_id, title, content, list(chunk_ids))], "article_id long, kb_id string, title string, content string, chunk_ids array<bigint>")
        accepted, sources = kb.derive(proposed, self.table("chunks"), max_tokens)
        if not accepted.head(1):
            raise ValueError(f"the article has more than {max_tokens} words")
        made = models.embed_articles(accepted, self.embedder, self.dims).select(*self.table("articles").columns)
        told = sources.select(F.lit(kb_id).alias("kb_id"), F.lit(title).alias("title"), "chunk_id")
        return self.store.commit({"articles": merge(made), "sources": merge(told)}, "derive")

    def compile(self, kb_ids: Sequence[str], **options) -> int:
        return compilation.compile_into(self.store, list(kb_ids), self.embedder, dims=self.dims, **options)

    def issues(self) -> DataFrame:
        links = self.table("links").select(article_id("src").alias("src"), article_id("dst").alias("dst"))
        return kb.issues(self.articles(), self.table("sources").select(article_id().alias("article_id")), links)

    def health(self) -> DataFrame:
        return kb.health(self.table("bases"), self.articles(), self.issues())

    def repair(self, kb_id: str) -> int:
        """Stale articles go; the next compilation writes them again."""
        _, gone = kb.repair(self.articles(kb_id))
        ends = [self.table("links").join(gone.select("kb_id", F.col("title").alias(e)), ["kb_id", e], "left_semi").select("kb_id", "src", "dst") for e in ("src", "dst")]
        changes = {
            "articles": delete(gone.select("kb_id", "title")),
            "sources": delete(self.table("sources").join(gone.select("kb_id", "title"), ["kb_id", "title"], "left_semi").select("kb_id", "title", "chunk_id")),
            "links": delete(ends[0].unionByName(ends[1]).distinct()),
        }
        return self.store.commit(changes, "repair")
