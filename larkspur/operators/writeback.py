"""Results of enrichment back to stored chunks, and stored chunks back to groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators.enrich import neighbours


def write_back(chunks: DataFrame, enriched: DataFrame) -> DataFrame:
    """``chunks`` with the prefixes of ``enriched (file_id, chunk_index, prefix)``; empty or missing ones change nothing."""
    new = enriched.select("file_id", "chunk_index", F.nullif("prefix", F.lit("")).alias("__new"))
    joined = chunks.join(new, ["file_id", "chunk_index"], "left")
    return joined.withColumn("context_prefix", F.coalesce("__new", "context_prefix")).drop("__new")


def groups(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Per parent, in order of creation: its text, an empty prefix, and its children by index."""
    own = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content", "context_prefix")))
    listed = children.groupBy("parent_chunk_id").agg(own.alias("children"))
    ordered = parents.select("file_id", "parent_chunk_id", "created_at", "content", F.lit("").alias("context_prefix"))
    none = F.array().cast("array<struct<chunk_index:int,chunk_id:bigint,content:string,context_prefix:string>>")
    return ordered.join(listed, "parent_chunk_id", "left").withColumn("children", F.coalesce("children", none))


def two_pass(chunks: DataFrame, summaries: DataFrame, model, reach: int = 3, chars: int = 500) -> DataFrame:
    """New prefixes from a document's summary, its sections, the neighbours and the chunk itself.

    ``summaries`` has ``file_id, summary, sections``; ``model`` maps the columns
    (summary, digest, neighbours, content) to one.  An empty answer, and a document
    without a summary, keep the old prefix.
    """
    near = neighbours(chunks, "file_id", "chunk_index", "content", reach, chars)
    known = near.join(summaries.select("file_id", "summary", tx.section_digest(F.col("sections")).alias("__digest")), "file_id", "left")
    asked: Column = model(F.col("summary"), F.col("__digest"), F.col("context"), F.col("content"))
    new = F.when(F.col("summary").isNotNull(), F.nullif(asked, F.lit("")))
    return known.withColumn("context_prefix", F.coalesce(new, "context_prefix")).drop("summary", "__digest", "context")


def whole_document_context(chunks: DataFrame, documents: DataFrame, model) -> DataFrame:
    """One pass: a prefix from the whole document and the chunk; an empty answer keeps the old."""
    known = chunks.join(documents.select("file_id", F.col("content").alias("__document")), "file_id", "left")
    asked = F.nullif(model(F.col("__document"), F.col("content")), F.lit(""))
    return known.withColumn("context_prefix", F.coalesce(asked, "context_prefix")).drop("__document")
