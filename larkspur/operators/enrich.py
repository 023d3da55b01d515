"""Enrichment: neighbours, summaries, table questions, embeddings; models are seams.

A provider is a function from text columns to a column.  The local ones are
expressions, so their results can be checked against SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions import vectors as vx

Provider = Callable[[Column], Column]


def neighbours(rows: DataFrame, group: str, order: str, text: str, reach: int = 3, chars: int = 500) -> DataFrame:
    """``context``: beginnings of up to ``reach`` pieces on either side, without the piece itself."""
    w = Window.partitionBy(group).orderBy(order)
    short = F.substring(F.col(text), 1, chars)
    before = F.collect_list(short).over(w.rowsBetween(-reach, -1))
    after = F.collect_list(short).over(w.rowsBetween(1, reach))
    return rows.withColumn("context", F.array_join(F.concat(before, after), "\n---\n"))


def first_sentences(text: Column, n: int = 2) -> Column:
    """Local summary provider."""
    return F.array_join(F.slice(tx.sentences(text), 1, n), " ")


def group_texts(parents: DataFrame, whole_max: int, group_max: int) -> DataFrame:
    """``file_id, tokens, n_groups, group_no, text``: files within ``whole_max`` tokens whole, others in greedy groups.

    Group numbers come from token counts alone; each text goes to its group once.
    Parents of one index stay together.
    """
    from larkspur.operators.packing import let, run, with_groups

    sizes = parents.groupBy("file_id", "parent_index").agg(F.sum("token_count").alias("t"))
    files = sizes.groupBy("file_id").agg(F.sum("t").alias("tokens"), F.array_sort(F.collect_list(F.struct("parent_index", "t"))).alias("__p"))
    whole = F.when(F.col("tokens") <= whole_max, F.array(F.struct(F.lit(0).alias("first"), (F.size("__p") - 1).alias("last"))))
    ranged = with_groups(files, "__greedy", F.transform("__p", lambda p: p["t"]), group_max).withColumn("__g", F.coalesce(whole, "__greedy"))
    members = let(
        F.struct(F.transform("__p", lambda p: p["parent_index"]).alias("p"), F.col("__g").alias("g")),
        lambda v: F.transform(v["g"], lambda r: run(v["p"], r["first"], r["last"])),
    )
    groups = ranged.select("file_id", "tokens", F.size("__g").alias("n_groups"), F.posexplode(members).alias("group_no", "__m"))
    placed = groups.select("file_id", "tokens", "n_groups", "group_no", F.explode("__m").alias("parent_index"))
    same = parents["file_id"].eqNullSafe(placed["file_id"]) & parents["parent_index"].eqNullSafe(placed["parent_index"])
    listed = parents.join(placed, same).select(placed["*"], parents["content"])
    ordered = F.array_sort(F.collect_list(F.struct("parent_index", "content")))
    text = F.array_join(F.transform(ordered, lambda p: p["content"]), "\n\n")
    return listed.groupBy("file_id", "tokens", "n_groups", "group_no").agg(text.alias("text"))


def document_summaries(parents: DataFrame, summarise: Provider = first_sentences, whole_max: int = 200_000, group_max: int = 50_000) -> DataFrame:
    """Summary per file: of the whole text, or of summaries of greedy groups beyond ``whole_max`` tokens.

    ``parents`` has ``file_id, parent_index, content, token_count``.
    """
    mapped = group_texts(parents, whole_max, group_max).select("file_id", "tokens", "n_groups", "group_no", summarise(F.col("text")).alias("s"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "s"))), lambda x: x["s"]), " ")
    reduced = mapped.groupBy("file_id", "tokens", "n_groups").agg(texts.alias("__s"), F.first("s").alias("__only"))
    summary = F.when(F.col("tokens") <= whole_max, F.col("__only")).otherwise(summarise(F.col("__s")))
    return reduced.select("file_id", "tokens", "n_groups", summary.alias("summary"))


def document_outlines(parents: DataFrame, outline: Provider = tx.document_outline, whole_max: int = 200_000, group_max: int = 50_000) -> DataFrame:
    """``file_id, tokens, n_groups, document_summary, section_summaries``.

    Beyond ``whole_max`` tokens each greedy group gets an outline; the file's summary
    is that of the groups' summaries, its sections are theirs in order.
    """
    mapped = group_texts(parents, whole_max, group_max).select("file_id", "tokens", "n_groups", "group_no", outline(F.col("text")).alias("o"))
    listed = mapped.groupBy("file_id", "tokens", "n_groups").agg(F.array_sort(F.collect_list(F.struct("group_no", "o"))).alias("__o"))
    joined = F.array_join(F.transform("__o", lambda x: x["o"]["document_summary"]), " ")
    summary = F.when(F.col("n_groups") == 1, joined).otherwise(outline(joined)["document_summary"])
    sections = F.flatten(F.transform("__o", lambda x: x["o"]["section_summaries"]))
    return listed.select("file_id", "tokens", "n_groups", summary.alias("document_summary"), sections.alias("section_summaries"))


def contextualise(chunks: DataFrame, enriched: Column) -> DataFrame:
    """New prefixes; an empty or missing one keeps the old."""
    return chunks.withColumn("context_prefix", F.coalesce(F.nullif(enriched, F.lit("")), F.col("context_prefix")))


def table_aliases(chunks: DataFrame, ask: Provider) -> DataFrame:
    """Questions for chunks that hold a table: ``chunk_id, question``."""
    tables = chunks.where(tx.is_table(F.col("content")))
    return tables.select("chunk_id", F.explode(tx.clean_questions(ask(F.col("content")))).alias("question"))


def embed(rows: DataFrame, prefix: str, content: str, dims: int = 256, full: int = 1024) -> DataFrame:
    """Local hashed embeddings: the full vector and its first ``dims`` dimensions."""
    vector = vx.hashed_embedding(tx.terms(tx.embedding_text(F.col(prefix), F.col(content))), full)
    return rows.withColumn("embedding_full", vector).withColumn("embedding", vx.head(F.col("embedding_full"), dims))
