"""Seams for models: embedders and scorers, called in batches, with deterministic local stand-ins.

An embedder is a function ``(texts, mode, model) -> vectors`` in plain Python;
``mode`` is ``document`` or ``query``.  It runs inside tasks, ``batch`` texts a
call, on Arrow batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions import vectors as vx

Embedder = Callable[[list[str], str, str], list[list[float]]]
BATCH = 64


def hashed_embedder(dims: int) -> Embedder:
    """Counts of hashed terms, the same as ``vectors.hashed_embedding``."""

    def embed(texts: list[str], mode: str, model: str) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for term in re.findall(tx.TERM, (t or "").lower()):
                v[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dims] += 1.0
            out.append(v)
        return out

    return embed


def model_of(content_type: str | None) -> str:
    """The model of a batch, by the type of its first chunk."""
    return "code" if content_type == "code" else "text"


def vectors_of(texts: Column, kinds: Column, embedder: Embedder, mode: str = "document", batch: int = BATCH) -> Column:
    """Vectors of ``texts``, ``batch`` a call; each call's model follows its first row's kind."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, kind in parts:
            found: list[list[float]] = []
            for at in range(0, len(text), batch):
                found.extend(embedder(list(text.iloc[at : at + batch]), mode, model_of(kind.iloc[at])))
            yield pd.Series(found, dtype=object)

    return run(texts, kinds)


def embed_chunks(chunks: DataFrame, embedder: Embedder, dims: int = 256, batch: int = BATCH) -> DataFrame:
    """``embedding_full`` of prefix and content, and ``embedding``, its first ``dims`` dimensions."""
    kind = F.col("content_type") if "content_type" in chunks.columns else F.lit("text")
    full = vectors_of(tx.embedding_text(F.col("context_prefix"), F.col("content")), kind, embedder, "document", batch)
    return chunks.withColumn("embedding_full", full).withColumn("embedding", vx.head(F.col("embedding_full"), dims))


def embed_aliases(aliases: DataFrame, chunks: DataFrame, embedder: Embedder, batch_id: int | None = None, dims: int = 256, batch: int = BATCH) -> DataFrame:
    """``alias_embedding`` of questions, in query mode, of the chunks of one batch or of all."""
    own = chunks if batch_id is None else chunks.where(F.col("batch_id") == batch_id)
    scoped = aliases.join(own.select("chunk_id"), "chunk_id")
    return scoped.withColumn("alias_embedding", vx.head(vectors_of(F.col("question"), F.lit("text"), embedder, "query", batch), dims))


def embed_articles(articles: DataFrame, embedder: Embedder, dims: int = 256, batch: int = BATCH) -> DataFrame:
    """Every article again, by title and content."""
    full = vectors_of(tx.article_text(F.col("title"), F.col("content")), F.lit("text"), embedder, "document", batch)
    return articles.withColumn("embedding_full", full).withColumn("embedding", vx.head(F.col("embedding_full"), dims))


def embed_query(question: str, embedder: Embedder, dims: int = 256) -> list[float]:
    """One vector, on the driver."""
    return list(embedder([question], "query", "text")[0][:dims])


def scorer(score: Callable[[str, Sequence[str]], Sequence[float]], query: str) -> Callable[[Column], Column]:
    """A rerank model ``(query, contents) -> relevances`` as an expression of the content."""

    @F.pandas_udf("double")
    def run(contents: pd.Series) -> pd.Series:
        return pd.Series(list(score(query, list(contents))), dtype="float64")

    return run
