"""Hybrid retrieval for many queries in one plan: every step is keyed by ``query_id``.

Queries are taken in blocks of ``query_block``; a block's terms and vectors are bounded
and are broadcast.  Texts and vectors are scanned once a block, however many queries it
holds: postings are joined to the block's terms, and each task keeps the nearest rows of
every query.  A block's result is written before the next one begins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions import vectors as vx
from larkspur.operators.retrieval import postings, query_terms
from larkspur.sources.scratch import new_folder, written


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """Each query's best ``k`` hits with their ``rank`` from 1; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def near_many(rows: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int, vector: str = "embedding") -> DataFrame:
    """``query_id, chunk_id, score``: for each query the ``k`` nearest rows by cosine; zero vectors have none and are none.

    One pass; a task sends on ``k`` rows a query.
    """
    shape = "query_id long, chunk_id long, score double"
    if not queries:
        return rows.sparkSession.createDataFrame([], shape)
    ids = np.array([i for i, _ in queries], dtype=np.int64)
    matrix = np.array([v for _, v in queries], dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    ids, matrix = ids[norms > 0], matrix[norms > 0] / norms[norms > 0, None]
    sent = rows.sparkSession.sparkContext.broadcast((ids, matrix))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = sent.value
        best = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(ids)
        for batch in batches:
            found = np.stack(batch["v"].to_list()) if len(batch) else np.zeros((0, matrix.shape[1]))
            length = np.linalg.norm(found, axis=1)
            named, found = batch["chunk_id"].to_numpy(np.int64)[length > 0], found[length > 0] / length[length > 0, None]
            scores = np.einsum("ij,kj->ki", found, matrix)  # each pair is summed in the same order, so equal vectors tie
            for q, (kept, who) in enumerate(best):
                scored, names = np.concatenate([kept, scores[q]]), np.concatenate([who, named])
                first = np.lexsort((names, -scored))[:k]
                best[q] = scored[first], names[first]
        rows = [(ids[q], i, s) for q, (kept, who) in enumerate(best) for s, i in zip(kept.tolist(), who.tolist(), strict=True)]
        yield pd.DataFrame(rows, columns=["query_id", "chunk_id", "score"])

    known = rows.where(F.col(vector).isNotNull()).select("chunk_id", F.col(vector).cast("array<double>").alias("v"))
    return known.mapInPandas(nearest, shape)


def texts_many(entries: DataFrame, n_docs: int, avgdl: float, queries: Sequence[tuple[int, str]], allowed: DataFrame | None = None) -> DataFrame:
    """``query_id, chunk_id, score``: for each query the documents with all its terms, by summed BM25.

    ``entries`` are postings ``term, chunk_id, tf, dl``; ``allowed (chunk_id)`` bounds the hits, not the statistics.
    """
    spark = entries.sparkSession
    wanted = [(i, t, len(terms)) for i, q in queries if (terms := query_terms(q)) for t in terms]
    asked = F.broadcast(spark.createDataFrame(wanted, "query_id long, term string, n_terms int"))
    terms = F.broadcast(spark.createDataFrame(sorted({(t,) for _, t, _ in wanted}), "term string"))
    found = written(entries.join(terms, "term"), "many-postings")
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # at most a row per term of the block
    scored = found.join(F.broadcast(df), "term").withColumn("gain", vx.bm25(F.col("tf"), F.col("df"), F.col("dl"), F.lit(avgdl), F.lit(n_docs)))
    if allowed is not None:
        scored = scored.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    summed = scored.join(asked, "term").groupBy("query_id", "chunk_id").agg(F.sum("gain").alias("score"), F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("of"))
    return summed.where("n = of").select("query_id", "chunk_id", "score")


def fuse_many(lists: Sequence[DataFrame], k: int = 60, limit: int = 20) -> DataFrame:
    """Each query's reciprocal rank fusion of ranked lists; ties by the list and rank that found a hit first."""
    every = None
    for i, hits in enumerate(lists):
        one = hits.select("query_id", "chunk_id", F.lit(i).alias("list_no"), (F.col("rank") - 1).alias("rank"))
        every = one if every is None else every.unionByName(one)
    first = F.min(F.struct("list_no", "rank")).alias("first")
    summed = every.groupBy("query_id", "chunk_id").agg(F.sum(vx.reciprocal_rank(F.col("rank"), k)).alias("score"), first)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def rerank_many(hits: DataFrame, queries: Sequence[tuple[int, str]], chunks: DataFrame, k: int) -> DataFrame:
    """Fused hits of each query by the share of its terms in their texts; chunks' columns, ``query_id, score, rank``.

    ``hits`` has a bounded number of rows a query, so a block's are broadcast to the chunks.
    """
    asked = hits.sparkSession.createDataFrame([(i, query_terms(q)) for i, q in queries], "query_id long, terms array<string>")
    wanted = hits.select("query_id", "chunk_id").join(F.broadcast(asked), "query_id")
    texts = chunks.join(F.broadcast(wanted), "chunk_id")
    share = F.size(F.array_intersect("terms", tx.terms(F.col("content")))) / F.greatest(F.lit(1), F.size("terms"))
    return ranked(texts.withColumn("score", share.cast("double")), k).drop("terms")


def search_many(
    queries: DataFrame,
    chunks: DataFrame,
    entries: DataFrame,
    n_docs: int,
    avgdl: float,
    k: int = 10,
    depth: int = 50,
    fused: int = 20,
    allowed: DataFrame | None = None,
    query_block: int = 1000,
) -> DataFrame:
    """``query_id, rank, score, chunk_id`` and the other columns of ``chunks``: hybrid search of ``queries (query_id, query, vector)``.

    ``chunks`` holds ``chunk_id, content, embedding``, ``entries`` the postings of their
    texts.  A query without a vector has text hits alone, one without terms vector hits alone.
    """
    spark = chunks.sparkSession
    columns = [c for c in chunks.columns if c != "embedding"]
    scoped = chunks if allowed is None else chunks.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    paths: list[str] = []
    for block in blocks(queries, query_block):
        asked = [(r["query_id"], r["query"]) for r in block]
        near = near_many(scoped, [(r["query_id"], r["vector"]) for r in block if r["vector"] is not None], depth)
        texts = texts_many(entries, n_docs, avgdl, asked, allowed)
        top = written(fuse_many([ranked(near, depth), ranked(texts, depth)], limit=fused).select("query_id", "chunk_id"), "many-fused")
        paths.append(new_folder(spark, "many-hits"))
        rerank_many(top, asked, chunks.select(*columns), k).select("query_id", "rank", "score", *columns).write.parquet(paths[-1])
    kinds = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in columns)
    shape = f"query_id long, rank int, score double, {kinds}"
    return spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)


def blocks(rows: DataFrame, size: int) -> Iterator[list]:
    held: list = []
    for row in rows.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def search_texts(queries: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """``search_many`` with postings and statistics made from the chunks themselves, once.

    ``chunks`` are scanned for postings, vectors and the texts of hits: give a stored table,
    a join is written first.
    """
    entries = written(postings(chunks), "many-entries")
    n_docs, length = chunks.count(), entries.agg(F.sum("tf").alias("length")).first()["length"] or 0
    return search_many(queries, chunks, entries, n_docs, length / n_docs if n_docs else 0.0, **options)
