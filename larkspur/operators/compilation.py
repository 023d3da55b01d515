"""Compiling knowledge bases: concepts, articles, connections, vectors; all bases at once.

Models are seams: functions from columns to a column.  The local ones are
expressions, so that a whole compilation can be checked against SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import vectors as vx
from larkspur.operators import kb, many
from larkspur.operators.models import Embedder, embed_articles, vectors_of
from larkspur.sources.scratch import written
from larkspur.sources.versioned import Store, delete, merge

Writer = Callable[[Column, Column], Column]


def kb_summaries(members: DataFrame, summaries: DataFrame) -> DataFrame:
    """``kb_id, file_id, summary`` of the files of each base."""
    return members.select("kb_id", "file_id").join(summaries.select("file_id", "summary"), "file_id")


def concept_queries(concepts: DataFrame) -> DataFrame:
    """``concepts`` with a ``query_id`` and the text that is searched for each: its name and its description."""
    told = F.col("description") if "description" in concepts.columns else F.lit("")
    numbered = concepts.withColumn("query_id", F.monotonically_increasing_id())
    return numbered.withColumn("query", F.concat(F.col("term"), F.lit(": "), F.coalesce(told, F.lit(""))))


def concept_hits(asked: DataFrame, chunks: DataFrame, members: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """``kb_id, term, rank, chunk_id, content``: hybrid hits of every concept at once, then those in its base's files.

    ``asked`` comes from ``concept_queries``, ``vectors`` holds ``query_id, vector``.  Files are looked
    at after the best ``k``, so a base may keep fewer, or none.  The number of scans
    doesn't grow with that of concepts.
    """
    queries = asked.join(vectors, "query_id", "left").select("query_id", "query", "vector").orderBy("query_id")
    found = many.search_texts(queries, chunks.select("chunk_id", "file_id", "content", "embedding"), k=k)
    hits = asked.select("query_id", "kb_id", "term").join(found, "query_id")
    return hits.join(members.select("kb_id", "file_id"), ["kb_id", "file_id"], "left_semi").select("kb_id", "term", "rank", "chunk_id", "content")


def query_vectors(asked: DataFrame, embedder: Embedder, dims: int) -> DataFrame:
    """``query_id, vector`` of the queries, by the model that made the chunks' vectors."""
    full = vectors_of(F.col("query"), F.lit("text"), embedder, "query")
    return asked.select("query_id", vx.head(full, dims).alias("vector"))


def beginnings(term: Column, texts: Column) -> Column:
    """Local writer: the first 80 characters of each text."""
    return F.array_join(F.transform(texts, lambda t: F.substring(t, 1, 80)), "\n")


class Generated(NamedTuple):
    articles: DataFrame
    sources: DataFrame


def generate(concepts: DataFrame, hits: DataFrame, write: Writer = beginnings) -> Generated:
    """An article per concept with hits and content, and its sources.

    New concepts become ``concept`` articles, known ones ``summary`` articles.
    """
    listed = F.array_sort(F.collect_list(F.struct("rank", "content", "chunk_id")))
    grouped = hits.groupBy("kb_id", "term").agg(listed.alias("__h"))
    texts = F.transform("__h", lambda h: h["content"])
    written = concepts.join(grouped, ["kb_id", "term"]).withColumn("content", write(F.col("term"), texts)).where("trim(content) <> ''")
    kind = F.when(F.col("is_new"), "concept").otherwise("summary")
    made = written.select("kb_id", F.col("term").alias("title"), kind.alias("article_type"), F.lit("published").alias("status"), "content", F.transform("__h", lambda h: h["chunk_id"]).alias("__ids"))
    sources = made.select("kb_id", "title", F.explode("__ids").alias("chunk_id"))
    return Generated(made.drop("__ids"), sources)


def connections(sources: DataFrame, min_shared: int = 1) -> DataFrame:
    """Local connections: pairs of a base's articles that share sources, by title; ``kb_id, source_title, target_title, link_type``.

    A base has a bounded number of concepts and each a bounded number of sources,
    so a source meets few articles.
    """
    a = sources.select("kb_id", "chunk_id", F.col("title").alias("source_title"))
    b = sources.select("kb_id", "chunk_id", F.col("title").alias("target_title"))
    pairs = a.join(b, ["kb_id", "chunk_id"]).where("source_title < target_title")
    counted = pairs.groupBy("kb_id", "source_title", "target_title").agg(F.count(F.lit(1)).alias("n_shared"))
    return counted.where(F.col("n_shared") >= min_shared).withColumn("link_type", F.lit("related"))


class Compiled(NamedTuple):
    articles: DataFrame
    sources: DataFrame
    links: DataFrame
    bases: DataFrame


def compile_bases(
    bases: DataFrame,
    members: DataFrame,
    summaries: DataFrame,
    titles: DataFrame,
    chunks: DataFrame,
    embedder: Embedder,
    write: Writer = beginnings,
    per_kb: int = 10,
    dims: int = 256,
    ask: Callable[[DataFrame], DataFrame] | None = None,
) -> Compiled:
    """Concepts, their hits, then articles, then connections both ways, then vectors of all articles.

    Concepts, hits and articles are written once and read by what follows.  ``ask`` gives
    ``query_id, vector`` for concepts; without it, the embedder does.  A base with
    articles turns ``active``, one without ``error``.
    """
    own = members.join(bases.select("kb_id"), "kb_id", "left_semi")
    found = written(concept_queries(kb.concepts(kb_summaries(own, summaries), titles, per_kb)), "concepts")
    hits = written(concept_hits(found, chunks, own, ask(found) if ask else query_vectors(found, embedder, dims)), "concept-hits")
    made = generate(found.select("kb_id", "term", "rank", "is_new"), hits, write)
    articles, sources = written(made.articles, "articles"), written(made.sources, "sources")
    forth = connections(sources).select("kb_id", F.col("source_title").alias("src"), F.col("target_title").alias("dst"), "link_type")
    forth = written(forth, "connections")
    links = forth.unionByName(forth.select("kb_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "link_type"))
    some = articles.select("kb_id").distinct().withColumn("__some", F.lit(True))
    state = F.when(F.col("__some"), "active").otherwise("error")
    after = bases.join(some, "kb_id", "left").withColumn("status", state).drop("__some")
    return Compiled(embed_articles(articles, embedder, dims), sources, links, after)


def compile_into(store: Store, kb_ids: list, embedder: Embedder, **options) -> int:
    """Compile bases of a store: first their state turns ``compiling``, then all results and the last state become one version.

    The store holds ``bases, members, summaries, chunks, articles, sources, links``; articles are
    known by base and title, sources and links by those too.  Old
    compiled articles of the bases, with their sources and links, give way to the new ones; derived and
    manual ones stay.  After a failure the bases are in ``error`` and all else is as it was.
    """
    wanted = F.col("kb_id").isin(kb_ids)
    bases = store.read("bases").where(wanted)
    begun = store.commit({"bases": merge(bases.withColumn("status", F.lit("compiling")))}, "compiling")
    now = {name: store.read(name, begun) for name in ("members", "summaries", "chunks", "articles", "sources", "links")}
    own = now["articles"].where(wanted)
    try:
        made = compile_bases(bases, now["members"], now["summaries"], own.select("kb_id", "title"), now["chunks"], embedder, **options)
        old = own.where(~F.col("article_type").isin("derived", "manual")).select("kb_id", "title")
        lost = {"articles": old, "sources": now["sources"].join(old, ["kb_id", "title"], "left_semi")}
        ends = [now["links"].join(old.withColumnRenamed("title", end), ["kb_id", end], "left_semi").select("kb_id", "src", "dst") for end in ("src", "dst")]
        lost["links"] = ends[0].unionByName(ends[1]).distinct()
        fresh = {"articles": made.articles, "sources": made.sources, "links": made.links}
        changes = {"bases": merge(made.bases)} | {n: [delete(lost[n].select(*store.keys[n])), merge(fresh[n].select(*now[n].columns))] for n in fresh}
        return store.commit(changes, "compiled", onto=begun)
    except Exception:
        store.commit({"bases": merge(bases.withColumn("status", F.lit("error")))}, "compile failed")
        raise
