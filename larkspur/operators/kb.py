"""Knowledge bases: membership, provenance, links, health.  DataFrames in, new snapshots out."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import UUID, word_count

SYMMETRIC = ("related", "contradicts")
LINK_TYPES = ("related", "contradicts", "extends", "prerequisite")


def create(bases: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` rows whose (tenant, name) isn't taken, one per name."""
    fresh = wanted.dropDuplicates(["tenant_id", "name"])
    return fresh.join(bases.select("tenant_id", "name"), ["tenant_id", "name"], "left_anti")


def cascade(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Dependent rows that outlive the deletion of ``gone``."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def resolve(bases: DataFrame, reference: str, tenant: str | None = None) -> DataFrame:
    """A tenant's base by its id, if ``reference`` is a UUID, else by its name."""
    own = bases if tenant is None else bases.where(F.col("tenant_id") == tenant)
    return own.where(F.col("kb_id") == reference) if re.fullmatch(UUID, reference) else own.where(F.col("name") == reference)


def listed(bases: DataFrame, tenant: str | None = None) -> DataFrame:
    """A tenant's bases, newest first."""
    own = bases if tenant is None else bases.where(F.col("tenant_id") == tenant)
    return own.orderBy(F.desc("created_at"), "kb_id")


def delete_bases(gone: DataFrame, bases: DataFrame, members: DataFrame, articles: DataFrame, sources: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """All tables without the bases of ``gone (kb_id)``: articles, their sources and links, and memberships go; files stay."""
    lost = articles.join(gone.select("kb_id").distinct(), "kb_id", "left_semi").select("article_id")
    return {
        "bases": cascade(bases, gone, "kb_id"), "members": cascade(members, gone, "kb_id"), "articles": cascade(articles, gone, "kb_id"),
        "sources": cascade(sources, lost, "article_id"),
        "links": edges.join(lost.withColumnRenamed("article_id", "src"), "src", "left_anti").join(lost.withColumnRenamed("article_id", "dst"), "dst", "left_anti"),
    }


def delete_files(gone: DataFrame, files: DataFrame, chunks: DataFrame, sources: DataFrame, aliases: DataFrame, **by_file: DataFrame) -> dict[str, DataFrame]:
    """All tables without the files of ``gone (file_id)``: chunks, their sources and aliases, and every table of ``by_file``."""
    lost = chunks.join(gone.select("file_id").distinct(), "file_id", "left_semi").select("chunk_id")
    kept = {"files": cascade(files, gone, "file_id"), "chunks": cascade(chunks, gone, "file_id"), "sources": cascade(sources, lost, "chunk_id"), "aliases": cascade(aliases, lost, "chunk_id")}
    return kept | {name: cascade(t, gone, "file_id") for name, t in by_file.items()}


def add_files(members: DataFrame, wanted: DataFrame, files: DataFrame, tenant: str | None = None) -> DataFrame:
    """New memberships: each pair once, not there yet, of files that exist (and are the tenant's)."""
    own = files if tenant is None else files.where(F.col("tenant_id") == tenant)
    return wanted.dropDuplicates(["kb_id", "file_id"]).join(members, ["kb_id", "file_id"], "left_anti").join(own.select("file_id"), "file_id", "left_semi")


class Removal(NamedTuple):
    members: DataFrame
    sources: DataFrame
    articles: DataFrame


def remove_files(members: DataFrame, sources: DataFrame, articles: DataFrame, chunks: DataFrame, gone: DataFrame) -> Removal:
    """Membership, sources and articles after ``gone (kb_id, file_id)``: affected articles turn stale."""
    lost = chunks.join(gone.select("file_id").distinct(), "file_id", "left_semi").select("chunk_id")
    touched = sources.join(lost, "chunk_id", "left_semi").join(articles.select("article_id", "kb_id"), "article_id")
    touched = touched.join(gone.select("kb_id").distinct(), "kb_id", "left_semi")
    affected = touched.select("article_id").distinct().withColumn("__hit", F.lit(True))
    status = F.when(F.col("__hit"), "stale").otherwise(F.col("status"))
    return Removal(
        members.join(gone, ["kb_id", "file_id"], "left_anti"),
        sources.join(touched.select("article_id", "chunk_id"), ["article_id", "chunk_id"], "left_anti"),
        articles.join(affected, "article_id", "left").withColumn("status", status).drop("__hit"),
    )


def derive(proposed: DataFrame, chunks: DataFrame, max_tokens: int = 8192) -> tuple[DataFrame, DataFrame]:
    """Accepted ``derived`` articles and their sources; sources that don't exist are left out."""
    sized = proposed.withColumn("token_count", word_count(F.col("content")))
    accepted = sized.where(F.col("token_count") <= max_tokens).withColumns({"article_type": F.lit("derived"), "status": F.lit("published")})
    sources = accepted.select("article_id", F.explode("chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return accepted.drop("chunk_ids"), sources


def links(articles: DataFrame, proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """New ``src, dst, link_type`` rows from proposals by title, in their order ``pos``.

    The last article of a title counts; unknown types become ``related``; loops
    go; the first proposal of a pair wins; symmetric types get their reverse.
    """
    ids = articles.groupBy("title").agg(F.max("article_id").alias("id"))
    found = proposed.join(ids.select(F.col("title").alias("source_title"), F.col("id").alias("src")), "source_title")
    found = found.join(ids.select(F.col("title").alias("target_title"), F.col("id").alias("dst")), "target_title").where("src <> dst")
    kind = F.when(F.col("link_type").isin(*LINK_TYPES), F.col("link_type")).otherwise("related")
    pairs = found.select("pos", F.lit(0).alias("back"), "src", "dst", kind.alias("link_type"))
    pairs = pairs.groupBy("src", "dst").agg(F.min_by(F.struct("pos", "back", "link_type"), "pos").alias("p")).select("src", "dst", "p.*")
    pairs = pairs.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")
    back = pairs.where(F.col("link_type").isin(*SYMMETRIC)).select("pos", F.lit(1).alias("back"), F.col("dst").alias("src"), F.col("src").alias("dst"), "link_type")
    every = pairs.unionByName(back).join(existing.select("src", "dst"), ["src", "dst"], "left_anti")
    first = F.min_by("link_type", F.struct("pos", "back"))
    return every.groupBy("src", "dst").agg(first.alias("link_type"))


def issues(articles: DataFrame, sources: DataFrame, edges: DataFrame) -> DataFrame:
    """``kb_id, article_id, issue, action``: unsourced, stale and unlinked articles."""
    compiled = articles.where(~F.col("article_type").isin("derived", "manual"))
    bare = compiled.join(sources.select("article_id").distinct(), "article_id", "left_anti")
    stale = articles.where(F.col("status") == "stale")
    ends = edges.select(F.col("src").alias("article_id")).unionByName(edges.select(F.col("dst").alias("article_id"))).distinct()
    many = articles.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lone = articles.join(many, "kb_id", "left_semi").join(ends, "article_id", "left_anti")
    parts = [(bare, "no_sources", None), (stale, "stale", "recompile"), (lone, "orphan", "link")]
    rows = [d.select("kb_id", "article_id", F.lit(i).alias("issue"), F.lit(a).cast("string").alias("action")) for d, i, a in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def health(bases: DataFrame, articles: DataFrame, found: DataFrame) -> DataFrame:
    """``kb_id, n_articles, n_bad, score``; a base without articles scores 1."""
    total = articles.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_articles"))
    bad = found.groupBy("kb_id").agg(F.count_distinct("article_id").alias("n_bad"))
    out = bases.select("kb_id").join(total, "kb_id", "left").join(bad, "kb_id", "left").fillna(0, ["n_articles", "n_bad"])
    share = (F.col("n_articles") - F.col("n_bad")) / F.nullif(F.col("n_articles"), F.lit(0))
    return out.withColumn("score", F.coalesce(F.bround(share, 2), F.lit(1.0)))


def repair(articles: DataFrame, apply: tuple[str, ...] = ("stale",)) -> tuple[DataFrame, DataFrame]:
    """Articles that stay, and those deleted; only ``stale`` does anything."""
    if "stale" not in apply:
        return articles, articles.limit(0)
    return articles.where("status <> 'stale'"), articles.where("status = 'stale'")


def page(rows: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset at least 0")
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_with_total(rows: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page whose ``total`` is the number of rows on it."""
    cut = page(rows, order, limit, offset)
    return cut.join(F.broadcast(cut.agg(F.count(F.lit(1)).alias("total"))))  # one row


def with_sources(articles: DataFrame, sources: DataFrame) -> DataFrame:
    listed = sources.groupBy("article_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    return articles.join(listed, "article_id", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<bigint>")))


def counts(bases: DataFrame, members: DataFrame, articles: DataFrame) -> DataFrame:
    files = members.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_files"))
    texts = articles.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_articles"))
    return bases.select("kb_id").join(files, "kb_id", "left").join(texts, "kb_id", "left").fillna(0)


def concepts(summaries: DataFrame, titles: DataFrame, per_kb: int = 10) -> DataFrame:
    """Local concept provider: a knowledge base's terms by tf-idf over its summaries; ``is_new`` unless a title."""
    from larkspur.functions.text import terms

    words = summaries.select("kb_id", "file_id", F.explode(terms(F.col("summary"))).alias("term"))
    tf = words.groupBy("kb_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.count_distinct("file_id").alias("df"))
    n = summaries.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n"))
    scored = tf.join(n, "kb_id").withColumn("weight", F.col("tf") * F.ln((F.col("n") + 1.0) / (F.col("df") + 0.5)))
    order = Window.partitionBy("kb_id").orderBy(F.desc("weight"), "term")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_kb)
    known = titles.select("kb_id", F.lower("title").alias("term"), F.lit(False).alias("__old")).dropDuplicates()
    return best.join(known, ["kb_id", "term"], "left").select("kb_id", "term", "rank", F.coalesce("__old", F.lit(True)).alias("is_new"))
