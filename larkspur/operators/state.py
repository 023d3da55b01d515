"""Ingest state: reaping, progress, phases, key validity.  Pure functions of rows and a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reaper_action(status: Column, created: Column, updated: Column, now: Column) -> Column:
    """``reset`` stuck files, ``delete`` stale uploads, ``enqueue`` pending ones, else null."""
    stuck = (status == "processing") & (updated < now - F.expr("INTERVAL 10 MINUTES"))
    stale = (status == "uploading") & (created < now - F.expr("INTERVAL 24 HOURS"))
    return F.when(stuck, "reset").when(stale, "delete").when(status == "pending", "enqueue")


def progress(batches: DataFrame) -> DataFrame:
    """Per file: batches, completed ones, and whether each phase is complete."""
    done = lambda c: (F.count(F.lit(1)) > 0) & F.bool_and(F.coalesce(F.col(c) == "completed", F.lit(False)))
    return batches.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("total_batches"),
        F.count_if(F.col("embedding_status") == "completed").alias("completed_batches"),
        done("chunking_status").alias("chunked"),
        done("enrichment_status").alias("enriched"),
        done("embedding_status").alias("embedded"),
        F.sum("chunk_count").alias("n_chunks"),
    )


def next_phase(summary_done: Column) -> Column:
    """The first phase that isn't complete, for rows of ``progress``."""
    return (
        F.when(~F.col("chunked"), "chunk")
        .when(F.col("n_chunks") == 0, "failed")
        .when(~summary_done, "summarise")
        .when(~F.col("enriched"), "enrich")
        .when(~F.col("embedded"), "embed")
        .otherwise("ready")
    )


def valid_keys(keys: DataFrame, prefix: str | None, now: Column) -> DataFrame:
    found = keys if prefix is None else keys.where(F.col("key_prefix") == prefix)
    return found.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
