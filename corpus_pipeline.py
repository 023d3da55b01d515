"""Corpus preparation: five stages, each on all that the one before it kept.

A stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from larkspur.llm.workspace import recorded, release, scratch_path

#: Documents with at least this toxicity go.
REJECT_AT = 0.7


def _packed(docs: DataFrame) -> DataFrame:
    """Id, text, and the columns but the text as one, whose names then can't clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*others).alias("__row"))


def _unpacked(packed: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    same = {"text": F.col("text")} | changed
    return packed.select(*[same.get(c, F.col("__row").getField(c)).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold."""
    labels = toxicity.read_labels(spark, f"{sf_dir}/labels.parquet")
    packed = _packed(docs)
    return _unpacked(toxicity.fit_and_score(packed, labels, keep=packed.columns).where(F.col("toxicity") < REJECT_AT), docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least 10 of them share."""
    out = line_dedup.dedup_lines(_packed(docs), min_docs=10, min_chars=1)
    return _unpacked(out, docs.columns, n_chars=F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id and text key."""
    return _unpacked(simhash.representatives(_packed(docs), radius=3, size=3), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _unpacked(decontaminate.find_contamination(_packed(docs), benchmark, width=10).where(~F.col("contaminated")), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated so that every source has the same weight, shuffled."""
    return mixing.mix_sources(docs, seed=17)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: Scores and fingerprints can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``.

    What a stage has written for itself, and the stage before it, goes when its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    results: list[str] = []
    for name, stage in STAGES:
        used: list[str] = []
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        with recorded(used):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(used + results, docs)
        results = [path]
    return docs
