"""Pairs of vectors above a similarity, exact, without comparing all pairs.

Dimensions are ordered by how many vectors use them, rare ones first.  A vector's prefix
holds its dimensions in that order until the rest is shorter than the threshold.  If
two unit vectors reach the threshold, the first dimension that both use lies in both
prefixes; otherwise all they share would be in a rest that is too short.  So vectors
meet by the dimensions of their prefixes alone, and a pair is verified once, where the
first one in common is.

Made for vectors with many zeros, such as counts of hashed terms.  Without zeros a
prefix holds most dimensions, and all pairs of a group meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import vectors as vx
from larkspur.operators.packing import settled


def prefixes(vectors: np.ndarray, order: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The prefix of each unit vector: dimensions in ``order``."""
    sorted_by = vectors[:, order]
    rest = np.cumsum((sorted_by**2)[:, ::-1], axis=1)[:, ::-1]
    needed = (rest >= threshold**2 - 1e-9) & (sorted_by != 0)
    return [order[row].astype(np.int32) for row in needed]


def postings(rows: DataFrame, threshold: float, ident: str, group: str, vector: str) -> DataFrame:
    """``id, g, u, prefix, dim``: unit vectors by the dimensions of their prefixes; zero and null vectors have none."""
    known = rows.select(F.col(ident).alias("id"), F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v")).where(F.exists("v", lambda x: x != 0))
    length = vx.norm(F.col("v"))
    units = known.select("id", "g", settled(F.transform("v", lambda x: F.try_divide(x, length))).alias("u"))
    used = units.select(F.posexplode("u").alias("dim", "x")).where("x <> 0").groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    order = np.array([r["dim"] for r in used.orderBy("n", "dim").collect()], dtype=np.int64)  # a row per dimension

    @F.pandas_udf("array<int>")
    def prefix(column: pd.Series) -> pd.Series:
        return pd.Series(prefixes(np.stack(column.to_list()), order, threshold)) if len(column) else pd.Series([], dtype=object)

    described = units.withColumn("prefix", prefix("u"))
    return described.select("id", "g", "u", "prefix", F.explode("prefix").alias("dim"))


def similar_pairs(rows: DataFrame, threshold: float, ident: str = "article_id", group: str = "kb_id", vector: str = "embedding") -> DataFrame:
    """``group, left, right, similarity`` of all pairs of a group with a cosine of at least ``threshold``; ``left`` is the smaller id."""
    a = postings(rows, threshold, ident, group, vector)
    left = a.select("g", "dim", F.col("id").alias("left"), F.col("u").alias("__a"), F.col("prefix").alias("__p"))
    right = a.select("g", "dim", F.col("id").alias("right"), F.col("u").alias("__b"), F.col("prefix").alias("__q"))
    met = left.join(right, ["g", "dim"]).where(F.col("left") < F.col("right"))
    once = met.where(F.element_at(F.array_intersect("__p", "__q"), 1) == F.col("dim"))
    return once.withColumn("similarity", vx.dot(F.col("__a"), F.col("__b"))).where(F.col("similarity") >= threshold).select(F.col("g").alias(group), "left", "right", "similarity")


def connections_by_text(articles: DataFrame, threshold: float, kind: Callable[[Column], Column] | None = None, vector: str = "embedding") -> DataFrame:
    """``kb_id, source_title, target_title, link_type`` of articles of one base with similar texts.

    ``kind`` is a model's judgement of a similarity; without it, all are ``related``.
    """
    found = similar_pairs(articles, threshold, "title", "kb_id", vector)
    link = F.lit("related") if kind is None else kind(F.col("similarity"))
    return found.select("kb_id", F.col("left").alias("source_title"), F.col("right").alias("target_title"), link.alias("link_type"))
