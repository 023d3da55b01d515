"""Exact top-k inner-product search with MaxScore over integer vectors.

Each component ``x`` becomes the integer ``floor(scale * x)``.  A dimension is a
query term.  A shard (some vectors of a task) holds two postings lists for it: the
vectors with a positive component and those with a negative one, each with its
values.  For a query, the list of the query's sign adds to scores, the other one
takes away, and the term's score bound is the largest amount it can add in the shard.
Terms are ordered by bound; those whose bounds together stay below the score to beat
are non-essential.  The essential postings are traversed, and what none of them
adds to is no candidate.  The remaining terms are probed, largest bound first,
only while a vector can still reach the score to beat.  Ties need care: a vector
that can exactly equal that score stays in, since the smaller id wins.

A task sorts the vectors of a batch by length, longest first, and cuts shards that
begin with ``FIRST_ROWS`` vectors and double up to ``MOST_ROWS``, so that there is a
score to beat early.  Each query takes the shards in the order of the sums of their
bounds and leaves out those whose sum is too small.

Queries are taken in blocks of ``query_block`` rows.  A block is broadcast (at
most ``query_block`` times the dimension integers), meets every vector once, its
result is written to the shared folder, and its broadcast is destroyed before the
next block begins.  Shards return their own ``k`` best, and a window over each
query merges the shards.

Numbers are 64-bit where the bounds of a shard and a query show that no sum can
leave them, and of any size elsewhere.

Defined results for odd input: a vector that is null, or holds a null or
non-finite component, takes no part, nor does a null id; a result whose score is
outside a long is an error that names query and vector; components missing at the end of a shorter vector count
as 0; a row whose id equals the query's is the query's own; repeated ids are
candidates each; of a query id's several vectors the smallest, compared component
by component, is the query; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.workspace import scratch_path

FIRST_ROWS, MOST_ROWS = 64, 1024
#: Sums and products below this are exact in 64 bits.
SAFE = 2.0**62
LONG = 2**63


def usable(ident: Column, vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return ident.isNotNull() & vector.isNotNull() & whole


def quantised(vectors: list[np.ndarray], scale: int, width: int) -> np.ndarray:
    """Integer matrix of the vectors, one column each, padded with 0; of Python integers if one needs more than 62 bits."""
    scaled = np.zeros((width, len(vectors)))
    for i, v in enumerate(vectors):
        with np.errstate(over="ignore"):
            scaled[: len(v), i] = np.floor(np.asarray(v, dtype=np.float64) * scale)
    if not (np.abs(scaled) >= SAFE).any():
        return scaled.astype(np.int64)
    out = np.full((width, len(vectors)), 0, dtype=object)
    for i, v in enumerate(vectors):
        out[: len(v), i] = [int(s) if np.isfinite(s) else int(x) * scale for s, x in zip(scaled[: len(v), i], v, strict=True)]
    return out


class Shard:
    """Postings of some vectors, with their score bounds."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray) -> None:
        self.ids, self.columns = ids, columns
        self.high = np.maximum(columns.max(axis=1), 0)
        self.low = np.minimum(columns.min(axis=1), 0)
        self.above = [(at := np.nonzero(c > 0)[0], c[at]) for c in columns]
        self.below = [(at := np.nonzero(c < 0)[0], c[at]) for c in columns]
        #: Terms and vectors met in all searches, and those of them that were traversed, or still alive after the last term.
        self.met, self.did = np.zeros(2, dtype=np.int64), np.zeros(2, dtype=np.int64)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The largest amount that each term can add."""
        return np.where(query > 0, query * self.high, query * self.low)

    def safe(self, query: np.ndarray) -> bool:
        if object in (self.columns.dtype, query.dtype):
            return False
        return float(np.abs(query.astype(np.float64)) @ np.maximum(self.high, -self.low).astype(np.float64)) < SAFE

    def search(self, query_id: int, query: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k best of ``best`` and these vectors, as ids and scores."""
        if object not in (self.columns.dtype, query.dtype, best[1].dtype) and self.safe(query):
            return self._search(query_id, query, k, best)
        wide = Shard(self.ids, self.columns.astype(object))
        return wide._search(query_id, query.astype(object), k, (best[0], best[1].astype(object)))

    def _search(self, query_id: int, query: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found_ids, found_scores = best
        beat = found_scores[-1] if len(found_ids) == k else None
        terms = np.nonzero(query)[0]
        bounds = self.bounds(query)[terms]
        order = np.argsort(-bounds, kind="stable")
        terms, bounds = terms[order], bounds[order]
        rest = np.concatenate([np.cumsum(bounds[::-1])[::-1], np.zeros(1, dtype=bounds.dtype)])  # rest[i]: the bounds of terms i and later
        # Without a score to beat, or with one that a vector in no list can reach, all terms are essential.
        essential = len(terms) if beat is None or beat <= 0 else min(int(np.count_nonzero(rest >= beat)), len(terms))
        scores, posted = np.zeros(len(self.ids), dtype=query.dtype), np.zeros(len(self.ids), dtype=bool)
        for t in terms[:essential].tolist():
            adding, taking = (self.above[t], self.below[t]) if query[t] > 0 else (self.below[t], self.above[t])
            posted[adding[0]] = True
            for at, values in (adding, taking):
                scores[at] += query[t] * values
        alive = np.arange(len(self.ids)) if essential == len(terms) else np.nonzero(posted)[0]
        alive = alive[self.ids[alive] != query_id]
        scores = scores[alive]
        for i in range(essential, len(terms)):
            reach = scores + rest[i] >= beat
            if not reach.all():
                alive, scores = alive[reach], scores[reach]
            if not len(alive):
                break
            scores = scores + query[terms[i]] * self.columns[terms[i], alive]
        self.met += (len(terms), len(self.ids))
        self.did += (essential, len(alive))
        if beat is not None:
            alive, scores = alive[scores >= beat], scores[scores >= beat]
        if not len(alive):
            return best
        ids, scores = np.concatenate([found_ids, self.ids[alive]]), np.concatenate([found_scores, scores])
        if scores.dtype == object:
            first = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k])
        else:
            first = np.lexsort((ids, -scores))[:k]
        return ids[first], scores[first]


def shards_of(ids: np.ndarray, columns: np.ndarray) -> list[Shard]:
    """Shards of vectors sorted by length, longest first; the first ones are small."""
    lengths = (columns.astype(np.float64) ** 2).sum(axis=0)
    order = np.argsort(-lengths, kind="stable")
    found, at, rows = [], 0, FIRST_ROWS
    while at < len(order):
        part = order[at : at + rows]
        found.append(Shard(ids[part], columns[:, part]))
        at, rows = at + rows, min(2 * rows, MOST_ROWS)
    return found


def search_shards(shards: list[Shard], query_id: int, query: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The k best of ``best`` and all shards, the most promising shard first."""
    reach = [float("inf") if not s.safe(query) else int(s.bounds(query).sum()) for s in shards]
    for i in sorted(range(len(shards)), key=lambda i: (-reach[i], i)):
        if len(best[0]) == k and reach[i] < best[1][-1]:
            break
        best = shards[i].search(query_id, query, k, best)
    return best


def _searcher(queries, scale: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, query_rows = queries.value
        none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        best = [none] * len(query_ids)
        for batch in batches:
            width = max([query_rows.shape[1], *map(len, batch["v"])])
            shards = shards_of(batch["id"].to_numpy(np.int64), quantised(list(batch["v"]), scale, width))
            for j, q in enumerate(query_ids):
                row = np.zeros(width, dtype=query_rows.dtype)
                row[: query_rows.shape[1]] = query_rows[j]
                best[j] = search_shards(shards, q, row, k, best[j])
        if sum(len(b[0]) for b in best):
            scores = np.concatenate([b[1] for b in best])
            outside = (scores < -LONG) | (scores >= LONG)
            yield pd.DataFrame({
                "query_id": np.repeat(query_ids, [len(b[0]) for b in best]),
                "vec_id": np.concatenate([b[0] for b in best]),
                "score": np.where(outside, np.where(scores > 0, LONG - 1, -LONG), scores).astype(np.int64),
                "outside": outside.astype(bool),
            })

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector: str = "embedding",
    query_block: int = 4096,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best other rows."""
    spark = vectors.sparkSession
    ident, vec = F.col(f"`{id_col}`"), F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.where(usable(ident, vec))
    wanted = rows.where(is_query).select(ident.cast("long").alias("id"), vec.alias("v"))
    kept = rows.select(ident.cast("long").alias("id"), vec.alias("v"))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found: list[str] = []
    for block in _blocks(wanted, query_block):
        ids = np.array([r["id"] for r in block], dtype=np.int64)
        width = max((len(r["v"]) for r in block), default=0)
        sent = spark.sparkContext.broadcast((ids, quantised([r["v"] for r in block], scale, width).T.copy()))
        best = kept.mapInPandas(_searcher(sent, scale, k), "query_id long, vec_id long, score long, outside boolean")
        ranked = best.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
        where = F.concat(F.lit("outside a long: the score of query "), F.col("query_id").cast("string"), F.lit(" and vector "), F.col("vec_id").cast("string"))
        ranked = ranked.withColumn("score", F.when(F.col("outside"), F.raise_error(where).cast("long")).otherwise(F.col("score")))
        found.append(scratch_path(spark, "topk"))
        ranked.select("query_id", "rank", "vec_id", "score").write.parquet(found[-1])
        sent.destroy()
    shape = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(shape).parquet(*found) if found else spark.createDataFrame([], shape)


def _blocks(rows: DataFrame, size: int) -> Iterator[list]:
    """The rows on the driver, ``size`` at a time; each id once."""
    block: list = []
    for row in rows.groupBy("id").agg(F.min("v").alias("v")).toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block
