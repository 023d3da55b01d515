"""Vectors stored by cell: k-means cells learned over all rows, searches that read the cells near a query.

A search reads the ``probes`` cells whose centres are nearest, or, without a number of
probes, as many as an exact answer needs: no vector of a cell is nearer to the query than
the cell's centre less the cell's radius, so cells beyond what the k-th hit allows are left out.
``probes_for`` measures which number of probes gives a wanted recall.

Zero and null vectors are not indexed.  Cells are learned on unit vectors; a task sends sums, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import vectors as vx
from larkspur.operators.retrieval import top_hits
from larkspur.sources.versioned import Store, append, replace


def units(vectors: Sequence[Sequence[float]]) -> np.ndarray:
    found = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    return rows.where(F.col(vector).isNotNull()).where(F.exists(vector, lambda x: x != 0))


def learn(rows: DataFrame, cells: int, rounds: int = 5, vector: str = "embedding") -> np.ndarray:
    """Unit centres of up to ``cells`` cells: the vectors with the smallest hashes, then ``rounds`` of k-means over all rows."""
    known = usable(rows, vector).select(F.col(vector).cast("array<double>").alias("v"))
    first = known.select("v", F.xxhash64("v").alias("h")).dropDuplicates(["h"]).orderBy("h").limit(cells).collect()
    centres = units([r["v"] for r in first]) if first else np.zeros((0, 0))
    for _ in range(rounds if len(centres) else 0):
        sent = rows.sparkSession.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(sent.value)
            for batch in batches:
                found = units(batch["v"].tolist())
                np.add.at(total, np.argmax(found @ sent.value.T, axis=1), found)
            used = np.nonzero(total.any(axis=1))[0]
            if len(used):
                yield pd.DataFrame({"cell": used, "s": list(total[used])})

        parts = known.mapInPandas(sums, "cell int, s array<double>").select("cell", F.posexplode("s").alias("dim", "x"))
        added = parts.groupBy("cell", "dim").agg(F.sum("x").alias("x")).toPandas()  # cells times dimensions
        moved = centres.copy()
        grid = added.pivot(index="cell", columns="dim", values="x")
        moved[grid.index.to_numpy()] = grid.to_numpy()
        length = np.linalg.norm(moved, axis=1, keepdims=True)
        centres = np.where(length > 0, moved / np.where(length > 0, length, 1), centres)
        sent.destroy()
    return centres


class VectorCells:
    """Cells below ``path``: tables ``vectors`` (by cell) and ``centres``."""

    def __init__(self, spark: SparkSession, path: str, cells: int = 64) -> None:
        self.spark, self.cells = spark, cells
        self.store = Store(spark, path, {"vectors": ["cell"], "centres": ["cell"]}, buckets=cells)

    def _placed(self, rows: DataFrame, centres: np.ndarray, ident: str, vector: str) -> DataFrame:
        sent = self.spark.sparkContext.broadcast(centres)

        @F.pandas_udf("cell int, angle double")
        def nearest(column: pd.Series) -> pd.DataFrame:
            near = units(column.tolist()) @ sent.value.T
            at = np.argmax(near, axis=1)
            return pd.DataFrame({"cell": at, "angle": np.arccos(np.clip(near[np.arange(len(at)), at], -1, 1))})

        vectors = usable(rows, vector).select(F.col(ident).alias("chunk_id"), F.col(vector).cast("array<double>").alias("embedding"))
        return vectors.withColumn("place", nearest("embedding")).select("place.cell", "chunk_id", "embedding", "place.angle")

    def build(self, rows: DataFrame, rounds: int = 5, ident: str = "chunk_id", vector: str = "embedding") -> int:
        """Learn cells from ``rows`` and store them by cell."""
        centres = learn(rows, self.cells, rounds, vector)
        made = [(i, c.tolist()) for i, c in enumerate(centres)]
        told = self.spark.createDataFrame(made, "cell int, centre array<double>")
        return self.store.commit({"centres": replace(told), "vectors": replace(self._placed(rows, centres, ident, vector))}, "build")

    def add(self, rows: DataFrame, ident: str = "chunk_id", vector: str = "embedding") -> int:
        """More vectors into the cells that are there."""
        return self.store.commit({"vectors": append(self._placed(rows, self._centres(), ident, vector))}, "add")

    def _centres(self) -> np.ndarray:
        return np.array([r["centre"] for r in self.store.read("centres").orderBy("cell").collect()])

    def _in(self, cells: list[int]) -> DataFrame:
        wanted = self.spark.createDataFrame([(c,) for c in cells], "cell int")
        return self.store.read("vectors", buckets=self.store.buckets_of("vectors", wanted)).where(F.col("cell").isin(cells))

    def _order(self, query: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """Cells from the nearest centre on, and each cell's angle to the query."""
        angles = np.arccos(np.clip(self._centres() @ units([query])[0], -1, 1))
        return np.argsort(angles, kind="stable"), angles

    def probed(self, query: Sequence[float], probes: int) -> DataFrame:
        """The vectors of the ``probes`` cells nearest to the query."""
        return self._in([int(c) for c in self._order(query)[0][:probes]])

    def search(self, query: Sequence[float], k: int = 50, probes: int | None = None) -> DataFrame:
        """``chunk_id, score``: the ``k`` nearest by cosine among ``probes`` cells, or among all without it."""
        scored = lambda rows: rows.select("chunk_id", (1.0 - vx.cosine_distance(F.col("embedding"), vx.literal(query))).alias("score"))
        if probes is not None:
            return top_hits(scored(self.probed(query, probes)), k)
        return top_hits(scored(self._in(self.needed(query, k))), k)

    def needed(self, query: Sequence[float], k: int) -> list[int]:
        """The cells that can hold one of the ``k`` nearest: known radii against the k-th hit of the first cells."""
        order, angles = self._order(query)
        told = {r["cell"]: (r["n"], r["r"]) for r in self.store.read("vectors").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect()}
        first, n = [], 0
        for c in order.tolist():
            if n >= k:
                break
            first.append(c)
            n += told.get(c, (0, 0.0))[0]
        last = self.search(query, k, len(first)).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        reach = float(np.arccos(np.clip(last["least"], -1, 1))) + 1e-9 if last["n"] == k else np.inf
        return [c for c in order.tolist() if c in told and angles[c] - told[c][1] <= reach]

    def probes_for(self, queries: Sequence[Sequence[float]], k: int = 50, recall: float = 0.95) -> tuple[int, float]:
        """The least number of probes with at least this recall over ``queries``, and the recall measured."""
        ranks = []
        for q in queries:
            place = {int(c): i + 1 for i, c in enumerate(self._order(q)[0])}
            hits = self.search(q, k).select("chunk_id")
            ranks.append([place[r["cell"]] for r in self.store.read("vectors").join(F.broadcast(hits), "chunk_id").select("cell").collect()])
        for probes in range(1, self.cells + 1):
            got = float(np.mean([np.mean([r <= probes for r in found]) for found in ranks])) if ranks else 1.0
            if got >= recall:
                return probes, got
        return self.cells, 1.0

    def bytes_of(self, query: Sequence[float], probes: int) -> int:
        """Bytes of the files that a search with so many probes opens."""
        wanted = self.spark.createDataFrame([(int(c),) for c in self._order(query)[0][:probes]], "cell int")
        files = self.store.manifest()["tables"]["vectors"]["files"]
        return sum(self.store.size_of(p) for b in self.store.buckets_of("vectors", wanted) for p in files.get(str(b), []))
