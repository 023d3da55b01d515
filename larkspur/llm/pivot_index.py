"""Near-duplicate vectors by an index of pivot permutations.

Pivots are reference vectors.  A vector is described by its ``prefix`` nearest ones.
Vectors of one label that share at least half of them are candidates, and only
those are verified by their cosine.  Candidates are retrieved through inverted
lists, one per label and pivot: two sets of ``prefix`` pivots with ``shared`` in
common also have a pivot in common among the first ``prefix - shared + 1`` of each
in pivot order, so a vector is posted in those lists alone, and a pair is counted
in the list of the first posted pivot that it shares.

Pivots come from a bounded sample: of the ``4 * pivots`` distinct vectors with the
smallest hashes, ``pivots`` are chosen farthest first, so that a large group of near
copies doesn't take up the pivots.  Every row is indexed.

Equal vectors of a label are one node with a weight from the start, so copies never
meet as pairs.  A list longer than ``part_rows`` is dealt over the pairs of its
salted parts; no task holds more than two parts.  A task returns no pairs: it
counts links per node and keeps a forest that spans them.  Lists are worked off in
``passes`` passes, which bounds what is shuffled at a time.

Pairs that share fewer pivots are not found; ``tests/llm/test_pivot_index.py``
measures the recall against all pairs.  No pair below the threshold is linked.

Defined results for odd input: a vector that is null, empty, zero or holds a null
or non-finite component, or whose label is null, has no links and is its own
component; vectors of different lengths don't link; repeated rows link with each
other; a null id takes part but can't name a component that has another id, and is
kept only where its component has none; every row with the id of its component is
kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.components import connected_components
from larkspur.llm.simhash import Forest
from larkspur.llm.workspace import forget, join_by_hot, united, written

TILE = 1024


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: list[np.ndarray], width: int | None = None) -> np.ndarray:
    """Rows of length 1, padded with zeros to ``width``; scaled first, so that no square overflows."""
    out = np.zeros((len(vectors), width or max(map(len, vectors), default=0)))
    for row, v in zip(out, vectors, strict=True):
        n = min(len(v), out.shape[1])
        row[:n] = v[:n]
    top = np.abs(out).max(axis=1, keepdims=True, initial=0)
    out /= np.where(top > 0, top, 1)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def spread_out(sample: np.ndarray, pivots: int, apart: float) -> np.ndarray:
    """Up to ``pivots`` rows of unit vectors, each the farthest from those before, while it is farther than ``apart``."""
    chosen, nearest = [], np.full(len(sample), -2.0)
    while len(chosen) < min(pivots, len(sample)):
        at = int(np.argmin(nearest))
        if nearest[at] >= apart:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, sample @ sample[at])
        nearest[at] = 2.0
    return sample[chosen]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each row, nearest first; ties go to the smaller number."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]


def _incidence(sets: np.ndarray, names: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(names) + 1), dtype=np.float32)
    at = np.searchsorted(names, sets)
    np.put_along_axis(out, at, 1, axis=1)
    return out[:, : len(names)]


def list_links(units: np.ndarray, described: np.ndarray, pivot: int, shared: int, threshold: float, weights: np.ndarray, parts: np.ndarray | None = None):
    """Link weight of every row of one list, the forest over its links, and how many pairs were verified.

    ``described`` holds the pivots of each row in ascending order.  With ``parts``
    (0 or 1 each) only pairs across the two parts count.
    """
    n, verified = len(units), 0
    posted = described[:, : described.shape[1] - shared + 1]
    names = np.unique(described)
    have = _incidence(described, names)
    before = _incidence(posted, names) * (names < pivot)
    links, forest = np.zeros(n, dtype=np.int64), Forest(n)
    for i in range(0, n, TILE):
        a = slice(i, i + TILE)
        for j in range(i, n, TILE):
            b = slice(j, j + TILE)
            near = (have[a] @ have[b].T >= shared) & (before[a] @ before[b].T == 0)
            if parts is not None:
                near &= parts[a, None] != parts[None, b]
            if i == j:
                near &= np.triu(np.ones(near.shape, dtype=bool), 1)
            candidates = int(near.sum())
            if not candidates:
                continue
            verified += candidates
            left, right = np.nonzero(near)
            if candidates * 8 < near.size:
                cosine = np.einsum("ij,ij->i", units[a][left], units[b][right])
                left, right = left[cosine >= threshold], right[cosine >= threshold]
            else:
                left, right = np.nonzero(near & (units[a] @ units[b].T >= threshold))
            np.add.at(links, left + i, weights[right + j])
            np.add.at(links, right + j, weights[left + i])
            forest.join(left + i, right + j)
    roots = forest.roots(np.arange(n))
    return links, roots, verified


KEY = ["label", "dim", "pivot", "low", "high"]


def _run_links(rows: pd.DataFrame, shared: int, threshold: float) -> pd.DataFrame:
    first = rows.iloc[0]
    parts = None if first["low"] == first["high"] else (rows["salt"] == first["high"]).to_numpy().astype(np.int8)
    described = np.sort(np.stack(rows["near"].tolist()).astype(np.int64), axis=1)
    weights, nodes = rows["w"].to_numpy(np.int64), rows["node"].to_numpy(np.int64)
    links, roots, verified = list_links(unit(rows["v"].tolist()), described, int(first["pivot"]), shared, threshold, weights, parts)
    hit = links > 0
    out = pd.DataFrame({"node": nodes[hit], "root": nodes[roots[hit]], "links": links[hit], "verified": 0})
    if verified:
        out = pd.concat([out, pd.DataFrame({"node": [-1], "root": [-1], "links": [0], "verified": [verified]})])
    return out


def _comparer(shared: int, threshold: float):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells come as runs of rows, sorted; a run is compared when it ends."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            while len(batch):
                own = held[0] if held else batch
                same = (batch[KEY] == own[KEY].iloc[0].values).all(axis=1).to_numpy()
                n = len(batch) if same.all() else int(np.argmin(same))
                if n:
                    held.append(batch.iloc[:n])
                    batch = batch.iloc[n:]
                if len(batch):
                    yield _run_links(pd.concat(held), shared, threshold)
                    held = []
        if held:
            yield _run_links(pd.concat(held), shared, threshold)

    return compare


def describe(nodes: DataFrame, pivots: np.ndarray, prefix: int) -> DataFrame:
    """``node, label, dim, near``: the numbers of each node's nearest pivots, nearest first."""
    sent = nodes.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("array<int>")
    def near(column: pd.Series) -> pd.Series:
        return pd.Series(list(nearest_pivots(unit(column.tolist(), sent.value.shape[1]), sent.value, prefix).astype(np.int32)))

    return nodes.select("node", "label", "dim", near("v").alias("near"))


def choose_pivots(nodes: DataFrame, pivots: int, apart: float) -> np.ndarray:
    """Reference vectors from a sample of at most ``4 * pivots`` nodes, those with the smallest hashes."""
    rows = nodes.select("v", F.xxhash64("v").alias("h"), "label").orderBy("h", "label").limit(4 * pivots).collect()
    return spread_out(unit([np.asarray(r["v"], dtype=np.float64) for r in rows]), pivots, apart)


def node_links(nodes: DataFrame, threshold: float = 0.98, pivots: int = 256, prefix: int = 8, part_rows: int | None = None, passes: int = 2) -> DataFrame:
    """``node, root, links, verified`` per list and linked node of ``nodes (node, label, dim, v, w)``.

    ``root`` is linked, also over others, to the node inside the list; ``links`` is the
    weight of linked nodes found there.  Rows of node -1 hold numbers of verified pairs.
    """
    spark = nodes.sparkSession
    shape = "node long, root long, links long, verified long"
    chosen = choose_pivots(nodes, pivots, threshold)
    if not len(chosen):
        return spark.createDataFrame([], shape)
    prefix = min(prefix, len(chosen))
    shared = (prefix + 1) // 2
    described = written(describe(nodes, chosen, prefix), "pivot-described")
    postings = described.select("node", "label", "dim", F.explode(F.slice(F.array_sort("near"), 1, prefix - shared + 1)).alias("pivot"))
    sizes = written(postings.groupBy("label", "dim", "pivot").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "pivot-sizes")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if part_rows is None:  # half of an even share, so that no task has much more than others
        total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
        part_rows = min(16_384, max(256, total // tasks // 2))
    sized = join_by_hot(postings, sizes.withColumn("salts", F.ceil(F.col("n") / part_rows).cast("int")), ["label", "dim", "pivot"])
    sized = sized.withColumn("salt", F.pmod(F.xxhash64("node", "pivot"), F.col("salts")).cast("int"))
    # A part meets itself and every other part: cells (low, high) of a triangle.
    meets = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda o: F.struct(F.least("salt", o).alias("low"), F.greatest("salt", o).alias("high")))
    places = sized.select("node", F.struct("pivot", "salt", meets.alias("meets")).alias("place"))
    placed = written(places.groupBy("node").agg(F.collect_list("place").alias("places")), "pivot-places")
    whole = nodes.join(described.select("node", "near"), "node").join(placed, "node")
    found = []
    for turn in range(passes):
        here = whole.select("node", "label", "dim", "v", "w", "near", F.explode("places").alias("p")).where(F.col("p.pivot") % passes == turn)
        cells = here.select("node", "label", "dim", "v", "w", "near", "p.pivot", "p.salt", F.explode("p.meets").alias("m"))
        dealt = cells.select("*", "m.low", "m.high").drop("m").repartition(tasks, *KEY).sortWithinPartitions(*KEY)
        found.append(written(dealt.mapInPandas(_comparer(shared, threshold), shape), "pivot-links"))
    forget(described, sizes, placed)
    return united(found)


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    pivots: int = 256,
    prefix: int = 8,
    part_rows: int | None = None,
    passes: int = 2,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    ident, vec, group = F.col(f"`{id_col}`").cast("long"), F.col(f"`{vector}`"), F.col(f"`{label}`")
    if vectors.schema[vector].dataType.simpleString() != "array<float>":
        vec = vec.cast("array<double>")
    keys = ["label", "dim", "a", "b"]
    takes_part = F.coalesce(usable(vec) & group.isNotNull(), F.lit(False))
    rows = vectors.select(ident.alias("id"), group.cast("string").alias("label"), vec.alias("v"), takes_part.alias("ok"))
    known = rows.where("ok").withColumns({"dim": F.size("v"), "a": F.xxhash64("v"), "b": F.xxhash64(F.lit(1), "v")})
    once = known.groupBy(*keys).agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v"))
    nodes = written(once.withColumn("node", F.monotonically_increasing_id()), "pivot-nodes")
    found = node_links(nodes.select("node", "label", "dim", "v", "w"), threshold, pivots, prefix, part_rows, passes)
    members = connected_components(found.where("node != root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    counts = found.where("node >= 0").groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "low", "w", *keys).join(counts, "node", "left").join(members, "node", "left")
    named = written(named.withColumn("component", F.coalesce("component", "node")), "pivot-members")
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = named.join(lowest, "component").select(*keys, "component_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.col("w").alias("n"))
    classes = written(classes, "pivot-classes")
    forget(nodes, named, *([found] if hasattr(found, "scratch") else []))
    linked = join_by_hot(known.select("id", *keys), classes, keys).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
