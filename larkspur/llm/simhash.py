"""SimHash near-duplicate groups by tiled exact comparison.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of a text's
word shingles.  Equal fingerprints are one node from the start, so that copies
never meet as pairs.  Fingerprints within ``radius`` bits agree on at least one
of ``radius + 1`` bit bands; each band value gathers the fingerprints that share
it, without loss.  Inside such a group fingerprints are sorted by population
count and compared tile against tile with exclusive-or and bit counts; a tile
pair whose population counts differ beyond the radius is skipped.  Tiles over the
whole table, without bands, would compare a constant share of all pairs.

A group of more than ``group_rows`` fingerprints is dealt over the pairs of its
salted parts, so no task holds more than two parts.  A task never returns pairs:
it joins what it found in a forest, at most one edge per fingerprint and part.
Components of these edges are the near-duplicate groups.  Classes go back to the
rows by fingerprint; the fingerprints that hold a large share of all rows, such as
that of empty texts, are broadcast, so their rows never meet in one task.

Defined results for odd input: a null or empty text, or one of white space, has
fingerprint zero and is linked like any other; fewer words than a shingle make
one shingle; a shingle counts as often as it occurs; repeated rows share a
fingerprint; a null id takes part but can't name a group that has another id; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.components import connected_components
from larkspur.llm.workspace import join_by_hot, key128, written

TILE = 128
HASHES_AT_ONCE = 1 << 17
SEED = 42


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def shingle_hashes(words: list[bytes], size: int) -> bytes:
    """XXH64 of every run of ``size`` words, repeats included, 8 bytes each."""
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        return digest(b" ".join(words), SEED) if words else b""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    ends = (ends[size - 1 :] - 1).tolist()
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)])


def fingerprint(text: str | None, size: int) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    hashes = shingle_hashes((text or "").encode().lower().split(), size)
    if not hashes:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8 * HASHES_AT_ONCE):
        part = np.frombuffer(hashes[at : at + 8 * HASHES_AT_ONCE], dtype=np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 16 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` and the columns ``also``: the fingerprint of each row as a signed long."""

    @F.pandas_udf("long")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, size)) for t in column], dtype="int64")

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), of(F.col(f"`{text}`")).alias("fp"), *also)


def bands(radius: int) -> list[tuple[int, int]]:
    """``(shift, width)`` of ``radius + 1`` bands that cover 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Forest:
    """Union-find over positions; the smallest position is the root."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        """Unite the pairs; whole arrays are pulled to their smaller roots."""
        while len(left):
            a, b = self.roots(left), self.roots(right)
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.up[at]
        while (up != (above := self.up[up])).any():
            up = above
        return up


def tile_links(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of two tiles differ in at most ``radius`` bits."""
    return np.bitwise_count(left[:, None] ^ right[None, :]) <= radius


def linked(fps: np.ndarray, radius: int, parts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A forest over ``fps`` (uint64, distinct) that spans all links, as two arrays.

    With ``parts`` (0 or 1 each) only links between the two parts are looked for.
    """
    counts = np.bitwise_count(fps)
    order = np.argsort(counts, kind="stable")
    fps, counts = fps[order], counts[order].astype(np.int64)
    parts = None if parts is None else parts[order]
    forest = Forest(len(fps))
    for i in range(0, len(fps), TILE):
        rows, top = fps[i : i + TILE], counts[min(i + TILE, len(fps)) - 1]
        for j in range(i, len(fps), TILE):
            if counts[j] - top > radius:
                break  # tiles further on only have higher counts
            near = tile_links(rows, fps[j : j + TILE], radius)
            if parts is not None:
                near &= parts[i : i + TILE, None] != parts[None, j : j + TILE]
            a, b = np.nonzero(near)
            forest.join(a + i, b + j)
    roots = forest.roots(np.arange(len(fps)))
    child = roots != np.arange(len(fps))
    return fps[child], fps[roots[child]]


def links(nodes: DataFrame, radius: int = 3, group_rows: int = 20_000) -> DataFrame:
    """Edges ``src, dst`` that connect fingerprints ``fp`` linked within ``radius``.

    ``nodes`` holds distinct fingerprints.
    """
    cut = [
        F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1).alias("value"))
        for i, (shift, width) in enumerate(bands(radius))
    ]
    spread = nodes.select("fp", F.explode(F.array(*cut)).alias("k")).select("fp", "k.band", "k.value")
    sizes = written(spread.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-groups")
    sized = spread.join(sizes, ["band", "value"])
    salts = F.ceil(F.col("n") / group_rows).cast("int")
    sized = sized.withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
    # A part meets itself and every other part: cells (low, high) of a triangle.
    cells = F.transform(
        F.sequence(F.lit(0), F.col("salts") - 1),
        lambda other: F.struct(F.least("salt", other).alias("low"), F.greatest("salt", other).alias("high")),
    )
    tasks = sized.select("fp", "band", "value", "salt", F.explode(cells).alias("cell"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells come as runs of rows, sorted; a run is compared when it ends."""
        held: list[pd.DataFrame] = []
        key = ["band", "value", "low", "high"]
        for batch in batches:
            held.append(batch)
            whole = pd.concat(held)
            last = (whole[key] == whole[key].iloc[-1].values).all(axis=1).to_numpy()
            yield from _compared(whole[~last], key, radius)
            held = [whole[last]]
        if held:
            yield from _compared(held[0], key, radius)

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["band", "value", "cell.low", "cell.high"]
    dealt = tasks.select("fp", "salt", *keys).repartition(n, "band", "value", "low", "high")
    return dealt.sortWithinPartitions("band", "value", "low", "high").mapInPandas(compare, "src long, dst long")


def _compared(rows: pd.DataFrame, key: list[str], radius: int) -> Iterator[pd.DataFrame]:
    if rows.empty:
        return
    values = rows[key].to_numpy()
    starts = np.concatenate([[0], np.nonzero((values[1:] != values[:-1]).any(axis=1))[0] + 1, [len(values)]])
    fps, salts = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["salt"].to_numpy()
    src, dst = [], []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        parts = None if values[a, 2] == values[a, 3] else (salts[a:b] == values[a, 3]).astype(np.int8)
        left, right = linked(fps[a:b], radius, parts)
        src.append(left)
        dst.append(right)
    if src:
        yield pd.DataFrame({"src": np.concatenate(src).view(np.int64), "dst": np.concatenate(dst).view(np.int64)})


def groups_of(marked: DataFrame, radius: int = 3, group_rows: int = 20_000) -> DataFrame:
    """``fp, low, n, component`` for each fingerprint of ``marked (doc_id, fp)``.

    ``component`` names the near-duplicate group, also one of null ids alone;
    ``low`` is the fingerprint's smallest id, ``n`` the number of its rows.
    """
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    members = connected_components(links(nodes.select("fp"), radius, group_rows))
    return written(nodes.join(members, nodes["fp"] == members["node"], "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("component")), "simhash-members")


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3, id_col: str = "doc_id", text: str = "text", group_rows: int = 20_000) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id among all rows reachable."""
    marked = written(fingerprints(docs, size, id_col, text), "simhash")
    joined = groups_of(marked, radius, group_rows)
    named = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = written(joined.join(named, "component").select("fp", "n", "component_id"), "simhash-classes")
    return join_by_hot(marked, classes, ["fp"]).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, radius: int = 3, size: int = 3, id_col: str = "doc_id", text: str = "text", group_rows: int = 20_000) -> DataFrame:
    """One row of ``docs`` per near-duplicate group: the smallest id, then the smallest text key.

    Rows are told apart by id and text, so neither a repeated nor a null id loses
    a row of another group.
    """
    ident = F.col(f"`{id_col}`").cast("long")
    keyed = docs.select(ident.alias("doc_id"), F.col(f"`{text}`").alias("text"), key128(F.col(f"`{text}`")).alias("key"))
    marked = written(fingerprints(keyed, size, also=("key",)), "simhash")
    classes = groups_of(marked.select("doc_id", "fp"), radius, group_rows).select("fp", "n", "component")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    first = join_by_hot(marked, classes, ["fp"]).groupBy("component").agg(smallest.alias("__first"))
    same = ident.eqNullSafe(F.col("__first.doc_id")) & (key128(F.col(f"`{text}`")) == F.col("__first.key"))
    kept = docs.join(first.select("__first"), same, "left_semi")
    return kept.withColumn("__key", key128(F.col(f"`{text}`"))).dropDuplicates([id_col, "__key"]).drop("__key")
