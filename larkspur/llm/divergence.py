"""Source divergence audit: which sources of a language differ, and by which terms.

A term is kept if at least ``min_docs`` documents of its language hold it.  A group
(language, source) gives each of the language's ``V`` kept terms the share
``p = 1 + floor(SCALE * (count + 1) / (N + V))``; ``N`` counts the group's kept terms.
The divergence of a term is ``f = floor((p - q)^2 / q)``, of two groups the sum over
all kept terms.  All arithmetic is on integers.

The vocabulary of a language is dealt into buckets of about ``bucket_terms`` terms,
so a cell (group, bucket) is bounded however large the group is.  Cells hold counts
above zero only, delta-coded and compressed; a term that neither of two groups holds
adds the same to their sum, which is multiplied instead.  The groups of a language
make blocks.  Blocks stay in their partition, held on disk by key; in each round of a
round-robin tournament (circle method) every block has one opponent, and the one
with the higher number travels, compressed, to the other one's partition.  A meeting
evaluates both directions of all its pairs.  A language with ``B`` blocks takes ``B``
rounds at most, and blocks grow with the number of groups so that there are at most
``MAX_ROUNDS``.  Each round's sums are written before the next begins.  Before the
rounds, blocks meet themselves and the language's own vector, and a heap per cell
keeps its ``top`` terms; a window over these ranks them.

Defined results for odd input: null language, source and text count as empty; a
group without terms still gives every kept term a share; without kept terms all
divergences are 0; repeated rows are documents each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.workspace import forget, join_by_hot, united, written

SCALE = 1_000_000_000
MAX_ROUNDS = 64
#: A task's counts are sent on when it holds so many.
ENTRIES = 400_000
LONG = 1 << 22
#: Separators become spaces, A-Z lower case, other bytes stay; terms are what is between spaces.
_TABLE = bytes(32 if c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, a few megabytes at a time."""
    flat = text.translate(_TABLE)
    at = 0
    while at < len(flat):
        end = flat.find(b" ", at + LONG)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            names = list(n)
            columns = [pa.array(names, pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array(list(map(df.__getitem__, names)), pa.int64())]
            columns = [pa.repeat(pa.scalar(x, pa.string()), len(names)) for x in (lang, source)] + columns
            whole = pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "df"])
            for at in range(0, len(names), 10_000):
                yield whole.slice(at, 10_000)

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, df = held[lang, source]
            seen: set[bytes] = set()
            size -= len(n)
            for some in terms(text):
                n.update(some)
                seen.update(some)
            df.update(seen)
            size += len(n)
            if size > ENTRIES:
                yield from out()
                held.clear()
                size = 0
    yield from out()


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df``: occurrences and documents of each term (binary, UTF-8) per group."""
    raw = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    counted = raw.mapInArrow(_count, "lang string, source string, term binary, n long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def packed(tids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending term numbers and their counts, delta-coded and compressed."""
    return zlib.compress(np.diff(tids, prepend=0).astype("<u4").tobytes() + counts.astype("<i8").tobytes(), 1)


def unpacked(blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if blob is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    raw = zlib.decompress(blob)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)), np.frombuffer(raw, "<i8", n, 4 * n).astype(np.int64)


def share(counts: np.ndarray, total: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / total)`` by long division to the base 1,000: exact for totals below 9e15."""
    out, rest = np.zeros(len(counts), dtype=np.int64), counts + 1
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        out, rest = out * 1000 + digit, rest - digit * total
    return out + 1


class Cell:
    """A group's shares in one bucket: of its terms, and of all others."""

    def __init__(self, name: int, n: int, blob: bytes | None, terms_in_bucket: int, vocabulary: int) -> None:
        self.name, self.tids = name, np.zeros(0, dtype=np.int64)
        self.rest = 0
        self.dense, self.has = np.zeros(terms_in_bucket, dtype=np.int64), np.zeros(terms_in_bucket, dtype=bool)
        if terms_in_bucket:
            self.tids, counts = unpacked(blob)
            self.rest = int(share(np.zeros(1, dtype=np.int64), n + vocabulary)[0])
            self.dense[:] = self.rest
            self.dense[self.tids] = share(counts, n + vocabulary)
            self.has[self.tids] = True


def directed(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def meeting(one: Cell, two: Cell) -> tuple[int, int]:
    """Divergence of ``one`` from ``two`` in this bucket, and the other way."""
    if not len(one.has):
        return 0, 0
    at = np.concatenate([one.tids, two.tids[~one.has[two.tids]]])
    p, q = one.dense[at], two.dense[at]
    others, gap = len(one.has) - len(at), (one.rest - two.rest) ** 2
    return int(directed(p, q).sum()) + others * (gap // two.rest), int(directed(q, p).sum()) + others * (gap // one.rest)


def best_terms(cell: Cell, whole: Cell, top: int) -> list[tuple[int, int]]:
    """The ``top`` terms of the cell above their share in ``whole``: value and number, ties to the smaller."""
    p, q = cell.dense[cell.tids], whole.dense[cell.tids]
    above = p > q
    values = directed(p[above], q[above])
    return [(-v, t) for v, t in heapq.nsmallest(top, zip((-values).tolist(), cell.tids[above].tolist(), strict=True))]


SUMS = "lang string, g long, h long, bucket long, tid long, value long"


def _meet(top: int):
    """Rows hold a block and, as ``peers``, the one that has come, or none and the language's vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, heaps = defaultdict(int), []

        def out() -> pa.RecordBatch:
            names, kinds = ["lang", "g", "h", "bucket", "tid", "value"], [pa.string()] + [pa.int64()] * 5
            rows = [(*k[:3], None, None, v) for k, v in sums.items()] + heaps
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: c[i].as_py() for k, c in zip(batch.schema.names, batch.columns, strict=True)}
                cells = [Cell(c["g"], c["n"], c["blob"], row["terms"], row["v"]) for c in row["cells"]]
                if row["peers"] is None:
                    pairs = [(a, b) for i, a in enumerate(cells) for b in cells[i + 1 :]]
                    whole = Cell(-1, row["whole_n"], row["whole"], row["terms"], row["v"])
                    heaps += [(row["lang"], c.name, None, row["bucket"], t, v) for c in cells for v, t in best_terms(c, whole, top)]
                else:
                    peers = [Cell(c["g"], c["n"], c["blob"], row["terms"], row["v"]) for c in row["peers"]]
                    pairs = [(a, b) for a in cells for b in peers]
                for a, b in pairs:
                    there, back = meeting(a, b)
                    sums[row["lang"], a.name, b.name] += there
                    sums[row["lang"], b.name, a.name] += back
                if len(sums) + len(heaps) > ENTRIES:
                    yield out()
                    sums.clear()
                    heaps.clear()
        yield out()

    return run


def opponent(block, blocks, turn: int):
    """Whom ``block`` of ``blocks`` meets in round ``turn`` of the circle method; ``blocks`` or more: nobody.

    With ``m`` odd, all but block ``m`` meet by ``i + j = turn (mod m)``, and who would meet itself meets ``m``.
    """
    m = F.when(blocks % 2 == 0, blocks - 1).otherwise(blocks)
    other = F.pmod(F.lit(turn) - block, m)
    last = F.pmod(F.lit(turn) * ((m + 1) / 2).cast("long"), m)
    found = F.when(block == m, last).when(other == block, m).otherwise(other)
    return F.when(F.lit(turn) < m, found).otherwise(blocks)


def _pack(column: str) -> Column:
    @F.pandas_udf("binary")
    def blobs(cells: pd.Series) -> pd.Series:
        return pd.Series([packed(np.array([c["tid"] for c in x], dtype=np.int64), np.array([c["n"] for c in x], dtype=np.int64)) for x in cells])

    return blobs(column)


PLACE = ["lang", "bucket", "block"]


def one_round(resident: DataFrame, blocks: DataFrame, turn: int) -> DataFrame:
    """Resident blocks with the ``peers`` that have come to them; those travel, the residents stay."""
    met = opponent(F.col("block"), F.col("blocks"), turn)
    moving = blocks.withColumn("place", met).where((F.col("place") < F.col("blocks")) & (F.col("place") < F.col("block")))
    return resident.join(moving.select("lang", "bucket", F.col("place").alias("block"), F.col("cells").alias("peers")), PLACE)


class Audit:
    """Tables of the audit, written to the shared folder: ``groups``, ``dictionary`` and ``blocks``."""

    def __init__(self, docs: DataFrame, min_docs: int, bucket_terms: int, block_groups: int) -> None:
        empty = F.lit("")
        named = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")])
        # One shuffle by term says which terms are kept and numbers their rows; only kept terms go on.
        by_term = Window.partitionBy("lang", "term")
        summed = {"df": F.sum("df").over(by_term), "count": F.sum("n").over(by_term), "first": F.row_number().over(by_term.orderBy("source")) == 1}
        kept = count_terms(named).withColumns(summed).where(F.col("df") >= min_docs)
        kept = written(kept.select("lang", "source", "term", F.col("n").alias("here"), "count", "first"), "divergence-kept")
        langs = named.select("lang", "source").distinct()
        size = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("here").alias("whole_n"))
        buckets = F.greatest(F.lit(1), F.ceil(F.col("v") / bucket_terms)).cast("long")
        size = written(size.withColumn("buckets", buckets), "divergence-sizes")
        # A language may hold most terms, so sizes meet them by broadcast.
        placed = join_by_hot(kept, size.select("lang", "buckets", F.col("v").alias("n")), ["lang"])
        tid = (F.dense_rank().over(Window.partitionBy("lang", "bucket").orderBy("term")) - 1).cast("long")
        numbered = placed.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets"))).withColumn("tid", tid)
        numbered = written(numbered.select("lang", "source", "bucket", "tid", "term", "here", "count", "first"), "divergence-numbered")
        forget(kept)
        self.dictionary = written(numbered.where("first").select("lang", "bucket", "term", "count", "tid"), "divergence-dictionary")
        pairs = F.sort_array(F.collect_list(F.struct("tid", F.col("here").alias("n"))))
        cells = numbered.groupBy("lang", "source", "bucket").agg(pairs.alias("cells"), F.sum("here").alias("n"))
        cells = written(cells.select("lang", "source", "bucket", "n", _pack("cells").alias("blob")), "divergence-cells")
        forget(numbered)
        totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        by_lang = Window.partitionBy("lang").orderBy("source")
        g = (F.row_number().over(by_lang) - 1).cast("long")
        groups = langs.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), g.alias("g"))
        groups = groups.withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy("lang")))
        each = F.greatest(F.lit(block_groups), F.ceil(F.col("groups") / MAX_ROUNDS))
        groups = groups.withColumn("block", F.floor(F.col("g") / each)).withColumn("blocks", F.ceil(F.col("groups") / each).cast("long"))
        self.groups = written(groups, "divergence-groups")
        whole = F.sort_array(F.collect_list(F.struct("tid", F.col("count").alias("n"))))
        self.whole = written(self.dictionary.groupBy("lang", "bucket").agg(whole.alias("cells"), F.count(F.lit(1)).alias("terms")).select("lang", "bucket", "terms", _pack("cells").alias("whole")), "divergence-whole")
        # Each group is in each bucket of its language, also without terms there; a language without terms has bucket 0.
        spread = self.groups.join(size, "lang", "left").withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("buckets", F.lit(1)) - 1)))
        filled = spread.join(cells.drop("n"), ["lang", "source", "bucket"], "left").join(self.whole.select("lang", "bucket", "terms"), ["lang", "bucket"], "left")
        members = F.sort_array(F.collect_list(F.struct("g", "n", "blob")))
        zero = F.lit(0).cast("long")
        blocks = filled.groupBy("lang", "bucket", "block").agg(
            members.alias("cells"),
            F.max("blocks").alias("blocks"),
            F.coalesce(F.max("terms"), zero).alias("terms"),
            F.coalesce(F.max("v"), zero).alias("v"),
            F.coalesce(F.max("whole_n"), zero).alias("whole_n"),
        )
        self.blocks = written(blocks, "divergence-blocks")
        forget(size, cells)

    def resident(self) -> DataFrame:
        """The blocks, dealt by key once and held on disk; a lost part is read from the table again."""
        tasks = int(self.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return self.blocks.repartition(tasks, *PLACE).persist(StorageLevel.DISK_ONLY)

    def rotated(self, top: int) -> DataFrame:
        """Sums of pairs (``h`` set) and the best terms of cells (``tid`` set) from all meetings."""
        peers = "array<struct<g:bigint,n:bigint,blob:binary>>"
        own = self.blocks.join(self.whole.select("lang", "bucket", "whole"), ["lang", "bucket"], "left").withColumn("peers", F.lit(None).cast(peers))
        columns = ["lang", "bucket", "cells", "peers", "terms", "v", "whole_n", "whole"]
        found = [written(own.select(*columns).mapInArrow(_meet(top), SUMS), "divergence-own")]
        most = self.groups.agg(F.max("blocks").alias("n")).first()["n"] or 0
        resident = self.resident()
        for turn in range(most - 1 + most % 2):
            meet = one_round(resident, self.blocks, turn).withColumn("whole", F.lit(None).cast("binary"))
            found.append(written(meet.select(*columns).mapInArrow(_meet(top), SUMS), "divergence-round"))
        resident.unpersist()
        forget(self.blocks, self.whole)
        return united(found)


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, bucket_terms: int = 8192, block_groups: int = 4) -> DataFrame:
    """``lang, source, part, item, value, rank`` for ``docs (lang, source, text)``.

    Part ``pair``: the divergence of a group from each other source of its language.
    Part ``term``: its ``top`` terms above the language's share.
    """
    tables = Audit(docs, min_docs, bucket_terms, block_groups)
    found = tables.rotated(top)
    names = tables.groups.select("lang", "g", "source")
    sums = found.where("h IS NOT NULL").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    others = names.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    pairs = sums.join(names, ["lang", "g"]).join(others, ["lang", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = found.where("tid IS NOT NULL").select("lang", "g", "bucket", "tid", "value")
    items = best.join(tables.dictionary.select("lang", "bucket", "tid", "term"), ["lang", "bucket", "tid"]).join(names, ["lang", "g"])
    items = items.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ranked)
    return pairs.withColumn("rank", rank).unionByName(items.withColumn("rank", rank).where(F.col("rank") <= top))
