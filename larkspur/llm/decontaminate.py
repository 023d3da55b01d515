"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Words are runs of characters other than ASCII punctuation, space and control
characters, with A-Z lower-cased.  Every ``width`` consecutive words of an item
are a pattern; an item with fewer words, but not none, is one pattern.  A search
looks at the last word and then at the block of the last two words under a window
as long as the patterns.  The shift table says how far the window can move on without skipping
an occurrence; where it can't move, the block's bucket names the patterns that
end there, parted by their first two words, and each that begins as the window
does is compared with it directly.

Patterns are grouped by length, so that one short item doesn't shorten the
shifts of all the others.  Items are taken in blocks of ``block_patterns``
patterns at most, which take some 55 MB in a task's Python; an item with more goes into several blocks.  A benchmark that
fits one block is broadcast to one pass over the documents.  Otherwise each block
gets a pass of its own, which writes the texts it hits, by a key of the text, and
its broadcast is destroyed before the next block begins; the hits are then united
per text and joined to the documents.

Item ids of any type that can be compared are reported as they are.

Defined results for odd input: a null or empty text has no words; an item
without words never occurs; items with equal patterns are all reported; a null
item id is reported as no item, but its words count as hit; repeated document
rows are searched each; empty tables give no hits, respectively no rows.  Other
columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.workspace import UPPER, key128, scratch_path

#: Bytes of UTF-8 text that part words: all of ASCII but digits and letters.
_PARTING = bytes(c for c in range(128) if not chr(c).isalnum())
_TABLE = bytes.maketrans(UPPER.encode() + _PARTING, UPPER.lower().encode() + b" " * len(_PARTING))
BLOCK = 2
Pattern = tuple[bytes, ...]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


def windows(words: list[bytes], width: int) -> list[Pattern]:
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class Matcher:
    """Shift tables and suffix buckets of patterns that all have ``length`` words."""

    def __init__(self, patterns: Iterable[Pattern], length: int) -> None:
        self.length = length
        self.block = min(BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict[Pattern, int] = {}
        self.buckets: dict[Pattern, dict[Pattern, list[Pattern]]] = {}
        for p in patterns:
            for end in range(self.block, length + 1):
                piece = p[end - self.block : end]
                self.shift[piece] = min(self.shift.get(piece, self.far), length - end)
            self.buckets.setdefault(p[length - self.block :], {}).setdefault(p[: self.block], []).append(p)
        self.known = {w for piece in self.shift for w in piece}

    def search(self, words: list[bytes]) -> Iterator[tuple[int, Pattern]]:
        """Start and pattern of every occurrence."""
        at, n, length, block, far = self.length, len(words), self.length, self.block, self.far
        shift, known = self.shift.get, self.known
        while at <= n:
            if words[at - 1] not in known:
                at += length  # no window that holds this word occurs
                continue
            piece = tuple(words[at - block : at])
            move = shift(piece, far)
            if move:
                at += move
                continue
            window = tuple(words[at - length : at])
            for p in self.buckets[piece].get(window[:block], ()):
                if p == window:
                    yield at - length, p
            at += 1


class Benchmark:
    """All matchers of a block of items."""

    def __init__(self, items: Iterable[tuple[Any, list[bytes]]], width: int) -> None:
        self.owners: dict[Pattern, set] = {}
        for item, words in items:
            for p in windows(words, width):
                self.owners.setdefault(p, set()).add(item)
        by_length: dict[int, list] = {}
        for p in self.owners:
            by_length.setdefault(len(p), []).append(p)
        self.matchers = [Matcher(ps, n) for n, ps in sorted(by_length.items())]
        self.patterns = len(self.owners)

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], list]:
        """Number of words, hit runs ``[start, end)``, and ids of items found."""
        words = words_of(text)
        found: list[tuple[int, int]] = []
        items: set = set()
        for m in self.matchers:
            for at, p in m.search(words):
                found.append((at, at + m.length))
                items |= self.owners[p]
        items.discard(None)
        return len(words), merged(found), sorted(items)


def merged(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


HITS = "struct<n_words:long,runs:array<struct<start:int,end:int>>,items:array<{}>>"


def _blocks(benchmark: DataFrame, item: str, text: str, width: int, block_patterns: int) -> Iterator[list[tuple[Any, list[bytes]]]]:
    """Items and their words, of at most ``block_patterns`` windows in all; items with more come in overlapping pieces."""
    block, held = [], 0
    for row in benchmark.select(F.col(f"`{item}`"), F.col(f"`{text}`")).toLocalIterator():
        words = words_of(row[1])
        for at in range(0, max(1, len(words) - width + 1), block_patterns):
            piece = words[at : at + block_patterns + width - 1]
            n = len(windows(piece, width))
            if block and held + n > block_patterns:
                yield block
                block, held = [], 0
            block.append((row[0], piece))
            held += n
    if block:
        yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    block_patterns: int = 50_000,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items`` and ``contaminated``.

    New columns replace columns of these names.
    """
    blocks = _blocks(benchmark, item, item_text, width, block_patterns)
    first, second = next(blocks, []), next(blocks, None)
    kind = HITS.format(benchmark.schema[item].dataType.simpleString())
    if second is None:
        out = docs.withColumn("__wm", F.array(_searched(docs, first, width, kind)(F.col(f"`{text}`"))))
    else:
        out = _united(docs, chain([first, second], blocks), text, width, kind)
    out = out.withColumn("__wm_runs", F.array_sort(F.flatten(F.col("__wm.runs"))))
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "__wm_runs",
        start,
        lambda acc, r: F.struct(
            F.greatest(acc["upto"], r["end"]).alias("upto"),
            (acc["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(acc["upto"], r["start"]))).alias("n"),
        ),
    )
    out = out.withColumns({
        "n_words": F.col("__wm")[0]["n_words"],  # of any block, all count the same words
        "n_hit": covered["n"],
        "items": F.array_distinct(F.flatten(F.col("__wm.items"))),
    })
    out = out.withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})
    return out.drop("__wm", "__wm_runs")


def _searched(docs: DataFrame, block: list, width: int, kind: str):
    return _searcher(docs.sparkSession.sparkContext.broadcast(Benchmark(block, width)), kind)


def _united(docs: DataFrame, blocks: Iterable[list], text: str, width: int, kind: str) -> DataFrame:
    """``docs`` with all blocks' hits as ``__wm``, block after block; only hit texts are written."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    counted = _searched(docs, [], width, kind)
    paths: list[str] = []
    for block in blocks:
        sent = spark.sparkContext.broadcast(Benchmark(block, width))
        hits = docs.select(key128(body).alias("key"), _searcher(sent, kind)(body).alias("hit")).where(F.size("hit.runs") > 0)
        paths.append(scratch_path(spark, "benchmark-hits"))
        hits.groupBy("key").agg(F.first("hit").alias("hit")).write.parquet(paths[-1])
        sent.destroy()
    found = spark.read.parquet(*paths).groupBy(F.col("key").alias("__wm_key")).agg(F.collect_list("hit").alias("__wm_hits"))
    joined = docs.withColumns({"__wm_own": key128(body), "__wm_words": counted(body)}).join(found, F.col("__wm_own") == F.col("__wm_key"), "left")
    every = F.concat(F.array("__wm_words"), F.coalesce("__wm_hits", F.array().cast(f"array<{kind}>")))
    return joined.withColumn("__wm", every).drop("__wm_own", "__wm_words", "__wm_key", "__wm_hits")


def _searcher(sent, kind: str):
    @F.pandas_udf(kind)
    def search(column: pd.Series) -> pd.DataFrame:
        rows = [sent.value.hits(t) for t in column]
        return pd.DataFrame({
            "n_words": [r[0] for r in rows],
            "runs": [[{"start": a, "end": b} for a, b in r[1]] for r in rows],
            "items": [r[2] for r in rows],
        })

    return search
