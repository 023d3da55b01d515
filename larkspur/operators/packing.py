"""Token-budget packing: groups of consecutive pieces, and parent/child chunks.

Only token counts travel to Python, in Arrow batches; texts stay in the JVM and
are rebuilt from the ranges that come back.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import count_tokens, sentences

RANGES = "array<struct<first:int,last:int>>"


def greedy_ranges(tokens: list[int], budget: int) -> list[tuple[int, int]]:
    """Runs whose sums stay within the budget; a piece over it stands alone."""
    out, first, total = [], 0, 0
    for i, n in enumerate(tokens):
        if i > first and total + n > budget:
            out.append((first, i - 1))
            first, total = i, 0
        total += n
    if len(tokens):
        out.append((first, len(tokens) - 1))
    return out


def overlapping_ranges(tokens: list[int], budget: int, overlap: int) -> list[tuple[int, int]]:
    """As above, each run after the first starting with the longest tail of the one before within ``overlap``."""
    out, first, total = [], 0, 0
    for i, n in enumerate(tokens):
        if i > first and total + n > budget:
            out.append((first, i - 1))
            carried, start = 0, i
            while start > first and carried + tokens[start - 1] <= overlap:
                start -= 1
                carried += tokens[start]
            first, total = start, carried
        total += n
    if len(tokens):
        out.append((first, len(tokens) - 1))
    return out


def _as_rows(ranges: list[tuple[int, int]]) -> list[dict]:
    return [{"first": a, "last": b} for a, b in ranges]


def settled(value: Column) -> Column:
    """``value``, as a column of its own step.

    The condition always holds, but isn't deterministic, so the optimizer doesn't merge the step into
    the Python function that reads it: an input with a lambda might then not be recognised,
    or be computed again.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def with_groups(rows: DataFrame, name: str, tokens: Column, budget: int, overlap: int | None = None) -> DataFrame:
    """``rows`` with the ranges of greedy groups of the token counts ``tokens``, overlapping ones with ``overlap``."""
    pack = greedy_groups(F.col("__tokens"), budget) if overlap is None else overlapping_groups(F.col("__tokens"), budget, overlap)
    return rows.withColumn("__tokens", settled(tokens)).withColumn(name, pack).drop("__tokens")


def greedy_groups(tokens: Column, budget: int) -> Column:
    @F.pandas_udf(RANGES)
    def pack(column: pd.Series) -> pd.Series:
        return column.map(lambda t: _as_rows(greedy_ranges(list(t), budget)))

    return pack(tokens)


def overlapping_groups(tokens: Column, budget: int, overlap: int) -> Column:
    @F.pandas_udf(RANGES)
    def pack(column: pd.Series) -> pd.Series:
        return column.map(lambda t: _as_rows(overlapping_ranges(list(t), budget, overlap)))

    return pack(tokens)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once; a column used in a lambda may be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def run(parts: Column, first: Column, last: Column) -> Column:
    return F.slice(parts, first + 1, last - first + 1)


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda acc, x: acc + x)


def longer(text: Column, tokens: int, beginning: int = 4096) -> Column:
    """Whether ``text`` has more than ``tokens`` tokens; a long one mostly shows it in its beginning, which has no more than all."""
    return F.when(count_tokens(F.substring(text, 1, beginning)) > tokens, True).otherwise(count_tokens(text) > tokens)


def chunk_hierarchy(
    texts: DataFrame, text: str = "text", parent_max: int = 1500, child_max: int = 300, min_child: int = 50, overlap: int = 30
) -> DataFrame:
    """Parent and child chunks: ``parent_index, child_index, parent, child`` with token counts.

    A text within ``child_max`` is one child and its own parent.  Otherwise
    sentences are packed into overlapping children; a last child under
    ``min_child`` tokens joins the one before; children are packed into parents.
    Time and memory are linear in the text, whose tokens are counted once, by sentence.
    """
    keys = [c for c in texts.columns if c != text]
    body = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\r\n\x0b\f"))
    base = texts.select(*keys, body.alias("__text")).where("__text <> ''")
    whole = F.array("__text")
    split = F.when(~longer(F.col("__text"), child_max), whole).otherwise(let(sentences(F.col("__text")), lambda s: F.when(F.size(s) == 0, whole).otherwise(s)))
    sized = base.select(*keys, split.alias("__s")).withColumn("__t", settled(F.transform("__s", count_tokens)))
    cut = with_groups(sized, "__ranges", F.col("__t"), child_max, overlap)
    # Pieces are joined by a blank, which no token holds: counts of a text are sums of its pieces' counts.
    drawn = let(
        F.struct(F.col("__s").alias("s"), F.col("__t").alias("t"), F.col("__ranges").alias("r")),
        lambda v: F.transform(
            v["r"],
            lambda r: F.struct(F.array_join(run(v["s"], r["first"], r["last"]), " ").alias("c"), total(run(v["t"], r["first"], r["last"])).alias("t")),
        ),
    )

    def with_tail(c: Column) -> Column:
        last, before = F.element_at(c, -1), F.element_at(c, -2)
        short = (F.size(c) > 1) & (last["t"] < min_child)
        both = F.struct(F.concat_ws(" ", before["c"], last["c"]).alias("c"), (before["t"] + last["t"]).alias("t"))
        return F.when(short, F.concat(F.slice(c, 1, F.size(c) - 2), F.array(both))).otherwise(c)

    children = cut.select(*keys, let(drawn, with_tail).alias("__c"))
    packed = with_groups(children, "__g", F.transform("__c", lambda x: x["t"]), parent_max)

    def parent(own: Column, first: Column) -> Column:
        joined = F.array_join(F.transform(own, lambda x: x["c"]), " ")
        return F.struct(first.alias("first"), joined.alias("parent"), total(F.transform(own, lambda x: x["t"])).alias("tokens"), own.alias("own"))

    parents = let(
        F.struct(F.col("__c").alias("c"), F.col("__g").alias("g")),
        lambda v: F.transform(v["g"], lambda r: let(run(v["c"], r["first"], r["last"]), lambda own: parent(own, r["first"]))),
    )
    out = packed.select(*keys, parents.alias("__ps")).select(*keys, F.posexplode_outer("__ps").alias("parent_index", "__p"))
    out = out.select(*keys, "parent_index", "__p.first", "__p.parent", "__p.tokens", F.posexplode_outer("__p.own").alias("__pos", "__x"))
    return out.select(
        *keys,
        "parent_index",
        (F.col("first") + F.col("__pos")).alias("child_index"),
        "parent",
        F.col("tokens").alias("parent_tokens"),
        F.col("__x.c").alias("child"),
        F.col("__x.t").alias("child_tokens"),
    )
