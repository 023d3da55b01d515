"""Corpus-wide line deduplication with DataFrame functions only.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at either end and with
A-Z lower-cased.  Keys found in at least ``min_docs`` documents lose all their
lines, in every document.

Lines are hashed once; a document's hashes are written without its text.  They
are exploded, each document's different ones, and counted; exploded again with
their positions, and met with the keys to drop.  The positions go back to the
document, which is put together from the lines at all others.

Defined results for odd input: a null or empty text is one empty line; a key
shorter than ``min_chars`` code points is never dropped; each row counts as one
document, so a repeated row counts again; a line repeated inside one document
counts once; an empty table gives an empty table.  Other columns pass through
untouched, whatever their names.

The count shuffles one 16-byte key per line and document, after partial
aggregation; adaptive execution may split the join where one line is in a large
share of all documents.  Line texts themselves move once, when a document meets
its positions.  All steps take time linear in a document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.workspace import ascii_lower, key128, written

#: The white space that is stripped from both ends of a line.
BLANKS = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 1) -> DataFrame:
    """``id, body, keys``: a key of the text, and the MD5 of each line's key (null if too short), by position."""

    def hashed(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= min_chars, F.md5(key))

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), key128(body).alias("body"), F.transform(_lines(text), hashed).alias("keys"))


def frequent_keys(hashed: DataFrame, min_docs: int = 10) -> DataFrame:
    """The keys ``k`` found in at least ``min_docs`` rows of ``hashed``."""
    each = hashed.select(F.explode(F.array_distinct("keys")).alias("k")).where("k IS NOT NULL")
    counted = each.select(F.unhex("k").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_docs).select("k")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with frequent lines removed from ``text``.

    Returns every row with all its columns, ``text`` rewritten, and the columns
    ``n_lines`` and ``n_dropped`` (they replace columns of these names).
    """
    hashed = written(hashed_lines(docs, id_col, text, min_chars), "line-keys")
    frequent = written(frequent_keys(hashed, min_docs), "frequent-lines")
    placed = hashed.select("id", "body", F.posexplode("keys").alias("pos", "k")).where("k IS NOT NULL").withColumn("k", F.unhex("k"))
    # Rows with one id and one text have the same positions, which are collected once.
    drops = placed.join(frequent, "k", "left_semi").groupBy(F.col("id").alias("__ld_id"), F.col("body").alias("__ld_body")).agg(F.collect_set("pos").alias("__ld_drop"))

    split = docs.withColumns({"__ld_lines": _lines(text), "__ld_key": key128(F.coalesce(F.col(f"`{text}`"), F.lit("")))}).drop(text)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__ld_id")) & (F.col("__ld_key") == F.col("__ld_body"))
    joined = split.join(drops, same, "left")
    every = F.sequence(F.lit(0), F.size("__ld_lines") - 1)
    kept = F.transform(F.array_except(every, F.col("__ld_drop")), lambda i: F.get("__ld_lines", i))
    out = joined.withColumns({
        "n_lines": F.size("__ld_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("__ld_drop"), F.lit(0)).cast("long"),
        text: F.array_join(F.when(F.col("__ld_drop").isNull(), F.col("__ld_lines")).otherwise(kept), "\n"),
    })
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[f"`{c}`" for c in order], "n_lines", "n_dropped")
