"""Text expressions: all return Columns and stay in generated code or built-in lambdas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word run or one other visible character is a token; a stand-in for a BPE count.
TOKEN = "[A-Za-z0-9]+|[^A-Za-z0-9 \\t\\r\\n]"
TERM = "[a-z0-9]+"
# Patterns of an id, of where sentences end, of the rule line of a table, of list marks
# before a question, and of front matter.
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"
TABLE_RULE = r"^\|[ \t\-:|]+\|$"
LIST_MARK = r"^[0-9.\-) ]+"
FRONT_MATTER = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)"


def sentences(text: Column) -> Column:
    """Split where white space follows ``. ! ?`` and precedes A-Z; blanks dropped."""
    parts = F.transform(F.split(text, SENTENCE_END), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def count_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)))


def truncate_to_tokens(text: Column, n: int) -> Column:
    """The first ``n`` tokens with the blanks between them; unchanged if not longer."""
    lossless = F.regexp_extract_all(text, F.lit(f"({TOKEN})[ \\t\\r\\n]*"), F.lit(0))
    lead = F.regexp_extract(text, "^[ \\t\\r\\n]*", 0)
    cut = F.rtrim(F.concat(lead, F.array_join(F.slice(lossless, 1, n), "")))
    return F.when(count_tokens(text) <= n, text).otherwise(cut)


def terms(text: Column) -> Column:
    """Lower-case ASCII words and numbers, the terms of full-text search."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\r\\n]+"), lambda w: w != ""))


def normalise_paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, trimmed, empty ones dropped, joined again."""
    parts = F.transform(F.split(text, "\n\n"), lambda p: F.btrim(p, F.lit(" \t\r\n")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def is_table(text: Column) -> Column:
    """At least 3 lines with 2 pipes, and a rule line."""
    lines = F.transform(F.split(F.btrim(text, F.lit(" \t\r\n")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    piped = F.filter(lines, lambda x: (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2) & ~x.startswith("`"))
    return (F.size(piped) >= 3) & F.exists(lines, lambda x: x.rlike(TABLE_RULE))


def clean_questions(text: Column) -> Column:
    """One question per line, list marks stripped, those of 5 characters or fewer dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.trim(x), LIST_MARK, ""))
    return F.filter(lines, lambda x: F.length(x) > 5)


def front_matter(text: Column) -> Column:
    """Map of the ``key: value`` lines between leading ``---`` lines, the last of a key; empty without them."""
    block = F.regexp_extract(text, FRONT_MATTER, 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.instr(x, ":") > 0)
    entries = F.transform(
        lines,
        lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v")),
    )
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def context_prefix(kind: Column, filename: Column, a: Column, b: Column, crumbs: Column) -> Column:
    """What a chunk's prefix says about its place; null parts are left out.

    ``a, b`` are class and function, key path, sheet and columns, or section and
    cell number, by content type; ``crumbs`` are headings.
    """

    def parts(first: str, *rest: tuple[str, Column]) -> Column:
        return F.concat_ws(" | ", F.concat(F.lit(first), filename), *[F.concat(F.lit(n), c.cast("string")) for n, c in rest])

    trail = F.when(F.size(crumbs) > 0, F.array_join(crumbs, " > "))
    return (
        F.when(kind == "code", parts("File: ", ("Class: ", a), ("Function: ", b)))
        .when(kind.isin("json", "yaml"), parts("File: ", ("Path: ", a)))
        .when(kind.isin("csv", "xlsx"), parts("File: ", ("Sheet: ", a), ("Columns: ", b)))
        .when(kind == "notebook", parts("Notebook: ", ("Section: ", a), ("Cell: ", b)))
        .when(kind.isin("pdf", "markdown"), F.concat_ws(" | ", parts("File: "), trail))
        .otherwise(parts("File: "))
    )


def embedding_text(prefix: Column, content: Column) -> Column:
    return F.when(F.coalesce(prefix, F.lit("")) != "", F.concat_ws("\n", prefix, content)).otherwise(content)


def article_text(title: Column, content: Column) -> Column:
    """What an article's vector is made of."""
    return F.concat_ws("\n\n", title, content)


def merged_metadata(front: Column, given: Column) -> Column:
    """One map of both; the given values win."""
    kept = F.map_filter(front, lambda k, v: ~F.coalesce(F.map_contains_key(given, k), F.lit(False)))
    return F.map_concat(kept, given)


def document_outline(text: Column, n: int = 2) -> Column:
    """Local summary: ``document_summary`` of the first sentences, and ``section_summaries`` of first- and second-level headings."""
    body = F.coalesce(text, F.lit(""))
    first = lambda t, k: F.array_join(F.slice(sentences(t), 1, k), " ")
    parts = F.slice(F.split(F.concat(F.lit("\n"), body), "\n#{1,2} +"), 2, 1_000_000)
    section = lambda p: F.struct(F.trim(F.substring_index(p, "\n", 1)).alias("heading"), first(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2), 1).alias("summary"))
    return F.struct(first(F.regexp_replace(body, "(?m)^#+ +", ""), n).alias("document_summary"), F.transform(parts, section).alias("section_summaries"))


def section_digest(sections: Column, separator: str = " | ") -> Column:
    """``heading: summary`` of an array of such structs."""
    return F.array_join(F.transform(sections, lambda s: F.concat(s["heading"], F.lit(": "), s["summary"])), separator)


def key_prefix(token: Column, marker: str, n: int = 8) -> Column:
    """The ``n`` characters after a fixed beginning, else null."""
    return F.when(token.startswith(marker), F.substring(token, len(marker) + 1, n))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))
