"""Markdown sections: line rows, fence parity, headings, breadcrumbs, small sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import count_tokens

HEADING = r"^(#{1,6})\s+(.+)$"


def sections(files: DataFrame, file: str = "file_id", content: str = "content") -> DataFrame:
    """``file, section_no, h1, h2, text``: text up to the next first- or second-level heading.

    Lines inside closed code fences are never headings; an unclosed fence protects nothing.
    """
    lines = files.select(F.col(file), F.posexplode(F.split(content, "\n")).alias("pos", "line"))
    whole, order = Window.partitionBy(file), Window.partitionBy(file).orderBy("pos")
    fence = F.when(F.col("line").startswith("```"), 1).otherwise(0)
    before = F.coalesce(F.sum(fence).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.withColumns({"__before": before, "__all": F.sum(fence).over(whole)})
    inside = (F.col("__before") % 2 == 1) & (F.col("__before") < F.col("__all") - F.col("__all") % 2)
    level = F.when(~inside, F.length(F.regexp_extract("line", HEADING, 1))).otherwise(0)
    title = F.trim(F.regexp_extract("line", HEADING, 2))
    marked = marked.withColumns({"__level": level, "__title": title})
    opens = F.when(F.col("__level").isin(1, 2), 1).otherwise(0)
    marked = marked.withColumn("section_no", F.sum(opens).over(order))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("h1", F.last(F.when(F.col("__level") == 1, F.col("__title")), ignorenulls=True).over(running))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    second = F.max(F.when(F.col("__level") == 2, F.col("__title")))
    return marked.groupBy(file, "section_no").agg(F.max("h1").alias("h1"), second.alias("h2"), text.alias("text"))


def join_small_sections(found: DataFrame, file: str = "file_id", min_tokens: int = 100) -> DataFrame:
    """Sections under ``min_tokens`` go before the next big one, which keeps its headings.

    Small sections at the end are joined under the first one's headings.
    """
    order = Window.partitionBy(file).orderBy("section_no")
    big = found.withColumn("__big", F.when(count_tokens(F.col("text")) >= min_tokens, 1).otherwise(0))
    before = F.coalesce(F.sum("__big").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = big.withColumn("group_no", before)
    parts = F.array_sort(F.collect_list(F.struct("section_no", "text")))
    own = F.struct(F.col("__big"), (-F.col("section_no")).alias("o"), F.col("h1"), F.col("h2"))
    out = grouped.groupBy(file, "group_no").agg(
        F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"),
        F.max(own).alias("__own"),
        F.count(F.lit(1)).alias("n_sections"),
    )
    return out.select(file, "group_no", "n_sections", F.col("__own.h1").alias("h1"), F.col("__own.h2").alias("h2"), "text", (F.col("__own.__big") == 0).alias("is_tiny"))
