"""Mixing sources to target weights by Poisson replication, DataFrame functions only.

A source with ``n`` of all ``N`` rows and target weight ``w`` gets the mean
repetition rate ``w * N / n``, so that the mixed corpus keeps about ``N`` rows.
Each row draws its number of copies by inverting the Poisson distribution with
that mean at a uniform number made from a hash of the seed and the row's id;
copies are exploded and then dealt over all partitions, in hash order inside
each.

A rate above ``PART_RATE`` is the sum of equal parts of at most that rate, each
drawn at a uniform number of its own (the part's number is hashed too): sums of
Poisson variables are Poisson variables.  So a source's table of the
distribution has at most 809 entries, and a row's work is linear in its copies.

Defined results for odd input: weights are divided by their sum; without
weights every source present gets the same share; a source without a weight
gets none and loses its rows; a null source is a source of its own (weight key
``None``); rows with the same id draw the same number of copies; a null id is
hashed as the empty string; a row's text plays no part.  An empty table gives an
empty table.

Rates depend on the number of sources only.  They are broadcast when there are
at most ``max_broadcast_sources`` (a table of 809 doubles each, 6.5 MB at the
default); beyond that they are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 13 hexadecimal digits are 52 bits, which a double holds exactly.
HEX_DIGITS = 13
#: Rates above it are drawn in parts; a part's copies are numbered from its number times PART_COPIES.
PART_RATE, PART_COPIES = 512.0, 1024


def uniform(ident: Column, seed: int, part: Column | None = None) -> Column:
    """A number in [0, 1) that depends on the seed, the id and, from 1, the part's number alone."""
    tail = F.lit("") if part is None else F.when(part > 0, F.concat(F.lit(":"), part.cast("string"))).otherwise(F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")), tail))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(16.0**HEX_DIGITS)


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, far into its upper tail.

    Terms are summed from their logarithms, so large rates don't underflow.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 25).cast("int")
    start = F.struct(
        (-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("cdf")
    )

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.ln(rate) - F.ln(k.cast("double"))
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    folded = F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]
    return F.when(rate > 0, folded).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source") -> DataFrame:
    """One row per source: ``source``, ``n_rows``, ``rate``, its ``parts`` and one part's table ``cdf``."""
    counts = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        weighted = counts.withColumn("weight", F.lit(1.0))
    else:
        total = float(sum(weights.values()))
        if total <= 0 or min(weights.values()) < 0:
            raise ValueError("weights must be at least 0, and one above 0")
        rows = [(k, float(v) / total) for k, v in weights.items()]
        given = docs.sparkSession.createDataFrame(rows, "name string, weight double")
        weighted = counts.join(given, counts["source"].cast("string").eqNullSafe(given["name"]), "left").drop("name")
        weighted = weighted.fillna(0.0, ["weight"])
    sums = weighted.agg(F.sum("n_rows").alias("n"), F.sum("weight").alias("weight")).first()
    all_weight = F.lit(sums["weight"] if weights is None else 1.0)
    rated = weighted.withColumn("rate", F.col("weight") / all_weight * F.lit(sums["n"]).cast("double") / F.col("n_rows"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("int")
    return rated.select("source", "n_rows", "rate", parts.alias("parts"), poisson_cdf(F.col("rate") / parts).alias("cdf"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    source: str = "source",
    max_broadcast_sources: int = 1_000,
) -> DataFrame:
    """Every row of ``docs`` as often as it was drawn, shuffled globally.

    Adds ``copy_no`` (from 0; with gaps where a rate is above ``PART_RATE``), which
    replaces a column of that name.
    """
    rates = source_rates(docs, weights, source).select(F.col("source").alias("__mix_source"), F.col("parts").alias("__mix_parts"), F.col("cdf").alias("__mix_cdf"))
    n_sources = docs.select(F.approx_count_distinct(F.col(f"`{source}`"), 0.02)).first()[0]
    side = F.broadcast(rates) if n_sources <= max_broadcast_sources else rates
    drawn = docs.join(side, F.col(f"`{source}`").eqNullSafe(F.col("__mix_source")), "left").where(F.size("__mix_cdf") > 1)
    drawn = drawn.withColumn("__mix_part", F.explode(F.sequence(F.lit(0), F.col("__mix_parts") - 1)))
    drawn = drawn.withColumn("__mix_u", uniform(F.col(f"`{id_col}`"), seed, F.col("__mix_part")))
    copies = F.size(F.filter("__mix_cdf", lambda c: c <= F.col("__mix_u")))
    drawn = drawn.withColumn("__mix_n", F.least(copies, F.size("__mix_cdf") - 1)).where(F.col("__mix_n") > 0)
    first = F.col("__mix_part") * PART_COPIES
    out = drawn.withColumn("copy_no", F.explode(F.sequence(first, first + F.col("__mix_n") - 1)))
    out = out.drop("__mix_source", "__mix_parts", "__mix_cdf", "__mix_part", "__mix_u", "__mix_n")
    place = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col("copy_no"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.withColumn("__mix_place", place).repartition(n, "__mix_place").sortWithinPartitions("__mix_place").drop("__mix_place")
