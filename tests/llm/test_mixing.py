import time
from collections import Counter

import pytest

from larkspur.llm import mixing
from tests.llm.brute import poisson_copies

ROWS = [(i, "big", "t") for i in range(300)] + [(300 + i, "small", None) for i in range(20)] + [(400, None, ""), (401, None, "x" * 100_000), (402, "big", "t"), (402, "big", "t"), (None, "small", "t")]


def frame(spark):
    return spark.createDataFrame([(*r, 7, 1) for r in ROWS], "doc_id long, source string, text string, copy_no int, rate int")


def expected(shares):
    n = Counter(s for _, s, _ in ROWS)
    out = Counter()
    for i, s, _ in ROWS:
        rate = shares.get(s, 0) * len(ROWS) / n[s]
        for c in range(poisson_copies(i, rate, 17) if rate else 0):
            out[i, s, c] += 1
    return out


@pytest.mark.parametrize("limit", [10_000, 1])
def test_same_share_for_every_source(spark, limit):
    out = mixing.mix_sources(frame(spark), max_broadcast_sources=limit)
    assert sorted(out.columns) == ["copy_no", "doc_id", "rate", "source", "text"]
    assert Counter((r["doc_id"], r["source"], r["copy_no"]) for r in out.collect()) == expected({s: 1 / 3 for s in ("big", "small", None)})


def test_given_weights(spark):
    got = mixing.mix_sources(frame(spark), weights={"big": 1.0, None: 3.0})
    assert Counter((r["doc_id"], r["source"], r["copy_no"]) for r in got.collect()) == expected({"big": 0.25, None: 0.75})
    for bad in ({"big": 0.0}, {"big": -1.0, None: 2.0}):
        with pytest.raises(ValueError):
            mixing.mix_sources(frame(spark), weights=bad)


def test_large_rates_follow_the_distribution(spark):
    rows = spark.createDataFrame([(i, "a" if i < 200 else "b") for i in range(40_000)], "doc_id long, source string")
    n = Counter(r["source"] for r in mixing.mix_sources(rows).collect())
    assert abs(n["a"] / 20_000 - 1) < 0.03 and abs(n["b"] / 20_000 - 1) < 0.03


def test_high_rates_are_drawn_in_parts(spark):
    """Ten rows of one source stand against 100,000 others: each is drawn thousands of times, in linear time."""
    rows = spark.range(100_000).selectExpr("id AS doc_id", "IF(id < 10, 'rare', 'usual') AS source")
    began = time.time()
    got = mixing.mix_sources(rows, weights={"rare": 0.9, "usual": 0.1}).where("source = 'rare'").groupBy("doc_id").agg({"*": "count", "copy_no": "max"}).collect()
    assert time.time() - began < 60
    rate, parts = 9_000.0, 18
    assert {r["doc_id"]: r["count(1)"] for r in got} == {i: sum(poisson_copies(i, rate / parts, 17, p) for p in range(parts)) for i in range(10)}
    assert all(abs(r["count(1)"] / rate - 1) < 0.05 for r in got)


def test_a_rate_of_a_million_takes_seconds(spark):
    rows = spark.range(2_000_000).selectExpr("id AS doc_id", "IF(id = 7, 'rare', 'usual') AS source")
    began = time.time()
    n = mixing.mix_sources(rows, weights={"rare": 0.5, "usual": 0.5}).where("source = 'rare'").count()
    assert time.time() - began < 120
    assert abs(n / 1_000_000 - 1) < 0.01


def test_empty_table(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, source string")).count() == 0
