import math

import numpy as np
import pytest

from larkspur.llm import pivot_index
from tests.llm.brute import components

SHAPE = "vec_id long, embedding array<double>, label int, n_links string"


def rows_of(seed, n, dim=32):
    """Vectors of three labels, one hot, with groups of near and exact copies."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        base, label = rng.normal(size=dim), int(rng.choice([0, 0, 0, 1, 2]))
        for _ in range(int(rng.choice([1, 1, 1, 2, 12]))):
            noise = rng.normal(size=dim) * rng.choice([0, 0.05, 0.12, 0.2]) * 0.9
            out.append((base + noise, label))
    return [(i, v.tolist(), label, "x") for i, (v, label) in enumerate(out[:n])]


def brute(rows, threshold=0.98):
    good = [(i, np.array(v), label) for i, v, label, _ in rows if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    units = [v / np.abs(v).max() for _, v, _ in good]
    units = [u / np.linalg.norm(u) for u in units]
    links = {(a, b) for a in range(len(good)) for b in range(a) if good[a][2] == good[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold}
    return [i for i, *_ in good], links


def told(df):
    return sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect())


def expected(rows, threshold=0.98):
    ids, links = brute(rows, threshold)
    low = components(ids, [(ids[a], ids[b]) for a, b in links])
    count = dict.fromkeys(ids, 0)
    for pair in links:
        for x in pair:
            count[ids[x]] += 1
    return sorted((r[0], count.get(r[0], 0), low.get(r[0], r[0]), low.get(r[0], r[0]) == r[0]) for r in rows)


@pytest.mark.parametrize("part_rows", [None, 16])
def test_against_brute_force(spark, part_rows):
    """Few pivots find all links here; lists are whole or dealt in parts."""
    rows = rows_of(1, 400)
    df = spark.createDataFrame(rows, SHAPE).repartition(4)
    assert told(pivot_index.near_duplicates(df, pivots=16, part_rows=part_rows, passes=3)) == expected(rows)


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs with a cosine just above 0.98 among unrelated vectors of 64 components, all one label."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    away = rng.normal(size=a.shape)
    away -= (away * a).sum(1)[:, None] * a
    away /= np.linalg.norm(away, axis=1)[:, None]
    b = 0.9801 * a + math.sqrt(1 - 0.9801**2) * away
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(np.concatenate([a, b]))]
    got = pivot_index.near_duplicates(spark.createDataFrame(rows, SHAPE).repartition(4)).collect()
    assert all(r["component_id"] in (r["vec_id"], r["vec_id"] % 1500) for r in got)
    assert sum(r["n_links"] for r in got) / 3000 >= 0.98
    nodes = spark.createDataFrame([(i, v, 1, 64, 1) for i, v, _, _ in rows], "node long, v array<double>, label int, dim int, w long")
    verified = pivot_index.node_links(nodes).where("node < 0").agg({"verified": "sum"}).first()[0]
    assert verified < 0.01 * 3000 * 2999 / 2


def test_odd_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [
        (1, None, 1, "x"), (2, [1.0, None], 1, "x"), (3, [math.nan, 1.0], 1, "x"), (4, [math.inf, 1.0], 1, "x"), (5, [0.0, 0.0], 1, "x"), (6, [], 1, "x"),
        (7, same, None, "x"), (8, same, 1, "x"), (9, same, 1, "x"), (10, [2.0, 4.0, 6.0], 1, "x"), (11, [1.0, 2.0], 1, "x"), (12, same, 2, "x"),
        (13, [1e300, 2e300, 3e300], 1, "x"), (14, [1e-310, 2e-310, 3e-310], 1, "x"),
    ]
    assert told(pivot_index.near_duplicates(spark.createDataFrame(rows, SHAPE))) == expected(rows)
    rows = [(None, same, 1, "x"), (3, same, 1, "x"), (3, same, 1, "x"), (None, [1.0, 0.0, 0.0], 1, "x"), (None, None, 1, "x")]
    got = pivot_index.near_duplicates(spark.createDataFrame(rows, SHAPE)).collect()
    key = lambda r: [(x is None, x) for x in r]
    want = [(3, 2, 3, True)] * 2 + [(None, 2, 3, False), (None, 0, None, True), (None, 0, None, True)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert pivot_index.near_duplicates(spark.createDataFrame([], SHAPE)).collect() == []


def test_pivots_are_spread():
    """A group of near copies that makes up most of the sample gives one pivot."""
    rng = np.random.default_rng(1)
    sample = pivot_index.unit(list(np.concatenate([np.ones((90, 16)) + 0.01 * rng.normal(size=(90, 16)), rng.normal(size=(10, 16))])))
    assert len(pivot_index.spread_out(sample, 50, 0.98)) == 11


def test_each_pair_is_verified_once():
    rng = np.random.default_rng(2)
    units = pivot_index.unit(list(rng.normal(size=(60, 8))))
    near = np.sort(pivot_index.nearest_pivots(units, units[:12], 6), axis=1)
    total = 0
    for p in range(12):
        at = np.nonzero((near[:, :4] == p).any(axis=1))[0]
        total += pivot_index.list_links(units[at], near[at], p, 3, 0.98, np.ones(len(at), dtype=np.int64))[2]
    shared = (near[:, None, :, None] == near[None, :, None, :]).sum((2, 3))
    assert total == (np.triu(shared, 1) >= 3).sum()
