import math
import random

import pytest
from pyspark.sql import functions as F

from larkspur.llm import topk

rng = random.Random(8)
vec = lambda n=6: [rng.choice([0.0, 1.0, -1.0]) * rng.random() for _ in range(n)]
SAME = vec()
ROWS = [(i, vec()) for i in range(150)] + [(200 + i, SAME) for i in range(30)] + [(7, SAME), (300, SAME[:3]), (400, vec(9))]
ODD = [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, SAME), (504, [])]


def brute(rows, k, is_query):
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    out = []
    for q, a in {i: v for i, v in ints if is_query(i)}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ints if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("query_block", [4096, 3])
def test_against_brute_force(spark, query_block):
    rows = spark.createDataFrame([(i, v, 1) for i, v in ROWS + ODD], "vec_id long, embedding array<double>, score int").repartition(4)
    got = topk.top_k(rows, F.col("vec_id") % 10 == 0, query_block=query_block)
    assert sorted(map(tuple, got.collect())) == brute([r for r in ROWS + [ODD[5]]], 10, lambda i: i % 10 == 0)


def test_blocks_of_vectors_keep_the_result():
    """MaxScore prunes from the second shard on."""
    import numpy as np

    ids, vectors = np.array([i for i, _ in ROWS[:150]]), [np.array(v) for _, v in ROWS[:150]]
    q = topk.quantised([vectors[0]], 1024, 6)[:, 0]
    best = (ids[:0], ids[:0])
    for at in range(0, 150, 16):
        best = topk.Shard(ids[at : at + 16], topk.quantised(vectors[at : at + 16], 1024, 6)).search(0, q, 10, best)
    want = [(i, s) for _, _, i, s in brute(ROWS[:150], 10, lambda i: i == 0)]
    assert list(zip(*(x.tolist() for x in best), strict=True)) == want


def test_shards_terms_and_vectors_are_left_out(spark):
    """Of the 500 embeddings of 64 components, in one task: not all postings are traversed, and few vectors stay to the last term."""
    import numpy as np

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    ids, columns = np.array([r["vec_id"] for r in rows]), topk.quantised([np.array(r["embedding"]) for r in rows], 1024, 64)
    shards = topk.shards_of(ids, columns)
    assert [len(s.ids) for s in shards] == [64, 128, 256, 52]
    none = (ids[:0], ids[:0])
    for q in ids[ids % 100 == 0]:
        best = topk.search_shards(shards, q, columns[:, ids == q][:, 0], 10, none)
        scores = columns[:, ids == q][:, 0] @ columns
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != q)[:10]
        assert list(zip((-best[1]).tolist(), best[0].tolist(), strict=True)) == want
    met, did = sum(s.met for s in shards), sum(s.did for s in shards)
    assert did[0] < 0.75 * met[0] and did[1] < 0.6 * met[1], (met, did)


def test_shorter_vectors_are_left_out():
    """Shards of short vectors can't reach the score to beat."""
    import numpy as np

    ids, near = np.arange(2000), np.random.default_rng(1)
    columns = topk.quantised(list(near.normal(size=(2000, 8)) * np.geomspace(1, 1e-4, 2000)[:, None]), 1024, 8)
    shards = topk.shards_of(ids, columns)
    topk.search_shards(shards, -1, columns[:, 0], 10, (ids[:0], ids[:0]))
    assert [s.met.any() for s in shards] != [True] * len(shards)


def test_postings_are_skipped(monkeypatch):
    """Terms with small bounds aren't traversed once there is a score to beat."""
    import numpy as np

    ids = np.arange(400)
    columns = np.array([[rng.choice([0, rng.randint(1, 1000)]) for _ in ids]] + [[rng.choice([0, 0, 0, 1]) for _ in ids] for _ in range(8)])
    query = np.array([50] + [1] * 8)
    read = []

    class Read(list):
        def __getitem__(self, t):
            read.append(t)
            return super().__getitem__(t)

    shard = topk.Shard(ids, columns)
    shard.above, shard.below = Read(shard.above), Read(shard.below)
    best = shard.search(-1, query, 10, (ids[:0], ids[:0]))
    first = len(read)
    again = topk.Shard(ids + 400, columns)
    again.above, again.below = shard.above, shard.below
    best = again.search(-1, query, 10, best)
    assert (first, len(read) - first) == (18, 2)
    scores = sorted(((-int(query @ columns[:, i % 400]), i) for i in range(800)))[:10]
    assert list(zip(best[1].tolist(), best[0].tolist(), strict=True)) == [(-s, i) for s, i in scores]


def test_query_ids_with_two_vectors_and_large_components(spark):
    rows = [(0, [2.0, 1.0]), (0, [1.0, 5.0]), (1, [1.0, 0.0]), (2, [1e9, 0.0]), (3, [65535.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 2, 1024 * 1024 * 10**9), (0, 2, 3, 1024 * 1024 * 65535), (0, 3, 1, 1024 * 1024)]


def test_components_of_any_size(spark):
    """Products beyond 64 bits that cancel, and integers beyond the exact range of doubles."""
    rows = [(0, [1e6, -1e6, 1.0]), (1, [1e12, 1e12, 3.0]), (2, [1e300, 1e300, 1.0]), (3, [1e15, 1e15, -2.0]), (4, [1.5, 0.25, 1e9]), (6, [-1e300, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 0, k=4)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == brute(rows, 4, lambda i: i == 0)
    with pytest.raises(Exception, match="outside a long: the score of query 0 and vector 6"):
        topk.top_k(df, F.col("vec_id") == 0, k=5).collect()


def test_fewer_rows_than_k_and_none(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(rows, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 512)]
    assert topk.top_k(rows.limit(0), F.col("vec_id") == 0).count() == 0
