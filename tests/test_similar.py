"""Similar pairs against all pairs."""

import random

import numpy as np
import pytest

from larkspur.operators import similar


def rows_of(seed, n=120, dims=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [0.0] * dims
        for _ in range(rng.randint(0, 9)):
            v[min(dims - 1, int(dims * rng.random() ** 2))] += 1.0
        if i % 5 == 4:
            v = list(out[-1][2])
            v[rng.randrange(dims)] += 1.0
        out.append((i, rng.choice("ab"), v))
    return out


@pytest.mark.parametrize("threshold", [0.55, 0.81, 0.97])
def test_against_all_pairs(spark, threshold):
    rows = rows_of(3)
    want = {}
    for i, g, v in rows:
        for j, h, w in rows:
            a, b = np.array(v), np.array(w)
            if i < j and g == h and a.any() and b.any() and (s := a @ b / np.linalg.norm(a) / np.linalg.norm(b)) >= threshold:
                want[g, i, j] = round(s, 9)
    df = spark.createDataFrame(rows + [(900, "a", None), (901, "a", [0.0] * 40)], "article_id long, kb_id string, embedding array<double>")
    got = similar.similar_pairs(df, threshold).collect()
    assert {(r["kb_id"], r["left"], r["right"]): round(r["similarity"], 9) for r in got} == want and len(got) == len(want)


def test_few_pairs_meet(spark):
    """Candidates are far fewer than pairs."""
    df = spark.createDataFrame(rows_of(4, 300, 200), "article_id long, kb_id string, embedding array<double>")
    p = similar.postings(df, 0.9, "article_id", "kb_id", "embedding").select("g", "dim", "id")
    met = p.join(p.withColumnRenamed("id", "other"), ["g", "dim"]).where("id < other").distinct().count()
    assert met < 0.15 * 300 * 299 / 4


def test_connections_with_kinds(spark):
    rows = [("k", "a", [1.0, 0.0]), ("k", "b", [1.0, 0.1]), ("k", "c", [0.0, 1.0]), ("l", "d", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "kb_id string, title string, embedding array<double>")
    from pyspark.sql import functions as F

    got = similar.connections_by_text(df, 0.9, lambda s: F.when(s > 0.99, "extends").otherwise("related")).collect()
    assert [tuple(r) for r in got] == [("k", "a", "b", "extends")]
