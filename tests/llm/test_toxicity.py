import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import toxicity
from larkspur.llm.queries import op1_toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_rows_are_told_apart(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op1_toxicity(spark, SF).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    bad, good = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert len(bad) > 3 and len(good) > 50
    above = sum((b["score"] > g["score"]) + 0.5 * (b["score"] == g["score"]) for b in bad for g in good)
    assert above / (len(bad) * len(good)) >= 0.9
    assert sum(r["predicted"] for r in bad) >= 0.8 * len(bad)
    assert sum(r["predicted"] for r in good) <= 0.01 * len(good)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs = spark.createDataFrame([(i, "you are an idiot and a moron " * 3 if i % 4 == 0 else f"a calm line number {i} on rivers") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.in_training(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (toxicity.score(docs, toxicity.fit(docs, x)).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b
    assert all((r["toxicity"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in a)


def test_scores_equal_the_plain_version(spark, sf_dir):
    """Written marks, joint scoring, and scoring of new rows all give the plain score of each text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = toxicity.read_labels(spark, f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    want = {r["doc_id"]: model.score(r["text"]) for r in docs.collect()}
    for got in (toxicity.fit_and_score(docs, labels, keep=["doc_id"]), toxicity.score(docs, model)):
        found = {r["doc_id"]: r["toxicity"] for r in got.collect()}
        assert found.keys() == want.keys()
        assert max(abs(found[i] - want[i]) for i in want) < 1e-9


def test_odd_input(spark):
    rows = [(1, "You idiot, you moron", 5), (1, "You idiot, you moron", 5), (2, None, 5), (3, "", 5), (None, "fine", None), (4, "word " * 100_000 + "idiot", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd_labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0), (3, 7)], "doc_id long, toxic int")
    for labels in (none, odd_labels):
        out = toxicity.score(docs, toxicity.fit(docs, labels))
        got = out.collect()
        assert out.columns == ["doc_id", "text", "toxicity"] and len(got) == 6
        assert all(0 <= r["toxicity"] <= 1 for r in got)
        by = {}
        for r in got:
            by.setdefault(r["doc_id"], set()).add(r["toxicity"])
        assert len(by[1]) == 1 and by[2] == by[3]
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


def plain_posteriors(patterns, counts, start, parents, rounds):
    """Expectation and maximisation, pattern by pattern and voter by voter."""
    share = list(start)
    bit = lambda p, v: p >> v & 1
    for _ in range(rounds):
        new = []
        tables = []
        for y in (0, 1):
            weight = [c * (s if y else 1 - s) for c, s in zip(counts, share, strict=True)]
            fire = {}
            for v, parent in enumerate(parents):
                for case in (0, 1) if parent >= 0 else (None,):
                    rows = [i for i, p in enumerate(patterns) if case is None or bit(p, parent) == case]
                    fire[v, case] = (sum(weight[i] for i in rows if bit(patterns[i], v)) + 0.5) / (sum(weight[i] for i in rows) + 1)
            tables.append(((sum(weight) + 1) / (sum(counts) + 2), fire))
        for p in patterns:
            odds = []
            for prior, fire in tables:
                chance = math.log(prior)
                for v, parent in enumerate(parents):
                    f = fire[v, bit(p, parent) if parent >= 0 else None]
                    chance += math.log(f if bit(p, v) else 1 - f)
                odds.append(chance)
            new.append(1 / (1 + math.exp(min(50, max(-50, odds[0] - odds[1])))))
        share = new
    return share


def some_patterns(seed):
    rng = random.Random(seed)
    patterns = sorted({sum((rng.random() < (0.7 if toxic else 0.1)) << v for v in range(toxicity.VOTERS)) for toxic in (0, 1) for _ in range(15)})
    return patterns, [rng.randint(1, 30) for _ in patterns], [rng.random() for _ in patterns]


def test_label_model_against_plain_sums():
    for seed in range(3):
        patterns, counts, start = some_patterns(seed)
        model = toxicity.LabelModel(np.array(patterns), np.array(counts), np.array(start), rounds=4)
        first = plain_posteriors(patterns, counts, start, [-1] * toxicity.VOTERS, 4)
        want = plain_posteriors(patterns, counts, first, model.parent.tolist(), 4)
        assert np.allclose(model.posterior, want, atol=1e-9)


def test_tree_is_a_maximum_spanning_tree():
    patterns, counts, start = some_patterns(5)
    model = toxicity.LabelModel(np.array(patterns), np.array(counts), np.array(start), rounds=3)
    posterior = plain_posteriors(patterns, counts, start, [-1] * toxicity.VOTERS, 3)
    gain = {}
    for a in range(toxicity.VOTERS):
        for b in range(a):
            gain[a, b] = 0.0
            for y in (0, 1):
                weight = [c * (s if y else 1 - s) for c, s in zip(counts, posterior, strict=True)]
                cell = {(i, j): 1 + sum(w for w, p in zip(weight, patterns, strict=True) if (p >> a & 1, p >> b & 1) == (i, j)) for i in (0, 1) for j in (0, 1)}
                total = sum(cell.values())
                for (i, j), n in cell.items():
                    gain[a, b] += n * math.log(n * total / ((cell[i, 0] + cell[i, 1]) * (cell[0, j] + cell[1, j])))
    group, best = list(range(toxicity.VOTERS)), 0.0
    for (a, b), g in sorted(gain.items(), key=lambda x: -x[1]):
        if group[a] != group[b]:
            best += g
            group = [group[a] if x == group[b] else x for x in group]
    found = [(max(v, p), min(v, p)) for v, p in enumerate(model._tree(np.array(posterior)).tolist()) if p >= 0]
    assert len(found) == toxicity.VOTERS - 1 and sum(gain[e] for e in found) == pytest.approx(best)


def test_regression_is_where_its_gradient_vanishes():
    rng = random.Random(7)
    rows = [toxicity.Features(sorted(rng.sample(range(6), rng.randint(0, 3))), [rng.random() for _ in range(5)], 0) for _ in range(200)]
    target = np.array([rng.random() for _ in rows])
    weights = toxicity._logistic(rows, target, 6, rounds=4000, l2=0.5)
    matrix = np.zeros((200, 12))
    for i, r in enumerate(rows):
        matrix[i, r.terms] = 1
        matrix[i, 6:11] = r.numbers
        matrix[i, 11] = 1
    gradient = matrix.T @ (1 / (1 + np.exp(-matrix @ weights)) - target) / 200 + np.append(0.05 * weights[:-1], 0)
    assert np.abs(gradient).max() < 2e-3


def test_features_against_plain_rules():
    lexicon = toxicity.Lexicon([("idiot", 5.0), ("moro*", 4.0), ("zzzz", 3.0)])
    text = "You idiot and morons; an idiot. " + "calm words of rivers " * 20
    got = lexicon.features(text)
    words = re.findall(r"[a-z]+", text.lower())
    marked = [w for w in words if w == "idiot" or w.startswith("moro") or w in toxicity.SEED_LEXICON]
    assert got.terms == [0, 1]
    assert got.numbers[:3] == pytest.approx([math.log1p(len(marked)), math.log1p(len(set(marked))), min(1.0, 20 * len(marked) / len(words))])
    assert got.numbers[4] == 1.0 and got.pattern >> lexicon.voter(0) & 1 and got.pattern >> lexicon.voter(1) & 1
    assert lexicon.features("calm rivers") == toxicity.Features([], [0.0] * 5, 0) == lexicon.features(None)
