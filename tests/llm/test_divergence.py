import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from larkspur.llm import divergence

SHAPE = "doc_id long, lang string, source string, text string, value long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, top=200):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    df, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in rows:
        df[lang].update(set(words))
        counts[lang, source].update(words)
        sources[lang].add(source)
    out = []
    for lang, here in sources.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        whole = shares(sum((counts[lang, s] for s in here), Counter()))
        p = {s: shares(counts[lang, s]) for s in here}
        f = lambda a, b: (a - b) ** 2 // b
        for s in here:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in here - {s}]
            terms = [(-f(p[s][t], whole[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def some_rows(seed, sources, n):
    rng = random.Random(seed)
    words = [a + b for a in "abcdefÉüß字" for b in ["", "x", "Yz", "é", "𝄞"]]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "1", "_", "\n", "\x7f"]) for _ in range(rng.randint(0, 40)))
    rows = [(rng.choice(["en", "de", None, ""]), f"s{int(sources * rng.random() ** 2)}", text()) for _ in range(n)]
    rows += [("en", "s0", "hot term")] * 50 + [("xx", "alone", "a b c"), ("xx", None, None), ("yy", "quiet", ""), ("en", "quiet", "1 2 3")]
    return rows


@pytest.mark.parametrize("sources,buckets,groups", [(3, 8192, 4), (9, 7, 1), (12, 16, 2)])
def test_against_brute_force(spark, sources, buckets, groups):
    rows = some_rows(sources, sources, 150)
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], SHAPE).repartition(5)
    got = divergence.audit(docs, top=9, bucket_terms=buckets, block_groups=groups)
    assert sorted(map(tuple, got.collect())) == brute(rows, top=9)


def test_every_pair_of_blocks_meets_once(spark):
    for blocks in range(1, 12):
        turns = blocks - 1 + blocks % 2
        df = spark.range(blocks).selectExpr("id", f"{blocks}L AS blocks")
        met = [
            (r["id"], r["other"])
            for t in range(turns)
            for r in df.select("id", divergence.opponent(df["id"], df["blocks"], t).alias("other")).collect()
            if r["other"] < blocks
        ]
        assert sorted(met) == sorted((a, b) for a in range(blocks) for b in range(blocks) if a != b)


def test_residents_are_not_shuffled_again(spark):
    """In a round, only the blocks that travel pass an exchange."""
    rows = some_rows(1, 9, 100)
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], SHAPE)
    tables = divergence.Audit(docs, 3, 16, 1)
    plan = divergence.one_round(tables.resident(), tables.blocks, 0)._jdf.queryExecution().executedPlan().toString()
    before = plan.split("InMemoryRelation")[0]
    assert before.count("InMemoryTableScan") == 1 and before.count("Exchange") <= 1


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(200):
        total = rng.randint(1, 8 * 10**15)
        counts = [rng.randint(0, total - 1) for _ in range(20)] + [0, total - 1]
        assert divergence.share(np.array(counts), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "LONG", 16)
    text = ("Ab cdé1x " * 50).encode()
    assert [w for part in divergence.terms(text) for w in part] == ["ab".encode(), "cdé".encode(), b"x"] * 50


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SHAPE)).collect() == []
