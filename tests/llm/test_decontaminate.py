import random

import pytest

from larkspur.llm import decontaminate as dc
from tests.llm.brute import contamination, words

rng = random.Random(2)
word = lambda: rng.choice("ab bc cd Éa 12 x".split())
line = lambda n: ", ".join(word() for _ in range(n))
ITEMS = [(1, line(14)), (2, line(4)), (3, None), (4, "..."), (5, line(30)), (None, line(11)), (10, line(2))]
ITEMS += [(6, ITEMS[0][1]), (1, ITEMS[4][1])]
ROWS = [(i, line(rng.randint(0, 60))) for i in range(40)]
ROWS += [(50, line(9) + " " + ITEMS[0][1].upper().replace("É", "É") + " " + line(9)), (51, None), (52, ""), (53, "?!"), (54, line(300) + " " + ITEMS[4][1]), (54, ITEMS[5][1]), (None, ITEMS[1][1]), (55, "zz " * 100_000 + ITEMS[0][1])]


@pytest.mark.parametrize("block_patterns", [200_000, 3])
def test_against_brute_force(spark, block_patterns):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, n_words int, items string")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    out = dc.find_contamination(docs, items, block_patterns=block_patterns)
    assert sorted(out.columns) == sorted(["doc_id", "text", "n_words", "items", "n_hit", "n_items", "contaminated"])
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], sorted(r["items"]), r["n_items"], r["contaminated"]) for r in out.collect())
    want = contamination([t for _, t in ROWS], ITEMS)
    assert got == sorted((i or -1, n, h, f, len(f), h > 0) for (i, _), (n, h, f) in zip(ROWS, want, strict=True))


def test_search_finds_every_occurrence():
    for _ in range(50):
        patterns = {tuple(rng.choice("abc").encode() for _ in range(5)) for _ in range(6)}
        text = [rng.choice("abcd").encode() for _ in range(200)]
        found = list(dc.Matcher(patterns, 5).search(text))
        assert found == [(i, tuple(text[i : i + 5])) for i in range(196) if tuple(text[i : i + 5]) in patterns]


def test_blocks_hold_no_more_than_they_may(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for most in (1, 3, 1000):
        blocks = list(dc._blocks(items, "item_id", "text", 10, most))
        sizes = [sum(len(dc.windows(w, 10)) for _, w in b) for b in blocks]
        assert max(sizes) <= most and sum(sizes) == sum(len(dc.windows(dc.words_of(t), 10)) for _, t in ITEMS)


def test_words():
    for t in ("A-b_c Éé 1.5", "\x7f\x80x", None, "don't"):
        assert [w.decode() for w in dc.words_of(t)] == words(t)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(ROWS[:3], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    out = dc.find_contamination(docs, items.limit(0)).collect()
    assert [(r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in out] == [(len(words(t)), 0, [], False) for _, t in ROWS[:3]]
    assert dc.find_contamination(docs.limit(0), items).count() == 0


def test_item_ids_that_are_texts(spark):
    docs = spark.createDataFrame([(1, f"zz {ITEMS[0][1]} zz")], "doc_id long, text string")
    items = spark.createDataFrame([("b/7", ITEMS[0][1]), ("a", ITEMS[0][1])], "item_id string, text string")
    for most in (50_000, 3):
        assert sorted(dc.find_contamination(docs, items, block_patterns=most).first()["items"]) == ["a", "b/7"]
