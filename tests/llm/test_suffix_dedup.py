import random

import numpy as np
import pytest

from larkspur.llm import suffix_dedup as sd
from larkspur.llm.queries import op5_suffix_dedup
from tests.llm.brute import repeats_removed, sha256

rng = random.Random(3)
word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9)))
prose = lambda n: " ".join(word() for _ in range(n))
SHARED = [prose(25) for _ in range(4)]


def fixture():
    rows = [(i, prose(15) + rng.choice(SHARED)[rng.randint(0, 20) :] + prose(15)) for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(5)] + [(5, rows[5][1])]
    rows += [(200, None), (201, ""), (202, "a" * 500), (203, "ab" * 300), (None, prose(10) + SHARED[0]), (204, "b" * 39), (205, prose(3) + SHARED[1] + prose(3) + SHARED[1])]
    return rows


@pytest.mark.parametrize("group_bytes", [1 << 20, 300, 0])
def test_against_brute_force(spark, group_bytes):
    """Also where anchors count as large and are divided, down to single strings."""
    rows = fixture()
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, anchor int, content binary")
    out = sd.remove_repeats(docs, length=48, group_bytes=group_bytes)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in out.collect())
    assert got == sorted((i or -1, len((t or "").encode()), *w) for (i, t), w in zip(rows, repeats_removed([t for _, t in rows], 48), strict=True))


def test_near_copies_of_one_passage_make_rows_in_proportion(spark, monkeypatch):
    """One anchor with thousands of different segments: edits and surroundings differ, the passage doesn't."""
    passage = prose(60)
    rows, letters = [], "abcdefghijklmnopqrstuvwxyz"
    for i in range(2_400):
        at = rng.randrange(len(passage))
        edited = passage[:at] + rng.choice(letters) + passage[at + 1 :] if i % 2 else passage
        rows.append((i, "".join(rng.choice(letters) for _ in range(60)) + edited + "".join(rng.choice(letters) for _ in range(60))))
    made = []
    plain = sd.pieces_of

    def counted(parts, width, length):
        out = plain(parts, width, length)
        made.append((parts.count(), out.count()))
        return out

    monkeypatch.setattr(sd, "pieces_of", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in sd.remove_repeats(docs, length=100, group_bytes=20_000).collect()}
    assert got == dict(zip([i for i, _ in rows], repeats_removed([t for _, t in rows], 100), strict=True))
    assert made and all(n <= 6 * parts for parts, n in made)
    first = made[0][0]
    assert all(parts <= 1.2 * first for parts, _ in made), made


def test_suffixes_are_sorted_and_repeats_found():
    for _ in range(40):
        segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(12, 60))) for _ in range(rng.randint(1, 6))]
        starts = [s[i : i + 12] for s in segments for i in range(len(s) - 11)]
        want = [starts.count(s) > 1 for s in starts]
        assert sd.repeated_starts(segments, 12).tolist() == want


def test_types_of_suffixes():
    text = b"mississippi" + sd.PAD
    small = sd.smaller_than_successor(np.frombuffer(text, dtype=np.uint8))
    assert small[:11].tolist() == [text[i:] < text[i + 1 :] for i in range(11)]


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in op5_suffix_dedup(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    want = repeats_removed([t for _, t in rows], 200)
    assert got == {(i, len((t or "").encode()), n, runs, sha256(kept)) for (i, t), (kept, n, runs) in zip(rows, want, strict=True)}
    assert sum(r[2] for r in got) > 0
