import random

import numpy as np
import pytest

from larkspur.llm import simhash
from larkspur.llm.components import connected_components
from larkspur.llm.queries import op7_simhash
from tests.llm.brute import components, fingerprint, near_components

rng = random.Random(5)


def test_fingerprints():
    for text in ("A b C d é", "one two", "one", "a b c a b c a b c", " \t", "", None, "\x1cx\x85y z", "w " * 5000):
        assert simhash.fingerprint(text, 3) == fingerprint(text, 3)


@pytest.mark.parametrize("group_rows", [20_000, 4])
def test_links_are_complete(spark, group_rows):
    """Also where one band value's group is salted into parts."""
    seeds = [rng.getrandbits(64) for _ in range(20)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for s in seeds for _ in range(6)} | set(seeds)
    fps |= {(5 << 48) | rng.getrandbits(48) for _ in range(40)}
    ids = sorted(fps)
    near = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (a ^ b).bit_count() <= 3]
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in ids], "fp long")
    found = [(r["src"] % 2**64, r["dst"] % 2**64) for r in simhash.links(nodes, 3, group_rows).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in found)
    assert components(ids, found) == components(ids, near)


def test_tiles_are_whole(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 7)
    fps = np.unique(np.array([rng.getrandbits(9) | (rng.getrandbits(6) << 40) for _ in range(200)], dtype=np.uint64))
    ids = fps.tolist()
    near = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (a ^ b).bit_count() <= 1]
    left, right = simhash.linked(fps, 1)
    assert components(ids, list(zip(left.tolist(), right.tolist(), strict=True))) == components(ids, near)


def test_tile_pairs_with_distant_population_counts_are_skipped(monkeypatch):
    """Of a group with population counts from 0 to 48, most tile pairs aren't compared, and no link is lost."""
    fps = np.unique(np.array([sum(1 << b for b in rng.sample(range(48), n % 49)) for n in range(3_000)], dtype=np.uint64))
    compared, plain = [], simhash.tile_links
    monkeypatch.setattr(simhash, "tile_links", lambda a, b, r: compared.append(1) or plain(a, b, r))
    left, right = simhash.linked(fps, 3)
    tiles = -(-len(fps) // simhash.TILE)
    assert len(compared) < tiles * (tiles + 1) / 2 / 2
    ids = fps.tolist()
    near = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(plain(fps, fps, 3), 1)), strict=True)]
    assert components(ids, list(zip(left.tolist(), right.tolist(), strict=True))) == components(ids, near)


def test_long_chains_are_one_component(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100}


def test_odd_input(spark):
    rows = [(9, "a b c d e"), (4, "A B c d e"), (4, "a b c d e"), (11, None), (12, ""), (13, " \n"), (None, "x y z w"), (20, "lone words " * 40_000)]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 8
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(9, 4), (4, 4), (11, 11), (12, 11), (13, 11), (None, None), (20, 20)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    fps, low = near_components(rows)
    assert {tuple(r) for r in op7_simhash(spark, sf_dir).collect()} == {(i, f"{fps[i]:016x}", low[i]) for i, _ in rows}
