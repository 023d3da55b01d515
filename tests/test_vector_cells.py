"""Cells against a scan of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import retrieval
from larkspur.operators.vector_cells import VectorCells


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    made = [(i, (centres[i % 12] + 0.5 * rng.normal(size=16)).tolist()) for i in range(1500)]
    return spark.createDataFrame(made, "chunk_id long, embedding array<double>").repartition(4).cache()


@pytest.fixture(scope="module")
def cells(spark, rows, tmp_path_factory):
    made = VectorCells(spark, f"file://{tmp_path_factory.mktemp('cells')}/c", cells=16)
    made.build(rows.where("chunk_id < 1200"))
    made.add(rows.where("chunk_id >= 1200").unionByName(rows.sparkSession.createDataFrame([(-1, [0.0] * 16), (-2, None)], "chunk_id long, embedding array<double>")))
    return made


def hits(df):
    return [(r["chunk_id"], round(r["score"], 9)) for r in df.collect()]


def queries(rows):
    return [r["embedding"] for r in rows.where("chunk_id % 301 = 5").orderBy("chunk_id").collect()]


def test_exact_search_reads_fewer_cells(rows, cells):
    for q in queries(rows):
        assert hits(cells.search(q, 50)) == hits(retrieval.vector_search(rows, q, 50))
    assert min(len(cells.needed(q, 10)) for q in queries(rows)) < 16


def test_recall_of_probes_as_measured(rows, cells):
    asked = queries(rows)
    probes, recall = cells.probes_for(asked, 50, 0.95)
    found = [{i for i, _ in hits(cells.search(q, 50, probes))} for q in asked]
    true = [{i for i, _ in hits(retrieval.vector_search(rows, q, 50))} for q in asked]
    assert np.mean([len(f & t) / 50 for f, t in zip(found, true, strict=True)]) == pytest.approx(recall) and recall >= 0.95 and probes < 8


def test_bytes_fall_with_probes(rows, cells):
    q = queries(rows)[0]
    sizes = [cells.bytes_of(q, p) for p in (1, 4, 16)]
    assert sizes[0] < sizes[1] < sizes[2] and sizes[0] < sizes[2] / 4


def test_every_usable_vector_is_in_one_cell(rows, cells):
    table = cells.store.read("vectors")
    assert table.count() == table.select("chunk_id").distinct().count() == 1500
    assert table.where("chunk_id < 0").count() == 0
    assert table.where(F.col("cell") == 0).select("cell").distinct().count() <= 1


def test_recall_on_the_embeddings(spark, tmp_path):
    """Unclustered vectors: most cells have to be probed for the wanted recall, and exact search still is exact."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    made = VectorCells(spark, f"file://{tmp_path}/e", cells=8)
    made.build(table)
    asked = [r["embedding"] for r in table.where("chunk_id in (0, 100)").collect()]
    probes, recall = made.probes_for(asked, 50, 0.95)
    assert recall >= 0.95 and probes <= 8
    assert hits(made.search(asked[0], 50)) == hits(retrieval.vector_search(table, asked[0], 50))


def test_fewer_vectors_than_cells(spark, tmp_path):
    made = VectorCells(spark, f"file://{tmp_path}/f", cells=8)
    made.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 1.0])], "chunk_id long, embedding array<double>"))
    assert [i for i, _ in hits(made.search([0.0, 1.0], 2))] == [2, 3] and [i for i, _ in hits(made.search([0.0, 1.0], 9))] == [2, 3, 1]
