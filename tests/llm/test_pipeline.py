import corpus_pipeline as cp
from larkspur.llm import toxicity
from tests.llm.brute import contamination, lines_kept, near_components, poisson_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def saved(spark, tmp_path, rows, items=(), labels=()):
    spark.createDataFrame(list(rows), SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stages_against_brute_force(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    model = toxicity.fit(docs.select("doc_id", "text"), toxicity.read_labels(spark, f"{sf_dir}/labels.parquet"))
    kept = cp.drop_toxic(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in rows if model.score(t) < cp.REJECT_AT}
    out = cp.drop_lines(spark, docs, sf_dir)
    assert out.columns == docs.columns
    want = {(i, "\n".join(ls), len("\n".join(ls))) for (i, _), (_, ls) in zip(rows, lines_kept(rows), strict=True)}
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()} == want
    out = cp.drop_near_copies(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == set(near_components(rows)[1].values())
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    out = cp.drop_contaminated(spark, docs, sf_dir)
    assert out.columns == docs.columns
    found = contamination([t for _, t in rows], items)
    assert {r["doc_id"] for r in out.collect()} == {i for (i, _), (_, hit, _) in zip(rows, found, strict=True) if not hit}
    n = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    copies = {r["doc_id"]: poisson_copies(r["doc_id"], len(rows) / len(n) / n[r["source"]], 17) for r in docs.select("doc_id", "source").collect()}
    got = cp.mix(spark, docs, sf_dir).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {i: c for i, c in copies.items() if c}


def test_odd_rows_pass_every_stage(spark, tmp_path):
    rows = [(1, "same words in one text", "en", "a", 22), (1, "same words in one text", "en", "a", 22), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "a text without an id", None, "b", 3), (4, "long words " * 50_000, "en", "a", 1)]
    sf_dir = saved(spark, tmp_path, rows, [(None, None), (1, "")], [(1, None, None), (None, 1, 1)])
    docs = docs_of(spark, sf_dir)
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == COLUMNS, name
        want = 6 if name != "simhash near-dedup" else 4  # one of the two copies, one of the two empty texts
        assert out.count() == want, name
    assert cp.run(spark, sf_dir).columns == [*COLUMNS, "copy_no"]


def test_near_copies_lose_no_other_text(spark, tmp_path):
    """Null ids and one id on unrelated texts: one row of each group stays, whatever its id."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (5, d), (9, c), (9, e), (None, e)]
    docs = docs_of(spark, saved(spark, tmp_path, [(i, t, "en", "a", 9) for i, t in rows]))
    got = sorted((r["text"], r["doc_id"]) for r in cp.drop_near_copies(spark, docs, "").collect())
    assert got == [(a, None), (b, None), (c, 7), (d, 5), (e, 9)]


def test_empty_tables(spark, tmp_path):
    assert cp.run(spark, saved(spark, tmp_path, [])).count() == 0


def test_extra_columns_stay(spark, tmp_path):
    sf_dir = saved(spark, tmp_path, [(1, "some text", "en", "a", 9)])
    docs = docs_of(spark, sf_dir).selectExpr("*", "1 AS toxicity", "'x' AS component_id", "2 AS n_hit", "3 AS n_lines", "4 AS items", "5 AS `odd.name`")
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs.select([f"`{c}`" for c in docs.columns]), sf_dir)
        assert out.columns == docs.columns
        assert [tuple(r) for r in out.collect()] == [tuple(r) for r in docs.collect()]


def test_a_run_leaves_its_result_alone(spark, sf_dir):
    """Tables that stages wrote for themselves, and earlier results, are gone when the run ends."""
    from larkspur.llm import workspace

    made = []
    with workspace.recorded(made):
        out = cp.run(spark, sf_dir)
    there = [p for p in made if spark._jvm.java.io.File(p.removeprefix("file://")).exists()]
    assert len(there) == 1 and "stage-mixing" in there[0] and out.count() > 0
