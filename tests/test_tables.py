"""Chunkers called in SQL give what the DataFrame chunkers give."""

from pyspark.sql import functions as F

from larkspur.functions import tables
from larkspur.operators import chunkers


def test_one_query_chunks_files_of_several_types(spark):
    rows = [(1, "a.py", "code", "import os\nclass K:\n    def m(self):\n        pass\n"), (2, "b.csv", "csv", "k,v\n" + "\n".join(f"{i},x" for i in range(70))), (3, "c.json", "json", '{"a": 1, "b": [2]}'), (4, "d.py", "code", None)]
    spark.createDataFrame(rows, "file_id int, filename string, kind string, content string").createOrReplaceTempView("mixed_files")
    tables.register(spark)
    try:
        got = spark.sql("""
            SELECT f.file_id, p.part, coalesce(p.function_name, '') AS name, p.content FROM mixed_files f, LATERAL python_chunks(f.content) p WHERE f.kind = 'code'
            UNION ALL SELECT f.file_id, c.chunk_index, concat_ws(',', c.head), cast(size(c.rows) AS string) FROM mixed_files f, LATERAL csv_chunks(f.content) c WHERE f.kind = 'csv'
            UNION ALL SELECT f.file_id, s.part, s.key, s.content FROM mixed_files f, LATERAL structured_chunks(f.filename, f.content) s WHERE f.kind = 'json'""").collect()
        files = spark.table("mixed_files")
        code = [(int(r["file_id"]), r["part"], r["function_name"] or "", r["content"]) for r in chunkers.chunk_python(files.where("kind = 'code'")).collect()]
        parts = [(r["file_id"], r["part"], r["content"]) for r in chunkers.chunk_structured(files.where("kind = 'json'")).collect()]
        csv = chunkers.chunk_csv(files.where("kind = 'csv'")).select("file_id", "chunk_index", (F.size(F.split("content", "\n")) - 2).cast("string")).collect()
    finally:
        spark.catalog.dropTempView("mixed_files")
    assert sorted(tuple(r) for r in got if r["file_id"] in (1, 4)) == sorted(code)
    assert sorted((r["file_id"], r["part"], r["content"]) for r in got if r["file_id"] == 3) == sorted(parts)
    assert sorted((r["file_id"], r["part"], r["content"]) for r in got if r["file_id"] == 2) == sorted(map(tuple, csv))
