"""One large file each, in the memory and time that many small ones of the same size take."""

import time

from pyspark.sql import functions as F

from larkspur.operators import chunkers, enrich, packing

MINUTE = 60


def timed(df, sink="noop"):
    began = time.monotonic()
    df.write.format(sink).mode("overwrite").save()
    return time.monotonic() - began


def test_csv_of_a_million_lines(spark):
    line = F.concat(F.lit("k"), F.col("id").cast("string"), F.lit(',"a, b",'), (F.col("id") % 7).cast("string"))
    text = spark.range(1_000_000, numPartitions=1).select(line.alias("x")).agg(F.concat(F.lit("key,both,n\n"), F.array_join(F.collect_list("x"), "\n")).alias("content"))
    file = text.select(F.lit(1).alias("file_id"), F.lit("big.csv").alias("filename"), "content")
    began = time.monotonic()
    got = chunkers.chunk_csv(file).agg(F.count(F.lit(1)), F.max("chunk_index"), F.sum(F.size(F.split("content", "\n")) - 2), F.max(F.length("prefix"))).first()
    assert tuple(got) == (33_334, 33_333, 1_000_000, len("File: big.csv | Columns: key, both, n")) and time.monotonic() - began < MINUTE


def test_csv_cells_beyond_the_parser_s_own_limit(spark):
    file = spark.createDataFrame([(1, "w.csv", "a,b\n" + "x" * 300_000 + ",1")], "file_id long, filename string, content string")
    assert chunkers.chunk_csv(file).first()["content"].endswith("x | 1 |")


def parents(spark, files, each, chars):
    text = F.concat(F.lit("Parent "), F.col("id").cast("string"), F.lit(". "), F.repeat(F.lit("Word. "), chars // 6))
    rows = spark.range(files * each, numPartitions=8)
    return rows.select((F.col("id") / each).cast("int").alias("file_id"), (F.col("id") % each).cast("int").alias("parent_index"), text.alias("content"), F.lit(300).alias("token_count"))


def test_thirty_megabytes_of_parents_in_one_file(spark):
    rows = parents(spark, 1, 30_000, 1000)
    assert timed(enrich.document_outlines(rows, group_max=600)) < MINUTE
    got = enrich.document_summaries(rows).collect()
    assert [(r["tokens"], r["n_groups"], r["summary"]) for r in got] == [(9_000_000, 181, "Parent 0. Word.")]


def test_groups_hold_every_parent_once(spark):
    got = enrich.group_texts(parents(spark, 3, 50, 30), 1000, 900).collect()
    assert all(r["n_groups"] == 17 for r in got) and len(got) == 51
    for file in range(3):
        text = "\n\n".join(r["text"] for r in sorted(got, key=lambda r: r["group_no"]) if r["file_id"] == file)
        assert [int(p.split(".")[0][7:]) for p in text.split("\n\n")] == list(range(50 * file, 50 * file + 50))


def test_hierarchy_is_linear_in_a_text(spark):
    def seconds(chars):
        text = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("Six words are in this one. "), chars // 27).alias("text"))
        return timed(packing.chunk_hierarchy(text))

    seconds(10_000)
    small, large = seconds(1_000_000), seconds(5_000_000)
    assert large < MINUTE and large < 10 * max(small, 1)
