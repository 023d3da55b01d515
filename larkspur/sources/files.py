"""Reading raw files and the structured formats inside them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.detect import content_type

NOTEBOOK = "struct<cells:array<struct<cell_type:string,source:array<string>>>>"


def object_path(tenant: Column, file_id: Column, filename: Column) -> Column:
    """Where a tenant's file lies in the object store."""
    return F.concat_ws("/", F.lit("tenants"), tenant.cast("string"), F.lit("files"), file_id.cast("string"), filename)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, modificationTime``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files with ``tenant_id, file_id`` from their path, type, and text (bad bytes replaced)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.regexp_extract("path", "/tenants/([^/]+)/files/", 1).alias("tenant_id"),
        F.regexp_extract("path", "/files/([^/]+)/[^/]+$", 1).alias("file_id"),
        name.alias("filename"),
        content_type(name, F.lit(None)).alias("content_type"),
        F.col("length").alias("file_size"),
        F.expr("make_valid_utf8(cast(content as string))").alias("content"),
    )


def write_files(files: DataFrame, path: str) -> None:
    """``tenant_id, file_id, filename, content`` byte for byte under one folder per tenant, each row with its object path."""
    kept = files.select("tenant_id", "file_id", "filename", F.col("content").cast("binary").alias("content"))
    kept.withColumn("path", object_path(F.col("tenant_id"), F.col("file_id"), F.col("filename"))).write.partitionBy("tenant_id").mode("append").parquet(path)


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def byte_pieces(files: DataFrame, size: int = 256 * 1024, content: str = "content") -> DataFrame:
    """``piece_no, piece`` of each file's bytes, none for an empty file."""
    starts = F.when(F.octet_length(content) > 0, F.sequence(F.lit(0), F.octet_length(content) - 1, F.lit(size)))
    cut = files.select(*files.drop(content).columns, content, F.posexplode(starts).alias("piece_no", "__at"))
    return cut.withColumn("piece", F.col(content).substr(F.col("__at") + 1, F.lit(size))).drop("__at", content)


def stream_bytes(spark: SparkSession, path: str, size: int = 256 * 1024) -> Iterator[bytes]:
    """A file's bytes, piece by piece; an error if there is none."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    for row in byte_pieces(spark.read.format("binaryFile").load(path).select("path", "content"), size).orderBy("piece_no").toLocalIterator():
        yield bytes(row["piece"])


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _place(spark, path)
    return bool(store.exists(at))


def total_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a prefix."""
    at, store = _place(spark, path)
    return int(store.getContentSummary(at).getLength())


def delete_prefix(spark: SparkSession, path: str) -> bool:
    """Remove all files below a prefix; whether there was anything."""
    at, store = _place(spark, path)
    return bool(store.delete(at, True))


def json_top_level(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per top-level key of JSON objects: ``key, value`` (text of strings, compact JSON of the rest).

    A value that isn't an object, or can't be parsed, gives one row with a null key.
    """
    others = [c for c in files.columns if c != content]
    keyed = files.select(*others, content, F.explode_outer(F.from_json(content, "map<string,string>")).alias("key", "__v"))
    return keyed.withColumn("value", F.when(F.col("key").isNull(), F.col(content)).otherwise(F.col("__v"))).drop("__v")


def json_values(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per top-level key of JSON objects: ``key, kind, value``, by the variant type.

    ``kind`` is text, number, boolean, null, object or array; ``value`` is its JSON, numbers as they
    were written up to 38 digits.  What isn't an object, or can't be parsed, gives none.
    """
    others = [c for c in files.columns if c != content]
    parsed = files.select(*others, F.try_parse_json(content).alias("__v")).where(F.schema_of_variant("__v").startswith("OBJECT"))
    parsed.createOrReplaceTempView(view := f"variants_{uuid.uuid4().hex}")
    try:
        keyed = files.sparkSession.sql(f"SELECT {', '.join(f'v.`{c}`' for c in others)}, e.key, e.value FROM {view} AS v, LATERAL variant_explode(v.__v) AS e")
    finally:
        files.sparkSession.catalog.dropTempView(view)
    shape = F.schema_of_variant("value")
    kind = F.when(shape == "STRING", "text").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").otherwise("number")
    return keyed.select(*others, "key", kind.alias("kind"), F.to_json("value").alias("value"))


def notebook_cells(files: DataFrame, content: str = "content") -> DataFrame:
    """``cell_no, cell_type, source`` of each notebook cell; invalid JSON gives none."""
    cells = files.withColumn("__nb", F.from_json(content, NOTEBOOK))
    out = cells.select(*files.drop(content).columns, F.posexplode("__nb.cells").alias("cell_no", "__c"))
    return out.select(*files.drop(content).columns, "cell_no", F.col("__c.cell_type").alias("cell_type"), F.array_join("__c.source", "").alias("source"))
