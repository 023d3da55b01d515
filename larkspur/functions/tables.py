"""Chunkers as table functions, to be called in SQL with LATERAL.

``register(spark)`` adds ``csv_chunks(content)``, ``python_chunks(content)`` and
``structured_chunks(filename, content)``; each gives rows for one file's text and keeps nothing
between files.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from larkspur.operators.chunkers import csv_tables, python_parts, structured_parts


class CsvChunks:
    def eval(self, content: str) -> Iterator[tuple]:
        """Number, header and up to 30 rows of each chunk."""
        yield from csv_tables(content or "", 30)


class PythonChunks:
    def eval(self, content: str) -> Iterator[tuple]:
        """Number, class, function and code of each part."""
        for n, part in enumerate(python_parts(content or "")):
            yield (n, *part)


class StructuredChunks:
    def eval(self, filename: str, content: str) -> Iterator[tuple]:
        """Number, key and indented JSON of each top-level value."""
        for n, part in enumerate(structured_parts(filename, content or "")):
            yield (n, *part)


SHAPES = {
    "csv_chunks": (CsvChunks, "chunk_index int, head array<string>, rows array<array<string>>"),
    "python_chunks": (PythonChunks, "part int, class_name string, function_name string, content string"),
    "structured_chunks": (StructuredChunks, "part int, key string, content string"),
}


def register(spark: SparkSession) -> None:
    for name, (made, shape) in SHAPES.items():
        spark.udtf.register(name, udtf(made, returnType=shape))
