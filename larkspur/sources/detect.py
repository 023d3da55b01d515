"""Logical content type of a file from its name and MIME type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by logical type.
CODE = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".rs", ".java", ".rb", ".c", ".cpp", ".h", ".hpp", ".swift", ".kt", ".scala",
    ".sh", ".bash", ".zsh", ".r", ".m", ".cs", ".php", ".lua", ".zig", ".nim", ".ex", ".exs", ".clj", ".hs", ".ml", ".vue", ".svelte",
)
BY_EXTENSION = {
    "pdf": [".pdf"],
    "markdown": [".md", ".mdx"],
    "json": [".json", ".toml"],
    "yaml": [".yaml", ".yml"],
    "csv": [".csv"],
    "xlsx": [".xlsx", ".xls"],
    "image": [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp"],
    "text": [".txt", ".log", ".rst"],
}
BY_MIME = (("pdf", "pdf"), ("image", "image"), ("json", "json"), ("yaml", "yaml"), ("yml", "yaml"))


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"[^/](\.[^./]+)$", 1))


def content_type(filename: Column, mime: Column) -> Column:
    """Notebook, then code, then other extensions, then MIME parts, then text."""
    ext, mime = extension(filename), F.coalesce(mime, F.lit(""))
    out = F.when(ext == ".ipynb", "notebook").when(ext.isin(*CODE), "code")
    for name, extensions in BY_EXTENSION.items():
        out = out.when(ext.isin(extensions), name)
    for part, name in BY_MIME:
        out = out.when(mime.contains(part), name)
    return out.otherwise("text")
