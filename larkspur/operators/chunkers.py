"""Chunkers: files in, rows of chunks out, one builder per content type."""

from __future__ import annotations

import ast
import csv
import io
import json
import tomllib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import context_prefix, count_tokens, front_matter, merged_metadata, normalise_paragraphs
from larkspur.operators.markdown import join_small_sections, sections
from larkspur.operators.packing import chunk_hierarchy
from larkspur.sources.files import notebook_cells
from larkspur.sources.scratch import new_folder

try:
    import yaml
except ImportError:  # without it, YAML files are raw chunks
    yaml = None


def _prefix(kind: str, filename: str = "filename", a: Column | None = None, b: Column | None = None, crumbs: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    listed = F.array().cast("array<string>") if crumbs is None else crumbs
    return context_prefix(F.lit(kind), F.col(filename), nothing if a is None else a, nothing if b is None else b, listed)


def chunk_text(files: DataFrame, kind: str = "text") -> DataFrame:
    """Plain text and code without a parser: paragraphs tidied, then the hierarchy."""
    body = normalise_paragraphs(F.col("content")) if kind == "text" else F.col("content")
    ready = files.select("file_id", "filename", body.alias("text"), _prefix(kind).alias("prefix"))
    return chunk_hierarchy(ready).withColumn("content_type", F.lit(kind))


def table_rows(rows: DataFrame, group: str, order: str, cells: list[str], size: int = 30) -> DataFrame:
    """Markdown tables of up to ``size`` rows: ``group, chunk_no, n_rows, content``."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells]), F.lit(" |"))
    number = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    placed = rows.select(F.col(group), F.col(order).alias("__order"), line.alias("__line"), F.floor(number / size).cast("int").alias("chunk_no"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__order", "__line"))), lambda x: x["__line"]), "\n")
    head = "| " + " | ".join(cells) + " |\n| " + " | ".join("---" for _ in cells) + " |\n"
    return placed.groupBy(group, "chunk_no").agg(F.count(F.lit(1)).alias("n_rows"), F.concat(F.lit(head), body).alias("content"))


def csv_tables(text: str, size: int) -> Iterator[tuple[int, list[str], list[list[str]]]]:
    """Number, header and up to ``size`` rows of each chunk, read one after the other."""
    csv.field_size_limit(1 << 30)  # else a cell of over 128 KB is an error
    rows = csv.reader(io.StringIO(text, newline=""))
    head = next(rows, [])
    for number in count():
        held = list(islice(rows, size))
        if not held:
            return
        yield number, head, held


def chunk_csv(files: DataFrame, size: int = 30, batch: int = 1000) -> DataFrame:
    """Comma-separated text: tables of ``size`` rows under the file's header; a blank line is a row of empty cells.

    A file is read as a stream and leaves its task as chunks, ``batch`` at a time.
    """
    kinds = {f.name: f.dataType.simpleString() for f in files.select("file_id", "filename").schema}
    names = ["file_id", "filename", "chunk_index", "head", "rows"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            chunks = ((i, f, *t) for i, f, c in zip(b["file_id"], b["filename"], b["content"], strict=True) for t in csv_tables(c or "", size))
            while held := list(islice(chunks, batch)):
                yield pd.DataFrame(held, columns=names)

    shape = f"file_id {kinds['file_id']}, filename {kinds['filename']}, chunk_index int, head array<string>, rows array<array<string>>"
    parts = files.select("file_id", "filename", "content").mapInPandas(cut, shape)
    width = F.size("head")
    padded = lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(r))))
    drawn = F.transform("rows", lambda r: F.concat(F.lit("| "), F.array_join(padded(r), " | "), F.lit(" |")))
    head = F.concat(F.lit("| "), F.array_join("head", " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    content = F.array_join(F.concat(F.array(head, rule), drawn), "\n")
    prefix = _prefix("csv", b=F.array_join("head", ", "))
    return parts.select("file_id", "chunk_index", content.alias("content"), prefix.alias("prefix")).withColumn("token_count", count_tokens(F.col("content")))


def structured_parts(filename: str, text: str) -> list[tuple[str | None, str]]:
    """Top-level keys of JSON, YAML or TOML with their values as indented JSON.

    What isn't an object is one part without a key; what can't be parsed, or is an
    empty object, is the raw text.
    """
    name = (filename or "").lower()
    try:
        if name.endswith(".toml"):
            value = tomllib.loads(text)
        elif name.endswith((".yaml", ".yml")):
            if yaml is None:
                return [(None, text)]
            value = yaml.safe_load(text)
        else:
            value = json.loads(text)
    except (ValueError, *([yaml.YAMLError] if yaml else [])):
        return [(None, text)]
    shown = lambda v: json.dumps(v, indent=2, ensure_ascii=False, default=str)
    if isinstance(value, dict):
        return [(str(k), shown({str(k): v})) for k, v in value.items()] or [(None, text)]
    return [(None, shown(value))]


def chunk_structured(files: DataFrame) -> DataFrame:
    """``file_id, part, content, prefix``: one chunk per top-level key, or one for the file."""

    @F.pandas_udf("array<struct<key:string,value:string>>")
    def parts(names: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[{"key": k, "value": v} for k, v in structured_parts(n, t or "")] for n, t in zip(names, texts, strict=True)], dtype=object)

    cut = files.select("file_id", "filename", F.posexplode(parts("filename", "content")).alias("part", "p"))
    prefix = F.when(F.col("p.key").isNotNull(), _prefix("json", a=F.col("p.key"))).otherwise("")
    return cut.select("file_id", "part", F.col("p.value").alias("content"), prefix.alias("prefix")).where("trim(content) <> ''")


def notebook_chunks(cells: DataFrame, group: str = "file_id") -> DataFrame:
    """Chunks from ``cell_no, cell_type, source``: markdown with the code cell after it, and single code cells."""
    order = Window.partitionBy(group).orderBy("cell_no")
    flat = cells.select(group, "cell_no", "cell_type", "source")
    headings = F.filter(F.split("source", "\n"), lambda x: x.startswith("#"))
    heading = F.trim(F.regexp_replace(F.try_element_at(headings, F.lit(-1)), "^#+", ""))
    titled = flat.withColumns({
        "__next_type": F.lead("cell_type").over(order),
        "__next": F.lead("source").over(order),
        "__before": F.lag("cell_type").over(order),
        "section": F.last(F.when(F.col("cell_type") == "markdown", heading), ignorenulls=True).over(order),
    })
    paired = (F.col("cell_type") == "markdown") & (F.col("__next_type") == "code")
    alone = (F.col("cell_type") == "code") & (F.coalesce(F.col("__before"), F.lit("")) != "markdown") & (F.trim("source") != "")
    content = F.when(paired, F.concat("source", F.lit("\n\n```python\n"), "__next", F.lit("\n```"))).otherwise(F.col("source"))
    kept = titled.where(paired | alone).select(group, "cell_no", F.coalesce("section", F.lit("")).alias("section"), content.alias("content"))
    return kept.withColumn("chunk_no", F.row_number().over(order))


def chunk_notebook(files: DataFrame) -> DataFrame:
    return notebook_chunks(notebook_cells(files.select("file_id", "content")))


def python_parts(source: str) -> list[tuple[str | None, str | None, str]]:
    """``class, function, code`` of top-level definitions, methods, and what lies between."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return [(None, None, source)]
    lines = source.split("\n")

    def text(node: ast.stmt) -> str:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        return "\n".join(lines[first - 1 : node.end_lineno])

    out: list[tuple[str | None, str | None, str]] = []
    loose: list[str] = []

    def flush() -> None:
        joined = "\n".join(loose).strip()
        if joined:
            out.append((None, None, joined))
        loose.clear()

    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in tree.body:
        if isinstance(node, functions):
            flush()
            out.append((None, node.name, text(node)))
        elif isinstance(node, ast.ClassDef):
            flush()
            methods = [(node.name, m.name, text(m)) for m in node.body if isinstance(m, functions)]
            whole = "\n".join(lines[node.lineno - 1 : node.end_lineno])
            out.extend(methods or [(node.name, None, whole)])
        else:
            loose.append(text(node))
    flush()
    return out or [(None, None, source)]


def chunk_python(files: DataFrame) -> DataFrame:
    """``file_id, part, class_name, function_name, content, prefix`` of Python files."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, f, n, *p) for i, f, c in zip(b["file_id"], b["filename"], b["content"], strict=True) for n, p in enumerate(python_parts(c or ""))]
            yield pd.DataFrame(rows, columns=["file_id", "filename", "part", "class_name", "function_name", "content"])

    cut = files.select(F.col("file_id").cast("string"), "filename", "content").mapInPandas(parts, "file_id string, filename string, part int, class_name string, function_name string, content string")
    return cut.withColumn("prefix", _prefix("code", a=F.col("class_name"), b=F.col("function_name"))).drop("filename")


def page_ranges(pages: Column, size: int = 500) -> Column:
    """``first-last`` ranges that cover ``pages`` pages."""
    return F.transform(F.sequence(F.lit(0), pages - 1, F.lit(size)), lambda s: F.concat_ws("-", (s + 1).cast("string"), F.least(s + size, pages).cast("string")))


ONLINE_PAGES, BATCH_PAGES = 30, 500


def pdf_jobs(pages: Column, stored: Column) -> Column:
    """How a PDF of so many pages is parsed: ``route`` and ``page_range`` of each job.

    Up to 30 pages are one online call; stored files go to batch jobs of up to 500
    pages; a file that isn't stored is split into online calls.
    """
    size = F.when(stored & (pages > ONLINE_PAGES), BATCH_PAGES).otherwise(ONLINE_PAGES)
    route = F.when(stored & (pages > ONLINE_PAGES), "batch").otherwise("online")
    starts = F.when(pages > 0, F.sequence(F.lit(0), pages - 1, size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(route.alias("route"), F.concat_ws("-", (s + 1).cast("string"), F.least(s + size, pages).cast("string")).alias("page_range")))


def chunk_pdf(files: DataFrame, parse: Callable[[Column, Column], Column]) -> DataFrame:
    """PDFs through a layout parser: ``parse(content, page_range)`` gives layout JSON per job.

    A file's jobs are put together in order, empty ones left out, and chunked as markdown.
    """
    jobs = files.select("file_id", "filename", "content", F.posexplode(pdf_jobs(F.col("n_pages"), F.col("is_stored"))).alias("job", "j"))
    parsed = jobs.select("file_id", "filename", "job", layout_text(parse(F.col("content"), F.col("j.page_range"))).alias("m")).where("m <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("job", "m")))
    whole = parsed.groupBy("file_id", "filename").agg(F.array_join(F.transform(ordered, lambda x: x["m"]), "\n\n").alias("content"))
    return chunk_markdown(whole, "pdf")


def layout_lines(block: dict) -> Iterator[str]:
    """Markdown of a layout block and those inside it; headers and footers go with all they hold."""
    kind = block.get("type", "")
    if kind in ("header", "footer"):
        return
    if kind == "table" and block.get("rows"):
        rows = [[str(c).replace("\n", " ") for c in r] for r in block["rows"]]
        width = max(map(len, rows))
        lines = [r + [""] * (width - len(r)) for r in rows]
        lines.insert(1, ["---"] * width)
        yield "\n".join("| " + " | ".join(r) + " |" for r in lines)
    text = (block.get("text") or "").strip()
    if text:
        level = HEADING_LEVELS.get(kind, 0)
        yield ("#" * level + " " if level else "- " if kind == "list-item" else "") + text
    for inner in block.get("blocks") or ():
        yield from layout_lines(inner)


def layout_text(layout: Column) -> Column:
    """Markdown of a layout's JSON, a list of blocks; empty if it can't be read."""

    @F.pandas_udf("string")
    def drawn(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                blocks = json.loads(t or "[]")
            except ValueError:
                blocks = []
            out.append("\n\n".join(x for b in blocks for x in layout_lines(b)))
        return pd.Series(out, dtype="object")

    return drawn(layout)


# How many heading marks a layout block's type has.
HEADING_LEVELS = {"title": 1, "heading-1": 2, "heading-2": 3, "heading-3": 4, "heading-4": 5, "heading-5": 6, "heading-6": 6}


def layout_markdown(blocks: DataFrame) -> DataFrame:
    """Markdown per file from flattened layout blocks ``file_id, pos, kind, text``.

    Headers and footers are left out; headings and list items get their marks.
    """
    mark = F.lit("")
    for kind, level in HEADING_LEVELS.items():
        mark = F.when(F.col("kind") == kind, "#" * level + " ").otherwise(mark)
    mark = F.when(F.col("kind") == "list-item", "- ").otherwise(mark)
    kept = blocks.where(~F.col("kind").isin("header", "footer") & (F.trim("text") != ""))
    lines = F.array_sort(F.collect_list(F.struct("pos", F.concat(mark, F.trim("text")).alias("line"))))
    return kept.groupBy("file_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("content"))


FRONT = r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)"


def chunk_markdown(files: DataFrame, kind: str = "markdown", min_tokens: int = 100) -> DataFrame:
    """Markdown: front matter, sections, small sections joined, then the hierarchy under each section's headings.

    ``metadata`` is the front matter under the file's own ``metadata``, if it has
    any; small sections left over at the end have none.
    """
    given = F.col("metadata") if "metadata" in files.columns else F.create_map().cast("map<string,string>")
    meta = files.select("file_id", "filename", merged_metadata(front_matter(F.col("content")), given).alias("__meta"))
    body = files.select("file_id", F.regexp_replace("content", FRONT, "").alias("content"))
    found = join_small_sections(sections(body), min_tokens=min_tokens).join(meta, "file_id")
    crumbs = F.filter(F.array("h1", "h2"), lambda h: h.isNotNull())
    none = F.create_map().cast("map<string,string>")
    ready = found.select("file_id", "group_no", "text", _prefix("markdown", crumbs=crumbs).alias("prefix"), F.when(F.col("is_tiny"), none).otherwise(F.col("__meta")).alias("metadata"))
    return chunk_hierarchy(ready).withColumn("content_type", F.lit("text" if kind == "markdown" else kind))


CHUNK = ("file_id", "content_type", "part", "parent_index", "child_index", "prefix", "parent", "child")


def _alone(rows: DataFrame, kind: str, part: str = "part") -> DataFrame:
    """Chunks that are their own parents."""
    return rows.select("file_id", F.lit(kind).alias("content_type"), F.col(part).cast("long").alias("part"), F.lit(0).alias("parent_index"), F.lit(0).alias("child_index"), "prefix", F.col("content").alias("parent"), F.col("content").alias("child"))


def _packed(rows: DataFrame, part: Column) -> DataFrame:
    return rows.withColumn("part", part.cast("long")).select(*CHUNK)


ROUTES = {"markdown": "markdown", "json": "structured", "yaml": "structured", "csv": "csv", "notebook": "notebook", "pdf": "pdf", "image": "unreadable", "xlsx": "unreadable"}


def route() -> Column:
    """Which chunker takes a file: by its type, code also by its name; unknown types are text."""
    kinds = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    code = F.when(F.lower("filename").endswith(".py"), "python").otherwise("code")
    return F.when(F.col("content_type") == "code", code).otherwise(F.coalesce(kinds[F.col("content_type")], F.lit("text")))


def chunk_files(files: DataFrame, parse_pdf: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Every file by the chunker of its ``content_type``; unknown types are read as text.

    Files are read once and written by route; each chunker reads its own folder.
    Images, workbooks, and PDFs without a parser give no chunks but rows of ``unreadable``.
    """
    columns = [c for c in ("file_id", "filename", "content_type", "content", "metadata", "n_pages", "is_stored") if c in files.columns]
    folder = new_folder(files.sparkSession, "routed")
    files.select(*columns).withColumn("__route", route()).where("__route <> 'unreadable'").write.partitionBy("__route").parquet(folder)
    routed = files.sparkSession.read.schema(files.select(*columns, F.lit("").alias("__route")).schema).parquet(folder)
    of = lambda name: routed.where(F.col("__route") == name).drop("__route")
    csv_rows = chunk_csv(of("csv")).withColumnRenamed("chunk_index", "part")
    cells = chunk_notebook(of("notebook")).join(of("notebook").select("file_id", "filename"), "file_id")
    cells = cells.withColumn("prefix", _prefix("notebook", a=F.nullif("section", F.lit("")), b=F.col("chunk_no")))
    parts = [
        _packed(chunk_text(of("text")), F.lit(0)),
        _packed(chunk_markdown(of("markdown")), F.col("group_no")),
        _packed(chunk_text(of("code"), "code"), F.lit(0)),
        _alone(chunk_python(of("python")), "code"),
        _alone(chunk_structured(of("structured")), "json"),
        _alone(csv_rows, "csv"),
        _alone(cells.withColumn("part", F.col("chunk_no") - 1), "code"),
    ]
    if parse_pdf is not None:
        parts.append(_packed(chunk_pdf(of("pdf"), parse_pdf), F.col("group_no")))
    parts = [p.withColumn("file_id", F.col("file_id").cast("string")) for p in parts]
    return reduce(DataFrame.unionByName, parts)


def unreadable(files: DataFrame, has_pdf_parser: bool = False) -> DataFrame:
    """``file_id, content_type, error`` of files that no chunker takes."""
    kinds = ["image", "xlsx", *([] if has_pdf_parser else ["pdf"])]
    error = F.concat(F.lit("no chunker for "), F.col("content_type"))
    return files.where(F.col("content_type").isin(kinds)).select(F.col("file_id").cast("string"), "content_type", error.alias("error"))
