"""Readers: folders of files, texts, tables, state files, keyword lists, vectors."""

from __future__ import annotations

import csv
import io
import lzma
import sys
import xml.etree.ElementTree as ET
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.fixed import FILE_TYPES
from tessera.functions.scalars import col, let
from tessera.functions.text import markdown_table, split_list
from tessera.operators import layout
from tessera.session import ship
from tessera.sources import charset, pdf


def scan(spark, folder: str, types: list[str] | None = None, recursive: bool = False) -> DataFrame:
    """path, filetype, modified, length, content and content_hash of a folder's files of these types,
    whatever the case of their endings. Empty folders give no rows; Spark's reader leaves out empty files."""
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in t) for t in types or FILE_TYPES) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select("path", kind.alias("filetype"), F.col("modificationTime").alias("modified"), "length", "content", F.sha2("content", 256).alias("content_hash"))


def plain_text(content="content", charset: str = "UTF-8") -> Column:
    """The text of bytes in a charset. Bytes that it doesn't know become replacement characters."""
    return F.decode(F.col(content) if isinstance(content, str) else content, charset)


def csv_table(spark, path: str, header: bool = True) -> DataFrame:
    """A table with inferred types; lines that don't fit it are left out."""
    return spark.read.csv(path, header=header, inferSchema=True, mode="DROPMALFORMED")


def _plain(c: Column) -> Column:
    """Whether bytes are UTF-8 that needs no closer look: valid, without a mark, zeros and escapes."""
    return F.is_valid_utf8(c.cast("string")) & ~F.hex(F.substring(c, 1, 3)).startswith("EFBBBF") & (F.translate(c.cast("string"), "\x00\x1b", "") == c.cast("string"))


def _by_worker(give, kind: str, content: Column, plain: Column) -> Column:
    """``plain`` for plain bytes, which no worker gets to see, and what ``give`` makes of others."""

    def look(contents: pd.Series) -> pd.Series:
        return pd.Series([give(bytes(c)) if c is not None else None for c in contents], dtype=object)

    made = F.pandas_udf(look, kind)(F.when(~_plain(content), content))
    return F.when(_plain(content), plain).otherwise(made)


def detected_charset(content="content") -> Column:
    """The charset of bytes, by ``charset.detect``; utf-8 for plain ones, null for null."""
    return _by_worker(charset.detect, "string", col(content), F.lit("utf-8"))


def detected_text(content="content") -> Column:
    """The text of bytes in their detected charset, without a byte order mark."""
    c = col(content)
    return _by_worker(charset.text, "string", c, c.cast("string"))


def _csv(text: str | None) -> list[list[str]] | None:
    """Rows of the usual dialect: quoted cells may hold commas, doubled quotes and line breaks; blank lines don't count."""
    if text is None:
        return None
    csv.field_size_limit(sys.maxsize)
    try:
        return [row for row in csv.reader(io.StringIO(text, newline="")) if row]
    except csv.Error:
        return None


def csv_rows(text) -> Column:
    """array<array<string>> of a small file's text; null where it can't be read."""

    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([_csv(t) for t in texts], dtype=object)

    return F.pandas_udf(read, "array<array<string>>")(col(text))


def _fitting(rows: Column) -> Column:
    """Without the lines that have more cells than the first."""
    return let(rows, lambda t: F.filter(t, lambda r: F.size(r) <= F.size(F.get(t, F.lit(0)))))


def csv_text(content="content") -> Column:
    """A small file's lines as a table with bars; lines with more cells than the first are left out."""
    return markdown_table(_fitting(csv_rows(detected_text(content))))


def csv_tables(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with tables: the one table of each, its first line the headers; none where a file can't be read or is empty."""
    rows = F.coalesce(_fitting(csv_rows(detected_text(content))), F.array().cast("array<array<string>>"))
    one = files.withColumn("__t", rows)
    table = F.struct(F.lit("table_1").alias("table_id"), F.get("__t", F.lit(0)).alias("headers"), F.slice("__t", 2, 2147483647).alias("data"))
    return one.withColumn("tables", F.when(F.size("__t") > 0, F.array(table)).otherwise(F.array().cast(f"array<{TABLE}>"))).drop("__t")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
TABLE = "struct<table_id:string,headers:array<string>,data:array<array<string>>>"


def _runs(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t"))


def _document(content: bytes) -> tuple[str | None, list[dict]]:
    """Text and tables of an office document; neither if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ET.ParseError, RuntimeError, zlib.error, lzma.LZMAError, EOFError, OSError, ValueError):
        return None, []  # damaged, encrypted, or packed in a way that the library doesn't know
    parts, tables = [], []
    for node in body if body is not None else []:
        if node.tag == f"{_W}p" and (text := _runs(node).strip()):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            level = name.removeprefix("Heading").strip()
            parts.append(f"{'#' * int(level)} {text}" if name.startswith("Heading") and level.isdigit() else text)
        elif node.tag == f"{_W}tbl":
            rows = [[_runs(c).strip() for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            if rows:
                tables.append({"table_id": f"table_{len(tables) + 1}", "headers": rows[0], "data": rows[1:]})
                parts.append("\n".join(["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:])]))
    return "\n\n".join(parts), tables


def office_documents(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with text and tables; both are empty where a file can't be read."""
    ship(files.sparkSession)

    def read(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_document(bytes(c) if c is not None else b"") for c in contents], columns=["text", "tables"])

    made = files.withColumn("__d", F.pandas_udf(read, f"text string, tables array<{TABLE}>")(F.col(content)))
    return made.select("*", "__d.text", "__d.tables").drop("__d")


PIECES = "array<array<struct<x0:double,y0:double,x1:double,y1:double,size:double,text:string>>>"


def _pdf_pages(files: DataFrame, content: str) -> DataFrame:
    """path, page (from 1) and pieces, for each page of each file that can be read."""
    ship(files.sparkSession)

    def read(contents: pd.Series) -> pd.Series:
        return pd.Series([pdf.placed(bytes(c)) if c is not None else None for c in contents], dtype=object)

    paged = files.select("path", F.posexplode(F.pandas_udf(read, PIECES)(F.col(content))).alias("__p", "pieces"))
    return paged.select("path", (F.col("__p") + 1).alias("page"), "pieces")


def _pieces(pages: DataFrame) -> DataFrame:
    return pages.select("path", "page", F.posexplode("pieces").alias("seq", "__x")).select("path", "page", "seq", "__x.*")


def pdf_pieces(files: DataFrame, content: str = "content") -> DataFrame:
    """path, page, seq, x0, y0, x1, y1, size, text: all that pages show, as ``operators.layout`` takes it."""
    return _pieces(_pdf_pages(files, content))


def pdf_pages(files: DataFrame, content: str = "content") -> DataFrame:
    """path, page (from 1) and page_text: tables as `TABLE:` texts, then lines; files that can't be read have no rows."""
    pages = _pdf_pages(files, content)
    text = layout.contents(_pieces(pages), ["path", "page"]).withColumnRenamed("text", "page_text")
    return pages.select("path", "page").join(text, ["path", "page"], "left").withColumn("page_text", F.coalesce("page_text", F.lit("")))


def pdf_tables(files: DataFrame, content: str = "content") -> DataFrame:
    """path, page, table_id (`page_i_table_j`), headers and data of each ruled table."""
    found = layout.tables(pdf_pieces(files, content), ["path", "page"])
    name = F.concat(F.lit("page_"), F.col("page").cast("string"), F.lit("_table_"), F.col("table").cast("string"))
    return found.select("path", "page", name.alias("table_id"), F.get("rows", F.lit(0)).alias("headers"), F.slice("rows", 2, 2147483647).alias("data"))


def texts(files: DataFrame) -> DataFrame:
    """path, filetype, content_hash and text of scanned files; pages of a PDF are joined by lines `---`.
    The text is null where a file can't be read."""
    rows = files.select("path", "filetype", "content_hash", "content")
    office = office_documents(rows.where("filetype = '.docx'")).select("path", "filetype", "content_hash", "text")
    paged = rows.where("filetype = '.pdf'")
    listed = F.array_sort(F.collect_list(F.struct("page", "page_text")))
    pages = pdf_pages(paged).groupBy("path").agg(F.array_join(F.transform(listed, lambda p: p["page_text"]), "\n---\n").alias("text"))
    paged = paged.select("path", "filetype", "content_hash").join(pages, "path", "left")
    plain = rows.where("filetype NOT IN ('.docx', '.pdf')")
    text = F.when(F.col("filetype").isin(".txt", ".md"), detected_text()).when(F.col("filetype") == ".csv", csv_text())
    return plain.select("path", "filetype", "content_hash", text.alias("text")).unionByName(office).unionByName(paged)


def json_state(spark, path: str, schema: str) -> DataFrame:
    """Records of a JSON file; unreadable ones are rows with _corrupt."""
    return spark.read.json(path, schema=f"{schema}, _corrupt string", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def state_or_aside(spark, path: str, schema: str) -> DataFrame:
    """Records of a JSON file; no rows if there is none. A file that can't be read as such is renamed to
    ``path``.corrupt, in place of an older one, so that the next state starts afresh and it can be looked at."""
    where, aside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.corrupt"))
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    none = spark.createDataFrame([], schema)
    if not fs.exists(where):
        return none
    rows = json_state(spark, path, schema)
    if rows.where("_corrupt is not null").take(1):
        if fs.exists(aside):
            fs.delete(aside, False)
        fs.rename(where, aside)
        return none
    return rows.drop("_corrupt")


def keyword_list(spark, path: str) -> DataFrame:
    """term: the trimmed, non-blank parts of comma-separated lines."""
    return spark.read.text(path).select(F.explode(split_list("value")).alias("term"))


def text_properties(df: DataFrame) -> DataFrame:
    """text: every non-blank value of every string or string-list column, trimmed."""
    from pyspark.sql.types import ArrayType, StringType

    lists = [F.array(F.col(f"`{f.name}`")) for f in df.schema if f.dataType == StringType()]
    lists += [F.col(f"`{f.name}`") for f in df.schema if f.dataType == ArrayType(StringType())]
    if not lists:
        return df.select(F.lit("").alias("text")).where("false")
    every = F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))
    return df.select(F.explode(every).alias("text")).select(F.trim("text").alias("text")).where("text <> ''")
