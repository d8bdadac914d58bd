"""Readers that turn files into pages: (source_id, page, text, quality, ocr, image)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T

PAGES = "source_id string, page int, text string, quality double, ocr boolean, image string"


def _finished(rows: DataFrame, quality: F.Column) -> DataFrame:
    kept = rows.withColumn("text", T.clean(F.col("text"))).where("text <> ''")
    return kept.select("source_id", F.col("page").cast("int").alias("page"), "text", quality.alias("quality"), F.lit(False).alias("ocr"), F.lit(None).cast("string").alias("image"))


def text_files(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Whole files as page 1; bytes that aren't UTF-8 are replaced."""
    rows = spark.read.text(path, wholetext=True).select(F.lit(source_id).alias("source_id"), F.lit(1).alias("page"), F.col("value").alias("text"))
    return _finished(rows, T.quality(F.col("text")))


def markdown_folder(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """File i by name is page i; empty files use up a number. Quality 1.

    Numbers come from the list of the folder's file names, which are counted; texts stay where they are.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    # Spark reads no rows of empty files, but it lists them
    names = sorted(unquote(f.rsplit("/", 1)[1]) for f in files.inputFiles())
    pages = F.broadcast(spark.createDataFrame([*enumerate(names, 1)], "page int, name string"))
    rows = files.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)).join(pages, "name").select(F.lit(source_id).alias("source_id"), "page", F.decode("content", "UTF-8").alias("text"))
    return _finished(rows, F.lit(1.0))


def _epub_pages(content: bytes) -> list[tuple[int, str]]:
    """(number, html) of the documents of a book, in the order in which its package file lists them; without one by file name."""
    import io
    import posixpath
    import xml.etree.ElementTree as ET
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        have = set(z.namelist())
        packages = []
        if "META-INF/container.xml" in have:
            packages = [e.get("full-path", "") for e in ET.fromstring(z.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile")]
        names = []
        for package in (p for p in packages if p in have):
            for e in ET.fromstring(z.read(package)).iter():
                if e.tag.endswith("}item") and e.get("media-type") == "application/xhtml+xml" and "nav" not in (e.get("properties") or "").split():
                    names.append(posixpath.normpath(posixpath.join(posixpath.dirname(package), e.get("href", ""))))
        names = [n for n in names if n in have] or sorted(n for n in have if re.search(r"\.x?html?$", n, re.I))
        return [(i, z.read(n).decode("utf-8", "replace")) for i, n in enumerate(names, 1)]


def epub_files(spark: SparkSession, path: str, source_id: str | None = None, min_chars: int = 200) -> DataFrame:
    """Chapters as pages, in the book's own order; short ones are dropped but use up a number.

    Without a ``source_id`` every book is a source of its own, named by its file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(p, *page) for p, content in zip(b["path"], b["content"]) for page in _epub_pages(content)]
            yield pd.DataFrame(out, columns=["path", "page", "html"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, html string")
    bare = F.regexp_replace("html", r"(?is)<nav\b[^>]*>.*?</nav>", " ")
    name = F.lit(source_id) if source_id is not None else F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    rows = found.select(name.alias("source_id"), "page", T.html_to_text(bare).alias("text"))
    return _finished(rows, T.quality(F.col("text"))).where(F.length("text") > min_chars)


def pdf_files(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Pages of PDFs where the optional reader is installed; without it no pages."""
    try:
        import fitz  # noqa: F401
    except ImportError:
        return spark.createDataFrame([], PAGES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for b in batches:
            for content in b["content"]:
                with fitz.open(stream=content, filetype="pdf") as doc:
                    yield pd.DataFrame([(i, p.get_text()) for i, p in enumerate(doc, 1)], columns=["page", "text"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "page int, text string")
    return _finished(found.withColumn("source_id", F.lit(source_id)), T.quality(F.col("text")))


def html_table(pages: DataFrame) -> DataFrame:
    """Web pages (page_id, url, html) as pages of their host."""
    rows = pages.select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("source_id"), F.col("page_id").alias("page"), T.html_to_text(F.coalesce("html", F.lit(""))).alias("text"))
    return _finished(rows, T.quality(F.col("text")))


def pages_of(spark: SparkSession, kind: str, path: str, source_id: str) -> DataFrame | None:
    """The reader of a format; None for formats without one."""
    reader = {"pdf": pdf_files, "epub": epub_files, "txt": text_files, "md": text_files, "markdown-dir": markdown_folder}.get(kind)
    return reader(spark, path, source_id) if reader else None


def checklists(spark: SparkSession, path: str) -> DataFrame:
    """(name, title, triggers, body) of the *.md files with a front matter; others are ignored."""
    front = r"(?s)^---\s*\n(.*?)\n---\s*\n"
    rows = spark.read.text(f"{path}/*.md", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("name"), "value").where(F.col("value").rlike(front))
    head = F.regexp_extract("value", front, 1)
    listed = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_extract(head, r"(?m)^declencheurs:(.*)$", 1), r"^\s*\[+|\]+\s*$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    title = F.trim(F.regexp_extract(head, r"(?m)^titre:(.*)$", 1))
    return rows.select("name", F.when(title != "", title).otherwise(F.col("name")).alias("title"), listed.alias("triggers"), T.strip(F.regexp_replace("value", front, "")).alias("body"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size, is_pdf) of files: what a lock file records."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"), (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"))


def probed(responses: DataFrame) -> DataFrame:
    """(id, ok) of first bytes that a source's URL gave: a .pdf must begin like one. responses: (id, url, head binary), head null on failure."""
    path = F.lower(F.substring_index("url", "?", 1))
    return responses.select("id", F.coalesce(F.col("head").isNotNull() & (~F.endswith(path, F.lit(".pdf")) | (F.substring("head", 1, 4) == F.lit(b"%PDF"))), F.lit(False)).alias("ok"))


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; blank lines are skipped."""
    from gristmill.operators.chunking import CHUNK

    return spark.read.schema(CHUNK).json(path).where("chunk_id is not null")


def documents_json(spark: SparkSession, path: str) -> DataFrame:
    """Pages of one-document JSON files {source_id, titre, pages: [{numero, texte, ocr, qualite, image}]}."""
    schema = "source_id string, titre string, pages array<struct<numero:int,texte:string,ocr:boolean,qualite:double,image:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select("source_id", F.explode("pages").alias("p"))
    return rows.select("source_id", F.col("p.numero").alias("page"), F.col("p.texte").alias("text"), F.col("p.qualite").alias("quality"), F.col("p.ocr").alias("ocr"), F.col("p.image").alias("image"))
