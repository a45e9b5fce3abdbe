"""Sources: binary documents, HTML, pasted text, JSON datasets; one row per document with an error column."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlark.functions import text as T

WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW_NS = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs, then tables with cells joined by blanks."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{WORD_NS}body")
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{WORD_NS}t"))
    paragraphs = [words(p) for p in body.findall(f"{WORD_NS}p")]
    rows = [" ".join("\n".join(words(p) for p in cell.iter(f"{WORD_NS}p")) for cell in row.findall(f"{WORD_NS}tc")) for row in body.iter(f"{WORD_NS}tr")]
    return "\n".join([*paragraphs, *rows])


def pptx_text(content: bytes) -> str:
    """Texts of all shapes, slide by slide."""
    deck = zipfile.ZipFile(io.BytesIO(content))
    slides = sorted((n for n in deck.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=lambda n: int("".join(filter(str.isdigit, n.rsplit("/", 1)[1])) or 0))
    lines = []
    for name in slides:
        lines += ["".join(t.text or "" for t in p.iter(f"{DRAW_NS}t")) for p in ElementTree.fromstring(deck.read(name)).iter(f"{DRAW_NS}p")]
    return "\n".join(lines)


def pdf_text(content: bytes) -> str:
    """Pages of a PDF, if a PDF library is installed; otherwise an error that the raw-text fallback takes."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return "\n".join(page.extract_text() or "" for page in pdf.pages)


EXTRACTORS: dict[str, Callable[[bytes], str]] = {".docx": docx_text, ".pptx": pptx_text, ".pdf": pdf_text}


def extract_text(name: str, content: bytes, extractors: dict[str, Callable[[bytes], str]] = EXTRACTORS) -> tuple[str | None, str | None]:
    """(text, error): by the name's ending, else or after an error as UTF-8."""
    for ending, extractor in extractors.items():
        if name.lower().endswith(ending):
            try:
                return extractor(content), None
            except Exception:  # any broken document falls back to its bytes
                break
    try:
        return content.decode("utf-8"), None
    except UnicodeDecodeError:
        return None, f"cannot read {name.rsplit('/', 1)[-1]}"


def read_documents(spark: SparkSession, path: str, extractors: dict[str, Callable[[bytes], str]] = EXTRACTORS) -> DataFrame:
    """Files below path -> (doc_id, source, text, error); doc_id is the digest of name and bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [extract_text(n, bytes(c), extractors) for n, c in zip(frame.path, frame.content, strict=True)]
            yield pd.DataFrame({"doc_id": frame.doc_id, "source": frame.path, "text": [g[0] for g in got], "error": [g[1] for g in got]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.sha2(F.concat(F.encode("path", "UTF-8"), "content"), 256).alias("doc_id"), "path", "content").mapInPandas(run, "doc_id string, source string, text string, error string")


def read_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text); pages without text are left out."""
    return pages.select("page_id", "url", T.html_to_text("html").alias("text")).where("text <> ''")


def pasted(spark: SparkSession, text: str) -> DataFrame:
    if not text or not text.strip():
        raise ValueError("no text")
    return spark.createDataFrame([(text,)], "text string").select(F.sha2("text", 256).alias("doc_id"), F.lit("text").alias("source"), "text")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions with their truth; placeholders, blank and unjudged ones are left out."""
    rows = spark.read.schema("question string, expected boolean").option("multiLine", True).json(path)
    return rows.where("question is not null and expected is not null and not contains(question, 'REPLACE_ME')").select(T.strip("question").alias("question"), "expected").where("question <> ''")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
