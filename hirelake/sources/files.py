"""Files: CVs as text or DOCX, uploads, logs; reports as JSON."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".md", ".txt", ".docx")
MAX_UPLOAD = 5 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Non-blank paragraphs, then table rows with their non-empty cells joined by ' | ', one on each line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    lines = [said(p) for p in body.findall(f"{_W}p")]
    for row in body.iter(f"{_W}tr"):
        lines.append(" | ".join(x for x in (said(c) for c in row.findall(f"{_W}tc")) if x))
    return "\n".join(x for x in lines if x)


def read_cvs(spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD) -> DataFrame:
    """(path, text) of each CV below ``path``: whole Markdown or text files in UTF-8, and DOCX.

    Files of other kinds and over ``max_bytes`` are left out by the scan; a path without files raises,
    and a single file of another kind raises ValueError.
    """
    suffix = PurePosixPath(path).suffix.lower()
    if suffix and suffix not in SUFFIXES and "*" not in path:
        raise ValueError(f"unsupported CV format: {suffix}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    wanted = F.rlike(F.lower("path"), F.lit(r"\.(?:md|txt|docx)$"))

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(text=[docx_text(c) if p.lower().endswith(".docx") else c.decode("utf-8", "replace") for p, c in zip(pdf["path"], pdf["content"], strict=True)])[["path", "text"]]

    return files.where((F.col("length") <= max_bytes) & wanted).select("path", "content").mapInPandas(run, "path string, text string")


def log_tail(lines: DataFrame, order: str, text: str, level: str = "", n: int = 200) -> DataFrame:
    """The last ``n`` lines, in order, that carry ``[LEVEL]``; all lines count where no level is given."""
    if level:
        lines = lines.where(F.contains(F.col(text), F.lit(f"[{level.upper()}]")))
    return lines.orderBy(F.desc(order)).limit(n).orderBy(order)


def append_report(report: DataFrame, path: str) -> None:
    """Append reports, one JSON object on a line."""
    report.write.mode("append").json(path)


def write_latest(report: DataFrame, path: str) -> str:
    """Overwrite the latest report of one row; returns its folder."""
    report.coalesce(1).write.mode("overwrite").json(path)
    return path
