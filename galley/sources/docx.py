"""Live text of Word packages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Parts whose text counts: the body, headers, footers, footnotes and endnotes.
_PARTS = re.compile(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml")

SCHEMA = "path string, part string, text string, media_bytes bigint, error struct<code:string,message:string>"


def read_package(content: bytes) -> list[tuple[str, str | None, int | None]]:
    """(part, text, media_bytes): the text of each part in order, and the sizes of media parts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        out: list[tuple[str, str | None, int | None]] = []
        for info in sorted(z.infolist(), key=lambda i: i.filename):
            if _PARTS.fullmatch(info.filename):
                out.append((info.filename, "".join(t.text or "" for t in ElementTree.fromstring(z.read(info)).iter(f"{_W}t")), None))
            elif info.filename.startswith("word/media/"):
                out.append((info.filename, None, info.file_size))
        return out


def scan(spark: SparkSession, path: str, fail_fast: bool = False) -> DataFrame:
    """A row per text or media part of the packages below path; what cannot be read is a row with an error, or raises."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for p, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(p, part, text, size, None) for part, text, size in read_package(content)]
                except (zipfile.BadZipFile, ElementTree.ParseError) as e:
                    if fail_fast:
                        raise
                    rows.append((p, None, None, None, {"code": "parse_error", "message": type(e).__name__}))
            yield pd.DataFrame(rows, columns=["path", "part", "text", "media_bytes", "error"]).astype({"media_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content").mapInPandas(parts, SCHEMA)
