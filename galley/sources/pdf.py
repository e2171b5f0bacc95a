"""Pages of PDF files as a data source; needs the pypdfium2 library on the executors."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, page int, width double, height double, chars array<struct<u:int,x0:double,y0:double,x1:double,y1:double,size:double>>, error struct<code:string,message:string>"


class MissingLibrary(RuntimeError):
    """The backend that was asked for is not installed."""


def backend(name: str = "pdfium"):
    if name != "pdfium":
        raise ValueError(f"unknown backend {name}")
    try:
        import pypdfium2
    except ImportError as e:
        raise MissingLibrary("reading PDF files needs pypdfium2") from e
    return pypdfium2


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        root = self.options["path"]
        found = [root] if os.path.isfile(root) else [p for p in glob.glob(f"{root}/**/*", recursive=True) if p.lower().endswith(".pdf") and not os.path.islink(p)]
        return [_File(p) for p in sorted(found, key=str.lower)]

    def read(self, partition: _File) -> Iterator[tuple]:
        lib = backend(self.options.get("backend", "pdfium"))
        try:
            pdf = lib.PdfDocument(partition.path, password=self.options.get("password"))
        except lib.PdfiumError as e:
            code = "unsupported" if "password" in str(e).lower() else "parse_error"
            if self.options.get("mode", "PERMISSIVE").upper() == "FAILFAST":
                raise
            yield partition.path, None, None, None, None, {"code": code, "message": type(e).__name__}
            return
        try:
            for number, page in enumerate(pdf, 1):
                width, height = page.get_size()
                text = page.get_textpage()
                chars = []
                for i in range(text.count_chars()):
                    left, bottom, right, top = text.get_charbox(i, loose=True)
                    code = ord((text.get_text_range(i, 1) or "\0")[0])
                    if code not in (0, 0xFFFE):
                        chars.append({"u": code, "x0": left, "y0": height - top, "x1": right, "y1": height - bottom, "size": top - bottom})
                yield partition.path, number, width, height, chars, None
                text.close()
                page.close()
        finally:
            pdf.close()


class PdfSource(DataSource):
    """spark.dataSource.register(PdfSource); spark.read.format("pdf_ir").load(folder): a row per page, a task per file."""

    @classmethod
    def name(cls) -> str:
        return "pdf_ir"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))
