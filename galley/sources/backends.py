"""The register of backends: what reads a path as a table of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galley import errors
from galley.layout import ir
from galley.sources import synthetic

Backend = Callable[[SparkSession, str], DataFrame]
_backends: dict[str, Backend] = {}


def register(name: str, backend: Backend) -> None:
    _backends[name] = backend


def select(name: str) -> Backend:
    """The backend of a name."""
    if name not in _backends:
        raise errors.InvalidOptions(f"no backend is registered as {name}")
    return _backends[name]


register("json", ir.read_pages)
register("text", lambda spark, path: synthetic.from_text(spark.read.parquet(path)))
