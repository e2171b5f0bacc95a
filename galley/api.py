"""Entry points: options, inference, conversion of folders of pages, and their reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley import errors
from galley.layout import infer as layout
from galley.layout import ir
from galley.sinks import docx

#: Documents of a run, pages of a document and of a run.
MOST_DOCUMENTS, MOST_PAGES, MOST_RUN_PAGES = 500, 250, 2000
TARGETS, ORACLES = ("word", "docs"), ("none", "libreoffice", "docs")


@dataclass(frozen=True)
class Options:
    target: str = "word"
    oracle: str = "none"
    refine_rounds: int = 0
    max_pages: int = MOST_PAGES
    max_run_pages: int = MOST_RUN_PAGES
    continue_on_error: bool = False

    def checked(self) -> Options:
        if self.target not in TARGETS or self.oracle not in ORACLES:
            raise errors.InvalidOptions("unknown target or oracle")
        if not 0 <= self.refine_rounds <= 10 or self.max_pages < 1 or self.max_run_pages < 1:
            raise errors.InvalidOptions("a number is out of its range")
        if self.refine_rounds and self.oracle == "none":
            raise errors.InvalidOptions("refinement needs an oracle")
        return self

    @staticmethod
    def of(values: dict) -> Options:
        """Options of a dictionary, with the older names of some."""
        alias = {"rounds": "refine_rounds", "renderer": "oracle", "profile": "target"}
        named = {alias.get(k, k): v for k, v in values.items()}
        unknown = set(named) - set(Options.__dataclass_fields__)
        if unknown:
            raise errors.InvalidOptions(f"unknown options: {', '.join(sorted(unknown))}")
        return Options(**named).checked()


@dataclass
class Warning_:
    code: str
    doc_id: int | None = None
    detail: str = ""


@dataclass
class OracleRun:
    oracle: str
    rounds: int = 0
    ok: bool = False


@dataclass
class Result:
    """What a conversion did: counts by status, warnings, and the run of the oracle."""

    statuses: dict[str, int] = field(default_factory=dict)
    warnings: list[Warning_] = field(default_factory=list)
    oracle: OracleRun = field(default_factory=lambda: OracleRun("none"))
    published: int = 0

    @property
    def degraded(self) -> bool:
        return bool(self.warnings) or (self.oracle.oracle != "none" and not self.oracle.ok)

    def as_dict(self) -> dict:
        return asdict(self) | {"degraded": self.degraded}


Renderer = Callable[[DataFrame], DataFrame]
_renderers: dict[str, Renderer] = {}


def register_renderer(name: str, renderer: Renderer) -> None:
    """A renderer turns packages (doc_id, content) into pages of objects."""
    _renderers[name] = renderer


def renderer(name: str) -> Renderer:
    if name not in _renderers:
        raise errors.RenderFailed(f"no renderer is registered as {name}")
    return _renderers[name]


def infer(objects: DataFrame) -> DataFrame:
    """Elements of a table of objects; see layout.infer."""
    return layout.infer(objects)


def preflight(pages: DataFrame, options: Options) -> DataFrame:
    """(doc_id, pages, status): ready, refused (nothing on any page, or too many pages), or skipped behind the document that crosses the run's limit, which is failed."""
    from pyspark.sql.window import Window

    some = F.size(F.coalesce("lines", F.array())) + F.size(F.coalesce("drawings", F.array())) + F.size(F.coalesce("images", F.array()))
    docs = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(some).alias("objects"))
    refused = (F.col("objects") == 0) | (F.col("pages") > options.max_pages)
    upto = F.sum(F.when(refused, 0).otherwise(F.col("pages"))).over(Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))  # one row per document of a run, MOST_DOCUMENTS at most
    over = F.col("upto") > options.max_run_pages
    status: Column = F.when(refused, "refused").when(over & (F.col("upto") - F.col("pages") > options.max_run_pages), "skipped").when(over, "failed").otherwise("ready")
    return docs.withColumn("upto", upto).select("doc_id", "pages", status.alias("status"))


def convert(spark: SparkSession, source: str, folder: str, options: Options | None = None) -> Result:
    """Pages of JSON lines at source become one package per document in folder; documents that are refused, and why, are in the result."""
    options = (options or Options()).checked()
    try:
        pages = ir.read_pages(spark, source)
        n = pages.select("doc_id").distinct().count()
    except errors.GalleyError:
        raise
    except Exception as e:
        raise (errors.InputMissing("no such input") if "PATH_NOT_FOUND" in str(e) else errors.InputMalformed("the input is no table of pages")) from e
    if n > MOST_DOCUMENTS:
        raise errors.LimitExceeded(f"a run takes {MOST_DOCUMENTS} documents at most")
    state = preflight(pages, options).collect()
    result = Result(statuses={s: sum(r.status == s for r in state) for s in ("ready", "refused", "failed", "skipped")})
    result.warnings = [Warning_(r.status, r.doc_id) for r in state if r.status != "ready"]
    if result.statuses["failed"] and not options.continue_on_error:
        result.warnings.append(Warning_("stopped"))
    ready = spark.createDataFrame([(r.doc_id,) for r in state if r.status == "ready"], "doc_id bigint")
    made = docx.layout_packages(infer(ir.objects(pages.join(F.broadcast(ready), "doc_id", "left_semi"))))
    if options.oracle != "none":
        result.oracle = OracleRun(options.oracle)
        renderer(options.oracle)(made)
        result.oracle.ok = True
    try:
        result.published = docx.publish_all(spark, made, folder)
    except ValueError as e:
        raise errors.OutputFailed("a package is not whole") from e
    return result


def report(result: Result) -> str:
    return json.dumps(result.as_dict(), sort_keys=True)
