import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from galley.functions import text as T
from galley.operators import assembly as A
from galley.operators import fidelity as D
from galley.operators import gate as Q
from galley.operators.graph import connected_components, with_least
from galley.operators.tables import free_names, keep, keep_sorted
from galley.sinks import docx as sink
from galley.sources import discovery
from galley.sources import docx as source


def test_hubs_are_dealt_out(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(2999, 5000), (5000, 5001), (7000, 7001), (7001, 6999)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)
    got = {x.node: x.component for x in connected_components(df, keep).collect()}
    assert got == {i: 0 for i in [*range(3000), 5000, 5001]} | {i: 6999 for i in (6999, 7000, 7001)}
    low = with_least(df.select(F.col("a").alias("u"), F.col("b").alias("v")), len(edges))
    assert sorted((x.u, x.v, x.m) for x in low.collect()) == sorted((a, b, min([a, *(y for x, y in edges if x == a)])) for a, b in edges)
    spread = [x["count"] for x in low.groupBy(F.spark_partition_id()).count().collect()]
    assert max(spread) < 0.6 * len(edges)  # the hub's edges stay where they were


def test_names_and_sorted_tables(spark):
    assert free_names(["A", "_a", "b"], "a", "c", "c") == ["__a", "c", "_c"]
    rows = [keep_sorted(spark.range(i, i + 50).select(F.col("id").alias("k"), F.lit(i).alias("n")), ["k"], 4) for i in (0, 25)]
    both = rows[0].hint("merge").join(rows[1], "k")
    assert both.count() == 25 and "Exchange" not in both._jdf.queryExecution().executedPlan().toString()


def test_components_of_random_graphs(spark):
    r = random.Random(0)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), keep).collect()}
    assert got == {x: find(x) for x in root}


def test_greedy_matches(spark):
    r = random.Random(1)
    rows = [(d, s, o, r.randrange(5)) for d in range(3) for s in range(8) for o in range(8) if r.random() < 0.6]
    want = []
    for d in range(3):
        left, right = set(), set()
        for c, s, o in sorted((c, s, o) for e, s, o, c in rows if e == d):
            if s not in left and o not in right:
                want.append((d, s, o, c))
                left.add(s), right.add(o)
    got = D.greedy_matches(spark.createDataFrame(rows, "doc int, src int, out int, cost int"), ["doc"])
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_monotone_pages(spark):
    votes = spark.createDataFrame([(1, 1, 5, 2), (1, 1, 6, 3), (1, 2, 5, 9), (1, 2, 7, 1), (1, 3, 7, 2), (1, 3, 6, 2), (1, 3, 8, 2), (1, 4, 1, 9)], "doc int, page int, rendered int, votes int")
    assert [(x.page, x.rendered) for x in D.monotone_pages(votes, ["doc"]).orderBy("page").collect()] == [(1, 6), (2, 7), (3, 7), (4, None)]


def test_running_head_threshold(spark):
    pages = spark.createDataFrame([(p, f"Report 2024 page {p}\nbody {p}x") for p in range(1, 6)], "page int, text string")
    lines = pages.select("page", F.explode(F.split("text", "\n")).alias("line")).select("page", T.digits_masked(F.col("line")).alias("sig"))
    found = lines.groupBy("sig").agg(F.count_distinct("page").alias("n")).where("n >= greatest(2, round(0.6 * 5))")
    assert {x.sig for x in found.collect()} == {"Report # page #", "body #x"}


def test_soft_join_and_width(spark):
    df = spark.createDataFrame([("exam-", "ple"), ("A-", "B"), ("x ", "y"), ("end", None)], "a string, b string")
    assert [x[0] for x in df.select(T.soft_join(F.col("a"), F.col("b"))).collect()] == ["exam", "A-", "x ", "end"]
    assert [x[0] for x in df.select(T.width(F.col("a"), {500: "exam-", 250: " "}, F.lit(10.0))).collect()] == [25.0, None, 7.5, None]


def test_page_assembly(spark):
    chars = [(1, 1, i, u, 10.0 * i + (30 if i > 2 else 0), 0.0, 10.0 * i + 5 + (30 if i > 2 else 0), 10.0, 10.0, 10.0) for i, u in enumerate("abcde")]
    df = spark.createDataFrame(chars, "doc_id bigint, page int, i int, u string, x0 double, y0 double, x1 double, y1 double, baseline double, size double")
    assert [x.text for x in A.per_page(df, A.build_lines, A.LINES_SCHEMA).orderBy("line").collect()] == ["a b c", "d e"]
    lines = pd.DataFrame({"text": list("abcd"), "x0": [0.0] * 4, "x1": [100.0] * 4, "baseline": [10.0, 22, 34, 90], "size": [10.0] * 4})
    assert A.build_blocks(lines)["block"].tolist() == [0, 0, 0, 1]
    parts = pd.DataFrame({"text": ["host", "2"], "x0": [0.0, 41], "x1": [40.0, 45], "baseline": [100.0, 96], "size": [10.0, 6]})
    got = A.absorb_scripts(parts)
    assert got[["text", "sup"]].values.tolist() == [["host2", "2"]]
    paras = pd.DataFrame({"seq": [1, 2, 3, 4], "source_lines": [1, 3, 4, 5], "predicted": [1, 3, 2, np.nan], "line_height": [12.0] * 4, "slack": [60.0] * 4, "capacity": [100.0] * 4})
    assert A.lock_lines(paras)["outcome"].tolist() == ["short", "flow", "line-locked", "unpredictable"]
    best = A.refine(5, lambda x: x, lambda x: (0, abs(x - 2), 0.5), lambda x, _: x - 1 if x else None, 9)
    assert best == (2, (0, 0, 0.5))


def test_gate_findings(spark):
    names = [m.name for m in Q.METRICS]
    schema = "doc string, " + ", ".join(f"{n} double" for n in names)
    good = (0.0, 0.97, 0.97, 0.95, 0.5, 1.0, 0.0)
    rows = spark.createDataFrame([("a", *good), ("b", 0.0, 0.90, 0.97, 0.95, 0.5, 9.0, None), ("new", *good)], schema)
    base = spark.createDataFrame([("a", *good), ("b", *good), ("gone", *good)], schema)
    known = spark.createDataFrame([("a", "doc_recall")], "doc string, metric string")
    got = {(x.doc, x.metric): x.finding for x in Q.verdicts(rows, base, "doc", known).collect()}
    assert got["a", "doc_recall"] == "stale" and got["a", "dy_p50"] == "pass" and got["b", "live_text_cov"] == got["b", "dy_p50"] == "regression"
    assert got["b", "raster_frac"] == "no-metric" and got["new", "dy_p50"] == "unrecorded" and got["gone", "dy_p50"] == "missing"


def test_packages_round_trip(spark, tmp_path):
    run = lambda t: {"text": t, "font": "Arial", "size": 10.0, "bold": False, "italic": False}
    paras = spark.createDataFrame([(1, 0, [run("A & <b>\x01")], "left", 12.0, 0.0, 0.0, 1), (1, 1, [run("two")], "justify", None, 4.0, 10.0, 0)], "doc_id bigint, seq int, runs array<struct<text:string,font:string,size:double,bold:boolean,italic:boolean>>, align string, leading double, space_before double, indent double, heading int")
    content = bytes(sink.packages(paras).first()["content"])
    sink.publish(content, str(tmp_path / "x.docx"))
    (tmp_path / "bad.docx").write_bytes(b"no")
    rows = {x.path.rsplit("/", 1)[1]: x for x in source.scan(spark, str(tmp_path)).collect()}
    assert rows["x.docx"].text == "A & <b>two" and rows["bad.docx"].error.code == "parse_error"
    with pytest.raises(Exception):  # noqa: B017
        sink.publish(b"no", str(tmp_path / "x.docx"))
    assert (tmp_path / "x.docx").read_bytes() == content


def test_discovery_and_manifest(spark, tmp_path):
    for n in ("B.pdf", "a.PDF", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "d.pdf").write_bytes(b"x")
    assert [x.rel for x in discovery.discover(spark, str(tmp_path), skip="out").collect()] == ["a.PDF", "B.pdf"]
    kind = StructType([StructField("w", DoubleType())])
    (tmp_path / "m.json").write_text(json.dumps({"schema": 3, "documents": {"a": {"w": 1.5}}}))
    assert [tuple(x) for x in discovery.keyed_json(spark, str(tmp_path / "m.json"), "doc", kind, "documents", ("schema", 3)).collect()] == [("a", 1.5)]
    with pytest.raises(ValueError):
        discovery.keyed_json(spark, str(tmp_path / "m.json"), "doc", kind, "documents", ("schema", 2))
    (tmp_path / "m.json").write_text(json.dumps({"schema": 3, "documents": {"a": {"w": 1.5, "z": 1}}}))
    with pytest.raises(ValueError):
        discovery.keyed_json(spark, str(tmp_path / "m.json"), "doc", kind, "documents", ("schema", 3))


def test_pdf_needs_its_library():
    from galley.sources import pdf

    try:
        import pypdfium2  # noqa: F401
    except ImportError:
        with pytest.raises(pdf.MissingLibrary):
            pdf.backend()
    assert pdf.PdfSource.name() == "pdf_ir"
