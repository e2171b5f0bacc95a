"""What queries move between tasks: texts may be dealt out, the words, glyphs and lines made of them may not."""

import random
import re

import pytest
from pyspark.sql import functions as F

from galley.functions import text as T
from galley.layout import ir
from galley.layout.infer import infer
from galley.operators import fidelity as D
from galley.operators import spatial as X
from galley.operators import tables
from galley.operators.tables import keep
from galley.plans.queries import QUERIES
from galley.sources import synthetic

SF = "/root/testdata/sf0.001"


def exploded_rows_moved(df) -> list[str]:
    """Exchanges of a plan below which rows are exploded without being grouped in between."""
    lines = [(len(m.group(0)), line) for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if (m := re.match(r"[ :+-]*", line))]
    found = []
    for n, (depth, line) in enumerate(lines):
        if line[depth:].startswith("Exchange "):
            for d, below in lines[n + 1 :]:
                if d <= depth:
                    break
                if below[d:].startswith("Generate"):
                    found.append(line)
                    break
    return found


def test_greedy_words(spark):
    r = random.Random(5)
    side = lambda n: [(d, p, r.choice("abc"), k, float(r.randrange(4)), float(r.randrange(4))) for d in range(4) for p in range(3) for k in range(n)]
    a, b = spark.createDataFrame(side(17), "doc int, page int, word string, src int, x0 double, y0 double"), spark.createDataFrame(side(14), "doc int, page int, word string, out int, x0 double, y0 double")
    pairs = a.alias("a").join(b.alias("b"), ["doc", "page", "word"]).selectExpr("doc", "page", "src", "out", "3 * abs(b.y0 - a.y0) + abs(b.x0 - a.x0) AS cost")
    want = sorted(map(tuple, D.greedy_matches(pairs, ["doc", "page"]).collect()))
    assert want and sorted(map(tuple, D.greedy_words(a, b, ["doc", "page"], "word").collect())) == want


def test_greedy_words_many_rounds(spark):
    """Each pair waits for the one before: the choice goes on after the rounds of all pairs at once."""
    n = 90
    at = [0.0]
    for k in range(2 * n - 1):
        at.append(at[-1] + 10.0 - 0.05 * k)
    side = lambda odd, name: spark.createDataFrame([(1, "w", k, at[2 * k + odd], 0.0) for k in range(n)], f"doc int, word string, {name} int, x0 double, y0 double")
    a, b = side(0, "src"), side(1, "out")
    pairs = a.alias("a").join(b.alias("b"), ["doc", "word"]).selectExpr("doc", "src", "out", "3 * abs(b.y0 - a.y0) + abs(b.x0 - a.x0) AS cost")
    assert sorted(map(tuple, D.greedy_words(a, b, ["doc"], "word").collect())) == sorted(map(tuple, D.greedy_matches(pairs, ["doc"]).collect()))


def test_greedy_word_match_moves_no_words(spark):
    assert not exploded_rows_moved(QUERIES["greedy_word_match"](spark, SF))


def test_boxes_at_one_place(spark):
    """A few places, each with many copies: pairs are made of places, and all copies are in the component."""
    r, most = random.Random(2), []
    places = [(p, 10.0 * r.randrange(12), 10.0 * r.randrange(12)) for p in range(2) for _ in range(40)]
    rows = [(k, p, x, y, x + 8, y + 8) for k, (p, x, y) in enumerate(r.choice(places) for _ in range(2000))] + [(2000, 0, None, 1.0, 2.0, 3.0)]
    root = {k: k for k, *_ in rows}

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for a in rows[:-1]:
        for b in rows[: a[0]]:
            if a[1] == b[1] and abs(a[2] - b[2]) <= 14 and abs(a[3] - b[3]) <= 14:
                p, q = find(a[0]), find(b[0])
                root[max(p, q)] = min(p, q)

    def cut(df):
        made = keep(df)
        most.append(made.count())
        return made

    boxes = keep(spark.createDataFrame(rows, "id int, page int, x0 double, y0 double, x1 double, y1 double"))
    assert {x.id: x.component for x in X.touching(boxes, ["page"], "id", 6.0, cut).collect()} == {k: find(k) for k in root}
    assert max(most) < 1000
    merged = {(x.page, x.id): x.n for x in X.merged_boxes(boxes.where("x0 is not null"), ["page"], "id", 6.0, keep).collect()}
    assert sum(merged.values()) == 2000


def test_severity_places(spark, tmp_path):
    """Places are those of the order, however the range's partitions are merged."""
    spark.range(20_000).selectExpr("id * 7919 % 20000 AS doc_id", "id % 97 AS n_chars").repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "24k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = QUERIES["severity_report"](spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    order = sorted(rows, key=lambda x: (("error", "fail", "warn", "pass").index(x.verdict), x.doc_id))
    assert [x.place for x in order] == list(range(1, 20_001))


@pytest.mark.parametrize("name", ["letter_spacing", "spans_to_runs", "word_recall_multiset", "importer_quirks", "gram_coverage_pairs", "placement_percentiles", "height_jumps", "line_words", "page_census"])
def test_moves_no_exploded_rows(spark, name):
    assert not exploded_rows_moved(QUERIES[name](spark, SF))


def test_votes_are_made_once(spark):
    plan = QUERIES["gutter_votes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", ["chained_cluster_1d", "order_statistics"])
def test_slices_grow_with_the_input(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "SLICE", 4096)
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(l_suppkey#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt and min(dealt) > 20


def test_rows_of_both_sides(spark):
    """As a join, with repeated and absent keys and null values."""
    a = spark.createDataFrame([(1, 1, 5.0), (1, 1, None), (1, 2, 6.0), (None, 1, 7.0), (2, 1, 8.0)], "doc int, i int, x double")
    b = spark.createDataFrame([(1, 1, 50.0), (1, 1, 51.0), (1, 2, None), (None, 1, 70.0), (3, 1, 9.0)], "doc int, i int, rx double")
    assert sorted(map(str, D.met(a, b, ["doc", "i"]).collect())) == sorted(map(str, a.join(b, ["doc", "i"]).collect()))


def test_width_by_bytes(spark):
    lines = ["", "Ab", "é", "aé", None, "a\tb", "日本", "~" * 5000, "W"] * 3
    df = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "k int, t string").repartition(2)
    of = {c: a for a, chars in T.HELVETICA.items() for c in chars}
    got = {r.k: (r.a, r.b) for r in df.select("k", T.width(F.col("t"), T.HELVETICA, F.lit(9.5)).alias("a"), T.width(F.col("t"), {500: "ab"}, F.lit(10.0), default=600).alias("b")).collect()}
    for k, t in enumerate(lines):
        known = t is not None and all(c in of for c in t)
        assert got[k][0] == (sum(of[c] for c in t) * 9.5 / 1000.0 if known else None)
        assert got[k][1] == (None if t is None else sum(500 if c in "ab" else 600 for c in t) * 10.0 / 1000.0)


def test_width_takes_one_pass(spark):
    assert "translate" not in QUERIES["text_width_sans"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_pages_are_folded_as_a_stream(spark):
    pages = synthetic.from_text(spark.createDataFrame([(k, " ".join(f"w{n}" for n in range(900 * k))) for k in range(3)] + [(None, "x"), (7, None)], "doc_id bigint, text string"))
    made = infer(ir.objects(pages))
    found = {(r.doc_id, r.page) for r in made.where("kind = 'para'").select("doc_id", "page").distinct().collect()}
    assert found == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, 4), (2, 5)}
