"""Columns of any name and type pass through every operator that returns the columns of its input."""

import pytest
from pyspark.sql import functions as F

from galley.llm import chat, langid, linededup, minhash, mixture, ngram, piece, quality, rules
from galley.llm.queries import model_path

NAMES = (
    "row size source_size target copies copy expected_grade tail_probability expected tail gone kept component_id n_shingles component node unit side comp band h leader "
    "n_lines n_dropped out at k h1 h2 doc first r1 r2 n label good grade __text __size ids n_tokens decoded held_out lang_pred score block table home data word_chars base_failed texts doc_id_ TEXT2"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "one line\nshared", "one line\nshared", "Four words stand here\nshared", "  \n", "shared", "x " * 300]
    base = spark.createDataFrame([(i, t, "en" if i % 2 else None, None if i == 3 else "ab"[i % 2]) for i, t in enumerate(texts)] + [(4, texts[4], "en", "a"), (None, "shared", None, None)], "doc_id bigint, text string, lang string, source string")
    return base.withColumns({c: F.lit(7) for c in NAMES} | {"n_chars": F.create_map(F.lit("a"), F.lit(1)), "odd name": F.array(F.lit(None).cast("int"))})


def check(docs, out, rows=None):
    assert out.columns[: len(docs.columns)] == docs.columns and len(set(map(str.lower, out.columns))) == len(out.columns)
    got = out.collect()
    assert rows is None or len(got) == rows
    for r in got:
        assert all(r[c] == 7 for c in NAMES) and r["n_chars"] == {"a": 1} and r["odd name"] == [None]


def test_operators_that_carry_columns(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 1), (4, 0, 0)], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))
    model = quality.train(docs, labels)
    check(docs, quality.grade(docs, model), 10)
    check(docs, quality.select(docs, model))
    check(docs, mixture.mix(docs), 10)
    check(docs, mixture.emit(docs))
    check(docs, linededup.drop_repeated_lines(docs, 3), 10)
    check(docs, linededup.drop_repeated_lines(docs, 3, keep_first=True), 10)
    check(docs, minhash.first_of_group(docs), 9)
    check(docs, piece.encode(docs, model_path(), keep=tuple(docs.columns)), 10)


def test_operators_that_read_columns(spark, docs):
    assert minhash.near_duplicates(docs).count() == ngram.score(docs).count() == rules.judge(docs, rules.Field.default()).count() == 10
    assert langid.predict(docs, langid.train(docs)).count() == 10
    events = docs.select(F.col("doc_id").alias("conv_id"), F.lit(1).cast("bigint").alias("seq"), F.lit("message").alias("kind"), F.lit("m").alias("message_id"), F.lit(None).cast("string").alias("role"), "text", *NAMES)
    assert chat.digest(chat.render(chat.fold(events))).count() == 9


def test_conflicting_labels_take_the_lower(spark, docs):
    texts = [(i, f"good words {i} stand on this line of text number {i} for one" if i % 2 else "### $$$ ||| %%% " * 9) for i in range(40)]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, 0, 0)], "doc_id bigint, quality int, toxic int")
    field = rules.train(rows, labels)
    assert (field.emit != rules.Field.default().emit).all()
    kept = {r.doc_id for r in rules.judge(rows, field).collect() if r.content_share >= 0.5}
    assert kept == {i for i in range(40) if i % 2}
