"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A labelled document is rated for quality and for cleanness (not toxic); its grade is the sum, 0 to 2.
P(grade <= j) is logistic(t[j] - w x) with weights w shared by all thresholds t over hashed text features x:
words (A-Z lower-cased letters, digits and bytes beyond ASCII), their first bytes, symbols, and marks for
words in capitals and words that repeat the one before, as counts over the square root of their number.
Features have a weight only if the share of documents with them differs between lower and higher grades by
more than DIFFERS standard errors, so that rare words add no noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from galley.llm import textvec
from galley.llm.linear import Rows, ordinal
from galley.operators import tables

WIDTH = 1 << 18
LEVELS = 3
#: Labelled documents of each grade, and bytes of a document, that the model is fitted on at most.
SAMPLE_DOCS, SAMPLE_BYTES = 2500, 1 << 15
DIFFERS = 4.5
#: The least tail probability of a document that is selected. The best grade and the others weigh the same when the
#: model is fitted, so a document about which nothing is known has one half.
LEAST = 0.45

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_IS_CAPITAL = np.zeros(256, bool)
_IS_CAPITAL[65:91] = True


def features(texts: textvec.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The text and the column of each feature."""
    buf = texts.buf
    starts, ends = texts.spans(_IN_WORD[buf])
    of = texts.text_of(starts)
    word = texts.hashes(starts, ends, fold=True)
    head = textvec.mix(texts.hashes(starts, np.minimum(ends, starts + 4), fold=True) + textvec.u64(1))
    capitals = np.concatenate([[0], np.cumsum(_IS_CAPITAL[buf])])
    loud = np.flatnonzero((capitals[ends] - capitals[starts] >= 2) & (capitals[ends] - capitals[starts] == ends - starts))
    again = np.flatnonzero((word[1:] == word[:-1]) & (of[1:] == of[:-1])) + 1
    marks = np.flatnonzero(~_IN_WORD[buf] & ~textvec.IS_SPACE[buf])
    text = np.concatenate([of, of, of[loud], of[again], texts.text_of(marks)])
    column = np.concatenate([word, head]) >> np.uint64(64 - 18)
    fixed = np.concatenate([np.full(len(loud), 1), np.full(len(again), 2), 16 + buf[marks].astype(np.int64)])
    return text, np.concatenate([column.astype(np.int64), fixed])


def _scale(text: np.ndarray, n: int) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(1, np.bincount(text, minlength=n)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: textvec.Texts) -> np.ndarray:
        """(n, LEVELS - 1): the probability of a grade above j."""
        text, column = features(texts)
        s = np.bincount(text, weights=self.weights[column], minlength=texts.n) * _scale(text, texts.n)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -40, 40)))


def fit(texts: list[str], grades: list[int]) -> Model:
    if len(set(grades)) < 2:  # nothing to tell apart: every document gets the best grade
        return Model(np.zeros(WIDTH), np.array([-40.0, -39.0]))
    parts = []
    for _, part in textvec.slices(pa.array(texts, pa.large_string())):
        text, column = features(part)
        parts.append(Rows.of(text, column, part.n, WIDTH, _scale(text, part.n)))
    x, g = Rows.joined(parts), np.array(grades, np.int64)
    row, kept = np.repeat(np.arange(len(g)), np.diff(x.first)), np.zeros(WIDTH, bool)
    for j in range(LEVELS - 1):
        high, low = max(1, (g > j).sum()), max(1, (g <= j).sum())
        with_high, with_low = (np.bincount(x.column, weights=side[row], minlength=WIDTH) for side in (g > j, g <= j))
        p = (with_high + with_low) / len(g)
        kept |= np.abs(with_high / high - with_low / low) > DIFFERS * np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / high + 1 / low))
    x.value = np.where(kept[x.column], x.value, 0.0)
    best = g == LEVELS - 1
    w, t = ordinal(x, g, LEVELS, np.where(best, 0.5 / max(1, best.sum()), 0.5 / max(1, (~best).sum())), l2=1e-6, rate=0.2)
    return Model(w * kept, t)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of at most SAMPLE_DOCS labelled documents of each grade, of at most SAMPLE_BYTES bytes each, picked by a hash of doc_id.

    A label without a quality is left out, one without a toxic mark is clean. Of several labels of a
    document the lowest grade counts; of several texts of a doc_id the least by code point. The sample has
    at most LEVELS * SAMPLE_DOCS rows of (doc_id, grade), which is what is broadcast.
    """
    grade = F.when(F.col("quality") > 0, 1).otherwise(0) + F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).otherwise(1)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(grade).alias("grade"))
    rank = F.xxhash64("doc_id", F.lit("quality"))
    picked = [known.where(F.col("grade") == g).orderBy(rank).limit(SAMPLE_DOCS) for g in range(LEVELS)]
    rows = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sample = rows.join(F.broadcast(picked[0].union(picked[1]).union(picked[2])), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).orderBy("doc_id").limit(LEVELS * SAMPLE_DOCS).collect()
    return fit([r["text"] for r in sample], [r["grade"] for r in sample])


def _grade(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in textvec.slices(batch.column("text")):
                tails = model.tails(texts)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(row, texts.n), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], names=["row", "expected", "tail"])

    return run


def _graded(docs: DataFrame, model: Model) -> DataFrame:
    """(row, expected, tail): row holds the columns of docs."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    schema = StructType([rows.schema["row"], StructField("expected", DoubleType()), StructField("tail", DoubleType())])
    return rows.mapInArrow(_grade(model), schema)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """docs with expected_grade (0 to 2) and tail_probability, that of the best grade; a null text is an empty one.

    New columns whose name docs has already get underscores in front.
    """
    expected, tail = tables.free_names(docs.columns, "expected_grade", "tail_probability")
    return _graded(docs, model).select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("expected").alias(expected), F.col("tail").alias(tail))


def select(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The documents whose probability of the best grade is at least so high; all columns stay."""
    return _graded(docs, model).where(F.col("tail") >= least).select("row.*")
