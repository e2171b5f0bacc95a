"""Language identification: the family first, then one-versus-one machines within it.

Features are the hashed byte trigrams of a text, A-Z lower-cased and white space as one kind of byte, as
shares of their number. Families vote by linear support vector machines for each pair of families; within
the family that wins, machines for each pair of its languages vote. All are fitted on the driver on a
bounded sample of labelled texts, whole ones and short pieces of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.llm import textvec
from galley.llm.linear import Rows, svm

WIDTH = 1 << 14
#: Documents of each language, and bytes of a document, that the machines are fitted on at most.
SAMPLE_DOCS, SAMPLE_BYTES = 300, 1 << 14
#: Bytes of the short pieces cut from each sampled text.
PIECES = (12, 24, 48, 96)
#: Language families by two-letter code; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "cy", "gd", "br"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "semitic": ("ar", "he", "mt", "am"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_BYTE = textvec.FOLD.copy()
_BYTE[textvec.IS_SPACE] = 32
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True


def trigrams(texts: textvec.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The column of each trigram, in order, and where those of each text begin (n + 1 places)."""
    b = _BYTE[texts.buf].astype(np.uint32)
    n = len(b)
    h = np.full(n, 0, np.uint32)
    h[: n - 2] = (b[: n - 2] * np.uint32(0x9E3779B1) + b[1 : n - 1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) if n > 2 else 0
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    size = np.maximum(np.diff(texts.off) - 2, 0)
    inside = np.ones(n, bool)
    for back in (1, 2):
        at = texts.off[1:] - back
        inside[at[at >= texts.off[:-1]]] = False
    return (h[inside] >> np.uint32(32 - 14)).astype(np.int64), np.concatenate([[0], np.cumsum(size)])


def _rows(texts: textvec.Texts) -> Rows:
    column, first = trigrams(texts)
    size = np.diff(first)
    return Rows.of(np.repeat(np.arange(texts.n), size), column, texts.n, WIDTH, 16 / np.maximum(1, size))


@dataclass
class Model:
    """machines: (first, second) to a column of weights; the first wins above 0. families: name to languages."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, texts: textvec.Texts) -> np.ndarray:
        column, first = trigrams(texts)
        size = np.diff(first)
        out = np.zeros((texts.n, len(self.pairs)))
        some = np.flatnonzero(size)
        if len(some):
            for j in range(len(self.pairs)):
                out[some, j] = np.add.reduceat(self.weights[j][column], first[some])
        return out * (16 / np.maximum(1, size))[:, None] + self.bias[None, :]

    def _vote(self, margins: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The place in names with most wins (ties: the larger sum of margins, the earlier name), and its mean chance against the others."""
        wins, sums, chance = (np.zeros((len(margins), len(names))) for _ in range(3))
        at = {name: i for i, name in enumerate(names)}
        for j, (a, b) in enumerate(self.pairs):
            if a in at and b in at:
                m = margins[:, j]
                p = 1 / (1 + np.exp(np.clip(-3 * m, -40, 40)))
                wins[:, at[a]] += m > 0
                wins[:, at[b]] += m <= 0
                sums[:, at[a]] += m
                sums[:, at[b]] -= m
                chance[:, at[a]] += p
                chance[:, at[b]] += 1 - p
        best = np.lexsort((sums.T, wins.T), axis=0)[-1] if len(names) > 1 else np.zeros(len(margins), np.int64)
        return best, chance[np.arange(len(margins)), best] / max(1, len(names) - 1) if len(names) > 1 else np.ones(len(margins))

    def predict(self, texts: textvec.Texts) -> tuple[list[str], np.ndarray]:
        names = sorted(self.families)
        if not names:
            return ["und"] * texts.n, np.zeros(texts.n)
        margins = self.margins(texts)
        family, score = self._vote(margins, [f"family:{f}" for f in names])
        lang = np.empty(texts.n, object)
        for i, name in enumerate(names):
            rows = np.flatnonzero(family == i)
            best, p = self._vote(margins[rows], self.families[name])
            lang[rows] = np.array(self.families[name], object)[best] if len(rows) else []
            score[rows] *= p
        return lang.tolist(), score


def fit(texts: list[str], langs: list[str]) -> Model:
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(_FAMILY.get(lang, lang), []).append(lang)
    data, label = [], []
    for text, lang in zip(texts, langs, strict=True):
        raw = text.encode()
        at = len(raw) // 3
        pieces = [raw, *(raw[at : at + n] for n in PIECES if len(raw) > 2 * n)]
        data += [p.decode(errors="ignore") for p in pieces]
        label += [lang] * len(pieces)
    parts = [_rows(t) for _, t in textvec.slices(pa.array(data, pa.large_string()))]
    if not parts:
        return Model({}, [], np.zeros((0, WIDTH)), np.zeros(0))
    x, y = Rows.joined(parts), np.array(label, object)
    family = np.array([f"family:{_FAMILY.get(lang, lang)}" for lang in label], object)
    pairs, weights, bias = [], [], []
    jobs = [(family, p) for p in combinations([f"family:{f}" for f in sorted(families)], 2)] + [(y, p) for langs_ in families.values() for p in combinations(langs_, 2)]
    for of, (a, b) in jobs:
        rows = np.flatnonzero((of == a) | (of == b))
        w, c = svm(x.take(rows), np.where(of[rows] == a, 1.0, -1.0))
        pairs.append((a, b))
        weights.append(w)
        bias.append(c)
    return Model(families, pairs, np.array(weights, np.float32).reshape(len(pairs), WIDTH), np.array(bias))


def held_out(doc_id) -> F.Column:
    """Whether the CRC-32 of the id's text is divisible by 5; null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Model:
    """A model of at most SAMPLE_DOCS documents of each language, of at most SAMPLE_BYTES bytes each, that are not held out, picked by a hash of doc_id.

    Of several texts of a (doc_id, lang) the least by code point counts; a repeated id is picked once. The ids
    that are broadcast are at most SAMPLE_DOCS a language, and one count a language beside them.
    """
    open_ = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    # Of a language only the least hashes, some four times the sample, reach the task that orders them.
    ids, by = open_.select("lang", "doc_id"), F.xxhash64("doc_id", F.lit("lang"))
    n = ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    least = ids.join(F.broadcast(n), "lang").where(by.cast("double") <= -(2.0**63) + 2.0**64 * 4 * SAMPLE_DOCS / F.col("n")).select("lang", "doc_id").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(by, "doc_id"))
    picked = least.withColumn("place", place).where(F.col("place") <= SAMPLE_DOCS).select("doc_id").distinct()
    sample = open_.select("doc_id", "lang", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).orderBy("doc_id", "lang").collect()
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def _has_letter(texts: textvec.Texts) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_IS_LETTER[texts.buf])])
    found = total[texts.off[1:]] > total[texts.off[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in texts.buf[texts.off[i] : texts.off[i + 1]].tobytes().decode())
    return found


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in textvec.slices(batch.column("text"), 1 << 20):
                lang, score = model.predict(texts)
                some = _has_letter(texts)
                lang = [x if ok else "und" for x, ok in zip(lang, some, strict=True)]
                rest = [batch.column(c).slice(row, texts.n) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(np.where(some, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred and score (0 to 1), from its whole text.

    A text that is null or has no letter (Unicode category L) is `und` with score 0; without anything learnt all are.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id bigint, held_out boolean, lang_pred string, score double")
