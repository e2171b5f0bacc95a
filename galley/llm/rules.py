"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

The field's two labels are boilerplate (0) and content (1). A line's score for a label is linear in the
features below, neighbouring labels have a transition score, and Viterbi decoding gives the best labels of
a whole document; the share of word characters in content lines then decides whether to keep it. The
weights are fitted by maximum likelihood on a bounded sample of documents with labels. Lines of a document
of bad quality are boilerplate; so are, in a good one, lines that repeat an earlier line of it; the others are
content. Without labels of both kinds the weights of `Field.default` hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm import textvec

#: Documents of either quality, and bytes of a document, that the field is fitted on at most.
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 1 << 15
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
FEATURES = ["bias", "symbols", "capitals", "digits", "pipes", "same_word", "seen_line", "marks", "log_words", "word_length", "few_kinds"]

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_CAPITAL = np.zeros(256, bool)
_IS_CAPITAL[65:91] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(b"!?;:=_/\\{}[]@^~+")] = True


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


@dataclass
class Counts:
    """What the rules count in each text of a slice, and the features of its lines."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_text: np.ndarray
    line_chars: np.ndarray
    features: np.ndarray


def count(texts: textvec.Texts) -> Counts:
    buf, off, n = texts.buf, texts.off, texts.n
    starts, ends = texts.words()
    of = texts.text_of(starts)
    words = np.bincount(of, minlength=n)
    h = texts.hashes(starts, ends)
    letters = ~textvec.IS_SPACE[buf] & ((buf & 0xC0) != 0x80)
    chars = _sums(letters, off[:-1], off[1:])
    symbols = _sums(_IS_SYMBOL[buf], off[:-1], off[1:])

    # Words in windows of five that the text has twice or more.
    at = textvec.windows(of, n, 5)
    key = textvec.chain(h, 5, at)
    order = textvec.by_text(of[at], key)
    k, t = key[order], of[at][order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    covered = np.zeros(len(h) + 5, np.int64)
    hit = at[order[twice]]
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + 5, -1)
    repeated = np.bincount(of, weights=np.cumsum(covered)[: len(h)] > 0, minlength=n).astype(np.int64) if len(h) else np.zeros(n, np.int64)

    # Lines with a word that equal an earlier one.
    ls, le, lt = texts.lines()
    lw = np.searchsorted(starts, le, "left") - np.searchsorted(starts, ls, "left")
    lh = texts.hashes(ls, le)
    full = np.flatnonzero(lw > 0)
    order = full[textvec.by_text(lt[full], lh[full])]
    first_of = np.ones(len(order), bool)
    first_of[1:] = (lh[order][1:] != lh[order][:-1]) | (lt[order][1:] != lt[order][:-1])
    group = np.cumsum(first_of) - 1
    least = np.full(int(first_of.sum()), np.iinfo(np.int64).max)
    np.minimum.at(least, group, order)
    dup = np.zeros(len(ls), bool)
    dup[order] = order != least[group] if len(order) else False
    dups = np.bincount(lt[dup], minlength=n)

    # Features of lines.
    lc = _sums(letters, ls, le)
    size = np.maximum(lc, 1)
    same_word = np.zeros(len(h), bool)
    same_word[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    wf, wl = np.searchsorted(starts, ls, "left"), np.searchsorted(starts, le, "left")
    share = lambda flags: _sums(flags[buf], ls, le) / size
    many = np.maximum(lw, 1)
    repeats = np.concatenate([[0], np.cumsum(np.cumsum(covered)[: len(h)] > 0)])
    features = np.stack(
        [np.ones(len(ls)), share(_IS_SYMBOL), share(_IS_CAPITAL), share(_IS_DIGIT), _sums(buf == 124, ls, le) / many, (lambda c: c[wl] - c[wf])(np.concatenate([[0], np.cumsum(same_word)])) / many,
         dup.astype(float), share(_IS_MARK), np.log1p(lw) / 4, lc / many / 10, (repeats[wl] - repeats[wf]) / many], axis=1,
    )
    return Counts(words, chars, symbols, dups, repeated, lt, np.where(lw > 0, lc, 0), features)


@dataclass
class Field:
    """emit: scores by feature of content over boilerplate; change[a, b]: of b behind a."""

    emit: np.ndarray
    change: np.ndarray

    @staticmethod
    def default() -> Field:
        return Field(np.array([2.0, -12, -4, -4, -6, -8, -4, -8, 0.5, 0, -6]), np.array([[0.7, -0.7], [-0.7, 0.7]]))


def _places(text: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each t, the lines that are the (t + 1)th of their text."""
    first = np.ones(len(text), bool)
    first[1:] = text[1:] != text[:-1]
    place = np.arange(len(text)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    order = np.argsort(place, kind="stable")
    cut = np.searchsorted(place[order], np.arange(place.max() + 2)) if len(text) else np.zeros(1, int)
    return [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], place


def viterbi(field: Field, features: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The best labels of the lines of each text; the t-th lines of all texts go together. Of equal scores content wins."""
    score = np.stack([np.zeros(len(text)), features @ field.emit], axis=1)
    steps, place = _places(text)
    back = np.zeros((len(text), 2), np.int8)
    for at in steps[1:]:
        through = score[at - 1][:, :, None] + field.change[None]
        best = np.where(through[:, 1] >= through[:, 0], 1, 0)
        back[at] = best
        score[at] += np.maximum(through[:, 0], through[:, 1])
    label = np.zeros(len(text), np.int8)
    last = np.ones(len(text), bool)
    last[:-1] = place[1:] == 0
    label[last] = score[last, 1] >= score[last, 0]
    for at in steps[:0:-1]:
        label[at - 1] = np.where(last[at - 1], label[at - 1], back[at, label[at]])
    return label


def _likelihood(w: np.ndarray, x: np.ndarray, text: np.ndarray, y: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The negative log likelihood of the labels by document, and its gradient, by the forward and backward sums."""
    k = x.shape[1]
    change = w[k:].reshape(2, 2)
    score = np.stack([np.zeros(len(text)), x @ w[:k]], axis=1)
    steps, place = _places(text)
    f = score.copy()
    add = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    for at in steps[1:]:
        f[at] = score[at] + add(np.swapaxes(f[at - 1][:, :, None] + change[None], 1, 2))
    b = np.zeros_like(f)
    for at in steps[:0:-1]:
        b[at - 1] = add(change[None] + (score[at] + b[at])[:, None, :])
    last = np.ones(len(text), bool)
    last[:-1] = place[1:] == 0
    whole = add(f[last])
    z = whole[np.cumsum(last) - last]
    p1 = np.exp(f[:, 1] + b[:, 1] - z)
    inner = np.flatnonzero(place > 0)
    pair = np.exp(f[inner - 1][:, :, None] + change[None] + (score[inner] + b[inner])[:, None, :] - z[inner][:, None, None])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    value = whole.sum() - score[np.arange(len(y)), y].sum() - (seen * change).sum()
    grad = np.concatenate([(p1 - y) @ x, (pair.sum(axis=0) - seen).ravel()])
    n = max(1, int(last.sum()))
    return value / n + l2 * (w @ w), grad / n + 2 * l2 * w


def repeated(texts: list[str]) -> np.ndarray:
    """Whether each line (of all texts, in order) has a word and equals an earlier line of its text, white space at the ends apart."""
    out = []
    for text in texts:
        seen: set[str] = set()
        for key in (line.strip() for line in text.split("\n")):
            out.append(bool(key) and key in seen)
            seen.add(key)
    return np.array(out, bool)


def fit(texts: list[str], good: list[bool], steps: int = 150) -> Field:
    """The field of most likelihood (with a small penalty) for lines labelled by their document's quality and their repetition."""
    if len(set(good)) < 2:
        return Field.default()
    xs, docs, ys = [], [], []
    y = np.array(good, np.int64)
    for row, part in textvec.slices(pa.array(texts, pa.large_string())):
        c = count(part)
        xs.append(c.features)
        docs.append(c.line_text + row)
        ys.append(y[c.line_text + row])
    x, doc, y = np.concatenate(xs), np.concatenate(docs), np.concatenate(ys)
    y = np.where(repeated(texts), 0, y)
    w, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    for i in range(1, steps + 1):
        _, g = _likelihood(w, x, doc, y, 1e-4)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.3 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9) * (1 - i / (steps + 1)) ** 0.5
    return Field(w[: x.shape[1]], w[x.shape[1] :].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame | None) -> Field:
    """A field fitted on at most SAMPLE_DOCS labelled documents of either quality, of at most SAMPLE_BYTES bytes each, picked by a hash of doc_id.

    A document with labels of both kinds is of bad quality; labels without a quality or doc_id are left out.
    """
    if labels is None:
        return Field.default()
    rank = F.xxhash64(F.col("doc_id").cast("bigint"))
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") > 0).alias("good")).groupBy("doc_id").agg(F.min("good").alias("good"))
    picked = known.where("good").orderBy(rank, "doc_id").limit(SAMPLE_DOCS).union(known.where("not good").orderBy(rank, "doc_id").limit(SAMPLE_DOCS))
    rows = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sample = rows.join(F.broadcast(picked), "doc_id").orderBy("doc_id", "text").limit(2 * SAMPLE_DOCS).collect()
    return fit([r["text"] for r in sample], [r["good"] for r in sample])


_KINDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]


def _judge(field: Field, least_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in textvec.slices(batch.column("text")):
                c = count(texts)
                label = viterbi(field, c.features, c.line_text)
                content = np.bincount(c.line_text, weights=c.line_chars * label, minlength=texts.n)
                share = content / np.maximum(1, c.word_chars)
                failed = (c.n_words < 10) | (100 * c.n_repeat_words > 20 * c.n_words)
                kept = ~failed & (share >= least_share)
                arrays = [pa.array(getattr(c, k).astype(np.int64)) for k, _ in _KINDS]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, texts.n).cast(pa.int64()), *arrays, pa.array(failed), pa.array(kept), pa.array(share)], names=["doc_id", *(k for k, _ in _KINDS), "base_failed", "kept", "content_share"])

    return run


def judge(docs: DataFrame, field: Field, least_share: float = 0.5) -> DataFrame:
    """One row per document: what the base rules count, base_failed, kept and content_share.

    Words are runs without [\\x20\\x09-\\x0D], of whole texts (a null text has none). word_chars: their code
    points; n_symbols: characters of #*$%&|<>; n_dup_lines: lines with a word that equal an earlier line;
    n_repeat_words: words in windows of five that the text has twice or more. base_failed: fewer than ten
    words, or more than a fifth of them repeated. kept: not base_failed, and at least least_share of the word
    characters in lines that the field marks as content.
    """
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _judge(field, least_share), "doc_id bigint, " + ", ".join(f"{k} bigint" for k, _ in _KINDS) + ", base_failed boolean, kept boolean, content_share double"
    )
