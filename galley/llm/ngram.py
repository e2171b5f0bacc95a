"""Stupid-backoff scores of documents, computed by joins of n-gram tables.

Documents are taken in blocks, runs of rows of an input partition. A block's n-grams, of every order up to
the longest, are exploded and pre-aggregated to distinct hashes with counts; these go to the count tables,
which are partitioned by ranges of the hash; each table sums what the blocks sent and answers every block with
the corpus counts of its own n-grams, in the order asked; and the block joins the answers to its n-grams again
and sums per document. A block sends an n-gram once, however often it has it, so common n-grams weigh no more
than rare ones. Its texts travel with its questions and answers, compressed, so that they are read once and
nothing depends on blocks being cut alike twice.

The tables' rows are packed: sorted hashes as differences, 3 to 4 bytes each. One row of Spark's for each
(block, n-gram) would be plainer; README.md has the figures why it is not done.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm import textvec
from galley.llm.mixture import n_words

#: Bytes of text in a block, about, where the corpus is small. There are as many tables as blocks, and a block sends
#: a row to each, so blocks grow with the square root of the corpus: rows then hold LEAST_ROW bytes of text or more.
BLOCK_BYTES = 12 << 20
LEAST_ROW = 2048


def _grams(texts: textvec.Texts, order: int, bits: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The text of each word, the number of words, and for n = 1..order the hash of the n words that end at each word (0 where the text has fewer)."""
    starts, ends = texts.words()
    h, of = texts.hashes(starts, ends, fold=True), texts.text_of(starts)
    out = []
    for n in range(1, order + 1):
        key = np.zeros(len(h), np.uint64)
        at = textvec.windows(of, texts.n, n)
        key[at + n - 1] = (textvec.chain(h, n, at) >> np.uint64(64 - bits)) | np.uint64(1)
        out.append(key)
    return of, np.bincount(of, minlength=texts.n), out


def _pack_texts(ids: pa.Array, texts: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """The ids (with a mark where null), sizes and bytes of a block's texts, compressed."""
    sizes = np.concatenate([np.diff(off) for _, off in texts]).astype("<i8")
    head = [np.array([len(sizes)], "<i8"), np.asarray(ids.fill_null(0)).astype("<i8"), np.asarray(ids.is_null()).astype("<i8"), sizes]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*(x.tobytes() for x in head), *(buf.tobytes() for buf, _ in texts)]))


def _unpack_texts(data: bytes) -> tuple[pa.Array, list[textvec.Texts]]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids, null, sizes = (np.frombuffer(raw, "<i8", n, 8 + 8 * n * i) for i in range(3))
    off = np.concatenate([[0], np.cumsum(sizes)])
    buf = np.frombuffer(raw, np.uint8, offset=8 + 24 * n)
    out, row = [], 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(off, off[row] + textvec.SLICE_BYTES, "right")) - 1)
        out.append(textvec.Texts(buf[off[row] : off[to]], off[row : to + 1] - off[row], np.zeros(to - row, bool)))
        row = to
    return pa.array(ids, mask=null.astype(bool)), out


def _squeeze(sorted_keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte plane, and counts; both compressed."""
    step = np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8")
    planes = step.view(np.uint8).reshape(-1, 8).T.copy().tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy().tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _expand(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // 12
    keys = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)
    return keys, np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _table_of(keys: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The table of each key: ranges of hashes, so that sorted keys are cut in order."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(tables) >> np.uint64(32)).astype(np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each occurs."""
    keys = np.sort(keys)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.append(new, len(keys)))


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and the places in it at which another key begins."""
    order = np.argsort(keys)
    keys = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _ask(order: int, tables: int, block_bytes: int, bits: int, spread: int):
    """Rows (table, block, home, texts, data): to each table a block's keys and counts, and to one of them its texts. home numbers the task that the block's answers go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number, size = 0, 0
        ids: list[pa.Array] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        parts: list[np.ndarray] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, size, ids, held, parts
            block = context.partitionId() << 32 | number
            home = context.partitionId() * spread + number
            keys, counts = _distinct(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
            cut = np.searchsorted(_table_of(keys, tables, bits), np.arange(tables + 1))
            texts = _pack_texts(pa.concat_arrays(ids), held)
            number, size, ids, held, parts = number + 1, 0, [], [], []
            for t, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                data = _squeeze(keys[a:b], counts[a:b])
                yield _row(t, block, home, texts if t == home % tables else None, data)

        for batch in batches:
            for row, texts in textvec.slices(batch.column("text")):
                ids.append(batch.column("doc_id").slice(row, texts.n))
                held.append((texts.buf.copy(), texts.off))
                parts += [g[g != 0] for g in _grams(texts, order, bits)[2]]
                size += len(texts.buf)
                if size >= block_bytes:
                    yield from close()
        if ids:
            yield from close()

    return run


_ROW = "table bigint, block bigint, home bigint, texts binary, data binary"


def _row(table: int, block: int, home: int, texts: bytes | None, data: bytes | None) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((table, block, home, texts, data), kinds, strict=True)], names=["table", "block", "home", "texts", "data"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables in order: the counts of all blocks are summed, and each block gets them for the keys that it sent."""
    table, blocks, held = None, [], []

    def sums() -> Iterator[pa.RecordBatch]:
        sent = [_expand(x) for x in held]
        cut = np.cumsum([0, *(len(k) for k, _ in sent)])
        order, new = _groups(np.concatenate([k for k, _ in sent]))
        counts = np.concatenate([c for _, c in sent])[order]
        del sent
        total = np.empty(len(order), "<u8")
        if len(new):
            total[order] = np.repeat(np.add.reduceat(counts, new), np.diff(np.append(new, len(order))))
        for i, (block, home) in enumerate(blocks):
            planes = total[cut[i] : cut[i + 1]].view(np.uint8).reshape(-1, 8).T.copy().tobytes()
            yield _row(table, block, home, None, zstandard.ZstdCompressor(level=1).compress(planes))

    for batch in batches:
        for t, b, home, texts, x in zip(*(batch.column(c).to_pylist() for c in ("table", "block", "home", "texts", "data")), strict=True):
            if table is not None and t != table:
                yield from sums()
                blocks, held = [], []
            table = t
            blocks.append((b, home))
            held.append(x)
            if texts is not None:
                yield _row(-1, b, home, texts, None)
    if held:
        yield from sums()


def _score(order: int, least: int, alpha: float, total: int, bits: int):
    """A block's texts (table -1) and answers, in the order of blocks and tables, become scores."""

    def scored(packed: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, slices = _unpack_texts(packed)
        exploded = [_grams(texts, order, bits) for texts in slices]
        flat = np.concatenate([g for _, _, grams in exploded for g in grams])
        none = len(flat) - int(np.count_nonzero(flat))
        by_key, new = _groups(flat)
        del flat
        new = new[1:] if none else new
        planes = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8) for x in answers]
        answer = np.concatenate([np.zeros(0, np.int64), *(np.ascontiguousarray(p.reshape(8, -1).T).view("<i8").ravel() for p in planes)])
        del planes
        # The join: the answers are in the order of the distinct keys.
        counts = np.zeros(len(by_key), np.int64)
        counts[by_key[none:]] = np.repeat(answer, np.diff(np.append(new, len(by_key))))
        del by_key, answer
        row = at = 0
        for i, texts in enumerate(slices):
            of, n, grams = exploded[i]
            exploded[i] = None
            c = [counts[at + m * len(of) : at + (m + 1) * len(of)] for m in range(order)]
            at += order * len(of)
            score = np.log(np.maximum(c[0], 1) / max(total, 1))
            backed = np.zeros(len(of), np.int64)
            for m in range(1, order):  # a longer n-gram, where it is known, has the say
                before = np.concatenate([[0], c[m - 1][:-1]])
                known, has = c[m] >= least, grams[m] != 0
                score = np.where(known, np.log(np.maximum(c[m], 1) / np.maximum(before, 1)), score + np.where(has, math.log(alpha), 0.0))
                backed = np.where(known, 0, backed + has)
            sums = [np.bincount(of, weights=x, minlength=texts.n) for x in (score, backed)]
            yield pa.RecordBatch.from_arrays([ids.slice(row, texts.n), pa.array(n.astype(np.int64)), pa.array(sums[0].astype(np.float64)), pa.array(sums[1].astype(np.int64))], names=["doc_id", "n_words", "log_score", "n_backoffs"])
            row += texts.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, packed, answers = None, None, []
        for batch in batches:
            for b, texts, x in zip(*(batch.column(c).to_pylist() for c in ("block", "texts", "data")), strict=True):
                if block is not None and b != block:
                    yield from scored(packed, answers)
                    answers = []
                block = b
                if texts is not None:
                    packed = texts
                else:
                    answers.append(x)
        if block is not None:
            yield from scored(packed, answers)

    return run


def score(docs: DataFrame, order: int = 3, least: int = 2, alpha: float = 0.4, block_bytes: int = BLOCK_BYTES, least_row: int = LEAST_ROW) -> DataFrame:
    """One row per document: doc_id, n_words, log_score and n_backoffs under the stupid-backoff model of all documents.

    Words are runs without [\\x20\\x09-\\x0D], A-Z lower-cased, of whole texts. A word's score is
    count(n-gram) / count(its first n - 1 words) for the longest n-gram up to the order that ends at it and
    that the corpus has at least `least` times, times alpha for each longer one (within the document) that it
    has not; a single word's is its share of all words. log_score sums logarithms; n_backoffs sums the steps
    down. A null text or one without words has 0 words and the score 0. Counts are over all documents, exact
    up to hashes of log2(words) + 30 bits (64 at most), which give an n-gram another's count with a chance of
    2^-30 or so. Rows that repeat are scored each. block_bytes and
    least_row size blocks and tables, not results.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size, total = docs.agg(F.sum(F.octet_length("text")), F.sum(n_words(F.col("text")))).first()
    size, total = size or 0, total or 0
    block_bytes = max(block_bytes, math.isqrt(size * least_row))
    tables, bits = max(1, math.ceil(size / block_bytes)), min(64, max(2, total).bit_length() + 30)
    spread = math.ceil(tables / max(1, docs.rdd.getNumPartitions()))
    asked = docs.mapInArrow(_ask(order, tables, block_bytes, bits, spread), _ROW)
    answers = asked.repartitionById(tables, F.col("table").cast("int")).sortWithinPartitions("table", "block").mapInArrow(_answer, _ROW)
    blocks = answers.repartitionById(tables, F.pmod("home", F.lit(tables)).cast("int")).sortWithinPartitions("block", "table")
    return blocks.mapInArrow(_score(order, least, alpha, int(total), bits), "doc_id bigint, n_words bigint, log_score double, n_backoffs bigint")
