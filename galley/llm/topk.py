"""Exact top-k by inner product: columnar branch and bound.

Candidates and queries are packed in blocks, each a matrix that holds one dimension after another
(vertical layout). A pair of blocks meets in one task: scores accumulate a group of dimensions at a time,
those that carry most mass first; what the remaining dimensions can still add is bounded by the sum over the
remaining groups of the products of the two norms, and candidates that cannot reach the floor of any query of
the strip any more are left out as the columns of the next groups are compacted. A query's floor is its k-th
best score of a first block, which all query blocks meet before the others. Queries that are alike share a
strip. Ties at the k-th place survive the bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.operators import tables as scratch

#: Vectors in a block of candidates and of queries; queries that share one compaction; dimensions in a group;
#: of so many candidates one is scored first, for a floor where none is given.
CANDIDATES, QUERIES, STRIP, GROUP, FLOOR_OF = 8192, 8192, 64, 16, 8
_PACKED = "dim int, block string, n int, ids binary, vectors binary"


def scaled(scale: float):
    """Rows (vec_id, embedding) become (vec_id, dim, v): the vector of floor(scale * x) as 64-bit integers; rows with a null or non-finite component go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            offsets = np.asarray(column.offsets).astype(np.int64)
            flat = np.asarray(column.values.cast(pa.float64()).fill_null(np.nan))
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(flat * scale)
                bad = ~np.isfinite(whole) | (np.abs(whole) >= 2.0**62)
            wrong = np.concatenate([[0], np.cumsum(bad)])
            ok = np.asarray(column.is_valid()) & (wrong[offsets[1:]] == wrong[offsets[:-1]]) & np.asarray(batch.column("vec_id").is_valid())
            ints = np.where(bad, 0, whole).astype("<i8")
            at = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(at)), pa.array((offsets[1:] - offsets[:-1])[at].astype(np.int32)), pa.array([ints[offsets[i] : offsets[i + 1]].tobytes() for i in at], pa.binary())],
                names=["vec_id", "dim", "v"],
            )

    return run


def _pack(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[list[int], list[bytes]]] = {}
        number = count()

        def block(dim: int) -> pa.RecordBatch:
            ids, rows = open_.pop(dim)
            ids = np.array(ids, "<i8")
            vectors = np.frombuffer(b"".join(rows), "<i8").reshape(len(ids), dim).T
            small = next((t for t in ("<i1", "<i2", "<i4") if not vectors.size or (vectors.min() >= np.iinfo(t).min and vectors.max() <= np.iinfo(t).max)), "<i8")
            name = f"{TaskContext.get().partitionId()}:{next(number)}"
            data = small.encode() + np.ascontiguousarray(vectors, small).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([name]), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data], pa.binary())], names=["dim", "block", "n", "ids", "vectors"])

        for batch in batches:
            for i, dim, v in zip(batch.column("vec_id").to_pylist(), batch.column("dim").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids, rows = open_.setdefault(dim, ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) == most:
                    yield block(dim)
        for dim in list(open_):
            yield block(dim)

    return run


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, data[:3].decode(), offset=3).reshape(dim, n)


def _alike(q: np.ndarray) -> np.ndarray:
    """An order of the queries (dim, n) in which those that are nearest to the same of a few of them stand together."""
    pivots = q[:, :: max(1, q.shape[1] // 32)]
    size = np.maximum(1e-9, np.sqrt((pivots**2).sum(axis=0)))
    return np.argsort(((pivots / size).T @ q).argmax(axis=0), kind="stable")


def block_top(
    q: np.ndarray, v: np.ndarray, qid: np.ndarray, vid: np.ndarray, k: int, floors: np.ndarray | None = None, group: int = GROUP, tally: list[float] | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, vec_ids, scores) of the k best candidates of each query, ties to smaller vec_id; q and v are (dim, n), whole numbers.

    Candidates below a query's floor may be left out; a query without one starts from the k-th best of every
    FLOOR_OF-th candidate. tally gets the share of the candidates that each strip
    still has behind each group but the last.
    """
    dim, n = v.shape
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(dim, 1)
    # Whole numbers in floats are exact below 2^24 and 2^53; beyond those Python's own are used, without bounds.
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
    order = np.argsort(-(v.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    turn = _alike(q.astype(np.float64)) if q.size else np.arange(q.shape[1])
    q, v, qid = q[order][:, turn].astype(kind), v[order].astype(kind), qid[turn]
    floors = np.full(len(qid), -np.inf) if floors is None else floors[turn]
    groups = [slice(i, min(i + group, dim)) for i in range(0, dim, group)]
    norms = lambda m: np.stack([np.sqrt((m[g].astype(np.float64) ** 2).sum(axis=0)) for g in groups]) if groups else np.zeros((0, m.shape[1]))
    q_norm, v_norm = norms(q), norms(v)
    some = np.arange(0, n, max(1, min(FLOOR_OF, n // (k + 1))))
    for s in range(0, q.shape[1], STRIP):
        qs, ids, floor = q[:, s : s + STRIP], qid[s : s + STRIP], floors[s : s + STRIP]
        if kind is not object and len(some) > k and not np.isfinite(floor).all():
            sure = np.where(vid[some][None, :] == ids[:, None], -np.inf, qs.T @ v[:, some])
            floor = np.maximum(floor, np.partition(sure, len(some) - k, axis=1)[:, len(some) - k])
        alive = np.arange(n)
        partial = np.zeros((len(ids), n), kind)
        for i, g in enumerate(groups):
            partial = partial + qs[g].T @ (v[g] if len(alive) == n else v[g][:, alive])
            if i + 1 == len(groups) or kind is object:
                continue
            slack = q_norm[i + 1 :, s : s + STRIP].T @ v_norm[i + 1 :, alive] * (1 + 1e-6) + 1e-6
            stay = ((partial + slack) >= floor[:, None]).any(axis=0)
            if tally is not None:
                tally.append(stay.sum() / max(1, n))
            if stay.mean() < 0.9:
                alive, partial = alive[stay], partial[:, stay]
        order_of = vid[alive]
        for j in range(len(ids)):
            ok = np.flatnonzero(order_of != ids[j])
            score = partial[j, ok]
            if len(ok) > k:
                kth = np.partition(score, len(ok) - k)[len(ok) - k]
                near = np.flatnonzero(score >= kth)
                ok, score = ok[near], score[near]
            best = np.lexsort((order_of[ok], -score))[:k] if kind is not object else np.array(sorted(range(len(ok)), key=lambda x: (-score[x], order_of[ok[x]]))[:k], int)
            yield int(turn[s + j]), order_of[ok[best]], score[best]


_FOUND = "q_block string, floors binary, found array<struct<query_id:bigint,vec_id:bigint,score:bigint>>"


def _search(k: int):
    """Pairs of blocks become one row each: the best candidates of the block for each query, and the queries' floors after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, v = _matrix(row["q_vectors"], row["q_n"], row["dim"]), _matrix(row["vectors"], row["n"], row["dim"])
                qid, vid = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                floors = np.full(len(qid), -np.inf) if row["floors"] is None else np.frombuffer(row["floors"], "<f8").copy()
                out: list[list] = [[], [], []]
                after = floors.copy()
                for j, ids, score in block_top(q, v, qid, vid, k, floors):
                    out[0].append(np.full(len(ids), qid[j]))
                    out[1].append(ids)
                    out[2].append(np.array([int(x) for x in score], np.int64) if score.dtype == object else score.astype(np.int64))
                    if len(ids) == k and score.dtype != object:
                        after[j] = max(after[j], float(score[-1]))
                flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
                found = pa.StructArray.from_arrays(flat, names=["query_id", "vec_id", "score"])
                yield pa.RecordBatch.from_arrays([pa.array([row["q_block"]]), pa.array([after.astype("<f8").tobytes()], pa.binary()), pa.ListArray.from_arrays([0, len(found)], found)], names=["q_block", "floors", "found"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of vectors by inner product of floor(scale * x), from rank 1, ties to smaller vec_id.

    Both have vec_id (bigint) and embedding (array of float or double). A query's own rows (of its vec_id) are
    no candidates; all, if fewer, are returned. Vectors that are null, have a null vec_id, or hold a null,
    non-finite or beyond 2^62 component take no part; vectors of different lengths never meet. Repeated
    query rows count once (the least of different vectors), repeated candidates each time. Scores beyond 64
    bits raise an error. block and query_block are vectors in a block: they size tasks, not results.
    """
    rows = lambda df: df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(scaled(scale), "vec_id bigint, dim int, v binary")
    candidates = scratch.keep(rows(vectors).mapInArrow(_pack(block), _PACKED))
    asked = rows(queries).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    n = max(1, math.ceil(asked.count() / query_block))
    asked = asked.repartition(n, "dim", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
    asked = scratch.keep(asked.mapInArrow(_pack(query_block), _PACKED).select("dim", F.col("block").alias("q_block"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))

    # Names of blocks only: which pairs of blocks meet. A block is sent once per block of the other side.
    named, q_named = candidates.select("dim", "block", "n"), asked.select("dim", "q_block")
    first = named.groupBy("dim").agg(F.max_by("block", F.struct("n", "block")).alias("block"))

    def meet(pairs: DataFrame, floors: DataFrame | None) -> DataFrame:
        pairs = scratch.keep(pairs)
        sides = pairs.join(candidates, ["dim", "block"]).join(asked, ["dim", "q_block"])
        sides = sides.join(floors, "q_block", "left") if floors is not None else sides.withColumn("floors", F.lit(None).cast("binary"))
        return scratch.keep(sides.repartition(max(1, pairs.count()), "block", "q_block").mapInArrow(_search(k), _FOUND))

    seed = meet(first.join(q_named, "dim"), None)
    others = named.join(first, ["dim", "block"], "left_anti").join(q_named, "dim").select("dim", "block", "q_block")
    found = seed.union(meet(others, seed.select("q_block", "floors"))).select(F.inline("found"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
