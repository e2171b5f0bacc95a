"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document's set holds its distinct word shingles. Its sketch has t places: in round i < t every
element falls into the place that a hash of that round gives it, in round t + j every element into
place j, and a place keeps its least (round, hash). So every place fills after 2 t rounds at the
latest, most after a few, and two sketches agree at a place with the probability of the sets'
similarity, concentrated as with t independent places (Dahlgaard, Knudsen, Thorup 2017).

Steps: documents with the same words form a class, of which one stands for all; equal bands of
sketches put classes into buckets; each bucket's members are confirmed against its first one on full
sets; in buckets whose members are then not all in one component, those outside the largest one are
confirmed against all, in tiles. Links are looked for until all pairs that share a bucket are confirmed,
refuted or known to be in one component, so banding alone decides what can be missed: see bands_for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm import textvec
from galley.operators import tables as scratch
from galley.operators.graph import connected_components

#: Members of a unit of confirmation: beside a leader, and on either side of a tile. Tiles hold at most
#: twice as many sets at a time; smaller ones would send a text more often.
TILE, WIDE_TILE = 64, 256


def bands_for(threshold: float, miss: float = 1e-7, places: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows with which a pair at the threshold shares no band with at most this probability, within so many places."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
        if bands * rows <= places:
            return bands, rows
    raise ValueError("no banding fits")


def sketch(of: np.ndarray, key: np.ndarray, n: int, t: int) -> np.ndarray:
    """(n, t) sketches of n sets, given as elements with the set that each is of, ordered by set. An empty set's places stay at the largest value."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, top)
    count = np.bincount(of, minlength=n)
    left = np.flatnonzero(count)
    cell, elements = of * t, key
    for i in range(2 * t):
        h = textvec.mix(elements + textvec.u64((i + 1) * 0xA0761D6478BD642F))
        place = ((h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, cell + place, (np.uint64(i) << np.uint64(54)) | (textvec.mix(h) >> np.uint64(10)))
        open_ = (out.reshape(n, t)[left] == top).any(axis=1)
        if not open_.all():
            left = left[open_]
            if not len(left):
                break
            going = np.zeros(n, bool)
            going[left] = True
            stay = going[cell // t]
            cell, elements = cell[stay], elements[stay]
    return out.reshape(n, t)


def _sketches(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in textvec.slices(batch.column("text")):
                of, key, sums = textvec.shingles(texts, k)
                made = sketch(of, key, texts.n, bands * rows)
                h = made.reshape(texts.n, bands, rows)
                band = textvec.mix(h[:, :, 0])
                for j in range(1, rows):
                    band = textvec.mix(band * np.uint64(0x9E3779B97F4A7C15) + h[:, :, j])
                count = np.bincount(of, minlength=texts.n).astype(np.int64)
                some = count > 0
                offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, texts.n).cast(pa.int64()), pa.array(count), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), lists],
                    names=["doc_id", "n_shingles", "s0", "s1", "bands"],
                )

    return run


def _confirm(k: int, percent: int):
    """Rows (unit, side, doc_id, comp, text) in the order of units become links (a, b)."""

    def linked(left: list, right: list) -> list[tuple[int, int]]:
        found = []
        for a, ca, x in left:
            for b, cb, y in right:
                if a == b or ca == cb:
                    continue  # the same document, or known to be in one group
                less, more = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(less) < percent * len(more) or not len(less):
                    continue
                at = np.searchsorted(more, less)
                at[at == len(more)] = 0
                both = int((more[at] == less).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    found.append((a, b))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sides = None, ([], [])
        for batch in batches:
            links: list[tuple[int, int]] = []
            units, side, ids, comps = (batch.column(c).to_pylist() for c in ("unit", "side", "doc_id", "comp"))
            for row, texts in textvec.slices(batch.column("text")):
                of, key, _ = textvec.shingles(texts, k)
                cut = np.searchsorted(of, np.arange(texts.n + 1))
                for i in range(texts.n):
                    r = row + i
                    if units[r] != unit:
                        links += linked(*sides)
                        unit, sides = units[r], ([], [])
                    sides[side[r]].append((ids[r], comps[r], key[cut[i] : cut[i + 1]].copy()))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        links = linked(*sides)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    return run


def _confirmed(units: DataFrame, texts: DataFrame, k: int, percent: int, parts: int) -> DataFrame:
    """Links of units (unit, side, doc_id, comp); the texts are fetched by a join whose skewed keys Spark splits."""
    rows = units.join(texts, "doc_id").select("unit", "side", "doc_id", "comp", "text")
    return rows.repartition(parts, "unit").sortWithinPartitions("unit", "side", "doc_id").mapInArrow(_confirm(k, percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-7, tile: int = TILE, wide_tile: int = WIDE_TILE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept, in groups linked by similar sets of k-word shingles.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets (A-Z lower-cased
    words between white space; a document of fewer than k words has its word sequence as its only
    shingle). component_id is the smallest doc_id that links reach, kept says that it is the document's.
    A null text, or one without words, has an empty set and is linked with nothing. A null doc_id takes
    no part: its component_id is null and it is kept. Rows that share a doc_id are one node; each is
    returned. Other columns, whatever their names, are left alone. tile and wide_tile size the units of
    confirmation, not results.
    """
    spark = docs.sparkSession
    bands, rows = bands_for(percent / 100, miss)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    made = scratch.keep(docs.mapInArrow(_sketches(k, bands, rows), "doc_id bigint, n_shingles bigint, s0 bigint, s1 bigint, bands array<bigint>"))
    some = made.where("doc_id is not null and n_shingles > 0")

    # One row per class of equal word sequences: the smallest doc_id stands for it.
    classes = scratch.keep(some.groupBy("s0", "s1").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("m")).select("s0", "s1", "m.*"))
    copies = some.join(classes.select("s0", "s1", F.col("doc_id").alias("a")), ["s0", "s1"]).where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct()

    # Buckets: the classes that share a band. By the band, one of three orders says who leads a bucket, so a
    # member of a large group meets several leaders.
    placed = classes.select("doc_id", F.posexplode("bands").alias("band", "h"))
    first = F.min(F.struct(F.xxhash64("doc_id", F.pmod("band", F.lit(3))).alias("x"), "doc_id"))
    shared = placed.groupBy("band", "h").agg(first["doc_id"].alias("leader"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("band", "h", "leader")
    members = scratch.keep(placed.join(shared, ["band", "h"]))
    # The texts that are compared. Most are not: the shuffle is the only one of all texts.
    texts = docs.where("doc_id is not null")
    if made.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        texts = texts.groupBy("doc_id", F.xxhash64("text"), F.md5(F.col("text"))).agg(F.first("text").alias("text")).select("doc_id", "text")
    texts = scratch.keep(texts.join(members.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"))

    # First every member against its leader, in chunks by a hash of the member.
    star = members.where("doc_id != leader").select("leader", "doc_id").distinct()
    size = star.groupBy("leader").agg(F.ceil(F.count("*") / tile).alias("chunks"))
    star = scratch.keep(star.join(size, "leader").withColumn("unit", F.struct("leader", F.pmod(F.xxhash64("doc_id"), "chunks").alias("i"), F.lit(0).cast("bigint").alias("j"))))
    units = star.select("unit", F.lit(1).alias("side"), "doc_id").union(star.select("unit", F.lit(0), F.col("leader")).distinct())
    links = scratch.keep(_confirmed(units.withColumn("comp", F.col("doc_id")), texts, k, percent, parts))

    # Then the pairs of a bucket that are in different components still. Members outside the bucket's largest
    # component are left over; tiles of these meet tiles of all members.
    reach = scratch.keep(connected_components(links, scratch.keep, lambda *old: scratch.drop(spark, *old)))
    known = members.join(reach.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "h", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    mixed = (
        known.groupBy("band", "h", "comp")
        .agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("sig"))
        .groupBy("band", "h")
        .agg(F.max(F.struct("n", "comp"))["comp"].alias("most"), F.max("n").alias("of_most"), F.sum("n").alias("n"), F.sum("sig").alias("sig"))
        .where("of_most < n and n > 2")  # of two members, the only pair is refuted
        .groupBy("n", "sig")
        .agg(F.min(F.struct("band", "h", "most", (F.col("n") - F.col("of_most")).alias("over"))).alias("m"))  # buckets with the same members count once
        .select("m.band", "m.h", "m.most", F.ceil(F.col("n") / wide_tile).alias("tiles"), F.ceil(F.col("m.over") / wide_tile).alias("over"))
    )
    left = known.join(mixed, ["band", "h"])
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64("doc_id"), n)
    over = left.where("comp != most").select("band", "h", at("over").alias("i"), upto("tiles").alias("j"), F.lit(0).alias("side"), "doc_id", "comp")
    all_ = left.select("band", "h", upto("over").alias("i"), at("tiles").alias("j"), F.lit(1).alias("side"), "doc_id", "comp")
    unit = F.struct(F.col("band").cast("bigint").alias("band"), "h", "i", "j").alias("unit")
    more = scratch.keep(_confirmed(over.union(all_).select(unit, "side", "doc_id", "comp"), texts, k, percent, parts))
    reach2 = connected_components(links.union(more).union(copies), scratch.keep, lambda *old: scratch.drop(spark, *old))
    reach2 = scratch.keep(reach2.where("node != component").withColumnRenamed("node", "doc_id"))
    scratch.drop(spark, classes, members, texts, star, links, reach, more)
    return made.join(reach2, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component").isNull(), F.lit(True)).alias("kept")
    )


def first_of_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that near_duplicates() does not keep; all columns stay. Of rows that repeat a doc_id, all stay or go."""
    gone = near_duplicates(docs.select("doc_id", "text"), k, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(gone, F.col("row.doc_id").cast("bigint") == F.col("gone"), "left_anti").select("row.*")
