"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from galley.llm import textvec
from galley.operators import tables as scratch

#: A table of sources of more bytes is joined by a shuffle, not broadcast.
BROADCAST_BYTES = 8 << 20


@F.arrow_udf(LongType())
def n_words(text: pa.Array) -> pa.Array:
    """The number of runs of characters other than [\\x20\\x09-\\x0D]; a null text has none."""
    counts = [np.zeros(0, np.int64)]
    for _, texts in textvec.slices(text):
        starts, _ = texts.words()
        counts.append(np.bincount(texts.text_of(starts), minlength=texts.n))
    return pa.array(np.concatenate(counts), pa.int64())


def rates(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) for sizes (source, size).

    The sources by code point (null last) take the weights in turn and share the sum of all sizes; a
    target stops at most times its source's size, and the excess is shared anew by weight until no
    target is above. Only sums leave the executors: the sources themselves stay a table.
    """
    spark = sizes.sparkSession
    sums = scratch.keep(sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")))
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    parts = max(1, sums.count() // 100_000)
    dealt = scratch.keep(sums.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before, seen = {}, 0
    for part, n in sorted(map(tuple, dealt.groupBy("part").count().collect())):
        before[part], seen = seen, seen + n
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("part")] if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + offset
    share = F.array(*map(F.lit, weights))[(place % len(weights)).cast("int")]
    ranked = scratch.keep(dealt.select("source", "source_size", share.cast("bigint").alias("weight")))
    scratch.drop(spark, sums, dealt)

    cap = F.col("source_size") * most
    wide = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("decimal(19,0)")
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight, capped = total or 0, weight or 0, 0
    left, share_of, ended = total, weight, not weight
    while not ended:  # the sources above their cap only grow: weights' shares of what is left rise
        above = wide(cap) * wide(share_of) < wide(left) * wide(F.col("weight"))
        taken, w, n = ranked.where(above).agg(F.sum(cap), F.sum("weight"), F.count("*")).first()
        left, share_of, ended, capped = total - (taken or 0), weight - (w or 0), n == capped or weight == (w or 0), n
    if not weight:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    above = wide(cap) * wide(share_of) < wide(left) * wide(F.col("weight")) if share_of else F.lit(True)
    fair = (wide(left) * wide(F.col("weight"))).cast("double") / F.lit(float(share_of or 1))
    return ranked.select("source", "source_size", F.when(above, cap.cast("double")).otherwise(fair).alias("target"))


def _mixed(docs: DataFrame, seed: str, weights: tuple[int, ...], most: int) -> DataFrame:
    """(row, size, source_size, target, copies): row holds the columns of docs."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sized = docs.select(row.alias("row"), n_words(F.col("text").cast("string")).alias("size"))
    table = scratch.keep(rates(sized.select(F.col("row.source").alias("source"), "size"), weights, most))
    small = table.agg(F.count("*"), F.sum(F.octet_length(F.col("source").cast("string")))).first()
    if 40 * small[0] + (small[1] or 0) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    joined = sized.join(table, F.col("row.source").eqNullSafe(F.col("source")))
    return joined.select("row", "size", "source_size", "target", copies.cast("bigint").alias("copies"))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each document.

    A document is taken floor(rate) times, and once more with the probability that is left of the rate,
    target / source_size, by a hash of its doc_id and the seed: reruns agree, rows that repeat a doc_id
    are taken alike. The size is the number of words; a null source is a source, a null doc_id hashes as
    the text null. A source without words has the target 0 and no copies of its documents are taken.
    What a source takes has its target as its mean; its standard error is the root of the summed
    size^2 p (1 - p) of its documents, p the fraction of the rate. New columns whose name docs has
    already get underscores in front.
    """
    names = scratch.free_names(docs.columns, "size", "source_size", "target", "copies")
    mixed = _mixed(docs, seed, weights, most)
    own = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return mixed.select(*own, *[F.col(c).alias(n) for c, n in zip(("size", "source_size", "target", "copies"), names, strict=True)])


def emit(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: the columns of docs, each document as often as it is taken."""
    taken = _mixed(docs, seed, weights, most).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")
