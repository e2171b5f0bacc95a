"""Line deduplication by levelled sorted runs of line hashes, with DataFrame functions only.

An index holds runs: tables of (h1, h2, n) in buckets by hash, each bucket sorted, where n documents have a
line whose key has that 128-bit hash. A batch of documents is merge-anti-joined with the runs held: keys that
a run already counts in enough documents are settled and are not stored again; the others make the batch's own
run, at level 0. Two runs of a level are compacted into one of the next by a merge join. Buckets and order are
alike in all runs, so neither of the joins shuffles or deals a run anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators import tables as scratch

#: White space stripped from a line to make its key: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def once(value: Column, then) -> Column:
    """then(value), where value is computed once however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text between \\n; a null text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys(text: Column, min_chars: int) -> Column:
    """The hash of each line's key, null for a key of fewer characters.

    The text is lower-cased as a whole: lower() agrees with A-Z to a-z where all characters are single bytes.
    """
    whole = F.coalesce(text, F.lit(""))
    folded = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))

    def key(line: Column) -> Column:
        k = F.btrim(line, F.lit(SPACE))
        return F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")))

    return F.transform(F.split(folded, "\n", -1), key)


def distinct_keys(text: Column, min_chars: int) -> Column:
    """The distinct hashes of a text's keys, by one sort: a text may have any number of lines."""
    return once(F.sort_array(keys(text, min_chars)), lambda k: F.filter(k, lambda x, i: x.isNotNull() & ((i == 0) | ~x.eqNullSafe(F.get(k, i - 1)))))


class LineIndex:
    """Runs by level, of documents (doc, text) added batch by batch; with firsts they hold the smallest doc of each key too."""

    def __init__(self, spark: SparkSession, at_least: int = 10, min_chars: int = 1, firsts: bool = False):
        self.spark, self.at_least, self.min_chars, self.firsts = spark, at_least, min_chars, firsts
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[DataFrame | None] = []

    def add(self, docs: DataFrame) -> None:
        """Adds a run of the batch's own lines that no run has settled; a document counts once for a key."""
        first = ["doc"] if self.firsts else []
        own = docs.select(*first, F.explode(distinct_keys(F.col("text"), self.min_chars)).alias("k")).select("k.*", *first)
        own = own.groupBy(*KEY).agg(F.count("*").alias("n"), *([F.min("doc").alias("first")] if self.firsts else []))
        # With firsts a settled key's smallest document may be in this batch still: the run keeps the key then.
        for run in self.runs():
            settled = run.where(F.col("n") >= self.at_least)
            if self.firsts:
                settled = settled.select(*KEY, F.col("first").alias("before"))
                own = own.join(settled.hint("merge"), [*[own[k] == settled[k] for k in KEY], own["first"] >= settled["before"]], "left_anti")
            else:
                own = own.join(settled.select(*KEY).hint("merge"), KEY, "left_anti")
        self._put(0, scratch.keep_sorted(own, KEY, self.buckets))

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append(None)
        other = self.levels[level]
        if other is None:
            self.levels[level] = run
            return
        self.levels[level] = None
        merged = scratch.keep_sorted(self.merged(other, run), KEY, self.buckets)
        scratch.drop(self.spark, other, run)
        self._put(level + 1, merged)

    def merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one, by a full merge join of their buckets."""
        name = lambda df, p: df.select(*[F.col(c).alias(c if c in KEY else f"{p}_{c}") for c in df.columns])
        first = [F.least("a_first", "b_first").alias("first")] if self.firsts else []
        count = F.coalesce("a_n", F.lit(0)) + F.coalesce("b_n", F.lit(0))
        return name(a, "a").hint("merge").join(name(b, "b"), KEY, "full_outer").select(*KEY, count.alias("n"), *first)

    def runs(self) -> list[DataFrame]:
        return [run for run in self.levels if run is not None]

    def found_in(self, at_least: int | None = None) -> DataFrame:
        """(h1, h2), and first if held, of keys that so many documents have (at_least, or fewer); the runs are compacted to one."""
        runs = self.runs()
        while len(runs) > 1:
            merged = scratch.keep_sorted(self.merged(runs[0], runs[1]), KEY, self.buckets)
            scratch.drop(self.spark, *runs[:2])
            runs = [merged, *runs[2:]]
        self.levels = [*[None] * (len(self.levels) - 1), *runs]
        return runs[0].where(F.col("n") >= (at_least or self.at_least)).drop("n")

    def free(self) -> None:
        scratch.drop(self.spark, *self.runs())
        self.levels = []


def without_lines(docs: DataFrame, gone: DataFrame, min_chars: int = 1) -> DataFrame:
    """docs with text freed of the lines whose key's hash is in gone, n_lines (before) and n_dropped; a null text becomes an empty one.

    Where gone has a column first, the lines of the documents with that doc_id stay. New columns whose name
    docs has already get underscores in front.

    The hashes, not the texts, go through the join with gone; a document's row then meets the places of its lines to drop.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    id_, text = F.col("row.doc_id"), F.col("row.text")
    me = [F.xxhash64(id_, text).alias("r1"), F.xxhash64(text, id_).alias("r2")]
    firsts = "first" in gone.columns
    doc = [id_.alias("doc")] if firsts else []
    placed = rows.select(*me, *doc, F.posexplode(keys(text, min_chars)).alias("at", "k")).where("k is not null").select("r1", "r2", *(["doc"] if firsts else []), "at", "k.h1", "k.h2")
    hit = placed.join(gone, KEY).where(~F.col("doc").eqNullSafe(F.col("first"))) if firsts else placed.join(gone, KEY, "left_semi")
    out = hit.groupBy("r1", "r2").agg(F.collect_set("at").alias("out"))
    met = rows.select("row", *me).join(out, ["r1", "r2"], "left")

    def kept(split: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("out"))
        return F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n")

    freed = F.when(F.col("out").isNull(), F.coalesce(text, F.lit(""))).otherwise(once(lines(text), kept))
    n_lines, n_dropped = scratch.free_names(docs.columns, "n_lines", "n_dropped")
    return met.select(
        *[freed.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns],
        F.size(lines(text)).cast("bigint").alias(n_lines),
        F.coalesce(F.size("out"), F.lit(0)).cast("bigint").alias(n_dropped),
    )


def drop_repeated_lines(docs: DataFrame, at_least: int = 10, min_chars: int = 1, batches: int = 4, keep_first: bool = False) -> DataFrame:
    """docs with text freed of the lines that at_least documents have, and n_lines and n_dropped.

    Lines are what \\n separates (a null or empty text has one empty line); a line's key is the line
    without white space at its ends and with A-Z lower-cased; a key of fewer than min_chars characters
    is never dropped. Every row counts as a document, repeated ones too. The documents come as batches
    by a hash of doc_id; each adds its run to an index, and then all are filtered by what the index holds.
    With keep_first the document of the smallest doc_id that has a line keeps it (all rows of that doc_id do).
    Other columns stay as they are, whatever their names and types.
    """
    index = LineIndex(docs.sparkSession, at_least, min_chars, firsts=keep_first)
    rows = docs.select(F.col("doc_id").alias("doc"), "text")
    for i in range(batches):
        index.add(rows.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == i))
    gone = scratch.keep(index.found_in())
    index.free()
    return without_lines(docs, gone, min_chars)
