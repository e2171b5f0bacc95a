"""Chat formatting: conversations rebuilt from their event logs and rendered with a loss mask.

Events are rows (conv_id, seq, kind, message_id, role, text); kinds:
  message     opens a message (null message_id: a message by itself, which later events cannot name)
  delta       adds text to the message that it names
  edit        replaces the text of the message that it names
  regenerate  empties the message that it names, and drops the messages opened after that message and before this event
Within a conversation events go by seq; ties put messages first, then go by kind, role and text. Nulls: a null
kind is a message, a null text is empty, a null seq comes first, a null conv_id is a conversation. An event
that names a message which no earlier event opened has no effect. A message event whose id is open already
adds its text to that message. A regeneration counts even if another one drops its message.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.operators import tables

TURN, END = "<|im_start|>", "<|im_end|>"
#: Characters of a segment of rendered turns, at most (a single longer turn is one segment).
SEGMENT = 1 << 20


def escape(text: str) -> str:
    """Without control strings: < before | gets a backslash behind it, and one more where there are some."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text) of the final messages; seq and role are those of the event that opened the message.

    The log is partitioned by message and sorted; what the last edit or regeneration replaced goes before texts
    are gathered, so that a row holds no more than its final text. What a regeneration drops is found by running
    maxima over ranges of a conversation, so that no conversation is gathered.
    """
    e = events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "message_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    opens = F.col("kind") == "message"
    alone = e.where(opens & F.col("message_id").isNull()).select("conv_id", "seq", "role", "text", F.lit(None).cast(events.schema["seq"].dataType).alias("again"))
    key = ["conv_id", "message_id"]
    log = Window.partitionBy(*key).orderBy("seq", ~opens, "kind", "role", "text")
    whole = Window.partitionBy(*key)
    named = e.where("message_id is not null").withColumns({"place": F.row_number().over(log), "open": F.max(opens).over(log.rowsBetween(Window.unboundedPreceding, Window.currentRow))}).where("open")
    last = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("place"))).over(whole)
    named = named.withColumns({"from": F.coalesce(last, F.lit(0)), "first": F.min("place").over(whole)})
    lasting = F.when((F.col("place") >= F.col("from")) & F.col("kind").isin("message", "delta", "edit"), F.struct("place", "text"))
    opener = F.when(F.col("place") == F.col("first"), F.struct("seq", "role"))
    folded = named.groupBy(*key).agg(F.max(opener).alias("o"), F.array_sort(F.collect_list(lasting)).alias("texts"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"))
    folded = folded.select("conv_id", "o.seq", "o.role", F.array_join("texts.text", "").alias("text"), "again")
    final = alone.unionByName(folded)
    if not e.where("kind = 'regenerate'").limit(1).count():
        return final.drop("again")
    return _without_dropped(final)


def _without_dropped(messages: DataFrame) -> DataFrame:
    """Messages but those opened behind a message and before its regeneration (again); that depends on conv_id and seq alone, so texts stay where they are."""
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    messages = tables.keep(messages)
    dealt = tables.keep(messages.groupBy("conv_id", "seq").agg(F.max("again").alias("again")).repartitionByRange(n, "conv_id", "seq").withColumn("part", F.spark_partition_id()))
    # The latest regeneration of messages of earlier ranges, then of earlier messages of the same range.
    ranges = dealt.groupBy("conv_id", "part").agg(F.max("again").alias("high"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranges.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.max("high").over(before).alias("carry"))
    met = dealt.join(carry, dealt["conv_id"].eqNullSafe(carry["c"]) & (dealt["part"] == carry["p"]))
    own = F.max("again").over(Window.partitionBy("conv_id", "part").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1))
    until = F.greatest("carry", own)  # skips nulls
    gone = tables.keep(met.withColumn("until", until).where(F.col("until") > F.col("seq")).select(F.col("conv_id").alias("c"), F.col("seq").alias("s")))
    return messages.join(gone, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seq") == F.col("s")), "left_anti").select("conv_id", "seq", "role", "text")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order become segments of conversations."""
    conv, open_ = None, False
    first: list = [None, None]
    parts: list[str] = []
    spans: list[dict] = []
    size = turns = number = 0
    out: list[tuple] = []

    def close() -> None:
        nonlocal parts, spans, size, turns, number
        if parts:
            out.append((conv, first[0], number, "".join(parts), spans, turns))
            number += 1
        parts, spans, size, turns = [], [], 0, 0

    def batch_of() -> pa.RecordBatch:
        nonlocal out
        made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=["conv_id", "first_seq", "number", "formatted", "loss", "n_turns"])
        out = []
        return made

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.int64()]
    for batch in batches:
        for c, seq, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "seq", "role", "text")), strict=True):
            if not open_ or c != conv or size >= SEGMENT:
                close()
                if not open_ or c != conv:
                    number = 0
                conv, open_, first = c, True, [seq]
            head, body = f"{TURN}{escape_role(role)}\n", escape(text)
            if role == "assistant":
                spans.append({"start": size + len(head), "stop": size + len(head) + len(body)})
            parts.append(f"{head}{body}{END}\n")
            size += len(parts[-1])
            turns += 1
        if len(out) >= 512:
            yield batch_of()
    close()
    yield batch_of()


def render(messages: DataFrame) -> DataFrame:
    """Segments (conv_id, part, first_seq, number, formatted, loss, n_turns) of rendered conversations.

    A turn reads <|im_start|>role, a line feed, the text, <|im_end|>, a line feed; control strings in roles
    and texts are escaped, reversibly. loss holds the places (in code points of formatted) of the assistant
    texts. Messages are dealt out by ranges of (conv_id, seq), so a conversation of any length spreads over
    tasks; its segments in the order of part and number, one after another, are its text.
    """
    order = ["conv_id", "seq", "role", "text"]
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("seq").cast("bigint").alias("seq"), "role", "text").repartitionByRange(n, *order).sortWithinPartitions(*order)
    made = dealt.mapInArrow(_render, "conv_id bigint, first_seq bigint, number bigint, formatted string, loss array<struct<start:bigint,stop:bigint>>, n_turns bigint")
    return made.withColumn("part", F.spark_partition_id())


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a rendered text."""
    for turn in formatted.split(TURN)[1:]:
        role, _, text = turn.partition("\n")
        yield unescape_role(role), unescape(text[: -len(END) - 1])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order become one row per conversation; only running hashes and counts are kept."""
    conv, state, out = None, None, []

    def close() -> None:
        if state:
            out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def batch_of() -> pa.RecordBatch:
        nonlocal out
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        out = []
        return made

    for batch in batches:
        for c, formatted, loss in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss")), strict=True):
            if state is None or c != conv:
                close()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in loss:
                learnt = unescape(formatted[span["start"] : span["stop"]])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
            state[4] += len(formatted)
        yield batch_of()
    close()
    yield batch_of()


def digest(segments: DataFrame) -> DataFrame:
    """One row per conversation, read back from its segments: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = segments.select("conv_id", "part", "number", "formatted", "loss").repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "number")
    return dealt.mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
