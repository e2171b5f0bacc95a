"""SentencePiece encoding and decoding as a weighted finite-state transducer over the tropical semiring.

A model file compiles into three machines, kept as arc tables. The normaliser N rewrites each character (the
space to the meta symbol) and puts a meta symbol in front. The lexicon L is a trie: its states are prefixes of
pieces, its arcs characters; a state that completes a piece has an arc that writes the piece, and a character
that is no piece has arcs that write its bytes or the unknown piece. The grammar G weighs pieces. In a unigram
model G has one state and weighs a piece by its negated score. In a BPE model G's states are pieces, and the
arc from one to the next weighs 0 if merging their characters by rank yields just these two, else infinity: a
BPE encoding is the one sequence all of whose neighbouring pairs weigh 0.

A text is composed with N, then with L and G on the fly: states are (place in the text, state of G), and the
weight of an arc is looked up in G when the arc is reached. The path of least weight (tropical semiring: least
of sums) is found best first, by weight and then by place. Where all finite weights are 0, as in BPE, that
order is depth first and the agenda a stack.

No piece holds a meta symbol behind another character, and some characters (the line feed, say) are in
no piece of several characters; the path passes such places whatever comes before or after, so a text
is cut there and the paths of the parts are kept in a bounded cache.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from galley.operators import tables

META = "▁"
#: Kinds of pieces in the model format: normal 1, unknown 2, control 3, user-defined 4, unused 5, byte 6.
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
#: Model types in the model format.
UNIGRAM, BPE = 1, 2
#: An unknown character weighs so much more than the heaviest piece of a unigram model.
UNKNOWN_WEIGHT = 10.0
#: Parts whose paths, and pairs whose weights, a worker keeps: of the parts so many of either generation, the
#: older of which it forgets when the younger is full; the pairs it forgets beyond.
CACHE_PARTS, CACHE_PAIRS = 300_000, 400_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while at < len(data):
        key = varint()
        match key & 7:
            case 0:
                yield key >> 3, varint()
            case 1:
                yield key >> 3, data[at : at + 8]
                at += 8
            case 2:
                n = varint()
                yield key >> 3, data[at : at + n]
                at += n
            case 5:
                yield key >> 3, struct.unpack("<f", data[at : at + 4])[0]
                at += 4


class Model:
    """The pieces of a model file, with what its normaliser does."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.dummy_prefix = UNIGRAM, True
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                self.dummy_prefix = bool(spec.get(3, 1))
                if spec.get(2, b"") or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models whose normaliser is the identity are supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if any(kind == USER for _, _, kind in self.pieces):
            raise ValueError("models with user-defined pieces are not supported")


class Normaliser:
    """N: one state, an arc for each character that it rewrites; the others stand for themselves."""

    def __init__(self, model: Model):
        self.arcs = {" ": META}
        self.start = META if model.dummy_prefix else ""

    def apply(self, text: str) -> str:
        if not text:
            return ""
        for a, b in self.arcs.items():
            text = text.replace(a, b)
        return self.start + text


class Lexicon:
    """L: a trie of nodes {character: node}; a node that completes a piece has its number under "". Characters that are no piece have numbers behind the pieces'."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.root = ["", *pieces], {}
        self.longest = max(map(len, self.pieces))
        for number, p in enumerate(pieces, 1):
            node = self.root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = number

    def text(self, number: int) -> str:
        return self.pieces[number] if number < len(self.pieces) else chr(number - len(self.pieces))

    def arcs(self, text: str, at: int) -> list[int]:
        """The numbers of the pieces that begin at a place, the shortest first; the first is of one character."""
        out, node = [], self.root
        for c in text[at : at + self.longest]:
            node = node.get(c)
            if node is None:
                break
            number = node.get("")
            if number is not None:
                out.append(number)
        if text[at] not in self.root or "" not in self.root[text[at]]:
            out.insert(0, len(self.pieces) + ord(text[at]))
        return out


#: Numbers of pieces and characters are below 1 << SHIFT.
SHIFT = 22


class Transducer:
    """N, L and G of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.score = {p: model.pieces[i][1] for p, i in self.ids.items()}
        self.rank = {p: -x for p, x in self.score.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
        self.normaliser, self.lexicon = Normaliser(model), Lexicon(list(self.ids))
        self.written = [b"", *(struct.pack("<i", i) for i in self.ids.values())]
        self.heaviest = max((-x for x in self.score.values()), default=0.0)
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        self.cuts_at_meta = not any(META in p.lstrip(META) for p in self.ids)
        self.cuts_at_line = "\n" not in inner
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The characters of a short text merged by rank, the leftmost of equal ranks first."""
        s, rank = list(text), self.rank
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                r = rank.get(s[i] + s[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def allowed(self, a: int, b: int) -> bool:
        """Whether BPE's G gives the pair of numbers weight 0; 0 is the beginning."""
        found = self.pairs.get(a << SHIFT | b)
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            x, y = self.lexicon.text(a), self.lexicon.text(b)
            found = self.pairs[a << SHIFT | b] = self.merged(x + y) == ([x, y] if a else [y])
        return found

    def weight(self, number: int) -> float:
        """The weight that a unigram model's G gives a piece."""
        return -self.score[self.lexicon.pieces[number]] if number < len(self.written) else self.heaviest + UNKNOWN_WEIGHT

    def path(self, part: str) -> list[int]:
        """The numbers of the pieces along the path of least weight through a normalised part."""
        return self._lightest(part) if self.model.kind == UNIGRAM else self._finite(part)

    def _lightest(self, part: str) -> list[int]:
        """Places in order, as arcs lead forward: the least weight of each, and the arc that gives it."""
        n, text = len(part), self.lexicon.text
        least, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for at in range(n):
            for number in self.lexicon.arcs(part, at):
                w, end = least[at] + self.weight(number), at + len(text(number))
                if w < least[end]:
                    least[end], back[end] = w, number
        out, end = [], n
        while end:
            out.append(back[end])
            end -= len(text(back[end]))
        return out[::-1]

    def _finite(self, part: str) -> list[int]:
        """The path of weight 0: the agenda is a stack of the arcs left at each place; a state (a place and the piece that ends there) is entered once."""
        n, arcs_at, pairs, allowed, pieces = len(part), self.lexicon.arcs, self.pairs, self.allowed, self.lexicon.pieces
        known = len(pieces)
        out: list[int] = []
        at, last, arcs = 0, 0, arcs_at(part, 0)
        agenda: list[tuple[int, int, list[int]]] = []
        dead: set[tuple[int, int]] = set()
        while at < n:
            while arcs:
                number = arcs.pop()
                ok = pairs.get(last << SHIFT | number)
                if (allowed(last, number) if ok is None else ok) and (not dead or (at, number) not in dead):
                    break
            else:  # no arc from here: back to the state before
                if not agenda:
                    raise ValueError("the grammar has no path")
                out.pop()
                gone = last
                at, last, arcs = agenda.pop()
                dead.add((at, gone))
                continue
            agenda.append((at, last, arcs))
            out.append(number)
            at, last = at + (len(pieces[number]) if number < known else 1), number
            if at < n:
                arcs = arcs_at(part, at)
        return out

    def part(self, part: str) -> bytes:
        """The ids of a normalised part as 32-bit integers."""
        found = self.old.get(part)
        if found is None:
            found, before, known = b"", 0, len(self.written)
            for number in self.path(part):
                if number < known:
                    found += self.written[number]
                elif self.bytes:
                    found += b"".join(struct.pack("<i", self.bytes[b]) for b in self.lexicon.text(number).encode())
                elif self.model.kind == BPE or before < known:  # a unigram model joins unknown characters
                    found += struct.pack("<i", self.unknown)
                before = number
        if len(part) <= 64:
            if len(self.parts) >= CACHE_PARTS:
                self.old, self.parts = self.parts, {}
            self.parts[part] = found
        return found

    def cut(self, text: str) -> list[str]:
        """The parts of a text, normalised."""
        text = self.normaliser.apply(text)
        if not self.cuts_at_meta or not text:
            return [text] if text else []
        if META + META in text or not self.cuts_at_line:
            return re.findall(rf"{META}*[^{META}\n]+|{META}+|\n" if self.cuts_at_line else rf"{META}*[^{META}]+|{META}+", text)
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append("\n")
            head, *rest = line.split(META)
            if head:
                out.append(head)
            out += [META + w for w in rest]
        return out

    def encode(self, text: str) -> np.ndarray:
        get, part = self.parts.get, self.part
        return np.frombuffer(b"".join([get(x) or part(x) for x in self.cut(text)]), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes of neighbouring byte pieces are read as UTF-8; one space in front goes."""
        if not hasattr(self, "table"):
            back = {i: b for b, i in self.bytes.items()}
            self.table = [bytes([back[i]]) if i in back else (p.replace(META, " ").encode() if kind == NORMAL else b" \xe2\x81\x87 " if kind == UNKNOWN else b"") for i, (p, _, kind) in enumerate(self.model.pieces)]
        text = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_compiled: dict[int, Transducer] = {}


def _encoder(data: bytes):
    key = hash(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _compiled.get(key)
        if fst is None:
            _compiled.clear()
            fst = _compiled[key] = Transducer(Model(data))
        for batch in batches:
            column = batch.column("text")
            for row in range(0, len(column), 512):
                texts = column.slice(row, 512).to_pylist()
                ids = [None if t is None else fst.encode(t) for t in texts]
                sizes = np.array([0 if x is None else len(x) for x in ids])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([*(x is None for x in ids), False]))
                flat = np.concatenate([np.zeros(0, np.int32), *(x for x in ids if x is not None)])
                back = [None if x is None else fst.decode(x) for x in ids]
                n = pa.array([None if x is None else len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(row, 512), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), n, pa.array(back, pa.string())], names=["row", "ids", "n_tokens", "decoded"])

    return run


def encode(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs with ids (array<int>), n_tokens (bigint) and decoded, the text that the ids decode to.

    ids equal what the sentencepiece library gives for the model; decoded equals the text, but for a meta
    symbol in it, which the model reads as a space. A null text gives nulls, an empty one no ids. The model
    file is read on the driver and goes to the workers with the function: its size is that of a vocabulary.
    New columns whose name is kept already get underscores in front.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    Model(data)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = StructType([rows.schema["row"], StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("decoded", StringType())])
    out = rows.mapInArrow(_encoder(data), schema)
    names = tables.free_names(list(keep), "ids", "n_tokens", "decoded")
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], *[F.col(c).alias(n) for c, n in zip(("ids", "n_tokens", "decoded"), names, strict=True)])


def decode(rows: DataFrame, model_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """rows with the texts of their arrays of ids in column out, which must be new; null ids give null."""
    with open(model_path, "rb") as f:
        data = f.read()
    size = len(Model(data).pieces)

    @F.pandas_udf("string")
    def back(column):
        fst = _compiled.get(hash(data)) or _compiled.setdefault(hash(data), Transducer(Model(data)))
        return column.map(lambda x: None if x is None else fst.decode(np.asarray(x, np.int64)))

    if out in rows.columns:
        raise ValueError(f"column {out} is there already")
    return rows.withColumn(out, F.when(F.forall(ids, lambda i: i.between(0, size - 1)), back(F.col(ids))))
