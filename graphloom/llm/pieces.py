"""SentencePiece BPE by prefix tables: the last token of every prefix, then the ids backwards.

A sequence of tokens is the encoding of its text exactly if each two neighbours are the encoding of theirs: merges are
taken by score and then by place, so what happens within two tokens is the same whether others stand around them
or not. So every prefix has one last token: among the tokens that end there (matches of an automaton over
all pieces), the one that its predecessor's own last token is compatible with.

Texts are cut where no piece of the vocabulary holds the two characters in a row: no merge can cross such a place.
"""

from __future__ import annotations

import codecs
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import slices, utf8, without

#: Encoded chunks and tested pairs that a worker remembers.
CACHE = 400_000
#: Bytes of text that are cut at once.
CHUNK = 1 << 20
#: The mark that stands for a space, piece types, the model type.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, raw[at : at + size]
        at += size


class Vocabulary:
    """Pieces, scores and settings of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            parts = list(_fields(file.read()))
        trainer, norm = (dict(chain.from_iterable(_fields(v) for f, v in parts if f == n)) for n in (2, 3))
        self.pieces: list[tuple[str, float, int]] = []
        for number, raw in parts:
            if number == 1:
                own = dict(_fields(raw))
                self.pieces.append((own.get(1, b"").decode("utf-8"), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
        self.dummy_prefix = bool(norm.get(3, 1))
        self.unknown = trainer.get(44, " ⁇ ".encode()).decode("utf-8")
        odd = {k for _, _, k in self.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}
        if trainer.get(3, 1) != BPE or not trainer.get(35, 0) or norm.get(2) or norm.get(4, 1) or not norm.get(5, 1) or trainer.get(24, 0) or odd:
            raise ValueError("only BPE models with byte fallback, spaces kept, without a normalisation table or user-defined pieces")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("graphloom-each-byte", _each_byte)


class Codec:
    """Encodes and decodes by one model file; what it remembers is bounded."""

    def __init__(self, path: str):
        known = vocabulary(path)
        self.dummy = SPACE if known.dummy_prefix else ""
        self.id = {p: i for i, (p, _, kind) in enumerate(known.pieces) if kind == NORMAL}
        self.score = {p: known.pieces[i][1] for p, i in self.id.items()}
        byte = {p: i for i, (p, _, kind) in enumerate(known.pieces) if kind == BYTE}
        self.byte = [byte[f"<0x{b:02X}>"] for b in range(256)]
        self.surface = [b"" if kind == CONTROL else known.unknown.encode() if kind == UNKNOWN else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode("utf-8") for p, _, kind in known.pieces]
        self.silent = {i for i, (_, _, kind) in enumerate(known.pieces) if kind == CONTROL}
        self.leads = {i for i, (p, _, kind) in enumerate(known.pieces) if kind == NORMAL and p.startswith(SPACE) and known.dummy_prefix}
        self.automaton = ahocorasick.Automaton()
        for piece in {*self.id, *chain.from_iterable(self.id)}:  # single characters are where merging starts, pieces or not
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.pairs = np.unique(np.fromiter((ord(a) << 32 | ord(b) for p in self.id for a, b in zip(p, p[1:])), np.uint64))  # noqa: B905
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.agree: dict[tuple[str, str], bool] = {}

    def compatible(self, left: str, right: str) -> bool:
        """Whether `left`, `right` is the encoding of left + right: merging them together must form both, and
        never join characters of the two. An empty left asks whether `right` encodes to itself."""
        found = self.agree.get((left, right))
        if found is None:
            if len(self.agree) >= CACHE:
                self.agree.clear()
            found = self.agree[left, right] = self.__merge(left, right)
        return found

    def __merge(self, left: str, right: str) -> bool:
        parts, edge, score = [*left, *right], len(left), self.score.get
        worth = [score(a + b) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while True:
            best = max((w for w in worth if w is not None), default=None)
            if best is None:
                return len(parts) == 1 + bool(left)
            i = worth.index(best)
            if i + 1 == edge:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            edge -= i + 1 < edge
            del worth[i]
            if i < len(worth):
                worth[i] = score(parts[i] + parts[i + 1])
            if i:
                worth[i - 1] = score(parts[i - 1] + parts[i])

    def tokens(self, chunk: str) -> list[str]:
        """The pieces of a chunk: the last token of each prefix from left to right, then back from the end."""
        last: list[str] = [""] * (len(chunk) + 1)
        compatible = self.compatible
        for end, piece in self.automaton.iter(chunk):
            end += 1
            at = end - len(piece)
            if not last[end] and (not at or last[at]) and compatible(last[at], piece):
                last[end] = piece
        out, at = [], len(chunk)
        while at:
            piece = last[at] or chunk[at - 1]
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    def __missing(self, chunk: str) -> tuple[int, ...]:
        if len(self.chunks) >= CACHE:
            self.chunks.clear()
        ids = tuple(chain.from_iterable((self.id[t],) if t in self.id else [self.byte[b] for b in t.encode("utf-8")] for t in self.tokens(chunk)))
        if len(chunk) <= 64:
            self.chunks[chunk] = ids
        return ids

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        ready = [self.dummy + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(ready)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.uint64)
        two = points[:-1] << np.uint64(32) | points[1:]
        held = np.minimum(np.searchsorted(self.pairs, two), max(len(self.pairs) - 1, 0))
        cuts = np.flatnonzero(self.pairs[held] != two) + 1 if len(self.pairs) else np.arange(1, len(points))
        at = np.cumsum([0, *map(len, ready)])
        first, past = np.searchsorted(cuts, at[:-1], side="right"), np.searchsorted(cuts, at[1:])
        chunks, missing = self.chunks, self.__missing
        for i in range(len(ready)):
            if at[i] == at[i + 1]:
                yield np.zeros(0, np.int32)
                continue
            edges = [int(at[i]), *cuts[first[i] : past[i]].tolist(), int(at[i + 1])]
            own = [whole[a:b] for a, b in zip(edges, edges[1:])]  # noqa: B905
            try:
                found = [chunks[c] for c in own]
            except KeyError:
                found = [chunks.get(c) or missing(c) for c in own]
            yield np.fromiter(chain.from_iterable(found), np.int32)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: one leading space goes, bytes that form no character become U+FFFD each. Control
        ids show nothing, but part the bytes on both sides of them."""
        if not self.silent.isdisjoint(ids):
            shown = [list(run) for silent, run in groupby(ids, self.silent.__contains__) if not silent]
            return "".join(self.__shown(run, k == 0) for k, run in enumerate(shown))
        return self.__shown(ids, True)

    def __shown(self, ids: list[int], leading: bool) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        return raw[leading and bool(ids) and ids[0] in self.leads :].decode("utf-8", "graphloom-each-byte")


def _ddl(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with ids (array<int>), as the sentencepiece library gives without begin or end ids.

    Null and empty texts have no ids; repeated rows are encoded alike; other columns pass through (one named
    ids or decoded gives way); an empty table gives none. Bytes of a text that are no UTF-8 count as U+FFFD. Texts
    are encoded whole, in time that grows with their length; memory is bounded by a text. `path` is a model file
    that every executor has. With `decoded`, the text that the ids decode to comes along, in the same pass.
    """
    added = ("ids", "decoded") if decoded else ("ids",)
    rest = without(docs, *added)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in stream:
            data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
            for i, j in slices(offsets, CHUNK):
                texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)]
                found = list(codec.encode_all(texts))
                at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                columns = [*batch.slice(i, j - i).columns, pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found)))]
                if decoded:
                    columns.append(pa.array([codec.decode(x.tolist()) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *added])

    return rest.mapInArrow(run, _ddl(rest) + "ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with decoded (string): the text of its ids, as the library's decode gives it; null ids give the
    empty text, null entries among them nothing."""
    rest = without(encoded, "decoded")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in stream:
            out = [codec.decode([i for i in ids or () if i is not None]) for ids in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return rest.mapInArrow(run, _ddl(rest) + "decoded string")
