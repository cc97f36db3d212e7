"""Byte-level BPE: boundaries by a scan of transition functions, merges by cache, decoding by offsets.

Classes of code points are those of the Python on the executors (`unicodedata.unidata_version`, 15.1 for Python 3.13).
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import slices, utf8, without

#: Character classes, then what the scan reads: classes refined by the characters that follow.
OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)
SYM_LETTER, SYM_NUMBER, SYM_OTHER, SYM_SHORT, SYM_LONG, SYM_INNER, SYM_BLANK, SYM_LAST = range(8)
#: States: what the characters before have opened.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, PREFIX, ONE_LEFT, TWO_LEFT, FRESH = range(8)
COLUMNS = 64
CACHE = 250_000
SHORT = 48
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, from its Unicode category; white space as the pattern's \\s has it."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
        elif kind == "Z":
            table[point] = SPACE
    table[[9, 10, 11, 12, 13, 0x85]] = SPACE
    table[32] = BLANK
    return table


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at this character."""
    if state in (ONE_LEFT, TWO_LEFT):
        return (FRESH if state == ONE_LEFT else ONE_LEFT), False
    if symbol in (SYM_LETTER, SYM_NUMBER, SYM_OTHER, SYM_SHORT, SYM_LONG):
        run = {SYM_LETTER: IN_LETTERS, SYM_NUMBER: IN_NUMBERS}.get(symbol, IN_OTHERS)
        if state in (run, PREFIX):
            return run, False
        if symbol == SYM_SHORT:
            return ONE_LEFT, True
        if symbol == SYM_LONG:
            return TWO_LEFT, True
        return run, True
    if symbol == SYM_INNER:
        return IN_SPACES, state != IN_SPACES
    return (PREFIX if symbol == SYM_BLANK else FRESH), True


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(of symbol, composition, result by function and state, start by state and symbol).

    The functions from state to state that symbols induce are few; composing them is a table lookup,
    and that is associative. Symbols from 8 on open a text: their function forgets the state.
    """
    base = [tuple(step(s, y)[0] for s in range(8)) for y in range(8)] + [(step(FRESH, y)[0],) * 8 for y in range(8)]
    found = [tuple(range(8))]
    index = {found[0]: 0}
    for f in found:
        for g in base:
            h = tuple(g[x] for x in f)
            if h not in index:
                index[h] = len(found)
                found.append(h)
    size = len(found)
    compose = np.array([[index.get(tuple(g[x] for x in f), 0) for g in found] for f in found], np.uint16)
    starts = np.array([[step(s, y)[1] for y in range(8)] + [True] * 8 for s in range(8)])
    return np.array([index[g] for g in base], np.uint16), compose.reshape(size, size), np.array(found, np.uint8), starts


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What the scan reads, from code points and the positions where texts begin."""
    kind = classes()[points]
    opens = np.zeros(len(points) + 2, bool)
    opens[first] = True
    opens[len(points) :] = True
    out = np.array([SYM_OTHER, SYM_LETTER, SYM_NUMBER, SYM_LAST, SYM_BLANK], np.uint8)[kind]
    blank = kind >= SPACE
    after = np.append(blank[1:], True) | opens[1:-1]
    out[blank & after] = SYM_INNER
    at = np.flatnonzero(points == 39)
    if len(at):
        padded = np.concatenate([points, [0, 0]])
        one, two = np.where(opens[at + 1], 0, padded[at + 1]), 0
        two = np.where(opens[at + 1] | opens[np.minimum(at + 2, len(opens) - 1)], 0, padded[at + 2])
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = SYM_SHORT
        out[at[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = SYM_LONG
    out[np.flatnonzero(opens[:-2])] += 8
    return out


def starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which pieces start, of texts that begin at `first`.

    Rows of COLUMNS characters are composed column by column, all rows at once; the rows' functions
    are composed by doubling; then each row runs from the state that it really starts in.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    of, compose, result, begins = monoid()
    symbol = symbols(points, first)
    rows = -(-n // COLUMNS)
    padded = np.zeros(rows * COLUMNS, np.uint8)
    padded[:n] = symbol
    grid = np.ascontiguousarray(padded.reshape(rows, COLUMNS).T)
    whole = of[grid[0]]
    for k in range(1, COLUMNS):
        whole = compose[whole, of[grid[k]]]
    reach = 1
    while reach < rows:
        whole[reach:] = compose[whole[:-reach], whole[reach:]]
        reach *= 2
    state = np.full(rows, FRESH, np.uint8)
    state[1:] = result[whole[:-1], FRESH]
    move = result[of][:, :].T  # state by symbol
    flags = np.empty((COLUMNS, rows), bool)
    for k in range(COLUMNS):
        flags[k] = begins[state, grid[k]]
        state = move[state, grid[k]]
    return np.flatnonzero(flags.T.ravel()[:n])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank, leftmost first, merges until none is known."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= SHORT:
        return _merge_short(piece, ranks)
    after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(piece[i : ends[j]])) is not None:
            heapq.heappush(queue, (rank, i, ends[j]))

    queue: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, end = heapq.heappop(queue)
        j = after[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue
        alive[j], ends[i], after[i] = False, end, after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same over a plain list, which is faster while the list is short."""
    get, never = ranks.get, 1 << 62
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], never) for i in range(len(piece) - 1)]
    while pairs and (low := min(pairs)) < never:
        i = pairs.index(low)
        joined = parts[i] + parts[i + 1]
        parts[i : i + 2] = [joined]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(joined + parts[i + 1], never)
        if i:
            pairs[i - 1] = get(parts[i - 1] + joined, never)
    return [ranks[p] for p in parts]


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encodes and decodes by the ranks of one vocabulary file; the cache of pieces is bounded."""

    def __init__(self, path: str):
        self.ranks = ranks_of(path)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}

    def __missing(self, piece: str) -> tuple[int, ...]:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        ids = tuple(merge(piece.encode("utf-8"), self.ranks))
        if len(piece) <= 256:
            self.cache[piece] = ids
        return ids

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, offset of each piece in characters) of each text of a UTF-8 buffer."""
        text = data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = lead[offsets]
        cuts = starts(points, at[:-1][at[:-1] < at[1:]])
        bounds = np.searchsorted(cuts, at)
        cache, missing = self.cache, self.__missing
        for i in range(len(offsets) - 1):
            own = cuts[bounds[i] : bounds[i + 1]]
            edges = [*own.tolist(), int(at[i + 1])]
            parts = [text[a:b] for a, b in zip(edges, edges[1:])]  # noqa: B905
            try:
                found = [cache[p] for p in parts]
            except KeyError:
                found = [cache.get(p) or missing(p) for p in parts]
            yield np.fromiter(chain.from_iterable(found), np.int32), (own - at[i]).astype(np.int32)

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        return next(self.encode_all(raw, np.array([0, len(raw)], np.int64)))[0].tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with ids (array<int>) and starts (array<int>: where the pieces start, in characters).

    Null and empty texts have no ids. Repeated rows are encoded alike, other columns pass through (one
    named ids or starts gives way), an empty table gives none. Texts are encoded whole, whatever their
    length; memory is bounded by a text, and a piece of n bytes takes n log n steps. `path` is a
    vocabulary file that every executor has; it is read there and never shipped. With `decoded`, the
    bytes that the ids decode to come along, in the same pass.
    """
    added = ("ids", "starts", "decoded") if decoded else ("ids", "starts")
    rest = without(docs, *added)

    def run(stream):
        codec = Codec(path)
        for batch in stream:
            data, offsets = utf8(batch.column(text))
            for i, j in slices(offsets, CHUNK):
                found = list(codec.encode_all(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                columns = [*batch.slice(i, j - i).columns, _lists([x for x, _ in found]), _lists([x for _, x in found])]
                if decoded:
                    columns.append(pa.array([codec.decode(x) for x, _ in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *added])

    return rest.mapInArrow(run, _ddl(rest) + "ids array<int>, starts array<int>" + ", decoded binary" * decoded)


def _ddl(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with decoded (binary): the bytes of its ids; null ids give no bytes."""
    rest = without(encoded, "decoded")

    def run(stream):
        codec = Codec(path)
        for batch in stream:
            out = [codec.decode(np.array(ids or (), np.int32)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return rest.mapInArrow(run, _ddl(rest) + "decoded binary")
