"""Exact removal of repeated strings of bytes or words by suffix sorting: difference covers, one suffix bucket at a time."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, batches, mix, slices, utf8, without, words_at
from graphloom.llm.shingles import word_bounds, word_names

#: Bytes of a repeated string and of the gram that anchors it; words of the gram where words are the symbols.
LENGTH, GRAM, WORD_GRAM = 400, 32, 16
CHUNK, ROWS = 1 << 20, 1000
ADDED = ("removed", "kept", "_t1", "_t2", "_spans", "_bytes")
#: Up to this many names of texts (16 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_TEXTS = 500_000
#: Positions within a chunk take so many bits of a sliding minimum's key; a longer text is cut into
#: overlapping pieces, so that every text is anchored by the same rule.
BITS = 26
PIECE = 1 << 25
#: Bytes of text that one suffix sort takes on, and distinct slices of one anchor from which on their
#: windows are counted by Spark instead of being sorted in one task.
BLOCK, HOT = 1 << 20, 4000


# --- suffix sorting of one block -------------------------------------------------------------------


@lru_cache(maxsize=4)
def difference_cover(v: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """(D, shift): residues D mod v such that for any two residues i, j one d = shift[i, j] < v has
    i + d and j + d both in D. Found by a greedy search over the differences not yet covered."""
    chosen: list[int] = [0]
    while len({(a - b) % v for a in chosen for b in chosen}) < v:
        have = {(a - b) % v for a in chosen for b in chosen}
        chosen.append(max((x for x in range(v) if x not in chosen), key=lambda x: (len({(x - a) % v for a in chosen} | {(a - x) % v for a in chosen} - have) - len(({(x - a) % v for a in chosen} | {(a - x) % v for a in chosen}) & have), -x)))
    cover = np.zeros(v, bool)
    cover[chosen] = True
    shift = np.zeros((v, v), np.int64)
    for i in range(v):
        for j in range(v):
            shift[i, j] = next(d for d in range(v) if cover[(i + d) % v] and cover[(j + d) % v])
    return np.flatnonzero(cover), shift


def _names(*columns: np.ndarray) -> np.ndarray:
    """Ranks of rows by their columns in turn; equal rows share one."""
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), np.int64)
    for c in columns:
        fresh[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


class CoverSample:
    """Ranks of the suffixes at cover positions by their first `depth` bytes, by doubling.

    The text is read as if zeros followed it; callers never compare past the end of a slice.
    """

    def __init__(self, data: np.ndarray, depth: int, v: int = 31):
        self.v, n = v, len(data)
        cover, self.shift = difference_cover(v)
        inside = np.zeros(v, bool)
        inside[cover] = True
        at = np.flatnonzero(inside[np.arange(n + v) % v])
        padded = np.concatenate([data, np.zeros(2 * v + 40, np.uint8)])
        eight = words_at(padded).byteswap()  # big-endian numbers sort as the bytes do
        whole, rest = divmod(v, 8)
        columns = [eight[at + 8 * k] for k in range(whole)]
        if rest:
            columns.append(eight[at + 8 * whole] >> np.uint64(64 - 8 * rest))
        rank = _names(*columns)
        place = np.full(n + 2 * v + 1, -1, np.int64)
        place[at] = np.arange(len(at))
        reach = v
        while reach < depth and (len(rank) and rank.max() + 1 < len(rank)):
            there = np.minimum(at + reach, n + 2 * v)  # a multiple of v on, so a cover position again
            after = np.where(place[there] >= 0, rank[place[there]], -1)
            rank = _names(rank, after)
            reach *= 2
        self.rank = np.zeros(n + 2 * v + 1, np.int64)
        self.rank[at] = rank


def sort_suffixes(data: np.ndarray, at: np.ndarray, depth: int, v: int = 31, aligned: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(order, tied): positions `at` sorted by the bytes from each on, `depth` of them at least; tied[i]
    if the first `depth` bytes of entry i equal those of entry i - 1.

    Buckets of one first byte are sorted one at a time, eight bytes a pass and only where all before
    are equal. Suffixes still equal after v bytes are settled by the precomputed ranks of the cover
    sample: at the shift of their two residues both have one. Within a bucket of equal v bytes,
    positions of one residue need one lookup each; positions of different residues are merged by
    pairwise comparison (`aligned` says that equal suffixes never differ in residue).
    """
    sample = CoverSample(data, depth, v)
    eight = words_at(np.concatenate([data, np.zeros(depth + v + 8, np.uint8)])).byteswap()
    buckets = [_sort_bucket(eight, at[data[at] == first], sample, aligned) for first in np.unique(data[at])]
    order = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
    tied = np.zeros(len(order), bool)
    rows = np.arange(1, len(order))
    for k in range(0, depth, 8):
        odd = eight[order[rows] + k] ^ eight[order[rows - 1] + k]
        if k + 8 > depth:
            odd >>= np.uint64(8 * (k + 8 - depth))
        rows = rows[odd == 0]
    tied[rows] = True
    return order, tied


def _sort_bucket(eight: np.ndarray, at: np.ndarray, sample: CoverSample, aligned: bool) -> np.ndarray:
    v = sample.v
    order = at[np.argsort(eight[at], kind="stable")]
    same = np.zeros(len(order), bool)  # equal to the entry before, as far as was read
    same[1:] = eight[order[1:]] == eight[order[:-1]]
    for k in range(8, v, 8):
        tie = same.copy()
        tie[:-1] |= same[1:]
        rows = np.flatnonzero(tie)
        if not len(rows):
            return order
        group = np.cumsum(~same)[rows]
        word = eight[order[rows] + k]
        if k + 8 > v:
            word = word >> np.uint64(8 * (k + 8 - v))
        by = np.lexsort((word, group))
        order[rows] = order[rows][by]
        word = word[by]
        equal = np.zeros(len(rows), bool)
        equal[1:] = (group[1:] == group[:-1]) & (word[1:] == word[:-1])
        same[rows] = equal
    tie = same.copy()
    tie[:-1] |= same[1:]
    rows = np.flatnonzero(tie)
    if not len(rows):
        return order
    group, own = np.cumsum(~same)[rows], order[rows]
    residue = own % v
    own = own[np.lexsort((sample.rank[own + sample.shift[residue, residue]], residue, group))]
    if not aligned:
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        for a, b in zip(starts, np.append(starts[1:], len(rows)), strict=True):
            if (own[a:b] % v != own[a] % v).any():
                own[a:b] = _merge(own[a:b], sample)
    order[rows] = own
    return order


def _merge(at: np.ndarray, sample: CoverSample) -> np.ndarray:
    from functools import cmp_to_key

    def compare(i: int, j: int) -> int:
        d = sample.shift[i % sample.v, j % sample.v]
        a, b = sample.rank[i + d], sample.rank[j + d]
        return int(a > b) - int(a < b)

    return np.array(sorted(at.tolist(), key=cmp_to_key(compare)))


def repeated(parts: list[tuple[bytes, int]], counts: np.ndarray, length: int = LENGTH, v: int = 31, width: int = 1) -> list[np.ndarray]:
    """For slices (bytes, offset of the core that their bucket shares) which of their windows of `length`
    bytes occur twice; windows start at every width-th byte.

    Slices are laid out so that their cores start at multiples of v: equal windows of one bucket then
    have equal residues. A slice counted more than once repeats as it is.
    """
    sizes = np.array([len(b) for b, _ in parts])
    starts, at = np.zeros(len(parts), np.int64), 0
    for i, (b, core) in enumerate(parts):
        at += (-(at + core)) % v
        starts[i] = at
        at += len(b)
    data = np.zeros(at, np.uint8)
    for i, (b, _) in enumerate(parts):
        data[starts[i] : starts[i] + len(b)] = np.frombuffer(b, np.uint8)
    windows = (sizes - length) // width + 1
    first = np.repeat(starts - width * np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + width * np.arange(windows.sum())
    order, tied = sort_suffixes(data, first, length, v, aligned=True)
    twice = tied.copy()
    twice[:-1] |= tied[1:]
    flags = np.zeros(at + 1, bool)
    flags[order[twice]] = True
    return [flags[s : s + width * w : width] | (c > 1) for s, w, c in zip(starts, windows, counts, strict=True)]


# --- anchors -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Unit:
    """What texts are strings of: bytes, or words (runs of anything but ASCII white space, each known by a
    name of 8 bytes); the symbols of a repeated string and of the gram that anchors it."""

    words: bool
    length: int
    gram: int

    @property
    def width(self) -> int:
        return 8 if self.words else 1

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return word_names(data, offsets, lower=False) if self.words else (data, offsets)

    def grams(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols) - self.gram + 1
        name = np.zeros(n, np.uint64)
        if self.words:
            for k in range(self.gram):
                name = name * np.uint64(0x9E3779B97F4A7C15) + symbols[k : k + n]
        else:
            eight = words_at(symbols)
            for k in range(0, self.gram, 8):
                name = (name ^ eight[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                name ^= name >> np.uint64(29)
        return mix(name)


BYTES = Unit(False, LENGTH, GRAM)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    rows = -(-len(x) // width)
    grid = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    grid[: len(x)] = x
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored(symbols: np.ndarray, offsets: np.ndarray, unit: Unit = BYTES) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor, its name) of every run of windows that share an anchor.

    The anchor of a window of `unit.length` symbols is its smallest gram by hash, the leftmost of equals:
    the window's content alone decides it, so equal windows have it at the same place.
    """
    n, length = len(symbols), unit.length
    empty = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n < length:
        return empty
    name = unit.grams(symbols)
    low = np.uint64((1 << BITS) - 1)
    best = sliding_minimum((name & ~low) | np.arange(len(name), dtype=np.uint64), length - unit.gram + 1)
    anchor = (best & low).astype(np.int64)
    change = np.zeros(len(anchor) + 1, np.int32)
    whole = offsets[1:] - offsets[:-1] >= length
    np.add.at(change, offsets[:-1][whole], 1)
    np.add.at(change, offsets[1:][whole] - length + 1, -1)
    valid = np.cumsum(change[:-1]) > 0
    edge = np.ones(len(anchor), bool)
    edge[1:] = anchor[1:] != anchor[:-1]
    edge[offsets[:-1][whole]] = True
    begin = np.flatnonzero(valid & edge)
    if not len(begin):
        return empty
    row = np.searchsorted(offsets, begin, side="right") - 1
    stop = np.minimum(np.append(begin[1:], n), offsets[row + 1] - length + 1) - 1
    return row, begin, stop, anchor[begin], name[anchor[begin]]


SEGMENT = "t1 long, t2 long, c int, s int, e int, p int, key long, name long"


def _within(row: np.ndarray, s: np.ndarray, e: np.ndarray, key: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, times, begin, end): which segments are the first of their kind in a text, how often each of
    those occurs there, and the first and last segments of runs that follow one another and all occur there
    more than once. Periodic text, where each window has an anchor of its own, is a few rows this way."""
    order = np.lexsort((s, name, key, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (row[order][1:] != row[order][:-1]) | (key[order][1:] != key[order][:-1]) | (name[order][1:] != name[order][:-1])
    group, sizes = np.cumsum(fresh) - 1, np.diff(np.append(np.flatnonzero(fresh), len(order)))
    times = np.empty(len(order), np.int64)
    times[order] = sizes[group]
    again = times > 1
    joined = np.zeros(len(order), bool)
    joined[1:] = again[1:] & again[:-1] & (row[1:] == row[:-1]) & (s[1:] == e[:-1] + 1)
    begin = np.flatnonzero(again & ~joined)
    end = np.flatnonzero(again & ~np.append(joined[1:], False))
    first = np.sort(order[fresh])
    return first, times[first], begin, end


def _segments(texts: DataFrame, unit: Unit) -> DataFrame:
    """Runs of windows with one anchor of each text (t1, t2, c, text): first and last start and anchor, counted
    in symbols from the text's start, the anchor's name and the run's; c: how often it is there, copies of the
    text counted. Rows without a key are runs that repeat within their own text."""

    def run(stream):
        for batch in stream:
            data, offsets = utf8(batch.column("text"))
            t1, t2, copies = (batch.column(c).to_numpy() for c in ("t1", "t2", "c"))
            for i, j in slices(offsets, CHUNK):
                symbols, own = unit.symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for skip in range(0, max(1, len(symbols)), PIECE) if j == i + 1 else (0,):
                    part = symbols[skip : skip + PIECE + unit.length - 1] if j == i + 1 else symbols
                    at = np.array([0, len(part)]) if j == i + 1 else own
                    row, s, e, p, key = anchored(part, at, unit)
                    raw, w = part.tobytes(), unit.width
                    name = [xxhash.xxh3_64_intdigest(raw[w * x : w * (y + unit.length)], seed=z - x) for x, y, z in zip(s.tolist(), e.tolist(), p.tolist(), strict=True)]
                    base = at[row] - skip if len(row) else row
                    key, name = key.astype(np.uint64).view(np.int64), np.array(name, np.uint64).view(np.int64)
                    one, times, begin, end = _within(row, s, e, key, name)
                    yield rows(t1[i + row[one]], t2[i + row[one]], copies[i + row[one]] * times, (s - base)[one], (e - base)[one], (p - base)[one], pa.array(key[one]), pa.array(name[one]))
                    if len(begin):
                        none = pa.nulls(len(begin), pa.int64())
                        yield rows(t1[i + row[begin]], t2[i + row[begin]], np.zeros(len(begin)), (s - base)[begin], (e - base)[end], np.zeros(len(begin)), none, none)

    def rows(t1, t2, c, s, e, p, key, name):
        return pa.RecordBatch.from_arrays([pa.array(t1), pa.array(t2), *[pa.array(x.astype(np.int32)) for x in (c, s, e, p)], key, name], names=["t1", "t2", "c", "s", "e", "p", "key", "name"])

    return texts.select("text", "t1", "t2", "c").mapInArrow(run, SEGMENT)


def _cut(texts: DataFrame, unit: Unit) -> DataFrame:
    """The symbols of every open segment of each text, from its first window's start to its last one's end."""
    kinds = "key long, t1 long, t2 long, s int, core int, c long, d long, slice binary"

    def run(stream):
        for batch in stream:
            rows, held = [], 0
            columns = [batch.column(c) for c in ("t1", "t2", "text", "open")]
            for t1, t2, text, found in zip(*columns, strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                symbols = unit.symbols(raw, np.array([0, len(raw)]))[0]
                for x in found.as_py():
                    part = symbols[x["s"] : x["e"] + unit.length].tobytes()
                    rows.append((x["key"], t1.as_py(), t2.as_py(), x["s"], (x["p"] - x["s"]) * unit.width, x["c"], x["d"], part))
                    held += len(part)
                    if held > CHUNK:
                        yield _slices(rows)
                        rows, held = [], 0
            if rows:
                yield _slices(rows)

    def _slices(rows):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "t1", "t2", "s", "core", "c", "d", "slice"])

    return texts.mapInArrow(run, kinds)


def _runs(t1: list, t2: list, s: list, flags: list[np.ndarray], length: int) -> pa.RecordBatch:
    """Spans of symbols covered by the flagged windows of each slice."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for a, b, at, twice in zip(t1, t2, s, flags, strict=True):
        step = np.diff(np.concatenate([[0], twice.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(begin):
            for o, v in zip(out, (np.full(len(begin), a), np.full(len(begin), b), begin + at, end - 1 + at + length), strict=True):
                o.append(v)
    whole = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
    return pa.RecordBatch.from_arrays([pa.array(whole[0], pa.int64()), pa.array(whole[1], pa.int64()), pa.array(whole[2].astype(np.int32)), pa.array(whole[3].astype(np.int32))], names=["t1", "t2", "s", "e"])


SPAN = "t1 long, t2 long, s int, e int"


def _sorted_spans(cut: DataFrame, unit: Unit) -> DataFrame:
    """Suffix sorting, block by block: a partition's slices come in the order of their anchors, and a
    block ends with an anchor once it holds BLOCK bytes, so one block bounds a task's memory."""

    def run(stream):
        held: list[dict] = []
        size = 0

        def solve():
            parts = [(x["slice"], x["core"]) for x in held]
            flags = repeated(parts, np.array([x["c"] for x in held]), unit.length * unit.width, width=unit.width)
            return _runs([x["t1"] for x in held], [x["t2"] for x in held], [x["s"] for x in held], flags, unit.length)

        for batch in stream:
            for row in batch.to_pylist():
                if held and size >= BLOCK and row["key"] != held[-1]["key"]:
                    yield solve()
                    held, size = [], 0
                held.append(row)
                size += len(row["slice"])
        if held:
            yield solve()

    return cut.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPAN)


def _counted_spans(cut: DataFrame, unit: Unit) -> DataFrame:
    """The same for the slices of hot anchors: windows are counted by anchor, place and name."""
    kinds = "key long, place int, w1 long, w2 long, t1 long, t2 long, s int, c long"
    width, length = unit.width, unit.length

    def run(stream):
        for batch in stream:
            for row in batch.to_pylist():
                raw = row["slice"]
                n = len(raw) // width - length + 1
                names = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[i * width : (i + length) * width]) for i in range(n)]), np.int64).reshape(-1, 2)
                at = np.arange(n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["key"])), pa.array(at - np.int32(row["core"] // width)), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array(np.full(n, row["t1"])), pa.array(np.full(n, row["t2"])), pa.array(at + np.int32(row["s"])), pa.array(np.full(n, row["c"]))], names=["key", "place", "w1", "w2", "t1", "t2", "s", "c"])

    windows = cut.mapInArrow(run, kinds)
    name = ["key", "place", "w1", "w2"]
    twice = windows.groupBy(*name).agg(F.sum("c").alias("n")).where("n > 1").drop("n")
    return windows.join(twice, name).select("t1", "t2", "s", (F.col("s") + length).cast("int").alias("e"))


def _few(names: DataFrame) -> DataFrame:
    """names, marked for broadcast if they are few."""
    return F.broadcast(names) if names.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else names


def repeated_spans(texts: DataFrame, unit: Unit, scratch: Scratch) -> DataFrame:
    """(t1, t2, spans): for each text (t1, t2, text) with any, the spans of symbols, unmerged, that strings of
    unit.length symbols cover which start anywhere else as well.

    1. Texts that occur more than once repeat whole; one copy of each goes on, counted twice. Every window
       is anchored by content; windows with one anchor form a segment. A segment whose anchor and symbols
       occur again repeats whole; one whose anchor occurs nowhere else cannot repeat.
    2. The distinct segments of anchors that have several are the suffix buckets left to sort. They are
       cut from their texts and dealt by anchor, and each task sorts the suffixes of one block of
       buckets after the other.
    """
    spark, by = texts.sparkSession, ["t1", "t2"]
    copied = scratch.put(texts.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by), "copied")
    named = _few(copied)
    single = texts.join(named, by, "left_anti").withColumn("c", F.lit(1))
    once = texts.join(named, by, "left_semi").groupBy(*by).agg(F.first("text").alias("text")).withColumn("c", F.lit(2))
    texts = single.select("t1", "t2", "text", "c").unionByName(once)
    with batches(spark, ROWS):
        found = scratch.put(_segments(texts, unit), "segments")
    own = found.where("key is null")
    found = found.where("key is not null")
    classes = scratch.put(found.groupBy("key", "name").agg(F.sum("c").alias("c"), F.min(F.struct("t1", "t2", "s", "e", "p")).alias("x")), "classes")
    whole = found.where("c = 1").join(classes.where("c > 1").select("key", "name"), ["key", "name"], "left_semi")
    whole = scratch.put(whole.unionByName(own).select("t1", "t2", "s", (F.col("e") + unit.length).cast("int").alias("e")), "whole")
    several = classes.groupBy("key").agg(F.count("*").alias("d")).where("d > 1")
    lists = classes.join(several, "key").groupBy("x.t1", "x.t2").agg(F.collect_list(F.struct("key", "x.s", "x.e", "x.p", "c", "d")).alias("open"))
    lists = scratch.put(lists, "open")
    opened = texts.join(_few(lists.select(*by)), by, "left_semi").join(lists, by)
    with batches(spark, ROWS):
        cut = scratch.put(_cut(opened.select("t1", "t2", F.col("text").cast("binary").alias("text"), "open"), unit), "cut")
        spans = whole.unionByName(scratch.put(_sorted_spans(cut.where(F.col("d") <= HOT), unit), "cold"))
        hot = cut.where(F.col("d") > HOT)
        if not hot.isEmpty():
            spans = spans.unionByName(scratch.put(_counted_spans(hot, unit), "hot"))
    spans = spans.unionByName(copied.select(*by, F.lit(0).alias("s"), F.lit((1 << 31) - 1).alias("e")))
    spans = scratch.put(spans.groupBy(*by).agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    scratch.drop("copied", "segments", "classes", "whole", "open", "cut", "cold", "hot")
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def dedup(docs: DataFrame, text: str = "text", words: int | None = None) -> DataFrame:
    """docs with removed (array<struct<s, e>>: maximal byte spans) and kept (binary: the bytes left).

    Each byte that a string of LENGTH bytes covers which also starts elsewhere, in this row or another,
    is removed; strings are judged on the input, and never cross rows. With `words` (WORD_GRAM at least), strings
    of so many words are judged instead, whatever their bytes and the white space between them; a span
    then reaches from a first word's start to a last word's end.

    Null counts as empty. Shorter texts keep everything. Rows with equal texts of a string's length or
    more lose all of them. Texts are handled whole, long ones in overlapping pieces. An empty table gives
    no rows; input columns named like one of ADDED give way.

    Texts are known by two 64-bit hashes. Equal texts meet once: what repeats is found per text, not
    per row, so a hot group of copies is one row in every join. Only texts that lose something pass
    a shuffle.
    """
    if words is not None and words < WORD_GRAM:
        raise ValueError(f"a string holds a gram of {WORD_GRAM} words")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    unit = BYTES if words is None else Unit(True, words, WORD_GRAM)
    rest = without(docs, *ADDED)
    keyed = rest.withColumn("_t1", F.xxhash64(F.coalesce(text, F.lit("")))).withColumn("_t2", F.xxhash64(F.lit("t2"), F.coalesce(text, F.lit(""))))
    every = keyed.select(F.coalesce(text, F.lit("")).alias("text"), F.col("_t1").alias("t1"), F.col("_t2").alias("t2"))
    spans = repeated_spans(every.where(F.octet_length("text") >= (LENGTH if words is None else 2 * words - 1)), unit, scratch)
    spans = spans.withColumnsRenamed({"t1": "_t1", "t2": "_t2", "spans": "_spans"})
    by = ["_t1", "_t2"]
    hit = _few(spans.select(*by))
    met = keyed.join(hit, by, "left_semi").join(spans, by)
    names = rest.columns

    def cut(data: np.ndarray, spans: list[dict]) -> list[tuple[int, int]]:
        if not unit.words:
            return merged([(x["s"], min(x["e"], len(data))) for x in spans])
        begin, end = word_bounds(data, np.array([0, len(data)]))
        return merged([(int(begin[x["s"]]), int(end[min(x["e"], len(begin)) - 1])) for x in spans if len(begin) >= unit.length])

    def run(stream):
        for batch in stream:
            removed, kept = [], []
            for spans, raw in zip(batch.column("_spans").to_pylist(), batch.column("_bytes"), strict=True):
                data = raw.as_buffer()
                runs = cut(np.frombuffer(data, np.uint8), spans)
                at, parts = 0, []
                for s, e in runs:
                    parts.append(data[at:s].to_pybytes())
                    at = e
                parts.append(data[at:].to_pybytes())
                removed.append([{"s": s, "e": e} for s, e in runs])
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(removed, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(kept, pa.binary())], names=[*names, "removed", "kept"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema.fields)
    raw = F.coalesce(text, F.lit("")).cast("binary")
    lost = met.select(*names, "_spans", raw.alias("_bytes")).mapInArrow(run, schema + "removed array<struct<s: int, e: int>>, kept binary")
    whole = keyed.join(hit, by, "left_anti").select(*names, F.array().cast("array<struct<s: int, e: int>>").alias("removed"), raw.alias("kept"))
    return lost.unionByName(whole)
