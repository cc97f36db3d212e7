"""Quality classifier: a generalised additive model with pairwise interactions over text statistics."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import batches, mix, slices, utf8, without, words_at

FEATURES = ("log_chars", "log_words", "word_length", "upper", "digit", "mark", "pipe", "exclaim", "stop", "distinct", "adjacent", "marked_words", "upper_words", "lower_lines", "line_words", "non_ascii", "top_word", "last_half_marks")
#: Labelled rows that a fit takes at most, chosen by hash of their id.
SAMPLE = 12_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAST = 48, 12, 150, 60, 8, 0.15, 4.0
CHUNK = 1 << 20
SPACE, LOWER, UPPER, DIGIT, MARK = range(5)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    table = np.full(0x110000, MARK, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))
        if kind[0] == "L" or kind[0] == "M":
            table[point] = UPPER if kind == "Lu" else LOWER
        elif kind[0] == "N":
            table[point] = DIGIT
    table[[32, 9, 10, 11, 12, 13]] = SPACE
    return table


def _per(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds, empty ranges included."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text of a UTF-8 buffer; all zeros for an empty text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[offsets]
    kind = kinds()[points]
    chars = np.maximum(at[1:] - at[:-1], 1).astype(np.float64)
    share = lambda flags: _per(flags, at) / chars
    opens = np.zeros(len(points) + 1, bool)
    opens[at] = True
    solid = kind != SPACE
    before = np.concatenate([[False], solid[:-1]]) & ~opens[:-1]
    begin = np.flatnonzero(solid & ~before)
    after = np.concatenate([solid[1:], [False]]) & ~opens[1:]
    end = np.flatnonzero(solid & ~after) + 1
    own = np.searchsorted(begin, at)
    words = own[1:] - own[:-1]
    some = np.maximum(words, 1).astype(np.float64)
    place = np.concatenate([np.flatnonzero(lead), [len(data)]])
    length = place[end] - place[begin]
    eight = words_at(data)[place[begin]] if len(begin) else np.zeros(0, np.uint64)
    short = np.minimum(length, 8).astype(np.uint64)
    eight = np.where(short < 8, eight & ((np.uint64(1) << (short * np.uint64(8))) - np.uint64(1)), eight)
    tail = words_at(data)[np.maximum(place[end] - 8, place[begin])] if len(begin) else eight
    name = mix(eight ^ mix(np.where(length > 8, tail, 0) + length.astype(np.uint64)))
    doc = np.repeat(np.arange(n), words)
    order = np.lexsort((name, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (name[order][1:] != name[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    runs = np.diff(np.append(np.flatnonzero(fresh), len(order)))
    top = np.zeros(n)
    np.maximum.at(top, doc[order][fresh], runs)
    same = np.zeros(len(name), bool)
    same[1:] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
    marks = np.concatenate([[0], np.cumsum(kind == MARK)])
    uppers = np.concatenate([[0], np.cumsum(kind == UPPER)])
    lowers = np.concatenate([[0], np.cumsum(kind == LOWER)])
    in_word = lambda total: total[end] - total[begin]
    per_word = lambda flags: _per(flags, own) / some
    newline = points == 10
    starts_line = np.concatenate([[True], newline[:-1]]) | opens[:-1]
    lines = _per(starts_line, at)
    half = (at[1:] + at[:-1]) // 2
    columns = [
        np.log1p(at[1:] - at[:-1]), np.log1p(words), _per(length, own) / some, share(kind == UPPER), share(kind == DIGIT), share(kind == MARK), share(points == ord("|")), share(points == ord("!")),
        share(points == ord(".")), _per(fresh, np.concatenate([[0], np.cumsum(words)])) / some, per_word(same), per_word(in_word(marks) >= 2), per_word((in_word(uppers) >= 2) & (in_word(lowers) == 0)),
        _per(starts_line & (kind == LOWER), at) / np.maximum(lines, 1), np.log1p(words / np.maximum(lines, 1)), share(points > 127), top / some, (marks[at[1:]] - marks[half]) / np.maximum(at[1:] - half, 1),
    ]
    out[:] = np.column_stack(columns)
    out[at[1:] == at[:-1]] = 0
    return out


@dataclass
class Model:
    """Cut points and a lookup table per feature and per chosen pair; a score is a sum of entries."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    base: float = 0.0

    def bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for table, b in zip(self.tables, self.bins(x, self.cuts), strict=True):
            total += table[b]
        if self.pairs:
            coarse = self.bins(x, self.coarse)
            for (f, g), table in self.pairs.items():
                total += table[coarse[f], coarse[g]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(h >= LEAST, g * g / (h + 1.0), -np.inf)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, bins to the left) of the best split of a histogram; 0 bins if none gains."""
    if len(g) < 2:
        return 0.0, 0
    left, right = (np.cumsum(g)[:-1], np.cumsum(h)[:-1]), (np.cumsum(g[::-1])[::-1][1:], np.cumsum(h[::-1])[::-1][1:])
    gain = _gain(*left) + _gain(*right) - g.sum() ** 2 / (h.sum() + 1.0)
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values by bin of a shallow tree over one histogram."""
    _, cut = _best_cut(g, h) if depth else (0, 0)
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of a tree that cuts one axis and then each side along the other."""
    best = (0.0, np.zeros_like(g))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        _, cut = _best_cut(a.sum(1), b.sum(1))
        if not cut:
            continue
        values, gain = np.zeros_like(a), -a.sum() ** 2 / (b.sum() + 1.0)
        for rows in (slice(0, cut), slice(cut, None)):
            ga, hb = a[rows].sum(0), b[rows].sum(0)
            values[rows] = _tree(ga, hb, 1)[None, :]
            gain += float((values[rows][0] * ga).sum())
        if gain > best[0]:
            best = (gain, values.T if turn else values)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts shallow trees on one feature after another, round by round, then on the pairs that still
    explain most of the residual; all trees of a feature or pair add up to its table. Without labels,
    or with one class only, the model is the constant of that class (0.5 if none)."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
    coarse = [c[:: max(1, -(-len(c) // (PAIR_BINS - 1)))] for c in cuts]
    model = Model(cuts, [np.zeros(len(c) + 1) for c in cuts], coarse)
    mean = (float(y.sum()) + 0.5) / (len(y) + 1)
    model.base = float(np.log(mean / (1 - mean)))
    if len(np.unique(y)) < 2:
        return model
    margin = np.full(len(y), model.base)
    bins, wide = model.bins(x, cuts), model.bins(x, coarse)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            size = len(table)
            step = RATE * _tree(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size))
            table += step
            margin += step[bins[f]]
    g, h = slopes()

    def histogram(f: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[f]) + 1, len(coarse[k]) + 1)
        cell = wide[f] * shape[1] + wide[k]
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), cell

    ranked = sorted(combinations(range(len(FEATURES)), 2), key=lambda p: (-_pair_tree(*histogram(*p)[:2])[0], p))[:PAIRS]
    model.pairs = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in ranked}
    for _ in range(PAIR_ROUNDS):
        for p, table in model.pairs.items():
            g, h = slopes()
            a, b, cell = histogram(*p)
            step = RATE * _pair_tree(a, b)[1]
            table += step
            margin += step.ravel()[cell]
    return model


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _ddl(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def _apply(docs: DataFrame, text: str, name: str, kind: str, answer) -> DataFrame:
    def run(stream):
        for batch in stream:
            data, offsets = utf8(batch.column(text))
            found = [answer(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in slices(offsets, CHUNK)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v for part in found for v in part])], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, _ddl(docs) + f"{name} {kind}")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text", sample: int = SAMPLE) -> Model:
    """A model from the documents of at most `sample` labelled keys that are not held out, the same on each run.

    Rows with a null key, label or no document are left out; of labels or documents that repeat a key, one counts.
    """
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key", "_label").limit(sample)
    rows = docs.select(key, text).join(F.broadcast(chosen), F.col(key) == F.col("_key")).select("_key", "_label", F.coalesce(text, F.lit("")).alias("_text"))
    with batches(docs.sparkSession, 1000):
        found = _apply(rows, "_text", "x", "array<double>", lambda x: x.tolist())
        rows = found.groupBy("_key").agg(F.min(F.struct("_label", "x")).alias("r")).select("r.*").toPandas()  # a row per key at most
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    y = (rows["_label"].to_numpy() >= 1).astype(float)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1). Null counts as empty; every row keeps its columns, repeated rows score
    alike, an empty table gives none; an input column named score gives way."""
    return _apply(without(docs, "score"), text, "score", "double", lambda x: model.score(x).tolist())
