"""Similarity self-join of shingle sets with a token-group matrix: documents in groups, groups by tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, batches, mix, slices, utf8
from graphloom.llm.components import components
from graphloom.llm.shingles import sets

#: Counters in each of two rows of the frequency sketch (a fixed size, whatever the corpus), pieces it is sent in.
WIDTH, PIECES = 1 << 22, 32
#: Min-hash keys of a set; any two of them make the name of a bucket, which texts that share one common line
#: seldom agree in.
KEYS = 4
DUOS = [(i, j) for i in range(KEYS) for j in range(i)]
#: Members and tokens of a block, the unit that is compared with another at once; members of a bucket that
#: sit in each of its blocks; rows that ask one block of a group in one task.
BLOCK, TOKENS, PIVOTS, ASKED = 512, 4 << 20, 6, 8192
#: Names of texts (16 bytes each) that a search for texts broadcasts at most.
BROADCAST_TEXTS = 500_000
CHUNK = 1 << 20
ROWS = 1000
#: Groups of one token that are paired at a time; tokens that more rows seem to have are dealt in tiles of so many.
TILE = 2048
FACTS = "doc_id long, t1 long, t2 long, k1 long, k2 long, n long, keys array<long>, piece int, counts binary"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def set_name(tokens: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return signed(x >> 64), signed(x & (1 << 64) - 1)


def cells(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (tokens & np.uint64(WIDTH - 1)).astype(np.int64), (tokens >> np.uint64(40) & np.uint64(WIDTH - 1)).astype(np.int64)


def to_byte(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte each: exact below 128, from there eight steps to a doubling."""
    return np.where(counts < 128, counts, np.minimum(128 + 8 * np.log2(np.maximum(counts, 128) / 128), 255)).astype(np.uint8)


def from_byte(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.where(x < 128, x, 128 * 2 ** ((x - 128) / 8))


def prefix(tokens: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens, rarest first, of which two sets that link must share one, and their counts on the
    sketch's scale. Any order that is the same for all sets is right; the sketch makes it a selective one."""
    n = len(tokens)
    keep = n - -(-percent * n // 100) + 1
    one, two = cells(tokens)
    count = np.minimum(sketch[0][one], sketch[1][two])
    order = np.lexsort((tokens, count))[:keep]
    return tokens[order], count[order]


def _facts(docs: DataFrame) -> DataFrame:
    """Per row its set's name, size and buckets; per task the pieces of its frequency sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("piece", pa.int32()), ("counts", pa.binary())])
    seeds = [np.uint64(xxhash.xxh3_64_intdigest(f"key {i}")) for i in range(KEYS)]

    def run(stream):
        sketch = np.zeros((2, WIDTH), np.int32)
        for batch in stream:
            data, offsets = utf8(batch.column("text"))
            names, sizes, keys = [], [], []
            for i, j in slices(offsets, CHUNK):
                found = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                every = np.concatenate(found) if found else np.zeros(0, np.uint64)
                for row, cell in zip(sketch, cells(every), strict=True):
                    np.add.at(row, cell, 1)
                at = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                full = np.flatnonzero(np.diff(at))
                low = np.zeros((KEYS, len(found)), np.uint64)
                for r, seed in enumerate(seeds):
                    if len(full):
                        low[r, full] = np.minimum.reduceat(mix(every ^ seed), at[full])
                low = np.array([mix(low[r] + np.uint64(c)) ^ low[q] for c, (r, q) in enumerate(DUOS)]).view(np.int64)
                names += [set_name(x) if len(x) else (None, None) for x in found]
                sizes += [len(x) for x in found]
                keys += [low[:, c].tolist() if len(x) else None for c, x in enumerate(found)]
            n = len(names)
            k1, k2 = zip(*names, strict=True) if names else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("t1"), batch.column("t2"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        step = 2 * WIDTH // PIECES
        for p, part in enumerate(sketch.reshape(PIECES, step)):  # a piece at a time, as counts pass through floats
            if part.any():
                yield pa.RecordBatch.from_pylist([{"piece": p, "counts": to_byte(part).tobytes()}], schema=schema)

    return docs.mapInArrow(run, FACTS)


def _sketch(pieces: DataFrame) -> np.ndarray:
    """The summed sketch on a scale of 8 steps to a doubling: 8 MB."""
    step = 2 * WIDTH // PIECES
    out = pa.schema([("piece", pa.int32()), ("counts", pa.binary())])

    def scaled(piece, counts):
        return pa.RecordBatch.from_pylist([{"piece": piece, "counts": np.minimum(8 * np.log2(1 + counts), 255).astype(np.uint8).tobytes()}], schema=out)

    def add(stream):
        held = None
        for batch in stream:
            for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts"), strict=True):
                if held is None or piece != held[0]:
                    if held:
                        yield scaled(*held)
                    held = (piece, np.zeros(step))
                held[1][:] += from_byte(np.frombuffer(counts.as_buffer(), np.uint8))
        if held:
            yield scaled(*held)

    total = np.zeros((PIECES, step), np.uint8)
    summed = pieces.repartition(PIECES, "piece").sortWithinPartitions("piece").mapInArrow(add, "piece int, counts binary")
    for row in summed.collect():  # PIECES rows of one size
        total[row["piece"]] = np.frombuffer(row["counts"], np.uint8)
    return total.reshape(2, WIDTH)


def tile_counts(sketch: np.ndarray) -> np.ndarray:
    """For each value of the sketch, in how many tiles the rows of such a token are dealt. What the median
    cell holds is noise, so the tiles follow the token's own rows at any size of the corpus."""
    rows = 2.0 ** (np.arange(256) / 8) - 1
    return 1 + np.maximum(0, (rows - 2 * rows[int(np.median(sketch))]) // TILE).astype(np.int32)


def _prefixes(docs: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """(k1, k2, n, tokens, hot) of every row that has a set; hot: tokens dealt in tiles, and in how many."""
    shared = docs.sparkSession.sparkContext.broadcast((sketch, tile_counts(sketch)))
    hot_type = pa.list_(pa.struct([("token", pa.int64()), ("tiles", pa.int32())]))

    def run(stream):
        counts, tiles = shared.value
        for batch in stream:
            data, offsets = utf8(batch.column("text"))
            names, sizes, tokens, hot = [], [], [], []
            for i, j in slices(offsets, CHUNK):
                for x in sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    if len(x):
                        own, often = prefix(x, counts, percent)
                        own, dealt = own.view(np.int64), tiles[often]
                        names.append(set_name(x))
                        sizes.append(len(x))
                        tokens.append(own[dealt == 1])
                        hot.append([{"token": int(t), "tiles": int(d)} for t, d in zip(own[dealt > 1], dealt[dealt > 1], strict=True)])
            if names:
                at = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int32)
                k1, k2 = zip(*names, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(tokens))), pa.array(hot, hot_type)], names=["k1", "k2", "n", "tokens", "hot"])

    return docs.select("text").mapInArrow(run, "k1 long, k2 long, n long, tokens array<long>, hot array<struct<token: long, tiles: int>>")


def _sets(texts: DataFrame) -> DataFrame:
    """(u, tokens) of (u, text): the whole set, as bytes."""

    def run(stream):
        for batch in stream:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("u")
            for i, j in slices(offsets, CHUNK):
                found = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array([x.tobytes() for x in found], pa.binary())], names=["u", "tokens"])

    return texts.select("u", "text").mapInArrow(run, "u long, tokens binary")


# --- comparing blocks ------------------------------------------------------------------------------


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of every set of a with every set of b.

    Only tokens that both sides have count. Those that few sets have are paired one by one, the others
    by a product of 0/1 matrices over a few thousand tokens at a time.
    """
    out = np.zeros((len(a), len(b)), np.int64)
    ta, tb = np.concatenate([np.zeros(0, np.uint64), *a]), np.concatenate([np.zeros(0, np.uint64), *b])
    oa, ob = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    common = np.intersect1d(ta, tb)
    if not len(common):
        return out
    sides = []
    for t, o in ((ta, oa), (tb, ob)):
        at = np.minimum(np.searchsorted(common, t), len(common) - 1)
        both = common[at] == t
        order = np.argsort(at[both], kind="stable")
        sides.append((at[both][order], o[both][order]))
    (ia, oa), (ib, ob) = sides
    ca, cb = np.bincount(ia, minlength=len(common)), np.bincount(ib, minlength=len(common))
    few = ca * cb <= 64
    first = np.concatenate([[0], np.cumsum(cb)])
    at, owner = ia[few[ia]], oa[few[ia]]
    for i in range(0, len(at), 1 << 14):
        x, o = at[i : i + (1 << 14)], owner[i : i + (1 << 14)]
        times = cb[x]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        out += np.bincount(np.repeat(o, times) * len(b) + ob[np.repeat(first[x], times) + step], minlength=out.size).reshape(out.shape)
    place = np.cumsum(~few) - 1
    for i in range(0, int((~few).sum()), 4096):
        parts = []
        for t, o, n in ((ia, oa, len(a)), (ib, ob, len(b))):
            at = place[t]
            on = ~few[t] & (at >= i) & (at < i + 4096)
            m = np.zeros((n, 4096), np.float32)
            m[o[on], at[on] - i] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def linked_sets(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a link with which of b: 100 * intersection >= percent * union."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    both = overlaps(a, b)
    return (both > 0) & (100 * both >= percent * (n[:, None] + m[None, :] - both))


class Forest:
    """Labels that links merge; merge() says which links joined what was apart."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        path = []
        while (y := self.above.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.above[p] = x
        return x

    def merge(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self.above[max(a, b)] = min(a, b)
        return True


def _compared(percent: int, keys: tuple[str, ...], alone: bool):
    """A function from rows (*keys, kind, u, root, tokens), in the order of keys and kind, to links (u, v).

    Rows of kind 0 that share their keys are a block; those of kind 1 ask it (with `alone`, each block is
    compared with itself instead). Of the links found, those are returned that join what earlier ones
    and the roots had left apart: fewer than the rows, whatever the number of links.
    """

    def run(stream):
        at, block, asked, size, forest = None, [], [], 0, Forest()

        def found(rows):
            if rows and block:
                links = linked_sets([x[2] for x in rows], [x[2] for x in block], percent)
                for i in np.flatnonzero(links.any(1)).tolist():
                    u, root, _ = rows[i]
                    for j in np.flatnonzero(links[i, :i] if alone else links[i]).tolist():
                        if block[j][0] != u and forest.merge(root, block[j][1]):
                            yield u, block[j][0]

        def solved():
            nonlocal asked, size
            out = list(found(block if alone else asked))
            asked, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])

        for batch in stream:
            names = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            kinds, us, roots = (batch.column(c).to_pylist() for c in ("kind", "u", "root"))
            for i, name in enumerate(names):
                if name != at:
                    yield from solved()
                    at, block, forest = name, [], Forest()
                row = us[i], us[i] if roots[i] is None else roots[i], np.frombuffer(batch.column("tokens")[i].as_py(), np.uint64)
                if kinds[i] == 0:
                    block.append(row)
                    continue
                asked.append(row)
                size += len(row[2])
                if len(asked) >= BLOCK or size >= TOKENS:
                    yield from solved()
        yield from solved()

    return run


# --- the token-group matrix ------------------------------------------------------------------------


def _paired(percent: int):
    """A function from rows (token, cell, side, g, info) sorted by token and cell to (g, h, gi, hi, hits): how
    many tokens each two groups share whose sizes (info: largest << 32 | smallest << 1 | several
    members) can link. Rows of side 0 meet each other, those of side 1 the ones of side 2."""

    def pairs(one, two):
        (g, gi), (h, hi) = one, two if two is not None else one
        for i in range(0, len(g), TILE):
            for j in range(i if two is None else 0, len(h), TILE):
                x, y = slice(i, i + TILE), slice(j, j + TILE)
                fits = (100 * (gi[x] >> 32)[:, None] >= percent * (hi[y] >> 1 & 0x7FFFFFFF)[None, :]) & (100 * (hi[y] >> 32)[None, :] >= percent * (gi[x] >> 1 & 0x7FFFFFFF)[:, None])
                if two is None and i == j:
                    fits = np.triu(fits, 1)
                a, b = np.nonzero(fits)
                a, b = a + i, b + j
                apart = g[a] != h[b]
                a, b = a[apart], b[apart]
                if len(a):
                    swap = g[a] > h[b]
                    yield np.where(swap, h[b], g[a]), np.where(swap, g[a], h[b]), np.where(swap, hi[b], gi[a]), np.where(swap, gi[a], hi[b])

    def counted(held):
        g, h, gi, hi = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((h, g))
        g, h, gi, hi = g[order], h[order], gi[order], hi[order]
        fresh = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])]))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (g[fresh], h[fresh], gi[fresh], hi[fresh], np.diff(np.append(fresh, len(g))))], names=["g", "h", "gi", "hi", "hits"])

    def close(token, cell, side, group, info):
        """Runs of equal tokens and cells with two groups or more."""
        starts = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])]))
        ends = np.append(starts[1:], len(token))
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            s, g, i = side[a:b], group[a:b], info[a:b]
            if s[0] == 0:
                yield from pairs((g, i), None)
            elif (s == 1).any() and (s == 2).any():
                yield from pairs((g[s == 1], i[s == 1]), (g[s == 2], i[s == 2]))

    names = ("token", "cell", "side", "g", "info")

    def run(stream):
        held, size, rest = [], 0, None

        def closed(columns):
            nonlocal held, size
            for p in close(*columns):
                held.append(p)
                size += len(p[0])
                if size > 2_000_000:
                    yield counted(held)
                    held, size = [], 0

        for batch in stream:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in names]
            if rest is not None:
                rows = [np.concatenate([r, c]) for r, c in zip(rest, rows, strict=True)]
            fresh = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
            cut = int(fresh[-1]) + 1 if len(fresh) else 0
            if cut:
                yield from closed([r[:cut] for r in rows])
            rest = [r[cut:] for r in rows]  # at most about a tile's groups twice
        if rest is not None:
            yield from closed(rest)
        if held:
            yield counted(held)

    return run


def _laid(own: DataFrame) -> DataFrame:
    """(token, cell, side, g, info): the matrix by token. Tokens that many rows have are dealt in tiles by group;
    each two tiles make a cell, so that no task holds more groups of a token than two tiles do. The
    members of a group lay a token once."""
    cold = own.select(F.explode("tokens").alias("token"), F.lit(0).cast("long").alias("cell"), F.lit(0).alias("side"), "g", "info")
    hot = own.where(F.size("hot") > 0).select(F.explode("hot").alias("x"), "g", "info").select("x.token", "x.tiles", "g", "info").withColumn("own", F.pmod(F.xxhash64("g"), "tiles"))
    hot = hot.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    cell = F.least("own", "other") * F.col("tiles") + F.greatest("own", "other")
    hot = hot.select("token", cell.cast("long").alias("cell"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "g", "info")
    every = cold.unionByName(hot)
    several = F.col("info").bitwiseAND(F.lit(1)) == 1
    return every.where(~several).unionByName(every.where(several).distinct())


def jaccard_components(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per input row.

    Rows link when 100 * intersection >= percent * union of their shingle sets. Null and empty texts
    and texts of white space only have empty sets, link with nothing and are their own component; so
    is a row with a null id, unless its set links (component_id is then the smallest id that is not
    null). Repeated rows and ids each give a row. An empty table gives none. Sets of any size are
    compared whole; no partner and no token is left out.

    1. Rows with equal sets are one unit (sets are known by 128-bit names). Each unit joins the most
       crowded of its buckets (two min-hash keys each). Buckets are cut into blocks; the members of a block
       are compared with each other, and a few members sit in every block of their bucket. What links
       makes up a group; members left alone form groups of a bucket's leftovers.
    2. The union of each group's rarest tokens, of which a linked pair shares at least one (see `prefix`),
       is laid out by token. Two groups are opened only if they share as many tokens as a linked pair
       would: for two single documents of sizes n and m that is ceil(p (n + m) / (100 + p)) - max(rest),
       where rest is what lies beyond a prefix; for larger groups the least of that over their sizes.
    3. Opened groups are compared block against block. Only links that join what was apart leave a task,
       so rows grow with the members and the blocks of a cluster and not with its pairs.

    How often a token occurs decides what is rare. The sketch that says so has a fixed size, so its
    noise grows with the corpus, but only as the root of it: a passage that a fixed share of all
    documents have stands out more, the more there are, and is left out of the prefixes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("t2"), "text")})
    with batches(spark, ROWS):
        facts = scratch.put(_facts(rows), "facts")
    with batches(spark, 8):
        sketch = _sketch(facts.where("piece is not null").select("piece", "counts"))
    facts = facts.where("piece is null")
    units = facts.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.min(F.struct("t1", "t2")).alias("t"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    units = scratch.put(units.select(F.monotonically_increasing_id().alias("u"), "k1", "k2", "first", "t.t1", "t.t2", "n", "keys"), "units")

    def sets_of(wanted: DataFrame, name: str) -> DataFrame:
        """(u, tokens) of the wanted units."""
        wanted = scratch.put(units.join(wanted, "u", "left_semi").select("u", "t1", "t2"), name + "-wanted")
        few = wanted.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS  # else all texts pass a shuffle
        found = rows.select("t1", "t2", "text").join(F.broadcast(wanted) if few else wanted, ["t1", "t2"])
        with batches(spark, ROWS // 2):
            return scratch.put(_sets(found.groupBy("u").agg(F.first("text").alias("text"))), name)

    # Blocks of buckets, each compared with itself.
    keyed = units.select("u", "n", F.posexplode("keys").alias("i", "key"))
    crowded = keyed.groupBy("i", "key").agg(F.count("*").alias("c")).where("c > 1")
    chosen = keyed.join(crowded, ["i", "key"]).groupBy("u").agg(F.max(F.struct("c", "i", "key")).alias("b"), F.first("n").alias("n"))
    chosen = scratch.put(chosen.select("u", "n", F.xxhash64("b.i", "b.key").alias("bucket")), "chosen")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / TOKENS)).cast("int")
    pivots = F.array_distinct(F.array(*[F.min_by("u", F.xxhash64("u", F.lit(j))) for j in range(PIVOTS)]))
    buckets = chosen.groupBy("bucket").agg(F.count("*").alias("m"), parts.alias("parts"), pivots.alias("pivots")).where("m > 1")
    members = chosen.join(buckets.select("bucket", "parts"), "bucket").select("u", "bucket", F.pmod(F.xxhash64("u"), "parts").cast("int").alias("part"))
    lead = buckets.where("parts > 1").select("bucket", "parts", F.explode("pivots").alias("u")).select("u", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = scratch.put(members.union(lead).distinct(), "dealt")
    block = dealt.select("u", "bucket", "part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("root")).join(sets_of(dealt.select("u"), "bucket-sets"), "u")
    with batches(spark, ROWS // 4):
        links = scratch.put(block.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "u").mapInArrow(_compared(percent, ("bucket", "part"), True), "u long, v long"), "bucket-links")

    # Groups: what links so far, and blocks of what a bucket has left.
    roots = components(links, "jaccard-groups").select(F.col("node").alias("u"), "root")
    left = chosen.join(roots, "u", "left_anti")
    left = left.join(left.groupBy("bucket").agg(F.count("*").alias("m"), parts.alias("parts")).where("m > 1"), "bucket").withColumn("part", F.pmod(F.xxhash64("u"), "parts").cast("int"))
    alone = left.join(left.groupBy("bucket", "part").agg(F.min("u").alias("g")), ["bucket", "part"]).select("u", "g", F.col("u").alias("root"))
    groups = roots.select("u", F.col("root").alias("g"), "root").union(alone)
    groups = scratch.put(groups.join(units.select("u", "n"), "u"), "groups")
    spans = scratch.put(groups.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("m"), F.sum("n").alias("w"), F.countDistinct("root").alias("roots")), "spans")

    # The matrix.
    with batches(spark, ROWS):
        own = _prefixes(rows, sketch, percent).groupBy("k1", "k2").agg(F.first("tokens").alias("tokens"), F.first("hot").alias("hot"))
        named = units.select("u", "k1", "k2", "n").join(groups.select("u", "g").join(spans, "g"), "u", "left")
        low, high = F.coalesce("low", "n"), F.coalesce("high", "n")
        info = F.shiftleft(high, 32).bitwiseOR(F.shiftleft(low, 1)).bitwiseOR((F.coalesce("m", F.lit(1)) > 1).cast("long"))
        own = scratch.put(own.join(named, ["k1", "k2"]).select("tokens", "hot", F.coalesce("g", "u").alias("g"), info.alias("info")), "prefixes")
    with batches(spark, 100_000):
        shared = _laid(own).repartition("token", "cell").sortWithinPartitions("token", "cell").mapInArrow(_paired(percent), "g long, h long, gi long, hi long, hits long")
        shared = shared.groupBy("g", "h").agg(F.sum("hits").alias("hits"), F.first("gi").alias("gi"), F.first("hi").alias("hi"))
        many = lambda c: F.col(c).bitwiseAND(F.lit(1))
        small, large = (lambda c: F.shiftright(F.col(c), 1).bitwiseAND(F.lit(0x7FFFFFFF))), (lambda c: F.shiftright(F.col(c), 32))
        shared = shared.select("g", "h", "hits", (many("gi") + many("hi") > 0).alias("several"), small("gi").alias("a1"), large("gi").alias("a2"), small("hi").alias("b1"), large("hi").alias("b2"))
        rest = lambda n: F.ceil(F.lit(percent) * n / 100) - 1
        need = lambda n, m: F.ceil(F.lit(percent) * (n + m) / (100 + percent)) - F.greatest(rest(n), rest(m))
        t, r = percent / (100 + percent), percent / 100
        least = F.ceil(F.least(t * F.col("b1") - (r - t) * F.col("a2"), t * F.col("a1") - (r - t) * F.col("b2")) - 1e-6)
        bound = F.when(F.col("several"), F.greatest(F.lit(1), least)).otherwise(need(F.col("a1"), F.col("b1")))
        opened = shared.where(F.col("hits") >= bound).select("g", "h").union(spans.where("m > 1 and roots > 1").select("g", F.col("g").alias("h")))
        opened = scratch.put(opened, "opened")

    # Opened groups, block against block: the larger one of two is held, the smaller one asks.
    size = spans.select(F.col("g").alias("x"), "m", "w")
    opened = opened.join(size.toDF("g", "mg", "wg"), "g", "left").join(size.toDF("h", "mh", "wh"), "h", "left").fillna(1, ["mg", "mh"]).fillna(0, ["wg", "wh"])
    swap = F.col("mh") > F.col("mg")
    held, ask = F.when(swap, F.col("h")).otherwise(F.col("g")), F.when(swap, F.col("g")).otherwise(F.col("h"))
    opened = scratch.put(opened.select(held.alias("g"), ask.alias("h"), F.greatest("mg", "mh").alias("m"), F.when(swap, F.col("wh")).otherwise(F.col("wg")).alias("w"), F.least("mg", "mh").alias("q")), "pairs")
    parts = F.ceil(F.greatest(F.first("m") / BLOCK, F.first("w") / TOKENS)).cast("int")
    asked = scratch.put(opened.groupBy("g").agg(parts.alias("parts"), F.ceil(F.sum("q") / ASKED).cast("int").alias("slices")), "asked")
    wanted = opened.select("g").union(opened.select("h")).distinct()
    wanted = scratch.put(wanted.join(groups, "g").select("u", "g", "root").union(wanted.join(groups.select("g").distinct(), "g", "left_anti").select(F.col("g").alias("u"), "g", F.col("g").alias("root"))), "asking")
    whole = wanted.join(sets_of(wanted.select("u"), "group-sets"), "u")
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    holds = whole.join(asked, "g").select("g", F.pmod(F.xxhash64("u"), "parts").cast("int").alias("part"), span("slices").alias("slice"), F.lit(0).alias("kind"), "u", "root", "tokens")
    asks = opened.select("g", "h").join(asked, "g").select("g", F.pmod(F.xxhash64("h"), "slices").cast("int").alias("slice"), span("parts").alias("part"), "h")
    asks = whole.withColumnRenamed("g", "h").join(asks, "h").select("g", "part", "slice", F.lit(1).alias("kind"), "u", "root", "tokens")
    with batches(spark, ROWS // 4):
        met = holds.unionByName(asks).repartition("g", "part", "slice").sortWithinPartitions("g", "part", "slice", "kind", "u")
        more = scratch.put(met.mapInArrow(_compared(percent, ("g", "part", "slice"), False), "u long, v long"), "group-links")

    roots = components(links.union(more), "jaccard-components").withColumnRenamed("node", "u")
    named = units.select("u", "k1", "k2", "first").join(roots, "u", "left").withColumn("root", F.coalesce("root", "u"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = scratch.put(named.join(least, "root").select("k1", "k2", "component"), "named")
    scratch.drop("units", "chosen", "dealt", "bucket-sets-wanted", "bucket-sets", "bucket-links", "groups", "spans", "prefixes", "opened", "pairs", "asked", "asking", "group-sets-wanted", "group-sets", "group-links")
    out = facts.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
