"""Operators on texts against brute force: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import bpe, jaccard_join, mixing, quality, shingles, suffix_dedup
from graphloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, ids int, kept int, target int"


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}é"[: rng.randrange(2, 6)] + str(rng.randrange(99)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base, passage, long = words(rng, 120), words(rng, 90), words(rng, 9000)
    out = [None, "", " \n\t ", "one two", "One TWO", "x" * 3000, long, base, base, base.upper(), base + " tail", base.replace("w1", "w2", 3)]
    out += [words(rng, 40) + " " + passage + " " + words(rng, 30) for _ in range(4)]
    out += ["ab " * 400, "ab " * 500, "y" * 399, "z" * 400, "z" * 400, "q" * 401, passage[:450]]
    out += [words(rng, rng.randrange(1, 200)) for _ in range(20)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{min(i % 5, 2)}", len(t or ""), "a", "b", 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[7:8] + [(None, "no id", None, None, None, None, None, None, None, None)], SCHEMA)


def brute_removed(raws, length=400):
    seen = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("hot", [10_000, 1])
def test_suffix_dedup(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = docs.collect()
    raws = [(r.text or "").encode() for r in rows]
    want = sorted((str(r.doc_id), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~g])).hexdigest(), int(g.sum())) for r, b, g in zip(rows, raws, brute_removed(raws)))
    found = suffix_dedup.dedup(docs)
    assert [c for c in docs.columns if c not in ("kept", "removed")] + ["removed", "kept"] == found.columns
    got = sorted((str(r.doc_id), hashlib.sha256(bytes(r.kept)).hexdigest(), sum(x.e - x.s for x in r.removed)) for r in found.collect())
    assert got == want


def test_suffix_dedup_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdefgh") for _ in range(950))
    fill = lambda n: "".join(rng.choice("ijklmnop") for _ in range(n))
    rows = [(0, fill(900) + shared + fill(800)), (1, fill(333) + shared), (2, fill(2500))]
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: [(900, 1850)], 1: [(333, 1283)], 2: []}


def test_suffix_dedup_empty_table(spark, docs):
    assert suffix_dedup.dedup(docs.where("false")).count() == 0


def brute_passages(texts, words):
    raws = [(t or "").encode() for t in texts]
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in raws]
    name = lambda b, s, i: b" ".join(b[x:y] for x, y in s[i : i + words])
    seen = Counter(name(b, s, i) for b, s in zip(raws, spans) for i in range(len(s) - words + 1))
    out = []
    for b, s in zip(raws, spans):
        gone = np.zeros(len(b), bool)
        for i in range(len(s) - words + 1):
            if seen[name(b, s, i)] > 1:
                gone[s[i][0] : s[i + words - 1][1]] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("chunk,piece,hot", [(1 << 20, 1 << 25, 4000), (700, 60, 4000), (1 << 20, 1 << 25, 1)])
def test_dedup_of_passages_by_words(spark, docs, monkeypatch, chunk, piece, hot):
    for name, value in (("CHUNK", chunk), ("PIECE", piece), ("HOT", hot)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(3)
    short = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(51))
    assert 250 < len(short) < 400
    other = short.split()
    rows = [r.text for r in docs.collect()]
    rows += [f"{words(rng, 60)} {short} {words(rng, 60)}", f"{short}\n{words(rng, 60)}", words(rng, 60) + "  " + short.replace(" ", "  ")]
    rows += [" ".join(other[:50]) + " end " + words(rng, 20), words(rng, 7) + " " + " ".join(other[1:])]  # 50 words only
    rows += [f"{words(rng, n)} {' '.join(other[:40])} {tail}" for n, tail in ((9, "x " * 30), (31, "x " * 22))]
    raws = [(t or "").encode() for t in rows]
    want = brute_passages(rows, 51)
    at = len(docs.collect())
    assert all(short.encode() in raws[at + k] and want[at + k].sum() == len(short) for k in (0, 1)) and not want[at + 3].any() and not want[at + 4].any()
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in suffix_dedup.dedup(table, words=51).collect()}
    for i, gone in enumerate(want):
        step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        assert got[i] == list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))
    import corpus_pipeline

    two = table.where(f"doc_id in ({at}, {at + 1})").selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars")
    assert all(short not in r.text for r in corpus_pipeline.repeated_passages(spark, two, "").collect())


def test_suffix_order_against_sorting():
    rng = random.Random(3)
    for _ in range(60):
        data = np.array([rng.randrange(97, 97 + rng.choice([1, 2, 4])) for _ in range(rng.randrange(1, 260))] * rng.choice([1, 2]), np.uint8)
        depth = rng.choice([5, 40, 130])
        at = np.arange(max(0, len(data) - depth + 1))
        order, tied = suffix_dedup.sort_suffixes(data, at, depth)
        keys = [data[i : i + depth].tobytes() for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == at.tolist()
        assert [bool(t) for t in tied] == [k > 0 and keys[k] == keys[k - 1] for k in range(len(keys))]


def test_difference_cover_covers_every_pair():
    cover, shift = suffix_dedup.difference_cover(31)
    held = set(cover.tolist())
    assert all((i + shift[i, j]) % 31 in held and (j + shift[i, j]) % 31 in held for i in range(31) for j in range(31))
    assert len(held) <= 8


def brute_set(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {k: find(k) for k in keys}


def test_jaccard_join(spark, docs):
    sets = {r.doc_id: brute_set(r.text) for r in docs.where("doc_id is not null").collect()}
    link = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = brute_components(sets, link)
    rows = jaccard_join.jaccard_components(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    assert want[11] == 7 and want[8] == 7


def test_jaccard_join_chains_and_small_groups(spark):
    rng = random.Random(8)
    chain = [[f"a{i}" for i in range(40)]]
    for _ in range(30):  # neighbours link, ends do not
        chain.append(chain[-1][1:] + [f"b{rng.randrange(10**9)}"])
    rows = [(i, " ".join(c)) for i, c in enumerate(chain)] + [(100 + i, f"p{i} " + " ".join(f"c{k}" for k in range(12))) for i in range(30)]
    sets = {i: brute_set(t) for i, t in rows}
    want = brute_components(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_jaccard_join_empty_table(spark, docs):
    assert jaccard_join.jaccard_components(docs.where("false")).count() == 0


def test_long_words_are_named_whole():
    a, b = shingles.set_of("x" * 200 + "a 1 2 3 4"), shingles.set_of("x" * 200 + "b 1 2 3 4")
    assert a.tolist() != b.tolist() and len(a) == 1


def test_mixing(spark, docs):
    rows = {r.doc_id: r for r in mixing.mixing_plan(docs.select("doc_id", "text", "source", "size", "target")).collect()}
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for k, r in rows.items()}
    assert all(rows[k].size == size[k] for k in rows)
    total = {}
    for r in docs.collect():
        total[r.source] = total.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, budget, target = set(order), 1.5 * sum(total.values()), {}
    while left:
        unit = budget / sum(weight[s] for s in left)
        full = {s for s in left if 2 * total[s] < unit * weight[s]}
        for s in full or left:
            target[s] = 2.0 * total[s] if full else unit * weight[s]
        budget -= sum(target[s] for s in full)
        left = left - full if full else set()
    for r in rows.values():
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
    mixed = mixing.mix_sources(docs)
    again = mixing.mix_sources(docs)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, again.collect()))
    assert mixing.mixing_plan(docs.where("false")).count() == 0


@pytest.mark.parametrize("sizes, want", [((100,) * 5, [200, 140, 70, 200, 140]), ((500, 200, 100), [750, 300, 150])])
def test_mixing_of_sources_that_fill_up_together(spark, sizes, want):
    sized = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    assert got == pytest.approx({f"s{i}": n for i, n in enumerate(want)})


def test_bpe_matches_the_library(spark, docs, texts):
    import public_tokenizers
    import tiktoken

    path = tokenizer_path()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(path), special_tokens={})
    rng = random.Random(2)
    parts = ["a", "B", "é", "'s", "'", "'re", "'ll", " ", "  ", "\n", "\t", "12", "½", "!", "--", "中", "🙂", "x" * 300, "'d", " '", "́", "​", "\x85", "<|endoftext|>"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(2000)] + ["ab" * 5000]
    codec = bpe.Codec(path)
    raw = [t.encode() for t in odd]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    for text, (ids, _) in zip(odd, codec.encode_all(np.frombuffer(b"".join(raw), np.uint8), offsets)):
        assert ids.tolist() == library.encode_ordinary(text)
    for r in bpe.decode(bpe.encode(docs, path), path).collect():
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
        assert len(r.starts) <= len(r.ids)
    assert bpe.encode(docs.where("false"), path).count() == 0
    both = bpe.encode(docs, path, decoded=True).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both) and len(both) == docs.count()


def test_transition_functions_compose():
    _, compose, result, _ = bpe.monoid()
    n = len(compose)
    rng = random.Random(0)
    for _ in range(500):
        f, g, h = (rng.randrange(n) for _ in range(3))
        assert compose[compose[f, g], h] == compose[f, compose[g, h]]
        assert result[compose[f, g], 3] == result[g, result[f, 3]]


def test_quality_learns_and_keeps_held_out_apart(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        t = words(rng, rng.randrange(20, 80)) + "."
        rows.append((i, t if good else " ".join(w + "$$$" for w in t.split()), "en", "s"))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows + [(901, None, None, None), (902, "", "en", "s")], "doc_id long, text string, lang string, score string")
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, marks, sample=500)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == bool(labels[i][1]) for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[901] == got[902]
    assert quality.score(docs.where("false"), model).count() == 0
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels], "doc_id long, quality int")
    assert {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, flipped, sample=500)).collect()} == got
    none = quality.train(docs, marks.where("false"))
    assert quality.score(docs, none).where("score = 0.5").count() == docs.count()
