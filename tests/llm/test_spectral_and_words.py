"""Whitening, spelling variants and SentencePiece pieces against dense, brute-force and library versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from graphloom.llm import pieces, queries, spelling, whitening


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_lobpcg_certifies_a_larger_matrix():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    spectrum = np.concatenate([np.geomspace(100, 2, 40), np.linspace(1.5, 0.1, 260)])
    matrix = (q * spectrum) @ q.T
    values, vectors, residuals, passes = whitening.lobpcg(lambda b: matrix @ b, 300, 12)
    assert np.allclose(values, spectrum[:12], rtol=1e-12)
    assert (np.abs((vectors * q[:, :12]).sum(0)) > 1 - 1e-12).all()
    assert (residuals <= whitening.TOLERANCE * values[0]).all() and 3 < passes < 60
    with pytest.raises(RuntimeError):
        whitening.lobpcg(lambda b: matrix @ b, 300, 12, rounds=2)


def odd_vectors(spark, n=300, d=40):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((n, d)) * np.geomspace(2, 0.1, d) + 3
    rows = [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(base)]
    rows += [(0, rows[0][1], 1), (None, rows[1][1], None), (900, None, 1), (901, [None] * d, 1), (902, [float("nan")] * d, 1), (903, [float("inf")] * d, 2), (904, [1.0, 2.0], 1), (905, [], 1)]
    return spark.createDataFrame([(*r, 7.0) for r in rows], "vec_id long, embedding array<float>, label int, whitened double")


def test_whitening_agrees_with_dense_eigenvectors(spark, tmp_path):
    df = odd_vectors(spark)
    got = queries.op11_whitening(spark, write(df, tmp_path, "embeddings")).collect()
    kept = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None and len(r.embedding) == 40 and all(x is not None and np.isfinite(x) for x in r.embedding)]
    x = np.array([[int(np.floor(64 * v)) + 1_000_000 for v in e] for _, e in kept])
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = c @ vectors[:, :32] / np.sqrt(values[:32])
    assert len(got) == 32 * n and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    near = lambda a, b: min(abs(a - b), abs(a + b)) < 1e-6
    exact = {k: int(((n * row - s) ** 2).sum()) for (k, _), row in zip(kept, x, strict=True)}
    place = {}
    for i, (k, _) in enumerate(kept):
        place.setdefault(k, i)
    for r in got:
        assert r.deviation == exact[r.vec_id] and near(r.whitened, white[place[r.vec_id], r.component - 1])
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)


def test_whitening_of_little(spark, tmp_path):
    df = odd_vectors(spark)
    run = lambda rows, name: queries.op11_whitening(spark, write(rows, tmp_path / name, "embeddings"))
    assert run(df.where("false"), "none").count() == 0
    assert run(df.where("vec_id = 0"), "equal").count() == 0
    assert run(df.where("vec_id in (900, 905)"), "unusable").count() == 0
    three = run(df.where("vec_id in (1, 2, 3)"), "three").where("vec_id is not null").collect()
    assert {r.component for r in three} == {1, 2} and all(r.identity_error < 1e-6 for r in three)
    ends = spark.createDataFrame([(i, [float(v), 1e38 * (-1) ** i]) for i, v in enumerate((1, 5, 9))], "vec_id long, embedding array<float>")
    huge = run(ends, "huge").collect()
    assert {r.vec_id for r in huge} == {0, 1, 2} and {r.deviation for r in huge} == {None}


def brute_variants(docs):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    out = {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        out[w] = [n[w], len(others), best if best and n[best] >= 2 * n[w] else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row += [n.get(row[2]), root]
    return out


def test_variants_agree_with_brute_force(spark, tmp_path):
    rng = random.Random(4)
    base = ["center", "centre", "colour", "color", "anagram", "nagaram", "résumé", "resume", "ÉCOLE", "aaaaa", "aaaaaa", "aaaaaaa", "mississippi", "listen", "silent", "Straße", "ÿÿÿÿÿ", "abcd", "abcde"]
    pool = [w if rng.random() < 0.5 else "".join(c if rng.random() < 0.93 else rng.choice("abcxyzéÀ×") for c in w) for w in base * 40]
    docs = [(i, " ".join(rng.choice(pool[: 1 + i * 3]) for _ in range(60)).replace("  ", "1")) for i in range(200)]
    docs += [(3, None), (None, "listen listen silent-Silent TINSEL"), (4, ""), (5, "x" * 100_000 + " " + "x" * 99_999), (5, "x" * 100_000), (6, "x" * 100_000), (7, "x" * 99_999), (7, "x" * 99_999)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, word int")
    got = {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in queries.op12_spelling(spark, write(df, tmp_path, "documents")).collect()}
    want = brute_variants(docs)
    assert len(want) > 60 and got == want
    assert sum(row[2] is not None for row in want.values()) > 20
    assert queries.op12_spelling(spark, write(df.where("false"), tmp_path / "none", "documents")).count() == 0


def test_variants_of_a_hot_key_and_long_chains(spark):
    letters = "abcdefgh"
    rng = random.Random(9)
    words = {"".join(rng.sample(letters, 8)) for _ in range(1500)}  # one anagram key for all of them
    words |= {w[:-1] for w in list(words)[:300]} | {w[:3] + "z" + w[4:] for w in list(words)[:300]}
    chain = {"q" * (10 + i): 3 * 2**i for i in range(30)}
    rows = [(w, 1 + i) for i, w in enumerate(sorted(words))] + list(chain.items())
    got = {r.word: r for r in spelling.variants(spark.createDataFrame([*rows, (None, 4), ("odd", None)], "word string, n long")).collect()}
    assert len(got) == len(rows) and {got[w].root for w in chain} == {"q" * 39}
    wide = [("\U0001f600\u65e5\u672c" * 3, 1), ("\U0001f600\u65e5\u672c" * 2 + "\U0001f600\u672c", 5), ("\U0001f601\u65e5\u672c" + "\U0001f600\u65e5\u672c" * 2, 2)]
    assert {(r.n, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame(wide, "word string, n long")).collect()} == {(1, 2, 5), (5, 1, None), (2, 1, None)}
    n = dict(rows)
    for w in list(words)[:200]:
        others = [v for v in n if v != w and (len(v) == len(w) and sum(a != b for a, b in zip(v, w, strict=True)) == 1 or abs(len(v) - len(w)) == 1 and any(max(v, w, key=len)[:i] + max(v, w, key=len)[i + 1 :] == min(v, w, key=len) for i in range(9)))]
        assert got[w].n_near == len(others)


TEXTS = [None, "", " ", "  two  spaces ", "plain words, with marks.", "naïve café — déjà vu", "日本語テスト", "👩‍👩‍👧 family", "a" * 3000, " " * 500, "tab\tand\nline\r\n", "▁ mark ▁▁", "<s> <0x0A> </s> <unk>", "\u0000null", "ｆｕｌｌ", "ȩ́"]


def test_pieces_agree_with_the_library(spark, tmp_path):
    rng = random.Random(2)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    shown = [library.id_to_piece(i).replace("▁", " ") for i in range(259, len(library))]
    texts = TEXTS + ["".join(rng.choice(shown) for _ in range(rng.randint(1, 12))) for _ in range(1500)] + ["".join(rng.choice("ab ▁\n.,-étß日<>") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "again", "x"), (None, "again", "x")], "doc_id long, text string, ids string")
    folder = write(df, tmp_path, "documents")
    got = {r.doc_id: r for r in queries.op13_pieces(spark, folder).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
    assert queries.op13_pieces(spark, folder).count() == len(texts) + 2
    assert queries.op13_pieces(spark, write(df.where("false"), tmp_path / "none", "documents")).count() == 0


def test_pieces_decode_any_ids(spark):
    rng = random.Random(8)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [[rng.choice([rng.randint(0, 31999), rng.randint(0, 260)]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    got = pieces.decode(spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(-1, None)], "k int, ids array<int>"), path).collect()
    assert {r.k: r.decoded for r in got} == {-1: ""} | {i: library.decode(r) for i, r in enumerate(rows)}
    assert pieces.Codec(path).encode("again and again") == library.encode("again and again")


def test_other_kinds_of_models_are_refused(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(bytes([0x12, 2, 0x18, 1]))  # a trainer of model type 1
    with pytest.raises(ValueError):
        pieces.Codec(str(path))
