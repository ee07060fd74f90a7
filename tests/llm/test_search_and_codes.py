"""Ranked search, token files and vector codes: odd tables, brute force and SQL on the smallest tables."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SMALL
from tokenizers import Tokenizer

from signalloom import llm
from signalloom.llm import lexical, vector_codes, wavelet

TABLES = ("documents", "benchmark", "embeddings")


def against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = llm.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({llm.ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, got.select(*columns).collect())), sorted(want)


@pytest.mark.parametrize("name", ["op11_lexical_search", "op13_vector_codes"])
def test_against_sql(spark, name):
    got, want = against_sql(spark, name)
    assert got == want


# --- 11 -----------------------------------------------------------------------------------------------------------------


def brute_search(docs, items, top=20):
    """Scores by the definition, with regular expressions and plain loops."""

    def words(text):
        return re.findall(lexical.PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    of = [(i, words(t)) for i, t in docs]
    of = [(i, w) for i, w in of if w]
    n, total, df = len(of), sum(len(w) for _, w in of), {}
    for _, w in of:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, w in of:
            m = 75 + 25 * len(w) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 12 * m)) for t in words(text) if t in w)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k, r[3], -r[0]) for k, r in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("shard_bytes", [60, 400, 1 << 20])
def test_search_equals_brute_force(spark, shard_bytes):
    rng = random.Random(shard_bytes)
    vocabulary = ["Alpha", "beta", "é漢", "x1", "gamma", "ΔΕΛΤΑ", "the", "THE", "zeta9", "rare"]
    docs = [(i // 2, rng.choice(["-", " ", ", "]).join(rng.choices(vocabulary, weights=range(1, 11), k=rng.randint(1, 25)))) for i in range(120)]
    docs += [(None, "alpha beta"), (None, None), (7, ""), (8, " .,!"), (9, "the " * 400), (9, "the " * 400), (10, "alpha beta — x1")]
    items = [(1, "alpha rare Rare unknown"), (2, None), (3, ""), (4, "the the é漢"), (4, "the the é漢"), (None, "beta gamma zeta9 x1"), (5, "nowhere")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    index = lexical.build_index(d, shard_bytes)
    assert found(lexical.search(index, q)) == brute_search(docs, items)
    assert found(lexical.search(index, q, top=3, block_bytes=24)) == brute_search(docs, items, 3)  # several blocks of items


def test_search_of_nothing(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert found(lexical.search(lexical.build_index(d), q)) == []
    some = lexical.build_index(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert found(lexical.search(some, q.where("item_id > 1"))) == []


def test_strata_below_the_last_score_are_left_out():
    rows = lexical.shard_rows(0, list(range(3000)), [[b"t"] * (1 + i % 3) + [b"w"] * (i % 300) for i in range(3000)], 3000, 3000 * 150).to_pylist()
    shard = lexical.Shard(rows[0]["doc_ids"], np.array(rows[0]["m"]), np.array(rows[0]["size"]))
    for r in rows[1:]:
        shard.add(r["term"], *(np.array(r[c]) for c in ("m", "tf", "size", "docs")))
    best = lexical.Best(5)
    assert shard.search([("t", 1000)], best) < len(shard.m)
    assert list(best.ids) == [2, 302, 602, 902, 1202]  # the shortest with three of the term, by doc_id
    assert shard.search([("t", 1)], best) == 0


# --- 12 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def expected(library, docs):
    out, at = [], 0
    for i, t in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_equal_the_library(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted(map(tuple, wavelet.op12_token_files(spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == expected(library, docs)


def test_token_files_of_odd_tables(spark, library):
    docs = [(5, None), (3, ""), (1, " \n\t "), (2, "one two"), (2, "one two"), (None, "last <|endoftext|> one"), (4, "é漢🙂 " * 900), (-7, "a" * 3000), (6, "x  y\n z")]
    made = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int").repartition(3)
    got = [tuple(r) for r in wavelet.token_files(made, shard_tokens=100).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(library, docs)
    assert wavelet.token_files(made.limit(0)).collect() == []


def test_pieces_encode_like_the_library(library):
    own, rng = wavelet.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, cache=300), random.Random(1)
    parts = [" ", " ", " ", "  ", "\n", "\t", "a", "the", "'s", "'ll", "É", "1", "²", "漢", "🙂", "\x1c", "\x85", "\xa0", "!", "__", "er", "Th", "́", "​", "a" * 300, "<|endoftext|>", "　", " "]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(40)]
        own.window = rng.choice([5, 20, 1 << 20])
        ids, n = own.ids(pa.array([*texts, None]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [*[e.ids for e in library.encode_batch(texts, add_special_tokens=False)], []]


@pytest.mark.parametrize("top", [1, 2, 50_000, 1 << 20])
def test_wavelet_file(top):
    rng = np.random.default_rng(top)
    ids = np.minimum(rng.zipf(1.2, 300_000), top).astype(np.uint32) - 1
    ids[::1000] = top - 1
    data, reads = wavelet.pack(ids, [4, None, 9], [100, 0, len(ids) - 100]), []

    def read(at, n):
        reads.append(n)
        return data[at : at + n]

    file = wavelet.WaveletFile(read, len(data))
    assert (file.ids() == ids).all() and file.doc_ids == [4, None, 9] and file.starts.tolist() == [0, 100, 100, len(ids)]
    places = rng.integers(0, len(ids), 500)
    assert (file.access(places) == ids[places]).all() and (file.document(0) == ids[:100]).all() and len(file.document(1)) == 0
    for token in {0, 1, 7, top - 1, int(ids[5])}:
        at = np.flatnonzero(ids == token)
        assert file.count(token) == len(at) and file.rank(token, 1234) == (ids[:1234] == token).sum()
        assert (file.occurrences(token) == at).all() and (file.occurrences(token, 2, 3) == at[2:5]).all()
    assert file.count(1 << 30) == 0
    reads.clear()
    fresh = wavelet.WaveletFile(read, len(data))
    fresh.access([17])
    assert len(reads) == 2 + fresh.bits  # the directory, and a block of each plane
    with pytest.raises(IndexError):
        file.access([len(ids)])
    with pytest.raises(ValueError):
        wavelet.WaveletFile(lambda at, n: b"x" * n, 100)


# --- 13 -----------------------------------------------------------------------------------------------------------------


def brute_codes(vectors, entries, rounds):
    """Plain Lloyd rounds with Python's whole numbers: (code, error) of each vector, and the codebooks."""
    x = [[math.floor(1024 * c) for c in v] for v in vectors]
    w = len(x[0]) // 4
    cut = [[v[p * w : p * w + w] for v in x] for p in range(4)]
    books = [[list(v) for v in c[:entries]] for c in cut]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for v in cut[p]:
                groups.setdefault(near(v, books[p])[1], []).append(v)
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    found = [[near(cut[p][i], books[p]) for p in range(4)] for i in range(len(x))]
    return [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in found], books


def test_codes_equal_brute_force(spark):
    rng = random.Random(3)
    vectors = [[rng.choice([-0.5, 0.25, 0.001, rng.gauss(0, 0.3)]) for _ in range(8)] for _ in range(90)]
    vectors += [vectors[3]] * 20  # repeated vectors: ties and unused entries
    rows = [(k, v, None if k % 3 == 0 else k % 3, "x") for k, v in enumerate(vectors)]
    bad = [(500, None, 1, "x"), (501, [0.0] * 7 + [float("nan")], 1, "x"), (502, [0.0] * 7 + [float("inf")], 1, "x"), (503, [0.0] * 7 + [None], 1, "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got = {r.vec_id: r for r in vector_codes.vector_codes(df, entries=40, rounds=3, pivots=3).collect()}
    want, _ = brute_codes(vectors, 40, 3)
    assert sorted(got) == list(range(len(vectors)))
    assert [(got[k].code, got[k].error) for k in range(len(vectors))] == want
    for label in (None, 1, 2):
        total = sum(want[k][1] for k, _, label_, _ in rows if label_ == label)
        assert {got[k].label_error for k, _, label_, _ in rows if label_ == label} == {total}


def test_codes_of_few_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1)], schema)).collect() == []
    same = spark.createDataFrame([(None, [0.5] * 4, None), (None, [0.5] * 4, None), (2, [0.25] * 4, 1)], schema)
    got = sorted((r.vec_id is None, r.code, r.error, r.label_error) for r in vector_codes.vector_codes(same).collect())
    assert got == [(False, "00000000", 0, 0), (True, "01010101", 0, 0), (True, "01010101", 0, 0)]
    with pytest.raises(Exception, match="components"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [0.5] * 4, 1), (2, [0.5] * 8, 1)], schema)).collect()
    with pytest.raises(ValueError, match="divide"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [0.5] * 5, 1)], schema))


def test_pivots_save_evaluations():
    rng = np.random.default_rng(1)
    centres = rng.integers(-400, 400, (256, 16))
    x = centres[rng.integers(0, 256, 2000)] + rng.integers(-30, 30, (2000, 16))
    pivots = vector_codes.choose_pivots(centres, 8)
    index, best, evaluated = vector_codes.nearest(x, vector_codes.distances(x, pivots), centres, vector_codes.distances(centres, pivots))
    d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert evaluated < d.size / 4
