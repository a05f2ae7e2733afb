"""Nearest vectors, ranked lexical search and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lares.llm import forest_search, lexical_search, periodic_runs, queries
from tests.llm import brute

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(brute.ASCII_LOWER))


def best_documents(rows, items, k=10):
    """rows: (doc_id, text), items: (item_id, text). item_id, rank, doc_id, score."""
    cut = [(key, Counter(terms(t))) for key, t in rows]
    cut = [(key, c) for key, c in cut if c]
    n, length = len(cut), sum(c.total() for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in cut:
            m = 25 + (75 * c.total() * n) // length
            score = sum(
                repeats * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t, repeats in Counter(terms(text)).items() if t in c
            )
            if score:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, key, -score) for i, (score, _, _, key) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def test_lexical_search(spark, small, rows_of):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = queries.op12_lexical_search(spark, small).collect()
    assert Counter(map(tuple, got)) == best_documents(rows_of(small), items)


def test_lexical_search_in_segments_and_blocks(spark, monkeypatch):
    """Many small segments, items in several blocks, and equal scores at the end of the list."""
    monkeypatch.setattr(lexical_search, "HELD", 50)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 20)
    rng = random.Random(4)
    word = lambda: f"W{int(rng.paretovariate(0.7)) % 200}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(150)]
    rows += [(i, "W3 w4, W5 the same") for i in range(200, 240)]
    items = [(i, "; ".join(word() for _ in range(rng.randrange(12)))) for i in range(30)] + [(99, "same the same w5")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lexical_search.rank(table, spark.createDataFrame(items, "item_id long, text string"), k=5).collect()
    assert Counter(map(tuple, got)) == best_documents(rows, items, 5)


def test_lexical_search_on_edges(spark, edges, edge_rows, nothing):
    items = [(1, None), (2, ""), (3, "?!"), (4, "words AGAIN"), (5, "größe 日本語 a b"), (None, "one two three"), (6, "again again")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("place", F.lit("extra"))
    got = lexical_search.rank(edges, table).collect()
    assert Counter(map(tuple, got)) == best_documents(edge_rows, items)
    assert lexical_search.rank(nothing, table).count() == lexical_search.rank(edges, table.limit(0)).count() == 0


def test_accumulators_are_limited():
    """The documents found are those of full evaluation, whenever the rest is too little for new ones."""
    rng = np.random.default_rng(7)
    for k in (1, 3, 10):
        for _ in range(60):
            lists = []
            for size in sorted(rng.integers(0, 40, 6)):
                docs = np.sort(rng.choice(40, size, replace=False)).astype(np.int32)
                lists.append((docs, rng.integers(0, 60 - size, size)))
            whole = np.zeros(40, np.int64)
            for docs, gain in lists:
                whole[docs] += gain
            kth = max(1, sorted(whole)[-k])
            docs, scores = lexical_search.first_documents(lists, 40, k)
            assert docs.tolist() == np.flatnonzero(whole >= kth).tolist() and scores.tolist() == whole[docs].tolist()


def nearest(ids, vectors, query, k):
    scores = (vectors * vectors[query]).sum(1)
    others = np.flatnonzero(ids != ids[query])
    return [int(ids[i]) for i in others[np.lexsort((ids[others], -scores[others]))][:k]]


def check_neighbours(got, ids, vectors, k, least):
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r)
    place = {int(v): i for i, v in enumerate(ids)}
    assert set(by) == {int(v) for v in ids if v % 20 == 0}
    found = total = 0
    for query, rows in by.items():
        assert [r["rank"] for r in rows] == list(range(1, min(k, len(ids) - 1) + 1))
        order = [(-r.score, r.vec_id) for r in rows]
        assert order == sorted(order) and query not in {r.vec_id for r in rows}
        for r in rows:
            assert r.score == pytest.approx(float(vectors[place[query]] @ vectors[place[r.vec_id]]), abs=1e-12)
        want = nearest(ids, vectors, place[query], k)
        found, total = found + len(set(want) & {r.vec_id for r in rows}), total + len(want)
    assert found >= least * total


def stored(spark, path):
    table = spark.read.parquet(path).select("vec_id", "embedding").toPandas().sort_values("vec_id")
    return table.vec_id.to_numpy(), np.array(table.embedding.tolist(), float)


def test_neighbours(spark, medium):
    ids, vectors = stored(spark, f"{medium}/embeddings.parquet")
    check_neighbours(queries.op11_forest_search(spark, medium).collect(), ids, vectors, 20, 0.9)


def test_neighbours_of_vectors_in_cells(spark, monkeypatch):
    """Cells in pieces, clusters, other lengths of vectors, and a third of the rows equal."""
    monkeypatch.setattr(forest_search, "CELL_ROWS", 128)
    monkeypatch.setattr(forest_search, "LEAF", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 10))
    vectors = centres[rng.integers(0, 12, 1800)] * rng.uniform(0.5, 2, (1800, 1)) + 0.3 * rng.normal(size=(1800, 10))
    vectors[rng.permutation(1800)[:600]] = centres[0]
    ids = np.sort(rng.permutation(4000)[:1800])
    table = spark.createDataFrame(list(zip(ids.tolist(), vectors.tolist(), strict=True)), "vec_id long, embedding array<double>").repartition(4)
    got = forest_search.neighbours(table, F.col("vec_id") % 20 == 0, k=7).collect()
    check_neighbours(got, ids, vectors, 7, 0.9)
    # Equal vectors come by vec_id.
    equal = [int(i) for i, v in zip(ids, vectors, strict=True) if (v == centres[0]).all()]
    first = {r.query_id: [] for r in got}
    for r in sorted(got, key=lambda r: r["rank"]):
        first[r.query_id].append((r.vec_id, r.score))
    for query in (q for q in first if q in equal):
        own = [v for v, score in first[query] if v in equal]
        assert own == [v for v in equal if v != query][: len(own)]


def test_neighbours_on_edges(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]), (7, [1.0]), (8, []), (None, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (40, [-1.0, 2.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table = table.withColumns({c: F.lit("extra") for c in ("place", "cell", "vector", "score", "n", "rank", "piece")})
    got = forest_search.neighbours(table, F.col("vec_id") % 20 == 0).collect()
    want = [(0, 1, 1, 0.5), (0, 2, 20, 0.5), (0, 3, 20, 0.5), (0, 4, 40, -1.0)]
    want += 2 * [(20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 40, 0.5)]
    want += [(40, 1, 1, 0.5), (40, 2, 20, 0.5), (40, 3, 20, 0.5), (40, 4, 0, -1.0)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert forest_search.neighbours(table.limit(0), F.lit(True)).count() == forest_search.neighbours(table, F.lit(False)).count() == 0


def varied_words(key, text):
    words = (text or "").encode().split()
    n, h = len(words), brute.crc(key) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def all_runs(words):
    """Stretches by every period, the smallest period of equal stretches."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - start >= max(24, 3 * q):
                found.setdefault((start, end + q), q)
            start = end + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def run_row(key, text):
    words = varied_words(key, text)
    own = all_runs(words)
    gone = {i for s, n, q in own for i in range(s + q, s + n)}
    best = min(own, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return key, len(own), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_periodic_runs(spark, small, rows_of):
    got = queries.op13_periodic_runs(spark, small).collect()
    want = Counter(run_row(key, text) for key, text in rows_of(small))
    assert Counter(map(tuple, got)) == want and sum(r[1] > 0 for r in want) > 10


def test_periodic_runs_on_edges(edges, edge_rows, nothing):
    rows = [(key, text) for key, text in edge_rows if key != 8]
    got = [r for r in map(tuple, periodic_runs.run_digests(edges).collect()) if r[0] != 8]
    assert Counter(got) == Counter(run_row(key, text) for key, text in rows)
    assert periodic_runs.run_digests(nothing).count() == periodic_runs.find_runs(nothing).count() == 0


def test_runs_of_nested_periods(spark, monkeypatch):
    """Roots that hold runs themselves, neighbouring runs, and several chunks."""
    monkeypatch.setattr(periodic_runs, "CHUNK", 600)
    rng = random.Random(8)
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(1, 5)):
            letters = rng.choice(["a", "ab", "abc", "abcdefgh"])
            root = [rng.choice(letters) for _ in range(rng.randrange(1, 30))]
            if i % 3 == 0:
                root = root[:3] + [rng.choice(letters) for _ in range(rng.randrange(1, 4))] * rng.randrange(1, 10)
            words += (root * rng.randrange(1, 9))[: rng.randrange(1, 200)]
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.find_runs(table).collect()}
    assert got == {key: all_runs(text.split()) for key, text in rows}


def test_range_successor():
    rng = np.random.default_rng(5)
    values = rng.permutation(300)
    tree = periodic_runs.Wavelet(values)
    low = rng.integers(0, 300, 500)
    high = np.minimum(300, low + rng.integers(0, 60, 500))
    x = rng.integers(0, 300, 500)
    want = [min((v for v in values[a:b] if v > y), default=-1) for a, b, y in zip(low, high, x, strict=True)]
    assert tree.successor(low, high, x).tolist() == want
