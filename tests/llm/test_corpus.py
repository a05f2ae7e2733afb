"""Operators that look at the whole corpus: near duplicates, leaks, repeats, scores, shards, and the pipeline."""

from __future__ import annotations

import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lares.llm import bpe, components, decontaminate, jaccard_join, lm_bloom, quality_fm, queries, secret_scan, sharding, suffix_dedup, tables, words
from lares.llm.tables import settle, text_slices
from tests.llm import brute

TEXTS = "doc_id long, text string"


def near(rows):
    """Rows without an id give no number to their component."""
    out = []
    for (key, text), members in zip(rows, brute.groups([t for _, t in rows]), strict=True):
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        n = len(brute.shingles(text))
        out.append((key, n, min(ids, default=None) if n else key))
    return Counter(out)


def test_near_duplicates(spark, medium, rows_of):
    got = queries.op2_jaccard_join(spark, medium).collect()
    assert Counter(map(tuple, got)) == near(rows_of(medium))


def test_near_duplicates_on_edges(edges, edge_rows, nothing):
    assert Counter(map(tuple, jaccard_join.near_duplicates(edges).collect())) == near(edge_rows)
    assert jaccard_join.near_duplicates(nothing).count() == 0


def test_near_duplicates_with_long_lists(spark, monkeypatch):
    """A large group of near copies, a passage in most texts, and blocks smaller than both."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = " ".join(word() for _ in range(30))
    origin = [word() for _ in range(120)]
    rows = []
    for i in range(90):
        if i % 2:
            copy = list(origin)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(120)] = word()
            rows.append((i, " ".join(copy)))
        else:
            rows.append((i, " ".join([*(word() for _ in range(40)), passage, *(word() for _ in range(rng.randrange(60)))])))
    table = spark.createDataFrame(rows, TEXTS).repartition(5)
    assert Counter(map(tuple, jaccard_join.near_duplicates(table).collect())) == near(rows)


def _sketch_of(texts):
    sketch = np.zeros(1 << jaccard_join.SKETCH_BITS, np.int64)
    for text in texts:
        table = pa.array([text], pa.string())
        (own,) = (s for slice_ in text_slices(table) for s in jaccard_join.shingle_sets(slice_))
        np.add.at(sketch, (own >> np.uint64(64 - jaccard_join.SKETCH_BITS)).astype(np.int64), 1)
    return sketch


def test_the_sketch_counts_all_texts(spark, edges, edge_rows, nothing):
    """Copies, repeated rows and long texts included, whatever the sizes of tasks."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(300)))) for i in range(400)]
    for table, texts in ((edges, edge_rows), (spark.createDataFrame(rows, TEXTS).repartition(7), rows)):
        got = jaccard_join.frequency_sketch(jaccard_join.facts(table.select("doc_id", "text")))
        assert np.array_equal(got, _sketch_of(text for _, text in texts))
    assert not jaccard_join.frequency_sketch(jaccard_join.facts(nothing.select("doc_id", "text"))).any()


def test_members_of_lists_without_partners():
    rng = np.random.default_rng(3)
    n, at = rng.integers(1, 60, 400), rng.integers(0, 8, 400)
    lists = np.sort(rng.integers(0, 90, 400))
    order = np.lexsort((n, lists))
    lists, n, at = lists[order], n[order], at[order]
    fits = [
        (x, y) for x in range(400) for y in range(400)
        if x != y and lists[x] == lists[y] and 5 * min(n[x], n[y]) >= 4 * max(n[x], n[y])
        and min(n[x] - at[x], n[y] - at[y]) * 9 >= 4 * (n[x] + n[y])
    ]
    kept = set(jaccard_join._with_partners(lists, n, at).tolist())
    assert {x for pair in fits for x in pair} <= kept and len(kept) < 300


def test_t_occurrence():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60):
        query = np.sort(rng.choice(1000, n, replace=False).astype(np.uint64))
        candidates = [np.sort(rng.choice(query, rng.integers(0, n + 1), replace=False)) for _ in range(40)] + [query]
        want = [(c, len(own)) for c, own in enumerate(candidates) if len(own) >= jaccard_join.needed(n)]
        assert sorted(jaccard_join.divide_skip(query, candidates)) == want


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1064)]
    found = components.components(spark.createDataFrame(links, "u long, v long"))
    got = {r.u: r.v for r in found.collect()}
    label = {x: x for link in links for x in link}
    for _ in label:
        before = dict(label)
        for u, v in links:
            label[u] = label[v] = min(label[u], label[v])
        if label == before:
            break
    assert got == {u: v for u, v in label.items() if u != v}


def test_components_in_blocks(spark, monkeypatch):
    """Links of many blocks need rounds; stars that share leaves, repeated links and keys of bytes as well."""
    monkeypatch.setattr(components, "CONTRACTED", 8)
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 130)] * 2 + [(300 + i % 7, 400 + i) for i in range(40)]
    pairs += [(500, 501)] * 20 + [(600, 600), (None, 601)]
    rng.shuffle(pairs)
    key = lambda x: None if x is None else x.to_bytes(2, "big")
    table = spark.createDataFrame([(key(a), key(b)) for a, b in pairs], "u binary, v binary").repartition(6)
    got = components.components(table).collect()
    want = {i: 0 for i in range(1, 61)} | {i: 100 for i in [*range(101, 130), 200]}
    want |= {400 + i: 300 + i % 7 for i in range(40)} | {501: 500}
    assert Counter((bytes(r.u), bytes(r.v)) for r in got) == Counter((key(a), key(b)) for a, b in want.items())


def test_components_take_few_jobs(spark, monkeypatch):
    """the driver keeps something of every job, stage and task. Links of one block need no round."""
    written = []
    monkeypatch.setattr(components, "settle", lambda df: written.append(1) or settle(df))
    table = spark.createDataFrame([(i, i + 1) for i in range(500)], "u long, v long").repartition(5)
    tracker, group = spark.sparkContext.statusTracker(), "components-take-few-jobs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = components.components(table)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(written) == 2
    assert len(tracker.getJobIdsForGroup(group)) <= 10
    assert {(r.u, r.v) for r in found.collect()} == {(i, 0) for i in range(1, 501)}


def normal(text):
    return " ".join(re.findall(r"[^\W_]+", (text or "").lower()))


def test_leaks(spark, medium, rows_of):
    items = {r.item_id: normal(r.text) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()}
    texts = [(key, f" {normal(t)} ") for key, t in rows_of(medium)]
    whole = {(key, i) for key, t in texts for i, item in items.items() if f" {item} " in t}
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontaminate(spark, medium).collect()}
    assert whole and got == whole


QUESTION = "Tom has 5 apples and buys 7 more apples for 3 dollars each. How much does Tom pay?"


def test_leaks_with_other_slots(spark):
    items = spark.createDataFrame([(1, QUESTION), (2, "too short"), (3, None), (4, ""), (None, QUESTION)], "item_id long, text string")
    docs = [
        (1, "xx yy. Anna has 9 apples and buys 4 more apples for 2 euros each. How much does Anna pay? zz"),
        (2, QUESTION.upper()),
        (3, "Anna has 9 apples and Bob buys one"),
        (4, None),
        (5, ""),
        (6, "too short"),
        (7, "Tom likes pears and sells all of them to the people in the market. How much do they weigh?"),
        (None, QUESTION),
        (8, QUESTION),
        (8, QUESTION),
    ]
    found = decontaminate.leaks(spark.createDataFrame(docs, TEXTS), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, i) for d in (1, 2, 8, None) for i in (1, None)}
    assert all(r.covered == r.item_words == 18 for r in found)


def test_leaks_need_consistent_slots(spark):
    item = "If Ann gave Bob the red book then Bob owes Ann a favour and Ann thanks Bob again"
    swapped = "If Joe gave Sue the red book then Tim owes Kim a favour and Max thanks Pam again"
    renamed = "If Joe gave Sue the red book then Sue owes Joe a favour and Joe thanks Sue again"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame([(1, swapped), (2, renamed)], TEXTS), items).collect()
    assert [(r.doc_id, r.consistent) for r in found] == [(2, 1.0)]


def test_leaks_of_items_with_few_literal_words(spark):
    items = [
        (1, "What is 12 times 13?"),
        (2, "Compute 12 + 7 - 3 * 4"),
        (3, "What is 15 percent of 240 dollars plus 30 dollars?"),
        (4, "Find the sum of 3, 5, 7, 9 and 11"),
        (5, "What is 12+7?"),
        (6, "Add 1 2 3 4 5 6 7 8 9 10 and then take 40 50 60 70 80 from all that was left"),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, f"so they said, {text.lower()} and no more") for i, text in items]
    docs += [
        (13, "What is 20 percent of 90 euros plus 8 euros?"),
        (14, "Find the sum of 2, 4, 6, 8 and 10"),
        (24, "Find the sum of 2, 4, 6, 8 or 10"),
        (34, "What is 12 times 14?"),
    ]
    found = decontaminate.leaks(spark.createDataFrame(docs, TEXTS), table).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i, _ in items} | {(13, 3), (14, 4)}
    again = spark.createDataFrame([(1, "Find the sum of 3, 5, 7, 9 and 3")], "item_id long, text string")
    docs = [(1, "Find the sum of 2, 4, 6, 8 and 2"), (2, "Find the sum of 2, 4, 6, 8 and 9")]
    assert [r.doc_id for r in decontaminate.leaks(spark.createDataFrame(docs, TEXTS), again).collect()] == [1]
    # The words before the first window with enough literals.
    late = spark.createDataFrame([(1, "7 8 9 10 11 12 are the numbers that we use")], "item_id long, text string")
    docs = [(1, "1 2 3 4 5 6 are the numbers that we use"), (2, "1 2 3 x 5 6 are the numbers that we use")]
    assert [r.doc_id for r in decontaminate.leaks(spark.createDataFrame(docs, TEXTS), late).collect()] == [1]


def test_leaks_with_number_words_and_glued_units(spark):
    items = [
        (1, "A shop packs three baskets with twelve pears and twenty-five plums for the market on the hill"),
        (2, "Ein Koch nimmt zwei Eier und hundert Gramm Mehl für den Kuchen in der kleinen Form"),
        (3, "The board weighs 5kg and has a length of 12cm when it lies flat on the wide bench"),
        (4, "A pump moves 3.5l of clear water in the time that a tall clerk needs to write"),
    ]
    docs = [
        (1, "so a shop packs six baskets with twenty pears and forty-two plums for the market on the hill"),
        (2, "ein Koch nimmt 7 Eier und dreißig Gramm Mehl für den Kuchen in der kleinen Form, ja"),
        (3, "The board weighs 7 kg and has a length of 15 cm when it lies flat on the wide bench"),
        (4, "A pump moves 12 ml of clear water in the time that a tall clerk needs to write"),
        (5, "The board weighs much and has a length of two when it stands up on the narrow bench"),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame(docs, TEXTS), table).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i, _ in items}
    assert {r.item_id: r.item_words for r in found} == {1: 17, 2: 16, 3: 20, 4: 18}


def test_common_windows_are_no_evidence(spark):
    rng = random.Random(5)
    order = "Read the text below with care and then choose the one answer that fits it best"
    own = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(50 * 20)]
    questions = [" ".join(own[20 * i : 20 * i + 20]) for i in range(50)]
    items = [(i, f"{order} {q}") for i, q in enumerate(questions)]
    items += [(100, "Say 7 8"), (None, f"{order} {questions[0]} anew")]
    items += [(200 + i, "one text that many items of the table repeat word for word") for i in range(9)]
    docs = [
        (1, f"intro {order} and more"),
        (2, f"{order} {questions[3]}"),
        (3, f"other words, then {questions[4]}"),
        (4, " ".join(questions[5].split()[:13])),
        (5, " ".join(questions[6].split()[:12])),
        (6, f"{order} {' '.join(questions[7].split()[:12])}"),
        (7, "one text that many items of the table repeat word for word"),
        (None, f"{order} {questions[0]} anew"),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.covered for r in decontaminate.leaks(spark.createDataFrame(docs, TEXTS), table).collect()}
    expected = {(2, 3): 20, (3, 4): 20, (4, 5): 13, (None, 0): 20, (None, None): 21}
    assert found == expected | {(7, 200 + i): 12 for i in range(9)}


def test_leaks_on_edges(spark, edges, edge_rows, nothing):
    items = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(edge_rows)], "item_id long, text string")
    found = decontaminate.leaks(edges, items).collect()
    assert {(8, 10), (10, 12), (6, 7), (6, 8), (6, 9), (7, 7)} <= {(r.doc_id, r.item_id) for r in found}
    assert decontaminate.leaks(nothing, items).count() == decontaminate.leaks(edges, items.limit(0)).count() == 0


def in_order(rows):
    """By doc_id, rows without one last; equal ids stay in the table's order."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_cover():
    cover = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.PERIOD for a in cover for b in cover} == set(range(suffix_dedup.PERIOD))


def repeats(rows):
    rows = in_order(rows)
    return Counter((key, *r) for (key, _), r in zip(rows, brute.without_repeats(rows), strict=True))


def test_repeats(spark, small, rows_of):
    got = queries.op5_suffix_dedup(spark, small).collect()
    assert Counter(map(tuple, got)) == repeats(rows_of(small))


def test_repeats_on_edges(edges, edge_rows, nothing):
    assert Counter(map(tuple, suffix_dedup.remove_repeats(edges.coalesce(1)).collect())) == repeats(edge_rows)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("partitions", [1, 6])
def test_repeats_of_random_pieces(spark, partitions):
    """Pieces around the width at all distances, overlapping repeats, and ids against the order of the table."""
    rng = random.Random(11)
    source = "".join(rng.choice("abcdé") for _ in range(3000))
    rows = []
    for i in range(60):
        pieces = []
        for _ in range(rng.randrange(5)):
            a = rng.randrange(2700)
            pieces += [source[a : a + rng.choice([80, 95, 99, 100, 101, 130, 250])], "".join(rng.choice("xyz") for _ in range(rng.randrange(9)))]
        rows.append((i * 37 % 60, "".join(pieces)))
    rows += [(100, "ab" * 300), (101, "ab" * 90)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, TEXTS).repartition(partitions)
    assert Counter(map(tuple, suffix_dedup.remove_repeats(table).collect())) == repeats(rows)


def test_no_repeats_in_a_task(spark):
    """Short texts and texts of their own, by themselves in a task, beside a task with repeats."""
    rng = random.Random(12)
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(150 if i % 2 else 30))) for i in range(40)]
    rows += [(40, rows[1][1]), (41, None)]
    for table in (spark.createDataFrame(rows, TEXTS).coalesce(1), spark.createDataFrame(rows, TEXTS).repartitionByRange(20, "doc_id")):
        assert Counter(map(tuple, suffix_dedup.remove_repeats(settle(table)).collect())) == repeats(rows)


def test_rows_of_a_slice_are_sent_as_distances():
    """Rows and ids are sent again to each range that has members of theirs: near ones have to be short."""
    rng = np.random.default_rng(8)
    whole = np.iinfo(np.int64)
    for values in ([7], [whole.min, whole.max, 0, -1], [-5, -5], rng.integers(whole.min, whole.max, 50), 10**15 + rng.permutation(900)):
        values = np.array(values, np.int64)
        assert np.array_equal(suffix_dedup._unpack_near(suffix_dedup._pack_near(values), len(values)), values)
    n = 900
    texts = next(text_slices(pa.array(["x" * 200] * n)))
    batch = pa.RecordBatch.from_pydict({"place": np.arange(n) + (5 << 33), "doc_id": np.arange(n) + 10**12})
    keys, owner = rng.integers(0, 1 << 63, 40 * n, np.uint64) * np.uint64(2), np.repeat(np.arange(n), 40)
    at = texts.offsets[owner] + np.tile(np.arange(40), n)
    sent = suffix_dedup.Slice(batch, texts).members(keys, keys, owner, at, at * 0, at * 0 + 100, 5)
    assert sum(len(r["places"]) + len(r["doc_ids"]) for r in sent) < 32 * (16 + 4 * n)
    got = suffix_dedup._received(sent)
    want = (keys, keys, owner + 10**12, owner + (5 << 33), at - texts.offsets[owner], at * 0, at * 0 + 100)
    a, b = np.argsort(got[0]), np.argsort(keys)
    assert all(np.array_equal(x[a], y[b]) for x, y in zip(got, want, strict=True))


def test_members_of_a_bucket_are_sent_in_few_bytes():
    """A bucket's hash in four bytes, a text's number once: the name takes the rest."""
    rng = np.random.default_rng(9)
    n, each, bits = 300, 40, 6
    batch = pa.RecordBatch.from_pydict({"place": np.arange(n), "doc_id": np.arange(n)})
    rows = suffix_dedup.Slice(batch, next(text_slices(pa.array(["x" * 200] * n))))
    owner = np.repeat(np.arange(n), each)
    at = rows.starts[owner] + np.tile(np.arange(each), n)
    names = rng.integers(0, 1 << 63, n * each, np.uint64)
    keys = suffix_dedup._first_bits(rng.integers(0, 1 << 63, n * each, np.uint64) * np.uint64(2), bits + suffix_dedup.KEY_BITS)
    sent = rows.members(keys, names, owner, at, at * 0 + 30, at * 0 + 100, bits)
    assert sum(len(r["keys"]) for r in sent) <= n * each * 4 + 64 * 9
    assert sum(len(r["counts"]) for r in sent) <= 4 * sum(len(r["places"]) for r in sent)
    got = suffix_dedup._received(sent)
    a, b = np.argsort(got[1]), np.argsort(names)
    for x, y in zip(got, (keys, names, owner, owner, at - rows.starts[owner], at * 0 + 30, at * 0 + 100), strict=True):
        assert np.array_equal(x[a], y[b])


@pytest.mark.parametrize("n", [0, 1, 3000, 60_000])
def test_maps_of_buckets(spark, monkeypatch, n):
    """All keys are found, also in a full map; of others few, as long as there is room."""
    monkeypatch.setattr(suffix_dedup, "MAP_BITS", 16)
    rng, bits, key_bits = np.random.default_rng(10), 3, 35
    keys = np.unique(suffix_dedup._first_bits(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2), key_bits))
    pieces = [(part, *suffix_dedup._segment(keys[some], bits)) for part, some in suffix_dedup._by_range(keys, bits)]
    got = suffix_dedup._whole_map(spark.createDataFrame(pieces, "part long, segment binary, probes int"), bits, key_bits)
    assert got.holds(keys | np.uint64(5)).all()
    others = rng.integers(0, 1 << 63, 20_000, np.uint64) * np.uint64(2)
    assert n > 3000 or got.holds(others).mean() < 0.01


def test_spans_of_blocks(spark):
    """Spans of one block from several ranges become one row; the rows they touch are found, also in far partitions."""
    blocks = {0: [(3, 0, 100), (3, 50, 180), (511, 7, 107)], 1: [(0, 0, 100)], (5 << 33) >> suffix_dedup.BLOCK_BITS: [(64, 1, 101)]}
    types = (np.uint16, np.int64, np.int64)
    sent = [(b, *(np.array([v], t).tobytes() for v, t in zip(s, types, strict=True))) for b, own in blocks.items() for s in own]
    spans = suffix_dedup.joined_spans(spark.createDataFrame(sent, "block long, rows binary, starts binary, ends binary"), 4)
    got = {r["block"]: list(zip(*(np.frombuffer(r[c], t).tolist() for c, t in zip(r.asDict(), (None, *types)) if t), strict=True)) for r in spans.collect()}
    assert got == blocks | {0: [(3, 0, 180), (511, 7, 107)]}
    touched = np.unpackbits(suffix_dedup.touched_rows(spans), axis=1, bitorder="little")
    assert touched.sum() == 4
    for block, own in blocks.items():
        assert all(touched[suffix_dedup._slot(np.array([block]))[0], row] for row, _, _ in own)
    assert not suffix_dedup.touched_rows(spans.limit(0)).any()


class Tasks:
    """In place of a table: keeps the functions that its tasks would run, so that a test can run them here."""

    sparkSession = sparkContext = property(lambda self: self)

    def __init__(self):
        self.functions = []

    def broadcast(self, value):
        return SimpleNamespace(value=value)

    def select(self, *columns):
        return self

    groupBy = select

    def mapInArrow(self, function, schema):
        self.functions.append(function)
        return self

    applyInArrow = mapInArrow


def functions_of_tasks(bits):
    """Of the three passes over the texts: what the tasks do that read texts, and those that get a range. The maps hold all."""
    full = suffix_dedup.Map(np.full(1 << (suffix_dedup.MAP_BITS - 3), 255, np.uint8), np.ones(1 << bits, np.uint8), 40)
    tables = [Tasks(), Tasks(), Tasks()]
    suffix_dedup.repeated_buckets(tables[0], bits, 40)
    suffix_dedup.ranked_ties(tables[1], full, bits)
    suffix_dedup.sorted_strings(tables[2], full, bits)
    return [t.functions for t in tables]


def batch_of(rows, first=0):
    ids, texts = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "place": np.arange(first, first + len(rows))})


def peak(function):
    """Bytes at the most and the result."""
    tracemalloc.start()
    try:
        result = function()
        return tracemalloc.get_traced_memory()[1], result
    finally:
        tracemalloc.stop()


def test_memory_of_a_task():
    """Texts without repeats, all of whose strings have to be sent, as in large tables, where the maps are full. An
    executor holds two workers beside its heap."""
    rng = np.random.default_rng(13)
    letters = rng.integers(97, 123, 8 << 20, np.uint8).tobytes().decode()
    rows = [(i, letters[a : a + 4096]) for i, a in enumerate(range(0, len(letters), 4096))]
    batches = [batch_of(rows[a : a + 900], a) for a in range(0, len(rows), 900)]
    tasks = functions_of_tasks(2)
    for (read, _), most in zip(tasks, (105, 110, 250), strict=True):
        assert peak(lambda read=read: [None for _ in read(iter(batches))])[0] < most << 20
    read, sort = tasks[2]
    table = pa.Table.from_batches(b.filter(pc.equal(b.column("part"), 1)) for b in read(iter(batches)))
    used, spans = peak(lambda: sort((pa.scalar(1),), table))
    assert not spans.num_rows
    assert used < 190 << 20


@pytest.mark.parametrize("small", [False, True])
def test_repeats_by_small_rounds(monkeypatch, small):
    """Rounds, pieces and tables of known keys of any size give the same spans, also of ids against the table's order."""
    if small:
        for name, value in (("SORTED", 50), ("SMALL_SLICE", 700), ("KNOWN", 90), ("HELD", 40)):
            monkeypatch.setattr(suffix_dedup, name, value)
    rng, bits = random.Random(14), 2
    source = "".join(rng.choice("abcd") for _ in range(1500))
    texts = ["".join(source[a : a + rng.choice([90, 100, 140, 300])] for a in rng.choices(range(1200), k=rng.randrange(5))) for _ in range(60)]
    rows = [(None if i % 19 == 7 else i * 37 % 60 // 2, text) for i, text in enumerate(texts)]
    sent = [[], [], []]
    for some in (range(25), range(25, 60)):  # two tasks
        for (read, _), held in zip(functions_of_tasks(bits), sent, strict=True):
            held += read(iter([batch_of(rows[some.start : some.stop], some.start)]))
    table, (_, sort) = pa.Table.from_batches(sent[0]), functions_of_tasks(bits)[0]
    segments = [sort((pa.scalar(part),), table.filter(pc.equal(table.column("part"), part))) for part in range(1 << bits)]
    twice = suffix_dedup._whole_map(SimpleNamespace(toArrow=lambda: pa.concat_tables(segments)), bits, 40)
    buckets, counts = np.unique(suffix_dedup.Suffixes(next(text_slices(pa.array(texts)))).bucket, return_counts=True)
    assert twice.holds(buckets[counts > 1]).all()
    assert twice.holds(buckets[counts == 1]).mean() < 0.01
    inside = [np.zeros(len(text), bool) for text in texts]
    for (_, sort), held in zip(functions_of_tasks(bits)[1:], sent[1:], strict=True):
        table = pa.Table.from_batches(held)
        for part in range(1 << bits):
            found = sort((pa.scalar(part),), table.filter(pc.equal(table.column("part"), part)))
            for r in found.filter(pc.is_valid(found.column("block"))).to_pylist():
                for row, a, b in zip(*suffix_dedup._read_spans([r]), strict=True):
                    inside[(r["block"] << suffix_dedup.BLOCK_BITS) + int(row)][a:b] = True
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    want = brute.without_repeats([rows[i] for i in order])
    assert [int(inside[i].sum()) for i in order] == [r[1] for r in want]
    assert sum(r[1] for r in want) > 1000


def check_scores(got, rows):
    want = defaultdict(list)
    for (key, _), r in zip(rows, brute.unigram_scores(rows), strict=True):
        want[key].append(r)
    assert len(got) == len(rows)
    for r in got:
        known = [w for w in want[r.doc_id] if (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]]
        assert any(r.base_score == pytest.approx(w[4], rel=1e-9) for w in known)
        assert np.isfinite(r.score) and r.score < 0


def test_language_model(spark, medium, rows_of):
    got = queries.op6_lm_scores(spark, medium).collect()
    check_scores(got, rows_of(medium))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_on_edges(edges, edge_rows, nothing):
    check_scores(lm_bloom.score(edges).collect(), edge_rows)
    assert lm_bloom.score(nothing).count() == 0


def test_rare_tokens_come_by_the_join(spark, small, rows_of, monkeypatch):
    monkeypatch.setattr(lm_bloom, "HOT", 8)
    check_scores(queries.op6_lm_scores(spark, small).collect(), rows_of(small))


def test_filter_levels():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) << np.uint64(1))
    counts = rng.zipf(1.6, len(keys)).clip(1, 1 << 20)
    parts = keys >> np.uint64(60)
    segments = [(1, int(p), lm_bloom.build_segment(keys[parts == p], counts[parts == p], 1)) for p in np.unique(parts)]
    found = lm_bloom.Filter(segments, 4).counts(keys, 1)
    level = np.floor(np.log2(counts))
    low = np.where(level < 1, 1, 1.5 * np.exp2(level))
    assert (found >= low).all() and (found == low).mean() > 0.9
    absent = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    assert (lm_bloom.Filter(segments, 4).counts(absent, 1) > 0).mean() < 0.1


def plain_scores(rows):
    """Scores by exact levels, without false hits."""
    middle = lambda c: c if c < 2 else 1.5 * 2 ** (c.bit_length() - 1)
    texts = [(key, [*brute.low_words(text), None]) for key, text in rows]
    learned = [own for key, own in texts if key is None or brute.crc(key) % 5 != 1]
    one = Counter(w for own in learned for w in own)
    two = Counter(pair for own in learned for pair in zip(["", *own], own, strict=False))
    out = {}
    for key, own in texts:
        out[key] = 0
        for v, w in zip(["", *own], own, strict=False):
            p = (middle(one[w]) + 0.5) / (one.total() + 0.5 * (len(one) + 1))
            history = len(learned) if v == "" else middle(one[v])
            out[key] += np.log10(0.6 * min(middle(two[v, w]), history) / history + 0.4 * p if history else p)
    return out


def test_scores_are_those_of_exact_levels(spark, small, rows_of):
    got, want = queries.op6_lm_scores(spark, small).collect(), plain_scores(rows_of(small))
    off = [abs(r.score - want[r.doc_id]) / r.n_tokens for r in got]
    assert len(off) == len(want) and np.mean(off) < 0.03


def test_quality_scores(spark, medium):
    got = {r.doc_id: r for r in queries.op3_quality_fm(spark, medium).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    assert all(r.held_out == (brute.crc(i) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(labels[i], got[i].predicted) for i in labels if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.93 * len(held)


def test_quality_scores_on_edges(spark, edges, edge_rows, nothing):
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 1), (8, 1), (None, 0), (99, 1)], "doc_id long, quality int")
    machine = quality_fm.fit(edges, labels)
    got = quality_fm.score(edges, machine).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in edge_rows) and all(0 <= r.score <= 1 for r in got)
    assert quality_fm.score(nothing, machine).count() == 0
    untaught = quality_fm.fit(edges, labels.limit(0))
    assert {r.score for r in quality_fm.score(edges, untaught).collect()} == {0.5}


def test_interactions_by_the_sum_of_squares():
    rng = np.random.default_rng(0)
    machine = quality_fm.Machine(0.3, rng.normal(size=quality_fm.WIDTH), rng.normal(size=(quality_fm.WIDTH, 4)))
    ids, values = rng.choice(quality_fm.WIDTH, 6, replace=False), rng.normal(size=6)
    got, _ = machine.raw(quality_fm.Features(np.zeros(6, np.int64), ids, values), 1)
    v = machine.factors[ids] * values[:, None]
    pairs = sum(v[i] @ v[j] for i in range(6) for j in range(i))
    assert got[0] == pytest.approx(0.3 + machine.linear[ids] @ values + pairs)


def check_shards(got, rows, spread):
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((k, len((t or "").encode()) + 1) for k, t in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= spread
    return sizes


def test_shards(spark, medium, rows_of):
    got = queries.op4_sharding(spark, medium).collect()
    rows = rows_of(medium)
    mean = sum(len(t.encode()) + 1 for _, t in rows) / 8
    check_shards(got, rows, 0.03 * mean)
    crcs = {r.doc_id: r.text_crc32 for r in got}
    assert all(crcs[k] == __import__("zlib").crc32(t.encode()) for k, t in rows)


def test_shards_of_a_large_group(spark):
    rows = [(i, "a copy of one text" if i % 3 == 0 else f"text number {i}" * (i % 7)) for i in range(1200)]
    sizes = check_shards(sharding.assign(spark.createDataFrame(rows, TEXTS), shards=5, bundles=64).collect(), rows, 1500)
    assert set(sizes) == set(range(5))


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_equal_texts_share_a_shard(spark, medium, scale):
    """At every size, for no group here is as large as a shard; sizes stay near equal where the texts are small to a shard."""
    table = spark.read.parquet(medium.replace("sf0.01", scale) + "/documents.parquet")
    got = sharding.assign(table, shards=8).join(table.select("doc_id", F.md5("text").alias("digest")), "doc_id").collect()
    shards_of, sizes = defaultdict(set), Counter()
    for r in got:
        shards_of[r.digest].add(r.shard)
        sizes[r.shard] += r["size"]
    assert len(shards_of) < len(got) and all(len(own) == 1 for own in shards_of.values())
    largest = max(r["size"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= max(largest, 0.01 * sum(sizes.values()) / 8)


def test_only_a_group_beyond_a_shard_is_cut(spark):
    rows = [(i, "one text of many copies" if i < 500 else "other copies" if i < 600 else f"another text, number {i}") for i in range(1000)]
    got = sharding.assign(spark.createDataFrame(rows, TEXTS), shards=8, bundles=64).collect()
    assert {r.shard for r in got if r.doc_id < 500} == set(range(8))
    assert len({r.shard for r in got if 500 <= r.doc_id < 600}) == 1


def test_tokens_of_shards_are_words(edges, edge_rows):
    got = Counter((r.doc_id, r.tokens) for r in sharding.measure(edges).collect())
    assert got == Counter((key, len(brute.words(text))) for key, text in edge_rows)


def test_shards_on_edges(edges, edge_rows, nothing):
    check_shards(sharding.assign(edges, shards=2).collect(), edge_rows, 10**6)
    assert sharding.assign(nothing).count() == 0


def test_a_settled_table_is_in_the_shared_folder(spark, edges):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert all(shared in path for path in settle(edges).inputFiles())


def brute_pipeline(rows, items, encode, kept_by_rules):
    rows = [(k, t) for k, t in rows if k in kept_by_rules]
    together = brute.groups([t for _, t in rows])
    rows = [r for i, r in enumerate(rows) if r[0] == min(rows[m][0] for m in together[i])]
    texts = {k: f" {normal(t)} " for k, t in rows}
    rows = [(k, t) for k, t in rows if not any(f" {item} " in texts[k] for item in items)]
    learned = brute.learned_dictionary(rows)
    return {k: encode(secret_scan.masked(t, learned)) for k, t in rows}


def test_pipeline(spark, medium, rows_of):
    import public_tokenizers
    import tiktoken

    from lares.llm import bpe, quality_rules

    encoder = bpe.load_encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.judge(docs).filter("kept").select("doc_id").collect()}
    items = [normal(r.text) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    want = brute_pipeline(rows_of(medium), items, encoding.encode_ordinary, kept)
    got = corpus_pipeline.run(spark, medium).collect()
    assert len(got) == len(want) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert {r.doc_id: list(r.ids) for r in got} == want


def test_pipeline_on_edges(spark, edges, nothing, tmp_path):
    edges = edges.withColumn(corpus_pipeline.ROW, F.lit("extra"))
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (edges, nothing):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = settle(stage(spark, docs, str(tmp_path)))
            assert name == "byte_bpe" or docs.columns == columns
    assert docs.count() == 0


def test_pipeline_counts_all_texts_of_its_join(spark, small, monkeypatch):
    sketches, count = [], jaccard_join.frequency_sketch
    monkeypatch.setattr(jaccard_join, "frequency_sketch", lambda *of: sketches.append(count(*of)) or sketches[-1])
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    corpus_pipeline.apply_jaccard_join(spark, docs, small)
    assert np.array_equal(sketches[0], _sketch_of(r["text"] for r in docs.collect()))


def test_batches_of_written_tables_are_small(spark):
    """Long texts are not gathered by number of rows; the session keeps its own settings."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = [spark.conf.get(name) for name in names]
    docs = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("words "), 10_000).alias("text"))
    got = [r.n for r in settle(docs.mapInArrow(sizes, "n long")).collect()]
    assert sum(got) > 400 * 60_000 and max(got) < tables.BATCH_BYTES + 100_000
    assert [spark.conf.get(name) for name in names] == before
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        settle(spark.range(3).select(F.expr("1 / (id - id)").alias("x")))
    assert [spark.conf.get(name) for name in names] == before


def test_written_tables_leave_no_shuffle_files(spark):
    def shuffled():
        return {name for name in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in name}

    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    before = shuffled()
    assert settle(spark.range(1000).groupBy((F.col("id") % 77).alias("k")).count()).count() == 77
    counted = len({name.split("shuffle_")[1].split("_")[0] for name in shuffled() - before})
    for _ in range(50):
        if counted <= 1:  # count()'s own
            break
        time.sleep(0.2)
        counted = len({name.split("shuffle_")[1].split("_")[0] for name in shuffled() - before})
    assert counted <= 1


def test_blocks_of_hashed_words(monkeypatch):
    """Words have the same hashes whatever the blocks, and a slice of texts leaves no large table of powers behind."""
    texts = next(text_slices(pa.array(["Some words of a text " * 20_000, None, "x" * 700, " and more, Größe\n" * 40_000])))
    found = words.find_words(texts)
    for lower in (True, False):
        data = words.LOWER[texts.data] if lower else texts.data
        whole = words.span_hashes(words.prefix_hashes(data), found.starts, found.ends)
        for size in (500, 50_000, words.HASHED):
            monkeypatch.setattr(words, "HASHED", size)
            assert np.array_equal(words.word_hashes(texts, found, lower), whole)
        monkeypatch.undo()
    monkeypatch.setattr(words, "_powers", {})
    words.word_hashes(texts, found)
    assert max(map(len, words._powers.values())) < len(texts.data) / 2


@pytest.mark.parametrize("operator", [bpe.encode, bpe.round_trip_digests])
def test_a_task_leaves_no_pretokens_behind(operator, monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoder = bpe.load_encoder(path, public_tokenizers.PATTERN)

    class Table:
        mapInArrow = staticmethod(lambda run, schema: run)

    monkeypatch.setattr(bpe, "keyed_texts", lambda *of: Table)
    run = operator(None, path, public_tokenizers.PATTERN)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words", "and more of them"]})
    outputs = run(iter([batch]))
    assert next(outputs).num_rows == 2 and encoder.kept.recent
    assert not list(outputs) and not encoder.kept.recent and not encoder.kept.older and not encoder.kept.size


def test_stage_names_and_oracle():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
