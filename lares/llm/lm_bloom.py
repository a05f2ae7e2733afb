"""Bigram language model in a log-frequency Bloom filter, and exact add-half unigram scores beside it.

Tokens of a text: its words, lower-cased (A-Z), then one end. Counts are learned from the rows not held out.

1. Tasks count the unigrams and bigrams of what they read and send the sums by hash range; a range's task adds them
   up. Ranges follow the number of input partitions, and frequent n-grams arrive as one sum a task.
2. A range's counts become a segment of the filter: an n-gram of count c is entered at levels 0 to floor(log2 c).
   A segment is sized by its entries and stays in its range: no task holds two, and none is made smaller.
3. A slice of texts sends each of its distinct bigrams, and each distinct token that is not frequent, to its hash range
   once, packed and in order. The range's task gives the level of each in its segment, found by probing level after
   level until one is missing, and the exact counts of tokens. Frequent tokens have at least 1 / HOT of all occurrences,
   so there are at most HOT of them; their levels and counts are all that is broadcast.
4. Levels and counts travel back to the slice, whose tokens were kept as places among its distinct ones. With c(level)
   the middle of the level, p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) and p(w | v) = 0.6 min(c(v w), c(v)) / c(v) + 0.4 p(w),
   or p(w) if v is unknown. The first word's v is the start of a text. score is the sum of log10 p(w | v). base_score
   is that of (c + 0.5) / (N + 0.5 (V + 1)) with exact counts c.

A null or empty text has one token, the end. A row without doc_id is a training row. Repeated rows count and are
scored each. With no training rows counts are 0 and both scores use N = V = 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lares.llm.tables import keyed_texts, settle, text_slices
from lares.llm.words import find_words, mix, word_hashes

HOT = 1 << 18
BITS_PER_ENTRY = 8
PROBES = 2
INTERPOLATION = 0.6
#: Tokens whose n-grams a task holds before it sends their counts on.
HELD = 3 << 20

END = np.uint64(0xE4D0F7E475000001)
START = np.uint64(0x57A4707E47500003)
_STEP = 0xD1B54A32D192ED03


class Tokens(NamedTuple):
    """Hashes of the tokens of texts; text d has the tokens first[d] to first[d + 1], the last one its end."""

    hashes: np.ndarray
    first: np.ndarray


def tokens_of(texts) -> Tokens:
    words = find_words(texts)
    n = len(words.first) - 1
    first = words.first + np.arange(n + 1)
    hashes = np.full(first[-1], END, np.uint64)
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    hashes[inner] = word_hashes(texts, words)
    return Tokens(hashes, first)


def bigrams_of(tokens: Tokens) -> np.ndarray:
    """The key of each token with the one before it, in 48 bits: the filter is approximate anyway."""
    before = np.empty_like(tokens.hashes)
    before[1:] = tokens.hashes[:-1]
    before[tokens.first[:-1]] = START
    return mix(before * np.uint64(0x9E6C63D0876A9A35) + tokens.hashes) & ~np.uint64(0xFFFF)


def _split(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Range numbers that sorted keys fall into, and where each range begins."""
    parts, at = np.unique(keys >> np.uint64(64 - bits), return_index=True)
    return parts.astype(np.int64), np.append(at, len(keys))


def _pack(values: np.ndarray) -> bytes:
    """Non-negative integers by byte planes, compressed: planes of zeros take no room."""
    cells = np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8)
    return zstandard.compress(np.ascontiguousarray(cells.T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    cells = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(cells.T).view(np.uint64).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as the distances between them."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def _count_rows(order: int, held: list[np.ndarray], bits: int) -> Iterator[dict]:
    keys, counts = np.unique(np.concatenate(held), return_counts=True)
    parts, at = _split(keys, bits)
    for part, a, b in zip(parts, at, at[1:], strict=False):
        yield {"order": order, "part": part, "keys": _pack_keys(keys[a:b]), "counts": _pack(counts[a:b])}


_COUNTS = pa.schema([("order", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _probe(keys: np.ndarray, level: int, probe: int) -> np.ndarray:
    return mix(keys + np.uint64(_STEP * (level * PROBES + probe + 1) % (1 << 64)))


def build_segment(keys: np.ndarray, counts: np.ndarray, order: int) -> bytes:
    """The bits of a range's n-grams, a power of two of them."""
    levels = np.frexp(counts.astype(np.float64))[1] - 1
    entries = int((levels + 1).sum())
    flags = np.zeros(1 << max(6, (BITS_PER_ENTRY * entries - 1).bit_length()), np.uint8)
    mask = np.uint64(len(flags) - 1)
    for level in range(int(levels.max(initial=-1)) + 1):
        some = keys[levels >= level]
        for probe in range(PROBES):
            flags[_probe(some, level, probe) & mask] = 1
    return np.packbits(flags, bitorder="little").tobytes()



def _add_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    order, part = key[0].as_py(), key[1].as_py()
    keys = [_unpack_keys(k) for k in table.column("keys").to_pylist()]
    counts = [_unpack(c).astype(np.int64) for c in table.column("counts").to_pylist()]
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    by_key = np.argsort(keys, kind="stable")
    keys, counts = keys[by_key], counts[by_key]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    keys, counts = keys[at], np.add.reduceat(counts, at)
    exact = order == 1
    return pa.table(
        {
            "order": pa.array([order], pa.int32()),
            "part": pa.array([part], pa.int64()),
            "distinct": pa.array([len(keys)], pa.int64()),
            "total": pa.array([int(counts.sum())], pa.int64()),
            "segment": pa.array([build_segment(keys, counts, order)], pa.binary()),
            "keys": pa.array([keys.tobytes() if exact else None], pa.binary()),
            "counts": pa.array([counts.astype(np.int64).tobytes() if exact else None], pa.binary()),
        }
    )


def learn(docs: DataFrame, bits: int) -> DataFrame:
    """A row a range and order: totals, filter segment and, for unigrams, keys with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {1: [], 2: []}
        size = 0
        for batch in batches:
            for texts in text_slices(batch.column("text")):
                tokens = tokens_of(texts)
                held[1].append(tokens.hashes)
                held[2].append(bigrams_of(tokens))
                size += len(tokens.hashes)
                if size > HELD:
                    for order in held:
                        yield pa.RecordBatch.from_pylist(list(_count_rows(order, held[order], bits)), _COUNTS)
                    held, size = {1: [], 2: []}, 0
        if size:
            for order in held:
                yield pa.RecordBatch.from_pylist(list(_count_rows(order, held[order], bits)), _COUNTS)

    counts = docs.filter(~F.col("held_out")).select("text").mapInArrow(
        run, "order int, part long, keys binary, counts binary"
    )
    return counts.groupBy("order", "part").applyInArrow(
        _add_up,
        "order int, part long, distinct long, total long, segment binary, keys binary, counts binary",
    )


class Filter:
    """Segments end to end; score() makes one of a single segment."""

    def __init__(self, segments: list[tuple[int, int, bytes]], bits: int):
        self.shift = np.uint64(64 - bits)
        self.offset = {order: np.zeros(1 << bits, np.int64) for order in (1, 2)}
        self.mask = {order: np.zeros(1 << bits, np.uint64) for order in (1, 2)}
        at = 8  # what has no segment probes an empty byte
        for order, part, segment in segments:
            self.offset[order][part], self.mask[order][part] = at, 8 * len(segment) - 1
            at += len(segment)
        self.data = np.zeros(at, np.uint8)
        for order, part, segment in segments:
            start = self.offset[order][part]
            self.data[start : start + len(segment)] = np.frombuffer(segment, np.uint8)

    def levels(self, keys: np.ndarray, order: int) -> np.ndarray:
        """How many levels each key is at."""
        part = (keys >> self.shift).astype(np.int64)
        offset, mask = self.offset[order][part], self.mask[order][part]
        levels = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        level = 0
        while len(left) and level < 63:
            for probe in range(PROBES):
                place = _probe(keys[left], level, probe) & mask[left]
                byte = self.data[offset[left] + (place >> np.uint64(3)).astype(np.int64)]
                left = left[(byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            level += 1
            levels[left] = level
        return levels

    def counts(self, keys: np.ndarray, order: int) -> np.ndarray:
        return middles(self.levels(keys, order))


def middles(levels: np.ndarray) -> np.ndarray:
    """The middle of the highest of so many levels; 0 if there is none."""
    return np.where(levels < 2, levels, 0.75 * np.exp2(levels))


class Model(NamedTuple):
    """Totals, and the frequent tokens by key with their levels and exact counts."""

    texts: int
    total: int
    distinct: int
    hot_keys: np.ndarray
    hot_levels: np.ndarray
    hot_counts: np.ndarray
    bits: int

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key would be among the frequent ones, and whether it is there."""
        at = np.minimum(np.searchsorted(self.hot_keys, keys), max(0, len(self.hot_keys) - 1))
        return at, self.hot_keys[at] == keys if len(self.hot_keys) else np.zeros(len(keys), bool)


_OUT = pa.schema(
    [
        ("slice", pa.int64()), ("order", pa.int32()), ("part", pa.int64()),
        ("keys", pa.binary()), ("levels", pa.binary()), ("counts", pa.binary()),
        ("place", pa.binary()), ("n_tokens", pa.binary()), ("ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
    ]
)
_OUT_SQL = (
    "slice long, order int, part long, keys binary, levels binary, counts binary, "
    "place binary, n_tokens binary, ids array<long>, held_out array<boolean>"
)


def _slice_rows(model: Model, texts, slice_id: int, ids: list, held_out: list) -> Iterator[dict]:
    """The texts' tokens as places among the distinct ones, and by hash range the n-grams to be looked up."""
    tokens = tokens_of(texts)
    keys, place = np.unique(tokens.hashes, return_inverse=True)
    hot = model.places(keys)[1]
    empty = dict.fromkeys(_OUT.names) | {"slice": slice_id}
    # Any range will do for the texts themselves; order 0 has no counts.
    yield empty | {
        "order": 0, "part": int(mix(np.array([slice_id], np.uint64))[0] >> np.uint64(64 - model.bits)),
        "keys": _pack_keys(keys[hot]), "place": _pack(place), "n_tokens": _pack(np.diff(tokens.first)),
        "ids": ids, "held_out": held_out,
    }
    for order, wanted in ((1, keys[~hot]), (2, np.unique(bigrams_of(tokens)))):
        parts, at = _split(wanted, model.bits)
        for part, a, b in zip(parts, at, at[1:], strict=False):
            yield empty | {"order": order, "part": int(part), "keys": _pack_keys(wanted[a:b])}


def _look_up(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table, bits: int) -> pa.Table:
    """Levels, and counts of tokens, of the n-grams of one range; rows that hold the texts themselves pass through."""
    order, part = key[0].as_py(), key[1].as_py()
    if not left.num_rows or order == 0:
        return left.cast(_OUT)
    segments, known, exact = [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if right.num_rows:
        segments = [(order, part, right.column("segment")[0].as_py())]
        if order == 1:
            known = np.frombuffer(right.column("keys")[0].as_py(), np.uint64)
            exact = np.frombuffer(right.column("counts")[0].as_py(), np.int64)
    own = Filter(segments, bits)
    levels, counts = [], []
    for packed in left.column("keys").to_pylist():
        keys = _unpack_keys(packed)
        levels.append(zstandard.compress(own.levels(keys, order).astype(np.uint8).tobytes(), 1))
        found = None
        if order == 1:
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            found = _pack(np.where(known[at] == keys, exact[at], 0) if len(known) else np.zeros(len(keys), np.int64))
        counts.append(found)
    columns = {"levels": pa.array(levels, pa.binary()), "counts": pa.array(counts, pa.binary())}
    if order == 2:
        columns["keys"] = pa.nulls(left.num_rows, pa.binary())
    return pa.table([columns.get(f.name, left.column(f.name)) for f in _OUT], _OUT.names).cast(_OUT)


_SCORES = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"]


def _levels(rows: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(zstandard.decompress(r["levels"]) for r in rows), np.uint8).astype(np.int64)


def _score_slice(model: Model, table: pa.Table) -> pa.Table:
    """The texts of one slice, from the rows that came back."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["order"], r["part"]))
    own = rows[0]
    n_tokens, place = _unpack(own["n_tokens"]).astype(np.int64), _unpack(own["place"]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n_tokens)])
    # Ranges are the high bits of sorted keys, so their answers in order are those of all keys.
    asked = [r for r in rows if r["order"] == 1]
    keys = np.concatenate([_unpack_keys(own["keys"]), *(_unpack_keys(r["keys"]) for r in asked)])
    at, hot = model.places(keys)
    levels, exact = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    levels[hot], exact[hot] = model.hot_levels[at[hot]], model.hot_counts[at[hot]]
    levels[~hot] = _levels(asked)
    exact[~hot] = np.concatenate([np.zeros(0, np.int64), *(_unpack(r["counts"]).astype(np.int64) for r in asked)])
    by_key = np.argsort(keys)
    keys, levels, exact = keys[by_key], levels[by_key], exact[by_key]
    base = np.add.reduceat(np.log10(exact + 0.5)[place], first[:-1])
    known = np.add.reduceat((exact > 0)[place].astype(np.int64), first[:-1])

    counts = middles(levels)
    p = ((counts + 0.5) / (model.total + 0.5 * (model.distinct + 1)))[place]
    history = np.empty(len(place))
    history[1:] = counts[place[:-1]]
    history[first[:-1]] = model.texts
    _, pair = np.unique(bigrams_of(Tokens(keys[place], first)), return_inverse=True)
    pairs = middles(_levels([r for r in rows if r["order"] == 2]))[pair]
    follows = history > 0
    p[follows] = INTERPOLATION * np.minimum(pairs, history)[follows] / history[follows] + (1 - INTERPOLATION) * p[follows]
    score = np.add.reduceat(np.log10(p), first[:-1])
    columns = [pa.array(own["ids"], pa.int64()), pa.array(own["held_out"], pa.bool_())]
    return pa.table([*columns, *map(pa.array, (n_tokens, known, base, score))], _SCORES)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    source = keyed_texts(docs, key, text).withColumn("held_out", held_out)
    bits = max(5, (2 * source.rdd.getNumPartitions() - 1).bit_length())
    learned = settle(learn(source, bits))
    sums = learned.groupBy("order").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).collect()
    total, distinct = next(((r["total"], r["distinct"]) for r in sums if r["order"] == 1), (0, 0))
    least = total / HOT

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.int64)
                keys, counts = keys[counts >= least], counts[counts >= least]
                levels = Filter([(1, row["part"], row["segment"])], bits).levels(keys, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(levels), pa.array(counts)], ["key", "level", "n"]
                )

    unigrams = learned.filter("order = 1").select("part", "segment", "keys", "counts")
    found = unigrams.mapInArrow(frequent, "key long, level long, n long").toArrow()
    hot_keys = found.column("key").to_numpy().view(np.uint64)
    by_key = np.argsort(hot_keys)
    hot = (hot_keys[by_key], *(found.column(c).to_numpy()[by_key] for c in ("level", "n")))
    texts = source.filter(~F.col("held_out")).select("doc_id").count()
    shared = spark.sparkContext.broadcast(tuple(Model(texts, total, distinct, *hot, bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            place, ids, held = (batch.column(c).to_pylist() for c in ("place", "doc_id", "held_out"))
            for texts in text_slices(batch.column("text")):
                a, b = texts.first_row, texts.first_row + len(texts.offsets) - 1
                yield pa.RecordBatch.from_pylist(list(_slice_rows(own, texts, place[a], ids[a:b], held[a:b])), _OUT)

    def look_up(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return _look_up(key, left, right, bits)

    def score_slice(table: pa.Table) -> pa.Table:
        return _score_slice(Model(*shared.value), table)

    asked = source.withColumn("place", F.monotonically_increasing_id()).mapInArrow(run, _OUT_SQL)
    answers = learned.select("order", "part", "segment", "keys", "counts").groupBy("order", "part")
    answered = asked.groupBy("order", "part").cogroup(answers).applyInArrow(look_up, _OUT_SQL)
    whole = answered.groupBy("slice").applyInArrow(
        score_slice, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    )
    divisor = float(np.log10(total + 0.5 * (distinct + 1)))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * divisor).alias("base_score"),
        "score",
    )
