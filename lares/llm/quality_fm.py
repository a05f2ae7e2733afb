"""Quality scores of texts by a factorisation machine.

Features of a text: its words, lower-cased and hashed into buckets, weighted so that the squares of their weights
sum to one; statistics of its structure (length, word length, symbols, capitals, digits, spaces, line breaks,
repeated neighbours, distinct words) and of its record (bytes and characters), each falling into one of a fixed
row of bins. The score is the logistic function of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

which takes time linear in the features. Weights are trained here, by AdaGrad over mini-batches.

Training reads at most `SAMPLE` labelled rows, those of least hash, and of them the features only, which go to the
driver: that is the documented bound, and it does not grow with the input. Scoring runs in the tasks with the
weights broadcast (WEIGHT_BYTES at most). Labels, language, source and doc_id are no features.

Null and empty texts have the features of an empty text and get a score as any other. Repeated rows are scored
each. Conflicting labels of one document count as the least. With no labelled rows every score is 0.5. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lares.llm.tables import Texts, keyed_texts, text_slices
from lares.llm.words import find_words, word_hashes

SAMPLE = 6_000
WORD_BITS = 15
BINS = 12
RANK = 8
EPOCHS = 12
_STATISTICS = 11
WIDTH = (1 << WORD_BITS) + BINS * _STATISTICS
WEIGHT_BYTES = 4 * (1 + WIDTH * (1 + RANK))

_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_LETTER = np.isin(np.arange(256), np.r_[65:91, 97:123, 128:256])
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Features(NamedTuple):
    """Entry j is feature[j] of text[j] with weight value[j]; texts stand in order."""

    text: np.ndarray
    feature: np.ndarray
    value: np.ndarray


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def extract(texts: Texts) -> Features:
    n = len(texts.offsets) - 1
    words = find_words(texts)
    hashes = word_hashes(texts, words)
    owner = np.repeat(np.arange(n), np.diff(words.first))
    keys, counts = np.unique(owner << WORD_BITS | (hashes & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64), return_counts=True)
    n_words = np.diff(words.first)
    weight = np.log1p(counts)
    norm = np.sqrt(np.bincount(keys >> WORD_BITS, weight**2, n))
    distinct = np.bincount(keys >> WORD_BITS, minlength=n)
    same = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 1:
        same[2:] = np.cumsum((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))
    data, offsets = texts.data, texts.offsets
    size = np.diff(offsets)
    some_words, some = np.maximum(n_words, 1), np.maximum(size, 1)
    characters = _per_text((data & 0xC0) != 0x80, offsets)
    letters = _per_text(_LETTER[data], offsets)
    spaces = _per_text(_SPACE[data], offsets)
    shares = [
        np.log2(1 + n_words) / 16,
        (size - spaces) / some_words / 16,
        (size - letters - spaces) / some * 2,
        _per_text(_UPPER[data], offsets) / np.maximum(letters, 1) * 2,
        _per_text(_DIGIT[data], offsets) / some * 4,
        spaces / some * 2,
        _per_text(data == 10, offsets) / some_words * 4,
        (same[words.first[1:]] - same[np.minimum(words.first[:-1] + 1, len(hashes))]).clip(0) / some_words,
        distinct / some_words,
        np.log2(1 + size) / 24,
        1 - characters / some,
    ]
    bins = np.stack([np.clip(s * BINS, 0, BINS - 1).astype(np.int64) for s in shares], 1)
    ids = (1 << WORD_BITS) + bins + np.arange(_STATISTICS) * BINS
    text = np.concatenate([keys >> WORD_BITS, np.repeat(np.arange(n), _STATISTICS)])
    feature = np.concatenate([keys & ((1 << WORD_BITS) - 1), ids.ravel()])
    value = np.concatenate([weight / norm[keys >> WORD_BITS], np.full(n * _STATISTICS, 0.5)])
    order = np.argsort(text, kind="stable")
    return Features(text[order], feature[order].astype(np.int32), value[order].astype(np.float32))


class Machine(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, f: Features, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The value before the logistic function, and the sums by factor, of texts 0 to n - 1.

        Every text has entries, so the sums are over stretches that are not empty.
        """
        at = np.searchsorted(f.text, np.arange(n))
        v = self.factors[f.feature] * f.value[:, None]
        sums = np.add.reduceat(v, at, axis=0)
        squares = np.add.reduceat((v * v).sum(1), at)
        linear = np.add.reduceat(self.linear[f.feature] * f.value, at)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def scores(self, texts: Texts) -> np.ndarray:
        n = len(texts.offsets) - 1
        return 1 / (1 + np.exp(-np.clip(self.raw(extract(texts), n)[0].astype(np.float64), -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """rows: features and values of each text."""
    rng = np.random.default_rng(seed)
    linear = np.zeros(WIDTH, np.float32)
    factors = rng.normal(0, 0.02, (WIDTH, RANK)).astype(np.float32)
    bias, bias_seen = 0.0, 1e-6
    linear_seen, factors_seen = np.full(WIDTH, 1e-6, np.float32), np.full((WIDTH, RANK), 1e-6, np.float32)
    if not len(rows):
        return Machine(0.0, linear, factors * 0)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), 64):
            part = order[start : start + 64]
            f = Features(
                np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part]),
                np.concatenate([rows[i][0] for i in part]),
                np.concatenate([rows[i][1] for i in part]),
            )
            raw, sums = Machine(bias, linear, factors).raw(f, len(part))
            error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[part]).astype(np.float32) / len(part)
            used, place = np.unique(f.feature, return_inverse=True)
            pull = (error[f.text] * f.value).astype(np.float32)
            own = factors[f.feature]
            g_linear = np.bincount(place, pull, len(used)).astype(np.float32) + 1e-5 * linear[used]
            g_entry = pull[:, None] * (sums[f.text] - own * f.value[:, None])
            by_feature = np.argsort(place, kind="stable")
            starts = np.searchsorted(place[by_feature], np.arange(len(used)))
            g_factors = np.add.reduceat(g_entry[by_feature], starts, axis=0) + 1e-4 * factors[used]
            g_bias = float(error.sum())
            linear_seen[used] += g_linear**2
            factors_seen[used] += g_factors**2
            bias_seen += g_bias**2
            linear[used] -= 0.15 * g_linear / np.sqrt(linear_seen[used])
            factors[used] -= 0.03 * g_factors / np.sqrt(factors_seen[used])
            bias -= 0.15 * g_bias / np.sqrt(bias_seen)
    return Machine(bias, linear, factors)


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Machine:
    """labels: doc_id and quality; rows that are held out are not read."""
    known = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    chosen = (
        known.filter(~is_held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    quality = {r["doc_id"]: r["quality"] for r in chosen.collect()}
    ids = docs.sparkSession.createDataFrame([(i,) for i in quality], "doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column("text")):
                n = len(part.offsets) - 1
                f = extract(part)
                cuts = np.searchsorted(f.text, np.arange(n + 1)).astype(np.int32)
                columns = [
                    batch.column("doc_id").slice(part.first_row, n),
                    pa.ListArray.from_arrays(cuts, f.feature),
                    pa.ListArray.from_arrays(cuts, f.value),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "features", "weights"])

    texts = keyed_texts(docs, key, text).join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    found = texts.mapInArrow(run, "doc_id long, features array<int>, weights array<float>").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy())
    features = found.column("features").combine_chunks() if found.num_rows else []
    weights = found.column("weights").combine_chunks() if found.num_rows else []
    rows = [(features[int(i)].values.to_numpy(), weights[int(i)].values.to_numpy()) for i in order]
    target = np.array([quality[int(found.column("doc_id")[int(i)].as_py())] for i in order], np.float32)
    return train(rows, target)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    weights = docs.sparkSession.sparkContext.broadcast(tuple(machine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*weights.value)
        for batch in batches:
            for part in text_slices(batch.column("text")):
                ids = batch.column("doc_id").slice(part.first_row, len(part.offsets) - 1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.scores(part), pa.float64())], ["doc_id", "score"])

    scored = keyed_texts(docs, key, text).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
