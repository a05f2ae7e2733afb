"""The best documents for each item of a benchmark, term at a time with a limited number of accumulators.

Terms are runs of ASCII letters and digits and of all other code points from 80 on, A-Z lower-cased. Scores are
integers: a term's weight w = floor(1000 ln((2N + 2) / (2 df + 1))) times (10^9 tf) div (1000 tf + 8 m), where
m = 25 + (75 n N) div L, over an item's terms with their repeats.

1. Index. A task gathers the postings of its documents, of the items' terms only, into segments of about HELD
   postings: documents with their lengths, and the terms with their documents and frequencies. A bitmap of
   2 ** MAP_BITS slots tells the items' terms; its size does not depend on either table.
2. Statistics. The segments' counts of documents and terms add up to N and L, and their lists to each term's df.
3. Search. Every segment is searched for every item by itself, items in blocks of about BLOCK_TERMS terms, which are
   what is broadcast. Terms come rarest first and add to the accumulators of their documents. As soon as what the
   remaining terms can give at most is less than the kth best partial score, no document outside can reach the
   first k of the segment: accumulators are no longer made, those that cannot reach the kth score are dropped, and
   the others are brought up to their exact scores.
4. The first k of each segment hold the first k of all; they are ranked by score, then doc_id.

A null or empty text has no terms and is not among the N documents; such an item has no result. Documents without
doc_id come after others of the same score. Repeated rows are documents, and items, each. An empty table on either
side gives an empty result. Very long texts and items are taken whole. Other columns are ignored. Terms are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lares.llm.tables import keyed_texts, settle, text_slices
from lares.llm.words import find_words, word_hashes

MAP_BITS = 22
#: Postings of a segment, but for those of the texts that fill it up.
HELD = 2 << 20
BLOCK_TERMS = 1 << 18
_CODES = np.arange(256)
#: Bytes that part terms: ASCII but for letters and digits.
BETWEEN = (_CODES < 0x30) | ((_CODES > 0x39) & (_CODES < 0x41)) | ((_CODES > 0x5A) & (_CODES < 0x61)) | ((_CODES > 0x7A) & (_CODES < 0x80))


def _counted(owners: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, by owner, and how often each occurs."""
    order = np.lexsort((terms, owners))
    owners, terms = owners[order], terms[order]
    new = np.flatnonzero(np.append(True, (owners[1:] != owners[:-1]) | (terms[1:] != terms[:-1]))) if len(owners) else np.zeros(0, int)
    return owners[new], terms[new], np.diff(np.append(new, len(owners)))


def item_terms(items: DataFrame) -> DataFrame:
    """place, term and repeats of each term of each item. items: place and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column("text")):
                words = find_words(texts, BETWEEN)
                owners = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
                owners, terms, repeats = _counted(owners, word_hashes(texts, words).view(np.int64))
                places = batch.column("place").to_numpy()[texts.first_row :][owners]
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(terms), pa.array(repeats)], ["place", "term", "repeats"])

    return items.mapInArrow(run, "place long, term long, repeats long")


_SEGMENT = pa.schema(
    [
        ("documents", pa.int64()), ("length", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()),
        ("terms", pa.binary()), ("df", pa.binary()), ("owners", pa.binary()), ("tf", pa.binary()),
    ]
)
_SEGMENT_SQL = "documents long, length long, doc_ids array<long>, lengths binary, terms binary, df binary, owners binary, tf binary"


def _segment(parts: list[tuple]) -> pa.RecordBatch:
    ids = pa.concat_arrays([p[0] for p in parts])
    lengths = np.concatenate([p[1] for p in parts])
    first = np.cumsum([0, *(len(p[1]) for p in parts)])
    owners = np.concatenate([p[2] + at for p, at in zip(parts, first, strict=False)]).astype(np.int32)
    terms, tf = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts]).astype(np.int32)
    order = np.argsort(terms, kind="stable")
    own, df = np.unique(terms, return_counts=True)
    row = {
        "documents": int((lengths > 0).sum()), "length": int(lengths.sum()), "doc_ids": ids, "lengths": lengths.tobytes(),
        "terms": own.tobytes(), "df": df.astype(np.int32).tobytes(), "owners": owners[order].tobytes(), "tf": tf[order].tobytes(),
    }
    return pa.RecordBatch.from_pylist([row], _SEGMENT)


def segments(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """The index of the documents (doc_id, text) for the terms whose slots are set in a packed bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.unpackbits(shared.value).astype(bool)
        held, size = [], 0
        for batch in batches:
            for texts in text_slices(batch.column("text")):
                words = find_words(texts, BETWEEN)
                lengths = np.diff(words.first)
                terms = word_hashes(texts, words)
                some = slots[terms >> np.uint64(64 - MAP_BITS)]
                owners = np.repeat(np.arange(len(lengths)), lengths)[some]
                ids = batch.column("doc_id").slice(texts.first_row, len(lengths))
                held.append((ids, lengths.astype(np.int64), *_counted(owners, terms[some].view(np.int64))))
                size += len(held[-1][2])
                if size >= HELD:
                    yield _segment(held)
                    held, size = [], 0
        if held:
            yield _segment(held)

    return docs.mapInArrow(run, _SEGMENT_SQL)


def document_frequencies(index: DataFrame) -> DataFrame:
    """term and df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, df in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist(), strict=True):
                columns = [pa.array(np.frombuffer(terms, np.int64)), pa.array(np.frombuffer(df, np.int32).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["term", "df"])

    return index.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def first_documents(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents whose score is above 0 and at least the kth best, and their scores.

    lists: documents and gains of each term, rarest term first.
    """
    score = np.zeros(n_docs, np.int64)
    rest = np.append(np.cumsum([int(gain.max(initial=0)) for _, gain in reversed(lists)])[::-1], 0) if lists else np.zeros(1, int)
    alive = None
    for i, (docs, gain) in enumerate(lists):
        if alive is None:
            score[docs] += gain
        else:
            some = alive[docs]
            score[docs[some]] += gain[some]
        kth = int(np.partition(score, n_docs - k)[n_docs - k]) if n_docs > k else 0
        if rest[i + 1] < kth:
            # Dropped accumulators stay below the kth score, those never made at 0.
            score[score + rest[i + 1] < kth] = 0
            alive = score > 0
    kth = max(1, int(np.partition(score, n_docs - k)[n_docs - k]) if n_docs > k else 1)
    found = np.flatnonzero(score >= kth)
    return found, score[found]


_FOUND = "place long, doc_id long, score long"


def _search(index: DataFrame, block: list[tuple[int, list[tuple[int, int]]]], n: int, length: int, k: int) -> DataFrame:
    """The first k documents, and those of equal score, of each segment and item. block: place and (term, factor)s."""
    places = [place for place, _ in block]
    first = np.cumsum([0, *(len(terms) for _, terms in block)])
    terms = np.array([t for _, own in block for t, _ in own], np.int64)
    factors = np.array([f for _, own in block for _, f in own], np.int64)
    shared = index.sparkSession.sparkContext.broadcast((places, first, terms, factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, first, terms, factors = shared.value
        for batch in batches:
            ids = batch.column("doc_ids")
            for row in range(batch.num_rows):
                lengths, own, df, owners, tf = (
                    np.frombuffer(batch.column(c)[row].as_py(), t)
                    for c, t in (("lengths", np.int64), ("terms", np.int64), ("df", np.int32), ("owners", np.int32), ("tf", np.int32))
                )
                if not len(own):
                    continue
                m = 25 + (75 * lengths * n) // length
                gains = (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m[owners])
                ends = np.cumsum(df)
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                held = own[at] == terms
                names = ids[row].values
                found = []
                for i, place in enumerate(places):
                    lists = [
                        (owners[ends[a] - df[a] : ends[a]], gains[ends[a] - df[a] : ends[a]] * factor)
                        for a, factor, here in zip(at[first[i] : first[i + 1]], factors[first[i] : first[i + 1]], held[first[i] : first[i + 1]], strict=True)
                        if here
                    ]
                    docs, scores = first_documents(lists, len(lengths), k)
                    found.append((np.full(len(docs), place), docs, scores))
                places_, docs, scores = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
                yield pa.RecordBatch.from_arrays([pa.array(places_), names.take(pa.array(docs)), pa.array(scores)], ["place", "doc_id", "score"])

    return index.mapInArrow(run, _FOUND)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the first k documents of each item."""
    spark = docs.sparkSession
    queries = keyed_texts(items, item, text).withColumnRenamed("doc_id", "item_id")
    queries = settle(queries.withColumn("place", F.monotonically_increasing_id()))
    terms = settle(item_terms(queries.select("place", "text")))
    slot = F.shiftrightunsigned("term", 64 - MAP_BITS).cast("int")
    wanted = np.zeros(1 << MAP_BITS, bool)
    wanted[terms.select(slot.alias("slot")).distinct().toArrow().column("slot").to_numpy()] = True
    index = settle(segments(keyed_texts(docs, key, text), np.packbits(wanted)))
    n, length = (x or 0 for x in index.agg(F.sum("documents"), F.sum("length")).first())
    weighed = settle(terms.join(document_frequencies(index), "term"))
    total = weighed.count()
    # A block takes about BLOCK_TERMS terms, half of that on average; an item is never cut.
    n_blocks = -(-2 * total // BLOCK_TERMS)
    found = []
    for b in range(n_blocks):
        own = weighed.filter(F.pmod(F.xxhash64("place"), F.lit(n_blocks)) == b).select("place", "df", "term", "repeats")
        block: dict[int, list[tuple[int, int]]] = {}
        for place, df, term, repeats in sorted(map(tuple, own.collect())):
            weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
            block.setdefault(place, []).append((term, weight * repeats))
        found.append(_search(index, list(block.items()), n, length, k))
    best = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _FOUND)
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(queries.select("place", "item_id"), "place").select("item_id", "rank", "doc_id", "score")
