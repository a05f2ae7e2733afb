"""Periodic runs of words in texts, by internal pattern matching.

A run is a stretch of words of smallest period q, of at least max(SHORTEST, REPEATS q) words, that can't be extended.

1. A run makes a window of WINDOW words occur again in its text. Texts without such a window, most of a corpus, are
   done after one pass over the hashes of their windows.
2. The others are joined to one sequence of word numbers, different from text to text, of about CHUNK words. Prefix
   doubling sorts its suffixes; the names of all substrings of 2^k words on the way give longest common extensions.
3. A wavelet matrix over the suffix array answers range successor queries: the next place after a given one at which
   a pattern occurs.
4. A run of period q in [2^k, 2^(k+1)) holds an aligned block of 2^k words (of LEAST, if that is more), and again q words
   later. The block's occurrences in the window of the next 2^(k+1) words are asked for one after another. Occurrences
   at most half a block apart are a progression, whose difference p is the block's period; the stretch of period p
   around it is skipped at once. Candidates for q are the distance to each occurrence, and for a progression the
   distances between the starts and between the ends of its stretch and of the one around the block.
5. A candidate is extended to both sides. Of equal stretches the smallest period is the run's.

Nulls and texts without words have no runs. A text of more words than CHUNK is a chunk of its own, which takes some 200
bytes a word. Repeated rows are treated each;
a row without doc_id is like one whose words are not changed. An empty table gives an empty result. Other columns are
ignored. Nothing is shuffled. Step 1 compares 64-bit hashes of windows, equal windows always have equal ones; all
later steps compare words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lares.llm.tables import keyed_texts, text_slices
from lares.llm.words import find_words, window_hashes, word_hashes

SHORTEST = 24
REPEATS = 3
#: Words that a run has in common with itself one period later, at least.
WINDOW = 16
#: Words of a pattern that occurs again, at least: 3 q - 2 q + 1 of a run of 24 or more words and a period of 8 or less.
LEAST = 8
CHUNK = 1 << 19

Run = tuple[int, int, int]  # start, length, period


class Wavelet:
    """Range successor over a permutation."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros, self.split = [], []
        for b in reversed(range(self.bits)):
            one = (values >> b) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one, dtype=np.int32)]).astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            values = np.concatenate([values[~one], values[one]])

    def _below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values under x the ranges hold."""
        low, high, count = low.copy(), high.copy(), np.zeros(len(x), np.int64)
        for zeros, split, b in zip(self.zeros, self.split, reversed(range(self.bits)), strict=True):
            one = (x >> b) & 1 == 1
            z_low, z_high = zeros[low], zeros[high]
            count += np.where(one, z_high - z_low, 0)
            low = np.where(one, low - z_low + split, z_low)
            high = np.where(one, high - z_high + split, z_high)
        return count

    def _ranked(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k of each range."""
        low, high, k, value = low.copy(), high.copy(), k.copy(), np.zeros(len(k), np.int64)
        for zeros, split, b in zip(self.zeros, self.split, reversed(range(self.bits)), strict=True):
            z_low, z_high = zeros[low], zeros[high]
            one = k >= z_high - z_low
            k -= np.where(one, z_high - z_low, 0)
            value |= np.where(one, 1 << b, 0)
            low = np.where(one, low - z_low + split, z_low)
            high = np.where(one, high - z_high + split, z_high)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value over x of each range, or -1."""
        k = self._below(low, high, x + 1)
        out = np.full(len(x), -1, np.int64)
        some = np.flatnonzero(k < high - low)
        out[some] = self._ranked(low[some], high[some], k[some])
        return out


class Suffixes:
    """Sorted suffixes of a sequence, the names of its substrings of 2^k items, and pattern queries."""

    def __init__(self, items: np.ndarray):
        self.n = n = len(items)
        self.names: list[np.ndarray] = []
        key, k = items.astype(np.int64), 0
        while True:
            order = np.argsort(key, kind="stable")
            new = np.append(True, key[order][1:] != key[order][:-1])
            name = np.empty(n, np.int32)
            name[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            self.names.append(name)
            if new.all() or 1 << k >= n:
                break
            after = np.zeros(n, np.int64)
            after[: n - (1 << k)] = name[1 << k :] + 1
            key = name.astype(np.int64) * (n + 1) + after
            k += 1
        # Names are places in the order of suffixes, so those of equal substrings are one range of it.
        self.wavelet = Wavelet(order)

    def level(self, k: int) -> int:
        return min(k, len(self.names) - 1)

    def ranges(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin like those at `at` for 2^k items."""
        name = self.names[self.level(k)]
        sizes = np.bincount(name, minlength=self.n)
        low = name[at].astype(np.int64)
        return low, low + sizes[low]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items from a on equal those from b on; a < b."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            name = self.names[k]
            fits = np.flatnonzero(b + (1 << k) <= self.n)
            same = fits[name[a[fits]] == name[b[fits]]]
            a[same] += 1 << k
            b[same] += 1 << k
            total[same] += 1 << k
        return total

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items before a equal those before b; a < b."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            name = self.names[k]
            fits = np.flatnonzero(a >= 1 << k)
            same = fits[name[a[fits] - (1 << k)] == name[b[fits] - (1 << k)]]
            a[same] -= 1 << k
            b[same] -= 1 << k
            total[same] += 1 << k
        return total

    def stretch(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest stretch of that period around two items a period apart."""
        return at - self.common_before(at, at + period), at + period + self.common(at, at + period)


def _candidates(own: Suffixes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and distances that may be a run's place and its period, of those in [2^k, 2^(k+1))."""
    size, pattern = 1 << k, max(1 << k, LEAST)
    level = pattern.bit_length() - 1
    block = np.arange(0, max(0, own.n - pattern - size + 1), size)
    low, high = own.ranges(level, block)
    block, low, high = (x[high - low > 1] for x in (block, low, high))
    at, period = block.copy(), np.zeros(len(block), np.int64)
    blocks, distances = [], []

    def add(some: np.ndarray, q: np.ndarray) -> None:
        fits = (q >= size) & (q < 2 * size)
        blocks.append(block[some][fits])
        distances.append(q[fits])

    while len(block):
        after = own.wavelet.successor(low, high, at)
        go = (after >= 0) & (after < block + 2 * size)
        block, low, high, at, period, after = (x[go] for x in (block, low, high, at, period, after))
        add(np.arange(len(block)), after - block)
        gap = after - at
        # at may be the last of a progression: then the block's period is known already.
        close = (gap <= pattern // 2) & ((period == 0) | (gap <= period))
        period = np.where(close, gap, period)
        known = np.flatnonzero(period > 0)
        if len(known):
            p = period[known]
            start, end = own.stretch(after[known], p)
            of_block, end_of_block = own.stretch(block[known], p)
            other = start != of_block
            add(known[other], (start - of_block)[other])
            add(known[other], (end - end_of_block)[other])
            after[known] += np.maximum(0, (end - pattern - after[known]) // p) * p
        at = after
    return np.concatenate(blocks or [np.zeros(0, np.int64)]), np.concatenate(distances or [np.zeros(0, np.int64)])


def runs(items: np.ndarray, longest: int) -> np.ndarray:
    """start, length, period (rows, by start, then period) of all runs of a sequence, of periods up to longest / REPEATS."""
    own = Suffixes(items)
    found = []
    for k in range(max(1, longest // REPEATS).bit_length()):
        at, q = _candidates(own, k)
        pairs = np.unique(np.stack([at, q]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        start, end = own.stretch(pairs[0], pairs[1])
        some = end - start >= np.maximum(SHORTEST, REPEATS * pairs[1])
        found.append(np.stack([start[some], end[some] - start[some], pairs[1][some]], 1))
    table = np.unique(np.concatenate(found), axis=0)
    least = np.append(True, (table[1:, :2] != table[:-1, :2]).any(1)) if len(table) else np.zeros(0, bool)
    table = table[least]
    return table[np.lexsort((table[:, 2], table[:, 0]))]


def word_places(n: int, doc_id: int | None) -> np.ndarray | None:
    """The places of the original words that make the words to look at, or None if the words are as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
        ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
    ]
)
_RESULT_SQL = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)
_SPANS = "doc_id long, runs array<struct<start: long, length: long, period: long>>"
_SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))])


def digest(doc_id: int | None, words: list[bytes], own: list[Run]) -> tuple:
    """The result's row of a text with these words and runs."""
    best = None
    for run in own:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    if own:
        turns = np.zeros(len(words) + 1, np.int64)
        for start, length, period in own:
            turns[start + period] += 1
            turns[start + length] -= 1
        words = [w for w, gone in zip(words, (np.cumsum(turns)[:-1] > 0).tolist(), strict=True) if not gone]
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in own)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(own), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def _texts_with_runs(batches: Iterator[pa.RecordBatch], varied: bool) -> Iterator[list[tuple[int | None, list[bytes], list[Run]]]]:
    """doc_id, words and runs of each text, in chunks. varied: with the words that word_places gives."""
    held: list[tuple[int | None, list[bytes]]] = []
    size = 0

    def solved() -> list[tuple[int | None, list[bytes], list[Run]]]:
        numbers, first = [], np.cumsum([0, *(len(words) for _, words in held)])
        last = 0
        for _, words in held:
            own: dict[bytes, int] = {}
            numbers.append(np.array([own.setdefault(w, last + len(own)) for w in words], np.int64))
            last += len(own)
        table = runs(np.concatenate(numbers), max(len(words) for _, words in held))
        cuts = np.searchsorted(table[:, 0], first)
        return [
            (key, words, [(s - at, n, q) for s, n, q in table[a:b].tolist()])
            for (key, words), at, a, b in zip(held, first.tolist(), cuts, cuts[1:], strict=False)
        ]

    for batch in batches:
        for texts in text_slices(batch.column("text")):
            words = find_words(texts)
            hashes = word_hashes(texts, words, lower=False)
            ids = batch.column("doc_id").slice(texts.first_row, len(words.first) - 1).to_pylist()
            done = []
            for d, (key, a, b) in enumerate(zip(ids, words.first.tolist(), words.first[1:].tolist(), strict=False)):
                places = word_places(b - a, key) if varied else None
                own = hashes[a:b] if places is None else hashes[a:b][places]
                parts = texts.data[texts.offsets[d] : texts.offsets[d + 1]].tobytes().split()
                if places is not None:
                    parts = [parts[i] for i in places.tolist()]
                windows = np.sort(window_hashes(own, WINDOW)) if b - a >= SHORTEST else own[:0]
                if (windows[1:] == windows[:-1]).any():
                    held.append((key, parts))
                    size += len(parts)
                    if size >= CHUNK:
                        yield solved()
                        held, size = [], 0
                else:
                    done.append((key, parts, []))
            yield done
    if held:
        yield solved()


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the runs (start, length, period in words) of each row's text as it is, by start, then period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in _texts_with_runs(batches, varied=False):
            rows = [{"doc_id": k, "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in own]} for k, _, own in done]
            yield pa.RecordBatch.from_pylist(rows, _SPANS_ARROW)

    return keyed_texts(docs, key, text).mapInArrow(run, _SPANS)


def run_digests(docs: DataFrame, varied: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a text: its number of runs, the one of greatest exponent, and digests of all runs and of the words kept.

    varied: a tenth of the texts, by the crc32 of doc_id, has the words that word_places gives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in _texts_with_runs(batches, varied):
            rows = [digest(*text) for text in done]
            columns = zip(*rows, strict=True) if rows else [[]] * len(_RESULT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True)], schema=_RESULT)

    return keyed_texts(docs, key, text).mapInArrow(run, _RESULT_SQL)
