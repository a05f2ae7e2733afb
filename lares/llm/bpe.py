"""Byte-level BPE: texts to token ids and back.

A text is cut into pre-tokens by a pattern. The distinct ones of a slice of texts that are not known yet go into
matrices of one row each, grouped by length and padded. In every round each row looks up the ranks of all its
neighbouring pairs in a hash table, merges its leftmost pair of least rank and closes the gap; rows without a
pair leave. A merged pair's id is its rank, as in rank files. A pre-token that is itself a token is that token.

Rows over MATRIX_WIDTH bytes merge all pairs of their least rank in one round, from left to right without overlap, so
that they need about a round a rank and not one a pair. That changes no merge, for no pair with the merged token comes
before the pairs of the same rank that are left, unless that token is part of one of lower rank; such tokens (`early`) are
looked up for each rank file and are merged one a round in long rows as well. Only ranks beside a merge are looked up again.

What a task keeps of pre-tokens is bounded in bytes (KEPT) and goes with it, so that the next stage of a worker has its
memory; what is forgotten is merged again. A very long text is
taken whole; it takes some 30 bytes a byte while it is cut.

Null and empty texts have no ids. Decoding concatenates the bytes of the ids, so any text comes back byte for
byte. Repeated rows are encoded each; an empty table gives an empty result; other columns are ignored. Nothing is
shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lares.llm.kept import Kept
from lares.llm.tables import SMALL_SLICE, keyed_texts, str_slices

#: Bytes of chunks and their ids that a task keeps.
KEPT = 96 << 20
#: The pattern under which a single space between two other characters always begins a pre-token (a fixed value).
SPACE_BEGINS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MATRIX_WIDTH = 128
MATRIX_CELLS = 1 << 20
_NONE = np.int32(2**31 - 1)


#: White space beside a space: there a space need not begin a pre-token.
_DOUBLE = re.compile(r"\s | \s")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: Stands before a chunk that has no space before it; a chunk of the text itself never begins so, for it holds no space.
_MARK = " "


def _whole(chunk: str) -> str:
    return chunk[1:] if chunk.startswith(_MARK) else " " + chunk


class PairTable:
    """Ranks of token pairs in an open-addressing hash table of arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        ranks = np.array(list(pairs.values()), np.int32)
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, ~np.uint64(0))
        self.ranks = np.full(1 << bits, _NONE)
        self.probes = 0
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = left[self.keys[slot[left]] == ~np.uint64(0)]
            taken, first = np.unique(slot[free], return_index=True)
            self.keys[taken], self.ranks[taken] = keys[free[first]], ranks[free[first]]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _NONE. Negative ids are padding."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        held = self.keys[slot]
        found = np.where(held == keys, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((held != keys) & (held != ~np.uint64(0)) & (left >= 0) & (right >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (held != ~np.uint64(0))]
        return found


class Spelling(NamedTuple):
    """The bytes that stand for each id: data[first[i]:first[i] + size[i]]."""

    data: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, parts: list[bytes]) -> Spelling:
        size = np.array([len(p) for p in parts], np.int64)
        return cls(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size)

    def write(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the ids end to end, and where each id's begin (and the last ends)."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.first[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return self.data[at].tobytes(), np.append(0, ends)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT):
        self.ranks, self.kept = ranks, Kept(kept)
        self.pattern = regex.compile(pattern)
        self.cuts = pattern == SPACE_BEGINS
        bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            bytes_of[i] = token
        self.tokens = Spelling.of(bytes_of)
        self.numbers = Spelling.of([b"%d," % i for i in range(len(bytes_of))])
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {
            (ranks[token[:cut]], ranks[token[cut:]]): i
            for token, i in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }
        #: Tokens that can be merged into one of lower rank.
        self.early = np.zeros(len(bytes_of), bool)
        self.early[[part for parts, i in pairs.items() for part in parts if part > i]] = True
        self.table = PairTable(pairs)

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin (and the last ends)."""
        cut = [self._chunks(text) for text in texts]
        known = self.kept.table(set().union(*cut), self._learn)
        own = [b"".join([known[c] for c in chunks]) for chunks in cut]
        return np.frombuffer(b"".join(own), np.int32), np.cumsum([0, *map(len, own)]) // 4

    def _learn(self, names: list[str]) -> list[bytes]:
        if not self.cuts:
            ids = self._merge(names)
            return [ids[name] for name in names]
        pretokens = [self.pattern.findall(_whole(name)) for name in names]
        ids = self._merge(set().union(*pretokens))
        return [ids[parts[0]] if len(parts) == 1 else b"".join([ids[p] for p in parts]) for parts in pretokens]

    def _chunks(self, text: str) -> list[str]:
        """Parts of a text that the pattern never joins: cut at single spaces, which always begin a pre-token; for
        patterns of which that is not known, the pre-tokens.

        A chunk stands for itself with a space before it; the first of a text, which has none, is marked.
        """
        if not text:
            return []
        if not self.cuts:
            return self.pattern.findall(text)
        chunks = text.split(" ")
        if len(chunks) > 1 and (not chunks[0] or not chunks[-1] or _DOUBLE.search(text)):
            chunks = _SINGLE.split(text)
        chunks[0] = _MARK + chunks[0]
        return chunks

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.tokens.write(np.asarray(ids, np.int64))[0]

    def _merge(self, names: Iterable[str]) -> dict[str, bytes]:
        """The ids of each pre-token, as the bytes of 32-bit numbers."""
        merged: dict[str, bytes] = {}
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for name in names:
            data = name.encode()
            if (whole := self.ranks.get(data)) is not None:
                merged[name] = whole.to_bytes(4, sys.byteorder)
            else:
                # Rows of a matrix differ by an eighth of their length at most.
                step = max(1, 1 << max(0, len(data).bit_length() - 4))
                by_width.setdefault(-(-len(data) // step) * step, []).append((name, data))
        for width, rows in by_width.items():
            step = max(1, MATRIX_CELLS // width)
            merge = self._by_ranks if width > MATRIX_WIDTH else self._by_pairs
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for (name, _), ids in zip(part, merge([d for _, d in part], width), strict=True):
                    merged[name] = ids
        return merged

    def _matrix(self, rows: list[bytes], width: int) -> np.ndarray:
        lengths = np.array([len(r) for r in rows])
        cells = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)
        return np.where(np.arange(width) < lengths[:, None], self.byte_ids[cells], np.int32(-1))

    def _by_pairs(self, rows: list[bytes], width: int) -> list[bytes]:
        """The ids of rows of at most `width` bytes, a pair of each row in a round."""
        matrix = self._matrix(rows, width)
        done = [b""] * len(rows)
        alive = np.arange(len(rows))
        while len(alive):
            wide = matrix.shape[1]
            ranks = self.table.lookup(matrix[:, :-1].ravel(), matrix[:, 1:].ravel()).reshape(len(alive), wide - 1)
            at = ranks.argmin(1) if wide > 1 else np.zeros(len(alive), np.int64)
            least = ranks[np.arange(len(alive)), at] if wide > 1 else np.full(len(alive), _NONE)
            ended = least == _NONE
            if ended.any():
                _finish(done, alive[ended], matrix[ended])
                go = ~ended
                matrix, at, least, alive = matrix[go], at[go], least[go], alive[go]
            matrix = np.where(np.arange(wide - 1) < at[:, None] + 1, matrix[:, :-1], matrix[:, 1:])
            matrix[np.arange(len(alive)), at] = least
        return done

    def _by_ranks(self, rows: list[bytes], width: int) -> list[bytes]:
        """The same, a rank of each row in a round."""
        matrix = self._matrix(rows, width)
        # The rank of a cell and the next one; none beyond the last.
        ranks = np.full(matrix.shape, _NONE)
        ranks[:, :-1] = self.table.lookup(matrix[:, :-1].ravel(), matrix[:, 1:].ravel()).reshape(len(rows), -1)
        done = [b""] * len(rows)
        alive = np.arange(len(rows))
        while len(alive):
            least = ranks.min(1)
            ended = least == _NONE
            if ended.any():
                _finish(done, alive[ended], matrix[ended])
                go = ~ended
                matrix, ranks, least, alive = matrix[go], ranks[go], least[go], alive[go]
                continue
            row, at = np.nonzero(ranks == least[:, None])
            # Places in a stretch of neighbouring hits: every other one overlaps the one before.
            begins = np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1))
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            chosen = place % 2 == 0
            chosen &= ~self.early[least[row]] | np.append(True, row[1:] != row[:-1])
            row, at = row[chosen], at[chosen]
            matrix[row, at] = least[row]
            matrix[row, at + 1] = -1
            fresh = np.zeros(matrix.shape, bool)
            fresh[row, at] = True
            matrix, ranks, fresh = _closed(matrix, ranks, fresh)
            fresh[:, :-1] |= fresh[:, 1:]
            row, at = np.nonzero(fresh)
            last = at + 1 == matrix.shape[1]
            after = np.where(last, np.int32(-1), matrix[row, np.minimum(at + 1, matrix.shape[1] - 1)])
            ranks[row, at] = self.table.lookup(matrix[row, at], after)
        return done


def _finish(done: list[bytes], rows: np.ndarray, matrix: np.ndarray) -> None:
    sizes = (matrix >= 0).sum(1)
    for row, ids, size in zip(rows.tolist(), matrix, sizes.tolist(), strict=True):
        done[row] = ids[:size].tobytes()


def _closed(matrix: np.ndarray, ranks: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows without their gaps."""
    kept = matrix >= 0
    sizes = kept.sum(1)
    filled = np.arange(sizes.max()) < sizes[:, None]
    out = []
    for cells, empty in ((matrix, -1), (ranks, _NONE), (fresh, False)):
        closed = np.full(filled.shape, empty, cells.dtype)
        closed[filled] = cells[kept]
        out.append(closed)
    return tuple(out)


@lru_cache(maxsize=2)
def load_encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file: lines of a base64 token and its rank. Kept by the Python worker."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return Encoder(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids and whether decoding gives the text's bytes again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path, pattern)
        for batch in batches:
            for row, texts in str_slices(batch.column("text"), SMALL_SLICE):
                ids, first = encoder.encode(texts)
                data, at = encoder.tokens.write(ids)
                ends = at[first].tolist()
                same = [data[a:b] == t.encode() for a, b, t in zip(ends, ends[1:], texts, strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                keys = batch.column("doc_id").slice(row, len(texts))
                yield pa.RecordBatch.from_arrays([keys, lists, pa.array(same, pa.bool_())], ["doc_id", "ids", "round_trip"])
        encoder.kept.clear()

    return keyed_texts(docs, key, text).mapInArrow(run, "doc_id long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the bytes that the ids stand for; a null list gives no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path, pattern)
        for batch in batches:
            data = [encoder.decode(i or ()) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    columns = encoded.select(encoded[key].cast("bigint").alias("doc_id"), encoded[ids].alias("ids"))
    return columns.mapInArrow(run, "doc_id long, data binary")


DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def round_trip_digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the number of ids, the digest of the ids and the digest of the bytes that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path, pattern)
        for batch in batches:
            for row, texts in str_slices(batch.column("text"), SMALL_SLICE):
                ids, first = encoder.encode(texts)
                digests = []
                for spelling, end in ((encoder.numbers, 1), (encoder.tokens, 0)):
                    data, at = spelling.write(ids)
                    own, cuts = memoryview(data), at[first].tolist()
                    # The last number of a text has no comma after it.
                    digests.append([hashlib.sha256(own[a : max(a, b - end)]).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)])
                keys = batch.column("doc_id").slice(row, len(texts))
                columns = [keys, pa.array(np.diff(first)), *map(pa.array, digests)]
                yield pa.RecordBatch.from_arrays(columns, schema=DIGESTS)
        encoder.kept.clear()

    return keyed_texts(docs, key, text).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
