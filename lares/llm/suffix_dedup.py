"""Bytes of texts that repeat an earlier string of 100 bytes, by buckets of suffixes at difference-cover positions.

A position is in the cover if its offset in the text, modulo 31, is in a difference cover of 6 residues: whatever
the offsets of two equal 100-byte strings, some common distance below 31 puts both on cover positions. There the
next 70 bytes, which lie inside both strings, are equal, too. Suffixes that begin with the same 70 bytes are a
bucket; its members stand for all strings of 100 bytes that contain their 70 bytes at a distance below 31. A shorter
period has more cover positions but fewer strings between a bucket's prefix and its names, which step 3 has to sort.

1. Buckets with one member can't repeat anything. Tasks send the hashes of their cover positions in few bits, and
   ranges of hashes answer with a map of those seen twice: MAP_BITS bits whatever the input, broadcast. A hash has as
   many places in its range's piece of the map as the number of hashes there leaves room for (a Bloom filter).
2. Ranks of the cover sample: members of a bucket are sorted by the name (hash) of all bytes that their strings can
   reach, 30 before and 100 from the position. Equal names are ties as long as they can matter; all but the first
   of them repeat all their strings, and no text is looked at again.
3. Buckets with several names go on: their strings, and only those, are sorted by their own hash one range of hashes
   at a time, and all but the first of equal ones repeat it.
4. Spans are joined by blocks of rows of the table. Texts with repeats meet them, the others are done where they are
   read.

Each range is one group of one task and is as small as the number of ranges, which follows the input's partitions,
makes it. A task sends only the first of equal names or strings that it has seen, so a large group of copies arrives
once a task. Maps only spare work: a hit too many costs time, and changes nothing. Strings, names and buckets are
compared by 64-bit hashes.

Earlier means smaller doc_id, then earlier row of the table, then smaller offset. Rows without doc_id come last.
Null and empty texts have no bytes; texts under 100 bytes lose none. Strings don't cross texts and are judged on
the input. Repeated rows are later than the first of them. Other columns are ignored. An empty table gives none; a very
long text is taken whole by one task.

Texts are taken in small pieces, members and spans in rounds of SORTED: what a worker holds beside the maps and the hashes
it has sent doesn't follow the table. A range is held by its members.

The table is read several times, and rows are known by their places in it: it has to be a stored table (or one that
settle() has stored), not the result of a shuffle that may give its rows in another order when run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lares.llm.tables import SMALL_SLICE, Texts, keyed_texts, pieces, release_memory, settle, text_slices
from lares.llm.words import mix, prefix_hashes, span_hashes

WIDTH = 100
#: A difference cover: every distance modulo PERIOD is a difference of two of these (fixed values).
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
PREFIX = WIDTH - PERIOD + 1
MAP_BITS = 28
#: Places of a key in a map, at most.
PROBES = 6
#: Bits of a bucket's hash that go to its range, besides those that the range's number tells. Members are told apart by
#: the whole hash of their names; buckets that look the same cost time only.
KEY_BITS = 32
TOUCHED_BITS = 24
#: Rows of the table that meet their spans in one group.
BLOCK_BITS = 9
#: Hashes that a task gathers before it sends them: the closer they lie, the fewer bits their distances have.
HELD = 6 << 20
KNOWN = 2 << 20
#: Members or spans that are sorted or made into rows at a time: what such a round takes is a multiple of it.
SORTED = 1 << 19
_LAST = np.iinfo(np.int64).max


class Suffixes:
    """Cover positions of a slice of texts that have room for a bucket's prefix, in order."""

    def __init__(self, texts: Texts):
        self.sums = prefix_hashes(texts.data)
        self.starts, self.ends = texts.offsets[:-1], texts.offsets[1:]
        sizes = np.diff(texts.offsets)
        turns = np.where(sizes >= WIDTH, -(-sizes // PERIOD), 0)
        owner = np.repeat(np.arange(len(sizes)), turns)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(turns) - turns, turns)
        at = ((self.starts[owner] + turn * PERIOD)[:, None] + np.array(COVER)).ravel()
        owner = np.repeat(owner, len(COVER))
        room = at + PREFIX <= self.ends[owner]
        self.at, self.owner = at[room], owner[room]
        self.bucket = span_hashes(self.sums, self.at, self.at + PREFIX)

    def keep(self, some: np.ndarray) -> None:
        self.at, self.owner, self.bucket = self.at[some], self.owner[some], self.bucket[some]

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that a member's strings can cover."""
        return np.maximum(self.starts[self.owner], self.at - PERIOD + 1), np.minimum(self.ends[self.owner], self.at + WIDTH)

    def names(self) -> np.ndarray:
        """Names of the reach; the place of the position in it is part of the name."""
        a, b = self.reach()
        return mix(span_hashes(self.sums, a, b) + (self.at - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class FirstSeen:
    """The least doc_id under which a task has sent each key. The task meets its rows in the table's order, so of places
    with one doc_id the known one is the earlier."""

    def __init__(self):
        self.keys, self.doc_ids = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def sort_out(self, keys: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
        """True for what has to be sent: keys with no earlier place known. Both are in the order of rows and offsets."""
        by = np.lexsort((doc_ids, keys))
        chosen = by[np.append(True, keys[by][1:] != keys[by][:-1])] if len(by) else by
        known, own = keys[chosen], doc_ids[chosen]
        at = np.searchsorted(self.keys, known)
        there = np.zeros(len(known), bool)
        if len(self.keys):
            near = np.minimum(at, len(self.keys) - 1)
            there = self.keys[near] == known
            earlier = there & (self.doc_ids[near] <= own)
            chosen, known, own, at, there = (x[~earlier] for x in (chosen, known, own, at, there))
        if len(self.keys) > KNOWN:
            self.__init__()
            at[:], there[:] = 0, False
        self.doc_ids[at[there]] = own[there]
        self.keys = np.insert(self.keys, at[~there], known[~there])
        self.doc_ids = np.insert(self.doc_ids, at[~there], own[~there])
        send = np.zeros(len(keys), bool)
        send[chosen] = True
        return send


def _pack(values: np.ndarray) -> bytes:
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _unpack(data: bytes | memoryview, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}" if n else "u1").astype(np.int64)


def _pack_near(values: np.ndarray) -> bytes:
    """One value or more, as the least and the distances to it (modulo 2 ** 64)."""
    least = values.min(keepdims=True)
    return least.tobytes() + _pack(values.view(np.uint64) - least.view(np.uint64))


def _unpack_near(data: bytes | memoryview, n: int) -> np.ndarray:
    return _unpack(data[8:], n) + np.frombuffer(data[:8], np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """One key or more, as the least and the distances to it; zero bits that end all distances are left out."""
    least = keys.min(keepdims=True)
    far = keys - least
    bits = int(np.bitwise_or.reduce(far))
    shift = (bits & -bits).bit_length() - 1 if bits else 0
    return bytes([shift]) + least.tobytes() + _pack(far >> np.uint64(shift))


def _unpack_keys(data: bytes | memoryview, n: int) -> np.ndarray:
    far = np.frombuffer(data[9:], f"u{(len(data) - 9) // n}").astype(np.uint64)
    return np.frombuffer(data[1:9], np.uint64) + (far << np.uint64(data[0]))


def _first_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    """The keys with only their first bits left."""
    return keys >> np.uint64(64 - bits) << np.uint64(64 - bits)


def _by_range(keys: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of hash ranges and the places of their keys, in order."""
    own = (keys >> np.uint64(64 - bits)).astype(np.min_scalar_type((1 << bits) - 1))
    order = np.argsort(own, kind="stable")
    own = own[order]
    cuts = _cuts(own)
    for part, a, b in zip(own[cuts].tolist(), cuts, np.append(cuts[1:], len(keys)), strict=False):
        yield part, order[a:b]


def _cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values begins."""
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, np.int64)


def _read_binary(column: pa.ChunkedArray) -> list[memoryview | None]:
    """The values where they lie, not copied."""
    return [memoryview(x.as_buffer()) if x.is_valid else None for x in column]


class Map(NamedTuple):
    """Flags of the places of keys, range by range, and the places that a key has in each range's piece. Keys are known by
    their first key_bits bits."""

    flags: np.ndarray
    probes: np.ndarray
    key_bits: int

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """True for all keys that are in it, and for a few others."""
        keys = _first_bits(keys, self.key_bits)
        bits = len(self.probes).bit_length() - 1
        part = (keys >> np.uint64(64 - bits)).astype(np.int64)
        left, found = np.arange(len(keys)), np.ones(len(keys), bool)
        for probe in range(int(self.probes.max())):
            left = left[self.probes[part[left]] > probe]
            place = (part[left] << (MAP_BITS - bits)) + _place(keys[left], probe, bits)
            hit = (self.flags[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            found[left[~hit]] = False
            left = left[hit]
        return found


def _place(keys: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """A place of each key within its range's piece of a map."""
    turned = mix(keys + np.uint64((probe + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return (turned >> np.uint64(64 - (MAP_BITS - bits))).astype(np.int64)


def _segment(keys: np.ndarray, bits: int) -> tuple[bytes, int]:
    """A range's piece of the map of its distinct keys, and the places that each of them has there."""
    size = 1 << (MAP_BITS - bits)
    probes = min(PROBES, max(1, round(0.69 * size / max(1, len(keys)))))
    flags = np.zeros(size, np.uint8)
    for probe in range(probes):
        flags[_place(keys, probe, bits)] = 1
    return np.packbits(flags, bitorder="little").tobytes(), probes


def _whole_map(segments: DataFrame, bits: int, key_bits: int) -> Map:
    """part, segment and probes -> the map, of 2 ** MAP_BITS bits."""
    found = segments.toArrow()
    whole, probes = np.zeros((1 << bits, 1 << (MAP_BITS - 3 - bits)), np.uint8), np.ones(1 << bits, np.uint8)
    for part, segment, n in zip(*(found.column(c).to_pylist() for c in ("part", "segment", "probes")), strict=True):
        whole[part], probes[part] = np.frombuffer(segment, np.uint8), n
    return Map(whole.ravel(), probes, key_bits)


_SLOTS = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("steps", pa.binary()), ("twice", pa.binary())])


def repeated_buckets(docs: DataFrame, bits: int, slot_bits: int) -> DataFrame:
    """part, segment and probes of the map of buckets that seem to have two members."""
    shift = np.uint64(64 - slot_bits)

    def rows(slots: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sorts them in place and copies only some of them at a time."""
        slots.sort()
        out, a, sent = [], 0, 0
        while a < len(slots):
            part = int(slots[a]) >> (slot_bits - bits)
            b = int(np.searchsorted(slots, np.uint64((part + 1) << (slot_bits - bits))))
            own, counts = np.unique((slots[a:b] - np.uint64(part << (slot_bits - bits))).astype(np.int64), return_counts=True)
            out.append({"part": part, "n": len(own), "steps": _pack(np.diff(own, prepend=0)), "twice": own[counts > 1].tobytes()})
            a = b
            if a - sent > SORTED or a == len(slots):
                yield pa.RecordBatch.from_pylist(out, _SLOTS)
                out, sent = [], a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = np.empty(HELD, np.uint64), 0
        for batch in batches:
            for texts in text_slices(batch.column("text"), SMALL_SLICE):
                slots = Suffixes(texts).bucket >> shift
                if size + len(slots) > HELD:
                    yield from rows(held[:size])
                    size = 0
                if len(slots) > HELD:
                    yield from rows(slots)
                else:
                    held[size : size + len(slots)] = slots
                    size += len(slots)
        yield from rows(held[:size])

    def seen_twice(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, counts = key[0].as_py(), table.column("n").to_pylist()
        twice = _read_binary(table.column("twice"))
        slots, done = np.empty(sum(counts) + sum(map(len, twice)) // 8, np.int64), 0
        for n, steps, again in zip(counts, _read_binary(table.column("steps")), twice, strict=True):
            np.cumsum(_unpack(steps, n), out=slots[done : done + n])
            slots[done + n : done + n + len(again) // 8] = np.frombuffer(again, np.int64)
            done += n + len(again) // 8
        slots.sort()
        slots = np.unique(slots[1:][slots[1:] == slots[:-1]]).astype(np.uint64) + np.uint64(part << (slot_bits - bits))
        segment, probes = _segment(slots << shift, bits)
        return pa.table({"part": pa.array([part], pa.int64()), "segment": pa.array([segment], pa.binary()), "probes": pa.array([probes], pa.int32())})

    sent = docs.select("text").mapInArrow(run, "part long, n long, steps binary, twice binary")
    return sent.groupBy("part").applyInArrow(seen_twice, "part long, segment binary, probes int")


#: Members sent to a range (keys, names or none, members of each text, offsets, spans before and after, the texts' rows
#: and ids) or spans found (block set), or a piece of a map.
_SENT = pa.schema(
    [
        ("part", pa.int64()), ("keys", pa.binary()), ("names", pa.binary()), ("counts", pa.binary()), ("offsets", pa.binary()),
        ("before", pa.binary()), ("after", pa.binary()), ("places", pa.binary()), ("doc_ids", pa.binary()),
        ("block", pa.int64()), ("rows", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary()), ("segment", pa.binary()), ("probes", pa.int32()),
    ]
)
_SENT_SQL = (
    "part long, keys binary, names binary, counts binary, offsets binary, before binary, after binary, places binary, "
    "doc_ids binary, block long, rows binary, starts binary, ends binary, segment binary, probes int"
)
_EMPTY = dict.fromkeys(_SENT.names)
_OF_MEMBERS = _SENT.names[1 : _SENT.names.index("block")]


def _spans(places: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> list[dict]:
    """Rows of spans by block of table rows; overlapping ones of a text are joined."""
    if not len(places):
        return []
    order = np.lexsort((starts, places))
    places, starts, ends = places[order], starts[order], ends[order]
    text = np.append(0, np.cumsum(places[1:] != places[:-1]))
    far = np.maximum.accumulate(ends + text * (1 << 40)) - text * (1 << 40)
    new = np.append(True, (text[1:] != text[:-1]) | (starts[1:] > far[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(new) - 1)
    places, starts, ends = places[new], starts[new], far[last]
    blocks, cuts = np.unique(places >> BLOCK_BITS, return_index=True)
    parts = mix(blocks.astype(np.uint64)) >> np.uint64(64 - bits)
    return [
        _EMPTY
        | {"part": int(part), "block": block, "rows": (places[a:b] & ((1 << BLOCK_BITS) - 1)).astype(np.uint16).tobytes()}
        | {"starts": starts[a:b].tobytes(), "ends": ends[a:b].tobytes()}
        for block, part, a, b in zip(blocks.tolist(), parts.tolist(), cuts, np.append(cuts[1:], len(places)), strict=True)
    ]


class Members(NamedTuple):
    """Members found in a slice of texts: what equal ones have in common, keys, names or none, texts, positions (in order)
    and the spans that they repeat if they aren't the first."""

    same: np.ndarray
    keys: np.ndarray
    names: np.ndarray | None
    owner: np.ndarray
    at: np.ndarray
    a: np.ndarray
    b: np.ndarray


class Slice:
    """Rows of a slice of texts and its own offsets."""

    def __init__(self, batch: pa.RecordBatch, texts: Texts):
        rows = slice(texts.first_row, texts.first_row + len(texts.offsets) - 1)
        self.places = batch.column("place").to_numpy()[rows]
        self.doc_ids = batch.column("doc_id").fill_null(int(_LAST)).to_numpy(zero_copy_only=False)[rows]
        self.starts = texts.offsets[:-1]

    def members(self, keys, names, owner, at, before, after, bits: int) -> list[dict]:
        """at: in order, so that a text's members follow one another."""
        out = []
        for part, some in _by_range(keys, bits):
            used, counts = np.unique(owner[some], return_counts=True)
            out.append(
                _EMPTY
                | {"part": part, "keys": _pack_keys(keys[some]), "names": None if names is None else names[some].tobytes()}
                | {"counts": counts.astype(np.uint32).tobytes(), "offsets": _pack(at[some] - self.starts[owner[some]])}
                | {"before": _pack(before[some]), "after": _pack(after[some])}
                | {"places": _pack_near(self.places[used]), "doc_ids": _pack_near(self.doc_ids[used])}
            )
        return out

    def spans(self, owner, a, b, bits: int) -> list[dict]:
        return _spans(self.places[owner], a - self.starts[owner], b - self.starts[owner], bits)


def _sent(batches: Iterator[pa.RecordBatch], found: Callable[[Texts], Members], bits: int) -> Iterator[pa.RecordBatch]:
    """Members to send to their ranges and spans of the others. Members are found in small pieces of a slice and sent by
    slice: a worker's memory follows the piece, the number of rows sent the slice."""
    seen = FirstSeen()
    for batch in batches:
        for texts in text_slices(batch.column("text")):
            rows, held, size = Slice(batch, texts), [], 0
            out: list[dict] = []
            for piece in pieces(texts, SMALL_SLICE):
                first = piece.first_row - texts.first_row
                _, keys, names, owner, at, a, b = own = found(piece)
                owner, at, a, b = owner + first, *(x + texts.offsets[first] for x in (at, a, b))
                send = seen.sort_out(own.same, rows.doc_ids[owner])
                out += rows.spans(owner[~send], a[~send], b[~send], bits)
                before, after = (at - a)[send].astype(np.uint8), (b - at)[send].astype(np.uint8)
                held.append((keys[send], keys[:0] if names is None else names[send], owner[send].astype(np.int32), at[send], before, after))
                size += len(before)
                if size > SORTED:
                    yield _batch(out, rows, held, names is not None, bits)
                    out, held, size = [], [], 0
            if out or size:
                yield _batch(out, rows, held, names is not None, bits)
    del seen
    release_memory()


def _batch(out: list[dict], rows: Slice, held: list[tuple[np.ndarray, ...]], named: bool, bits: int) -> pa.RecordBatch:
    keys, names, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    return pa.RecordBatch.from_pylist(out + rows.members(keys, names if named else None, *rest, bits), _SENT)


def _received(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """keys, names, doc_ids, places, offsets, before, after of the members sent to a range."""
    counts = [np.frombuffer(r["counts"], np.uint32) for r in rows]
    ends = np.cumsum([0, *(int(c.sum()) for c in counts)])
    named = any(r["names"] is not None for r in rows)
    types = (np.uint64, *[np.int64] * 2, np.uint32, *[np.uint8] * 2)
    keys, doc_ids, places, offsets, before, after = columns = [np.empty(ends[-1], t) for t in types]
    names = np.empty(ends[-1], np.uint64) if named else keys
    for r, own, a, b in zip(rows, counts, ends, ends[1:], strict=False):
        keys[a:b] = _unpack_keys(r["keys"], b - a)
        if named:
            names[a:b] = np.frombuffer(r["names"], np.uint64)
        doc_ids[a:b], places[a:b] = (np.repeat(_unpack_near(r[c], len(own)), own) for c in ("doc_ids", "places"))
        offsets[a:b], before[a:b], after[a:b] = (_unpack(r[c], b - a) for c in ("offsets", "before", "after"))
    return keys, names, *columns[1:]


def _some_keys(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places of the keys of a range, those of equal keys together, by the bits behind the first `bits`: about SORTED at a time."""
    more = max(0, -(-len(keys) // SORTED) - 1).bit_length()
    if not more:
        yield np.arange(len(keys))
        return
    for _, some in _by_range(keys << np.uint64(bits), min(16, more)):
        yield some


def _sort_range(bits: int, with_map: bool):
    """A function over one range: spans of all members but the first of equal names, and the map of keys with several
    names. Rows of spans pass through."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        passed = table.filter(pc.is_valid(table.column("block"))).select(_SENT.names).cast(_SENT)
        found = pa.Table.from_pylist(sort(key[0].as_py(), table), _SENT)
        release_memory()
        return pa.concat_tables([passed, found])

    def sort(part: int, table: pa.Table) -> list[dict]:
        sent = zip(*(_read_binary(table.column(c)) for c in _OF_MEMBERS), strict=True)
        members = _received([r for values in sent if (r := dict(zip(_OF_MEMBERS, values, strict=True)))["keys"] is not None])
        out, held, size, several = [], [], 0, []
        for some in _some_keys(members[0], bits):
            keys, names, doc_ids, places, offsets, before, after = (x[some] for x in members)
            order = np.lexsort((offsets, places, doc_ids, names, keys))
            keys, names, places, offsets, before, after = (x[order] for x in (keys, names, places, offsets.astype(np.int64), before, after))
            equal = keys[1:] == keys[:-1]
            later = np.append(False, equal & (names[1:] == names[:-1])) if len(keys) else np.zeros(0, bool)
            held.append((places[later], (offsets - before)[later], (offsets + after)[later]))
            size += len(held[-1][0])
            if size > SORTED:
                out += _spans(*map(np.concatenate, zip(*held, strict=True)), bits)
                held, size = [], 0
            if with_map:
                several.append(np.unique(keys[1:][equal & (names[1:] != names[:-1])]))
        if held:
            out += _spans(*map(np.concatenate, zip(*held, strict=True)), bits)
        if with_map:
            segment, probes = _segment(np.concatenate(several), bits)
            out.append(_EMPTY | {"part": part, "segment": segment, "probes": probes})
        return out

    return run


def ranked_ties(docs: DataFrame, repeated: Map, bits: int) -> DataFrame:
    """Spans of members with an earlier one of the same name, and the map of buckets with several names."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(repeated))

    def found(texts: Texts) -> Members:
        own = Suffixes(texts)
        own.keep(Map(*shared.value).holds(own.bucket))
        a, b = own.reach()
        whole = b - a >= WIDTH
        own.keep(whole)
        names = own.names()
        keys = _first_bits(own.bucket, bits + KEY_BITS)
        return Members(mix(own.bucket) + names, keys, names, own.owner, own.at, a[whole], b[whole])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(batches, found, bits)

    return docs.mapInArrow(run, _SENT_SQL).groupBy("part").applyInArrow(_sort_range(bits, True), _SENT_SQL)


def sorted_strings(docs: DataFrame, several: Map, bits: int) -> DataFrame:
    """Spans of strings with an earlier equal one, of those in a bucket with several names."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(several))

    def found(texts: Texts) -> Members:
        own = Suffixes(texts)
        own.keep(Map(*shared.value).holds(own.bucket))
        turns = np.zeros(len(texts.data) + 1, np.int32)
        np.add.at(turns, np.maximum(own.starts[own.owner], own.at - PERIOD + 1), 1)
        np.add.at(turns, own.at + 1, -1)
        at = np.flatnonzero(np.cumsum(turns, dtype=np.int32)[:-1] > 0)
        owner = np.searchsorted(texts.offsets, at, "right") - 1
        room = at + WIDTH <= texts.offsets[owner + 1]
        at, owner = at[room], owner[room]
        keys = span_hashes(own.sums, at, at + WIDTH)
        return Members(keys, keys, None, owner, at, at, at + WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(batches, found, bits)

    return docs.mapInArrow(run, _SENT_SQL).groupBy("part").applyInArrow(_sort_range(bits, False), _SENT_SQL)


_SPANS = pa.schema([(c, _SENT.field(c).type) for c in ("block", "rows", "starts", "ends")])
_SPANS_SQL = "block long, rows binary, starts binary, ends binary"


def _read_spans(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """Rows within the block, starts and ends."""
    types = {"rows": np.uint16, "starts": np.int64, "ends": np.int64}
    return tuple(np.concatenate([np.zeros(0, t), *(np.frombuffer(r[c], t) for r in rows)]) for c, t in types.items())


def joined_spans(spans: DataFrame, bits: int) -> DataFrame:
    """One row a block: the spans that all ranges found in its texts, overlapping ones joined, some rows at a time."""

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        columns = [_read_binary(table.column(c)) for c in _SPANS.names[1:]]
        read = np.cumsum([len(r) // 2 for r in columns[0]])
        joined: list[dict] = []
        row = 0
        while row < len(read):
            stop = max(row + 1, int(np.searchsorted(read, (read[row - 1] if row else 0) + SORTED, "right")))
            some = [dict(zip(_SPANS.names[1:], r, strict=True)) for r in zip(*(c[row:stop] for c in columns), strict=True)]
            rows, starts, ends = _read_spans(joined + some)
            joined = _spans((key[0].as_py() << BLOCK_BITS) + rows.astype(np.int64), starts, ends, bits)
            row = stop
        return pa.Table.from_pylist([{c: r[c] for c in _SPANS.names} for r in joined], _SPANS)

    return spans.groupBy("block").applyInArrow(join, _SPANS_SQL)


def _slot(blocks: np.ndarray) -> np.ndarray:
    return (mix(blocks.astype(np.uint64)) >> np.uint64(64 - (TOUCHED_BITS - BLOCK_BITS))).astype(np.int64)


def touched_rows(spans: DataFrame) -> np.ndarray:
    """A bit for each row that has spans, in 2 ** TOUCHED_BITS bits: a line of bits a slot of blocks. Blocks that share
    a slot share its bits, and a bit too many costs a row's way, no more."""
    words = [f"w{i}" for i in range((1 << BLOCK_BITS) // 64)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = np.zeros((batch.num_rows, 1 << BLOCK_BITS), np.uint8)
            for line, rows in zip(flags, batch.column("rows").to_pylist(), strict=True):
                line[np.frombuffer(rows, np.uint16)] = 1
            masks = np.packbits(flags, axis=1, bitorder="little").view(np.int64)
            columns = [_slot(batch.column("block").to_numpy()).astype(np.int32), *masks.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["slot", *words])

    marked = spans.select("block", "rows").mapInArrow(mark, "slot int, " + ", ".join(f"{w} long" for w in words))
    found = marked.groupBy("slot").agg(*[F.bit_or(w).alias(w) for w in words]).toArrow()
    touched = np.zeros((1 << (TOUCHED_BITS - BLOCK_BITS), len(words)), np.int64)
    touched[found.column("slot").to_numpy()] = np.stack([found.column(w).to_numpy() for w in words], axis=1)
    return touched.view(np.uint8)


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
)
_TEXTS = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("text", pa.binary()), *_RESULT])
_RESULT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes outside the spans, the number inside and the number of stretches that they make."""
    turns = np.zeros(len(data) + 1, np.int64)
    np.add.at(turns, starts, 1)
    np.add.at(turns, ends, -1)
    gone = np.cumsum(turns)[:-1] > 0
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return kept, int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum())


def _cut(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """The rows of one block: those that are done, and those whose text meets its spans."""
    rows, starts, ends = _read_spans(right.to_pylist())
    out = []
    for r in left.to_pylist():
        if r["text"] is not None:
            own = rows == (r["place"] & ((1 << BLOCK_BITS) - 1))
            kept, removed, stretches = without_spans(r["text"], starts[own], ends[own])
            r |= {"n_removed": removed, "n_spans": stretches, "kept_sha256": hashlib.sha256(kept).hexdigest()}
        out.append({c: r[c] for c in _RESULT.names})
    return pa.Table.from_pylist(out, _RESULT)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    spark = docs.sparkSession
    source = keyed_texts(docs, key, text).withColumn("place", F.monotonically_increasing_id())
    partitions = source.rdd.getNumPartitions()
    bits = min(MAP_BITS - 3, max(4, (2 * partitions - 1).bit_length()))
    slot_bits = min(56, 33 + max(0, (partitions // 64).bit_length()))
    repeated = _whole_map(settle(repeated_buckets(source, bits, slot_bits)), bits, slot_bits)
    ties = settle(ranked_ties(source, repeated, bits))
    several = _whole_map(ties.filter("segment is not null"), bits, bits + KEY_BITS)
    strings = settle(sorted_strings(source, several, bits))
    spans = ties.filter("block is not null").unionByName(strings.filter("block is not null"))
    spans = settle(joined_spans(spans.select("block", "rows", "starts", "ends"), bits))
    shared = spark.sparkContext.broadcast(touched_rows(spans))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        possible = np.unpackbits(shared.value, axis=1, bitorder="little").astype(bool)
        for batch in batches:
            for texts in text_slices(batch.column("text")):
                out = []
                places = batch.column("place").to_numpy()[texts.first_row :][: len(texts.offsets) - 1]
                ids = batch.column("doc_id").slice(texts.first_row, len(places)).to_pylist()
                wanted = possible[_slot(places >> BLOCK_BITS), places & ((1 << BLOCK_BITS) - 1)]
                for i, (place, doc_id) in enumerate(zip(places.tolist(), ids, strict=True)):
                    data = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
                    row = {"block": place >> BLOCK_BITS, "place": place, "doc_id": doc_id, "n_bytes": len(data)}
                    if wanted[i]:
                        out.append(row | {"text": data})
                    else:
                        out.append(row | {"n_removed": 0, "n_spans": 0, "kept_sha256": hashlib.sha256(data).hexdigest()})
                yield pa.RecordBatch.from_pylist(out, _TEXTS)

    texts = source.mapInArrow(read, f"block long, place long, text binary, {_RESULT_SQL}")
    return settle(texts.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_cut, _RESULT_SQL))
