"""Near duplicates: texts whose sets of word shingles have a Jaccard similarity of at least 0.8, and their components.

A text's set holds the hashes of its shingles of five words, lower-cased (A-Z); with fewer words, of the whole
sequence; without words it is empty and links with nothing. Texts of equal sets form a class, and only one text of
a class, the first of it in a task, takes part in the search. Links are found by T-occurrence: a text of n
shingles can only link with one that shares T = ceil(0.8 n) of them.

1. Order. All texts are counted into a sketch of 2 ** SKETCH_BITS numbers, which is broadcast: how many shingles of their
   sets have a hash of that slot. All texts order their shingles from rare to common by it, then by hash. Any order gives
   right results; this one keeps lists short.
2. Lists. Two linked texts share one of the first n - T + 1 shingles of each in this order. These are sent to hash ranges
   and make inverted lists. Of the shingles that two linked texts share, the first is at places i and j of which neither
   leaves too few behind it: m <= (5 n - 9 i) / 4, and the same for n and j. A class without any partner of such a size
   leaves the list, and a list is cut where neighbouring sizes are too different to link; what has two classes remains.
3. Stars. Every list compares its least class with the others. What links makes components.
4. Representatives. Each class that is still apart from the component with most members of a list meets REPRESENTATIVES
   members of that component; of its meetings in all lists the most frequent are decided. What links joins the component,
   so that a large group of near copies is together but for a few members before all pairs are looked at.
5. The rest. Every list compares all its classes that are not in one component yet, in blocks if it is long. So all
   links between components are found, and copies of copies need no pairs.
6. Deciding. Pairs of too different sizes, or with too little in common by the counts of BUCKETS hash buckets (an
   upper bound of the overlap), are dropped. The rest is decided from the whole sets, one text against its
   candidates at a time: short lists of the candidates are merged through a heap, and candidates with T - L hits are
   probed by binary search in the L long ones (DivideSkip).

Null and empty texts have no shingles and their own doc_id as component. Rows without doc_id join components and
give no number to them; alone they have none. Repeated rows are rows of one class. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lares.llm.components import components
from lares.llm.tables import SLICE_BYTES, SMALL_SLICE, keyed_texts, settle, text_slices
from lares.llm.words import find_words, mix, window_hashes, word_hashes

SHINGLE = 5
PERCENT = 80
SKETCH_BITS = 22
#: Text bytes behind one range of shingles: the number of ranges follows the bytes of all texts.
RANGE_BYTES = 16 << 20
#: Ranges of the sketch that are added up by themselves.
SKETCH_PARTS = 16
BUCKETS = 256
#: Classes of a list that are compared in one group.
BLOCK = 512
REPRESENTATIVES = 8
#: Slots of the map of classes whose sets are wanted; a full map costs time only.
WANTED_BITS = 24
#: Weight of a probe against a step of the merge, from the published heuristic for L.
MU = 0.01


def shingle_sets(texts) -> list[np.ndarray]:
    """The sorted set of each text."""
    words = find_words(texts)
    hashes = word_hashes(texts, words)
    windows = window_hashes(hashes, SHINGLE)
    sets = []
    for a, b in zip(words.first, words.first[1:], strict=False):
        if b - a >= SHINGLE:
            sets.append(np.unique(windows[a : b - SHINGLE + 1]))
        elif b > a:
            sets.append(mix(window_hashes(hashes[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def class_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def needed(n: int) -> int:
    """T of a set of n."""
    return -(-PERCENT * n // 100)


def linked(n: int, m: int, common: int) -> bool:
    return common > 0 and 100 * common >= PERCENT * (n + m - common)


def divide_skip(query: np.ndarray, candidates: list[np.ndarray]) -> list[tuple[int, int]]:
    """The candidates that share at least T of the query's shingles, and how many they share."""
    n, least = len(query), needed(len(query))
    lists: list[list[int]] = [[] for _ in range(n)]
    for c, own in enumerate(candidates):
        at = np.minimum(np.searchsorted(own, query), max(0, len(own) - 1))
        for i in np.flatnonzero(own[at] == query).tolist() if len(own) else ():
            lists[i].append(c)
    lists.sort(key=len)
    lists = [one for one in lists if one]
    longest = len(lists[-1]) if lists else 0
    n_long = min(int(least / (MU * math.log2(longest + 1) + 1)), least - 1, len(lists)) if lists else 0
    short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    found = []
    for c, same in groupby(heapq.merge(*short)):
        hits = sum(1 for _ in same)
        if hits >= least - n_long:
            for one in long_:
                at = _probe(one, c)
                hits += at < len(one) and one[at] == c
            if hits >= least:
                found.append((c, hits))
    return found


def _probe(one: list[int], c: int) -> int:
    low, high = 0, len(one)
    while low < high:
        middle = (low + high) // 2
        if one[middle] < c:
            low = middle + 1
        else:
            high = middle
    return low


_FACTS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int32()), ("cls", pa.binary()), ("buckets", pa.binary()), ("part", pa.int64()), ("counts", pa.binary())]
)
_FACTS_SQL = "doc_id long, n int, cls binary, buckets binary, part long, counts binary"


def _bucket_counts(own: np.ndarray) -> bytes:
    return np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=BUCKETS).clip(0, 255).astype(np.uint8).tobytes()


def facts(docs: DataFrame) -> DataFrame:
    """A row a text: size, class and, once a task and class, bucket counts. Then rows with a part of the sketch of the
    task's texts (part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for texts in text_slices(batch.column("text"), SMALL_SLICE):
                sets = shingle_sets(texts)
                np.add.at(sketch, _slot(np.concatenate(sets)), np.int32(1))
                classes = [class_of(s) for s in sets]
                ids = batch.column("doc_id").slice(texts.first_row, len(sets))
                counts = []
                for own, name in zip(sets, classes, strict=True):
                    counts.append(_bucket_counts(own) if len(own) and name not in seen else None)
                    seen.add(name)
                sizes = pa.array([len(s) for s in sets], pa.int32())
                columns = [ids, sizes, pa.array(classes), pa.array(counts, pa.binary())]
                columns += [pa.nulls(len(sets), kind) for kind in (pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=_FACTS)
        if seen:
            parts = [_packed(p) for p in sketch.reshape(SKETCH_PARTS, -1)]
            yield pa.RecordBatch.from_pylist([{"part": i, "counts": p} for i, p in enumerate(parts)], _FACTS)

    return docs.mapInArrow(run, _FACTS_SQL)


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype(np.min_scalar_type(int(counts.max()))).tobytes(), 1)


def frequency_sketch(known: DataFrame) -> np.ndarray:
    """How many shingles of all texts' sets fall into each slot. known: facts."""
    width = (1 << SKETCH_BITS) // SKETCH_PARTS

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for packed in table.column("counts"):
            counts = zstandard.decompress(packed.as_py())
            total += np.frombuffer(counts, f"u{len(counts) // width}")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([_packed(total.clip(0, 1 << 30))], pa.binary())})

    parts = known.filter("part is not null").select("part", "counts")
    sketch = np.zeros((SKETCH_PARTS, width), np.int32)
    for part, packed in parts.groupBy("part").applyInArrow(add, "part long, counts binary").collect():
        counts = zstandard.decompress(bytes(packed))
        sketch[part] = np.frombuffer(counts, f"u{len(counts) // width}")
    return sketch.ravel()


def ordered_prefix(own: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The first n - T + 1 shingles, rare ones first."""
    count = len(own) - needed(len(own)) + 1
    return own[np.argsort(sketch[_slot(own)], kind="stable")[:count]]


def _first_in_task(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[list[np.ndarray], list[bytes]]]:
    """Sets and classes of each slice of about `limit` bytes, a class once in a task; no empty sets."""
    seen: set[bytes] = set()
    for batch in batches:
        for texts in text_slices(batch.column("text"), limit):
            sets, classes = [], []
            for own in shingle_sets(texts):
                if len(own) and (name := class_of(own)) not in seen:
                    seen.add(name)
                    sets.append(own)
                    classes.append(name)
            if sets:
                yield sets, classes


_POSTINGS = pa.schema([("part", pa.int64()), ("shingles", pa.binary()), ("owners", pa.binary()), ("at", pa.binary()), ("classes", pa.binary()), ("sizes", pa.binary())])
_POSTINGS_SQL = "part long, shingles binary, owners binary, at binary, classes binary, sizes binary"
_LISTS = pa.schema(
    [("list", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("first", pa.binary()), ("first_n", pa.int32()), ("members", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32()))]
)
_LISTS_SQL = "list long, block int, blocks int, first binary, first_n int, members array<binary>, sizes array<int>"


def _with_partners(lists: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the members (of lists in order, by size n within) with another one whose size their place allows."""
    kept = np.arange(len(lists))
    step = int(n.max(initial=0)) * 2 + 2
    while len(kept):
        own, size = lists[kept] * step, n[kept]
        most = (5 * size - 9 * at[kept]) // 4
        keys = own + size
        others = np.searchsorted(keys, own + most, "right") - np.searchsorted(keys, own - (-4 * size // 5), "left")
        some = others - (most >= size) > 0
        if some.all():
            break
        kept = kept[some]
    return kept


def _inverted_lists(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Lists of one hash range that have two classes or more; equal ones once, long ones in blocks."""
    shingles, owners, places, classes, sizes, at = [], [], [], [], [], 0
    for row in table.to_pylist():
        shingles.append(np.frombuffer(row["shingles"], np.uint64))
        own = np.frombuffer(row["classes"], "V16")
        owners.append(np.frombuffer(row["owners"], np.uint32).astype(np.int64) + at)
        places.append(np.frombuffer(row["at"], f"u{8 * len(row['at']) // len(row['shingles'])}").astype(np.int64))
        classes.append(own)
        sizes.append(np.frombuffer(row["sizes"], np.int32))
        at += len(own)
    shingles, owners, places, sizes = (np.concatenate(x) for x in (shingles, owners, places, sizes))
    classes = np.concatenate(classes)
    # Within one range the first half of a class' 128 bits tells classes apart.
    halves, first, place = np.unique(classes.view(np.uint64)[::2], return_index=True, return_inverse=True)
    owners, sizes = place[owners], sizes[first].astype(np.int64)
    order = np.lexsort((owners, sizes[owners], shingles))
    shingles, owners, places = shingles[order], owners[order], places[order]
    new = np.append(True, (shingles[1:] != shingles[:-1]) | (owners[1:] != owners[:-1]))
    shingles, owners, places = shingles[new], owners[new], places[new]
    lists = np.append(0, np.cumsum(shingles[1:] != shingles[:-1]))
    kept = _with_partners(lists, sizes[owners], places)
    shingles, owners, n = shingles[kept], owners[kept], sizes[owners[kept]]
    cut = np.append(True, (shingles[1:] != shingles[:-1]) | (5 * n[:-1] < 4 * n[1:]))[: len(n)]
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(shingles))[: len(starts)]
    numbers = mix(shingles[starts] + n[starts].astype(np.uint64)).view(np.int64)
    names = [c.tobytes() for c in classes[first]]
    rows, known = [], set()
    for number, a, b in zip(numbers.tolist(), starts, ends, strict=True):
        if b - a < 2:
            continue
        members = np.sort(owners[a:b])
        if (print_ := members.tobytes()) in known:
            continue
        known.add(print_)
        head = {"list": number, "first": names[members[0]], "first_n": int(sizes[members[0]])}
        for c in range(0, b - a, BLOCK):
            block = members[c : c + BLOCK]
            place = {"block": c // BLOCK, "blocks": -(-int(b - a) // BLOCK)}
            rows.append(head | place | {"members": [names[m] for m in block], "sizes": sizes[block]})
    return pa.Table.from_pylist(rows, _LISTS)


def inverted_lists(docs: DataFrame, sketch: np.ndarray, size: int) -> DataFrame:
    """The lists of all texts, which have `size` bytes."""
    bits = max(4, (size // RANGE_BYTES).bit_length())
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, classes in _first_in_task(batches):
            heads = [ordered_prefix(own, shared.value) for own in sets]
            shingles = np.concatenate(heads)
            owners = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
            names = np.frombuffer(b"".join(classes), "V16")
            sizes = np.array([len(s) for s in sets], np.int32)
            places = np.concatenate([np.arange(len(h)) for h in heads])
            order = np.argsort(shingles)
            shingles, owners, places = shingles[order], owners[order], places[order]
            parts, cuts = np.unique(shingles >> np.uint64(64 - bits), return_index=True)
            rows = []
            for part, a, b in zip(parts, cuts, np.append(cuts[1:], len(shingles)), strict=True):
                used, place = np.unique(owners[a:b], return_inverse=True)
                rows.append(
                    {"part": int(part), "shingles": shingles[a:b].tobytes(), "owners": place.astype(np.uint32).tobytes()}
                    | {"at": places[a:b].astype(np.min_scalar_type(int(places[a:b].max()))).tobytes()}
                    | {"classes": names[used].tobytes(), "sizes": sizes[used].tobytes()}
                )
            yield pa.RecordBatch.from_pylist(rows, _POSTINGS)

    postings = docs.select("text").mapInArrow(run, _POSTINGS_SQL)
    return postings.groupBy("part").applyInArrow(_inverted_lists, _LISTS_SQL)


def _size_fits(n: Column, m: Column) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def _ordered(pairs: DataFrame) -> DataFrame:
    swap = F.col("x") > F.col("y")
    return pairs.select(
        F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"),
        F.when(swap, F.col("m")).otherwise(F.col("n")).alias("n"), F.when(swap, F.col("n")).otherwise(F.col("m")).alias("m"),
    ).distinct()


def star_pairs(lists: DataFrame) -> DataFrame:
    member = F.explode(F.arrays_zip(F.col("members").alias("y"), F.col("sizes").alias("m")))
    pairs = lists.select(F.col("first").alias("x"), F.col("first_n").alias("n"), member.alias("member"))
    pairs = pairs.select("x", "n", "member.y", "member.m").filter(F.col("x") != F.col("y"))
    return _ordered(pairs.filter(_size_fits(F.col("n"), F.col("m"))))


def _listed(lists: DataFrame) -> DataFrame:
    """list, block, blocks, member and n, a row a member."""
    member = F.explode(F.arrays_zip(F.col("members").alias("member"), F.col("sizes").alias("n")))
    return lists.select("list", "block", "blocks", member.alias("m")).select("list", "block", "blocks", "m.member", "m.n")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """With the component of each member. labels: u and its component v, if it has one."""
    label = labels.select(F.col("u").alias("member"), F.col("v").alias("label"))
    return rows.join(label, "member", "left").withColumn("label", F.coalesce("label", "member"))


def meetings(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Up to REPRESENTATIVES pairs for each class that is apart from the main component of one of its lists."""
    rows = _labelled(_listed(lists).select("list", "member", "n"), labels)
    # The member of least hash, by several hashes: lists that share most of a component choose the same ones.
    chosen = [
        F.min(F.struct(F.xxhash64("member", F.lit(i)).alias("h"), "member", "n")).alias(f"r{i}") for i in range(REPRESENTATIVES)
    ]
    sizes = rows.groupBy("list", "label").agg(F.count("*").alias("copies"), *chosen)
    every = F.array_distinct(F.array(*[F.struct(f"r{i}.member", f"r{i}.n") for i in range(REPRESENTATIVES)]))
    best = F.max_by(F.struct("label", every.alias("all")), F.struct("copies", "label"))
    main = sizes.groupBy("list").agg(F.count("*").alias("labels"), best.alias("main")).filter("labels > 1").drop("labels")
    apart = rows.join(main, "list").filter(F.col("label") != F.col("main.label"))
    pairs = apart.select("member", "n", F.explode("main.all").alias("r")).filter(_size_fits(F.col("n"), F.col("r.n")))
    counted = pairs.groupBy("member", "n", "r.member", "r.n").agg(F.count("*").alias("lists")).toDF("x", "n", "y", "m", "lists")
    order = Window.partitionBy("x").orderBy(F.desc("lists"), "y")
    return _ordered(counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= REPRESENTATIVES))


def _may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the bucket counts of pairs of texts leave room for a link."""
    most = np.where((a == 255) | (b == 255), 1 << 40, np.minimum(a, b).astype(np.int64)).sum(1)
    most = np.minimum(most, np.minimum(n, m))
    return 100 * most >= PERCENT * (n + m - most)


def _counts(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, BUCKETS)


def _cross_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks of a list (or within one) that have different labels and may link."""
    for batch in batches:
        for left, right, rows in zip(*(batch.column(c).to_pylist() for c in ("left", "right", "rows")), strict=True):
            codes: dict[bytes, int] = {}
            label = np.array([codes.setdefault(r["label"], len(codes)) for r in rows])
            n = np.array([r["n"] for r in rows], np.int64)
            block = np.array([r["block"] for r in rows])
            counts = _counts([r["buckets"] for r in rows])
            a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
            n_a, n_b = n[a][:, None], n[b][None, :]
            apart = label[a][:, None] != label[b][None, :]
            apart &= np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * PERCENT
            i, j = np.nonzero(np.triu(apart, 1) if left == right else apart)
            i, j = a[i], b[j]
            for start in range(0, len(i), 1 << 14):
                x, y = i[start : start + (1 << 14)], j[start : start + (1 << 14)]
                some = _may_link(counts[x], counts[y], n[x], n[y])
                names = [pa.array([rows[k]["member"] for k in side[some]], pa.binary()) for side in (x, y)]
                yield pa.RecordBatch.from_arrays(names, ["x", "y"])


def cross_pairs(lists: DataFrame, labels: DataFrame, buckets: DataFrame) -> DataFrame:
    """All pairs of a list's members that are in different components and may link.

    labels: u and its component v, if it has one. Counts travel with the members, so that pairs never do.
    """
    labelled = _labelled(_listed(lists), labels)
    mixed = labelled.groupBy("list").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a != b").select("list")
    dealt = (
        labelled.join(mixed, "list", "left_semi")
        .join(buckets.withColumnRenamed("cls", "member"), "member")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    groups = dealt.groupBy("list", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).agg(
        F.collect_list(F.struct("block", "member", "n", "label", "buckets")).alias("rows")
    )
    pairs = groups.select("left", "right", "rows").mapInArrow(_cross_pairs, "x binary, y binary")
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def wanted_sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """cls and its whole set, of the classes in the pairs and a few more. The map of wanted classes is all that is
    broadcast, of a size that does not depend on the data."""
    names = pairs.select(F.explode(F.array("x", "y")).alias("cls"))
    slots = names.select(F.conv(F.hex(F.substring("cls", 1, WANTED_BITS // 8)), 16, 10).cast("int").alias("slot"))
    marked = np.zeros(1 << WANTED_BITS, bool)
    marked[slots.distinct().toArrow().column("slot").to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marked, bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for sets, classes in _first_in_task(batches, SMALL_SLICE):
            slots = (int.from_bytes(c[: WANTED_BITS // 8], "big") for c in classes)
            some = [i for i, slot in enumerate(slots) if wanted[slot >> 3] >> (slot & 7) & 1]
            columns = [pa.array([classes[i] for i in some], pa.binary()), pa.array([sets[i].tobytes() for i in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "own"])

    return docs.select("text").mapInArrow(run, "cls binary, own binary").dropDuplicates(["cls"])


def likely_pairs(pairs: DataFrame, buckets: DataFrame) -> DataFrame:
    """Pairs whose bucket counts allow a link. buckets: cls and counts."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_counts(batch.column(c).to_pylist()) for c in ("bx", "by"))
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
            keep = pa.array(_may_link(a, b, n, m))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("x", "y")], ["x", "y"])

    def counts(side: str) -> DataFrame:
        return buckets.select(F.col("cls").alias(side), F.col("buckets").alias(f"b{side}"))

    return pairs.join(counts("x"), "x").join(counts("y"), "y").mapInArrow(bound, "x binary, y binary")


_LINKS = pa.schema([("u", pa.binary()), ("v", pa.binary())])


def _one_text(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """The links of one text with a block of its candidates."""
    names, found = left.column("y").to_pylist(), []
    if right.num_rows and names:
        query = np.frombuffer(right.column("own")[0].as_py(), np.uint64)
        candidates = [np.frombuffer(c, np.uint64) for c in left.column("other").to_pylist()]
        found = [c for c, hits in divide_skip(query, candidates) if linked(len(query), len(candidates[c]), hits)]
    return pa.Table.from_pylist([{"u": key[0].as_py(), "v": names[c]} for c in found], _LINKS)


def decide(docs: DataFrame, likely: DataFrame) -> DataFrame:
    """Those of a written table's pairs that are links, as u and v."""
    sets = settle(wanted_sets(docs, likely))
    # A text with many candidates meets them in blocks.
    parts = likely.groupBy("x").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = likely.join(parts, "x").select("x", "y", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int").alias("part"))
    candidates = dealt.join(sets.select(F.col("cls").alias("y"), F.col("own").alias("other")), "y")
    queries = dealt.select("x", "part").distinct().join(sets.withColumnRenamed("cls", "x"), "x")
    queries = queries.select(F.col("x").alias("query"), F.col("part").alias("query_part"), "own")
    return candidates.groupBy("x", "part").cogroup(queries.groupBy("query", "query_part")).applyInArrow(_one_text, "u binary, v binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    source = keyed_texts(docs, key, text)
    known = settle(facts(source))
    texts = known.filter("part is null").select("doc_id", "n", "cls")
    buckets = known.filter("buckets is not null").groupBy("cls").agg(F.first("buckets").alias("buckets"))
    size = text_bytes(source)
    lists = settle(inverted_lists(source, frequency_sketch(known), size))
    stars = settle(likely_pairs(star_pairs(lists), buckets))
    labels = components(decide(source, stars))
    met = settle(likely_pairs(meetings(lists, labels), buckets).join(stars, ["x", "y"], "left_anti"))
    labels, tested = components(decide(source, met).unionByName(labels)), stars.unionByName(met)
    rest = settle(cross_pairs(lists, labels, buckets).join(tested, ["x", "y"], "left_anti"))
    labels = components(decide(source, rest).unionByName(labels))
    classes = texts.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    labelled = classes.join(labels.select(F.col("u").alias("cls"), F.col("v").alias("label")), "cls", "left")
    labelled = labelled.select("cls", "least", F.coalesce("label", "cls").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = labelled.join(least, "label").select("cls", "component_id")
    return texts.join(of_class, "cls", "left").select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
