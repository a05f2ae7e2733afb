"""Benchmark items in documents, also with other numbers, names and units.

A text becomes a template: punctuation around words goes, words without a letter or digit go, words are lower-cased
(A-Z and Latin-1), numbers (digits, or number words of four languages) become one placeholder, units after a number
another; a unit glued to its number ("5kg") is a word of its own. A second template of the same words makes
capitalised words a placeholder, too. The words as they are make a third, for verbatim copies. Each is cut into
windows of WINDOW words. An item of fewer words is one window, with at least SHORTEST words for the templates and at
least VERBATIM as it is. Template windows must have LITERALS literal words to be looked up; words as they are need none.

Windows that more than COMMON items hold, as an instruction put before each question, are no evidence: unless they
cover the item whole, they are not looked up, and the words under them don't count below.

Document windows are hash-joined with the items' windows. Before the join a bitmap of 2 ** MAP_BITS slots, which is
all that is broadcast, drops the windows that can't match; its size does not depend on either table. A match lines
a document up with an item at a distance. Slots lined up must be consistent: one value of an item's slot has one
value in the document. Distances of which under CONSISTENT of the values do are dropped: the words between the
slots agree but the question is another. A window carries the words beside it that only windows with too few literals
reach, each word once a side and template. Of these, the ones that agree with the item's in a row next to the match
are covered as well; a slot among them only if its value is consistent. The rest is a leak when windows and such words
cover at least COVERED words of the item, or the item whole if it is shorter (of both, the words under common windows
don't count).

Null and empty texts, and items under VERBATIM words, match nothing. Items that repeat are reported each;
rows that repeat are reported once by key. Rows without a key are reported under null. Other columns are ignored.
Without documents or items there are no leaks. A very long text is taken whole by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lares.llm.tables import SMALL_SLICE, Texts, keyed_texts, settle, text_slices
from lares.llm.words import LOWER, find_words, mix, prefix_hashes, span_hashes, window_hashes

WINDOW = 8
SHORTEST = 5
VERBATIM = 3
LITERALS = 4
COVERED = 13
COMMON = 4
CONSISTENT = 0.8
MAP_BITS = 22

#: Units of measure and money (fixed values).
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons "
    "ounce ounces oz pound pounds lb lbs ml l liter liters litre litres gallon gallons second seconds sec minute "
    "minutes min hour hours h day days week weeks month months year years dollar dollars cent cents euro euros usd "
    "eur percent degrees celsius fahrenheit watt watts kw volt volts amp amps hz mph kmh km/h m/s"
).split()

#: Number words of English, German, French and Spanish, without those for one, which are articles too (fixed values).
_ONES = "two three four five six seven eight nine".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = (
    *_ONES, *_TENS,
    *"ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million".split(),
    *"zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn".split(),
    *"achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend".split(),
    *"deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante".split(),
    *"cinquante soixante mille dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince".split(),
    *"veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien".split(),
)

_WORDLIKE = np.isin(np.arange(256), np.r_[48:58, 65:91, 97:123, 128:256])
_DIGIT = np.isin(np.arange(256), np.r_[48:58])
_IN_NUMBER = np.isin(np.arange(256), np.r_[48:58, list(b".,")])
_CAPITAL = np.isin(np.arange(256), np.r_[65:91])
#: The place of the words as they are among the sequences.
AS_IS = 2
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x4E756D6265720001, 0x556E697400000003, 0x4E616D6500000005))


def _texts(strings: list[str]) -> Texts:
    data = [s.encode() for s in strings]
    offsets = np.cumsum([0, *map(len, data)])
    return Texts(0, np.frombuffer(b"".join(data), np.uint8), offsets)


def _hash(strings: list[str]) -> np.ndarray:
    texts = _texts(strings)
    return span_hashes(prefix_hashes(texts.data), texts.offsets[:-1], texts.offsets[1:])


_UNIT_HASHES = np.sort(_hash(UNITS))
_NUMBER_HASHES = np.sort(_hash([*NUMBER_WORDS, *(f"{ten}-{one}" for ten in _TENS for one in ("one", *_ONES))]))


def _is_one_of(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _glued_units(data: np.ndarray, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that are a number and a unit without a space, and where their units begin."""
    some = np.flatnonzero(_DIGIT[data[starts]] & ~_IN_NUMBER[data[ends - 1]])
    other = np.flatnonzero(~_IN_NUMBER[data])
    begin = other[np.searchsorted(other, starts[some])]
    unit = _is_one_of(_UNIT_HASHES, span_hashes(sums, begin, ends[some]))
    return some[unit], begin[unit]


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals of Latin-1 (two bytes, the first C3) in lower case."""
    out = LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[capital] += 32
    return out


_WORD = pa.struct([("word", pa.int64()), ("slot", pa.int64())])


class Templates:
    """The words of texts as three sequences of hashes (the last as they are), and the value of each slot (0: literal)."""

    def __init__(self, texts: Texts):
        words = find_words(texts)
        starts, ends = words.starts.copy(), words.ends.copy()
        for edge, step in ((starts, 1), (ends, -1)):
            left = np.arange(len(starts))
            while len(left):
                left = left[starts[left] < ends[left]]
                outer = edge[left] if step > 0 else edge[left] - 1
                left = left[~_WORDLIKE[texts.data[outer]]]
                edge[left] += step
        pieces = (starts < ends).astype(np.int64)
        full = np.flatnonzero(pieces)
        starts, ends = starts[full], ends[full]
        sums = prefix_hashes(lowered(texts.data))
        glued, begin = _glued_units(texts.data, sums, starts, ends)
        pieces[full[glued]] = 2
        starts = np.insert(starts, glued + 1, begin)
        ends = np.insert(ends, glued, begin)
        self.first = np.concatenate([[0], np.cumsum(pieces)])[words.first]
        values = span_hashes(sums, starts, ends)
        number = _DIGIT[texts.data[starts]] | _is_one_of(_NUMBER_HASHES, values)
        unit = np.zeros(len(values), bool)
        unit[1:] = _is_one_of(_UNIT_HASHES, values)[1:] & number[:-1]
        unit[self.first[:-1][self.first[:-1] < len(unit)]] = False
        second = texts.data[np.minimum(starts + 1, len(texts.data) - 1)] if len(starts) else starts
        accented = (texts.data[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        name = (_CAPITAL[texts.data[starts]] | accented) & (ends - starts > 1)
        plain = np.where(number, NUMBER, np.where(unit, UNIT, values))
        typed = np.where(name & ~number & ~unit, NAME, plain)
        self.sequences = (plain, typed, values)
        self.slots = tuple(np.where(s == values, np.uint64(0), values) for s in self.sequences)

    def windows(self, width: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows within one text that have enough literal words."""
        sequence, slots = self.sequences[kind], self.slots[kind]
        hashes = mix(window_hashes(sequence, width) + np.uint64(width + ((kind == AS_IS) << 32)))
        room = np.repeat(self.first[1:], np.diff(self.first))[: len(hashes)]
        starts = np.arange(len(hashes))
        literal = np.concatenate([[0], np.cumsum(slots == 0)])
        enough = (literal[starts + width] - literal[starts] >= LITERALS) | (kind == AS_IS)
        starts = starts[(starts + width <= room) & enough]
        return starts, hashes[starts]

    def beside(self, kind: int, all_starts: np.ndarray, some: np.ndarray, most: int) -> tuple[pa.ListArray, pa.ListArray]:
        """Words before (nearest first) and after the windows all_starts[some], up to the next window of all_starts.

        Each is its hash and slot; there are at most `most` a side.
        """
        starts = all_starts[some]
        text = np.searchsorted(self.first, starts, "right") - 1
        begin, end = self.first[text], self.first[text + 1]
        around = np.concatenate([[-1], all_starts, [len(self.sequences[kind])]])
        left = starts - np.maximum(around[:-2][some], begin - 1) - 1
        right = np.minimum(around[2:][some], end - WINDOW + 1) - starts - 1
        sides = []
        for sizes, origin, step in ((left, starts - 1, -1), (right, starts + WINDOW, 1)):
            sizes = np.clip(sizes, 0, most)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            at = np.repeat(origin, sizes) + step * (np.arange(cuts[-1]) - np.repeat(cuts[:-1], sizes))
            words = [pa.array(x[kind][at].view(np.int64)) for x in (self.sequences, self.slots)]
            sides.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays(words, fields=list(_WORD))))
        return sides[0], sides[1]


_ROWS = pa.schema(
    [
        ("key", pa.int64()), ("hash", pa.int64()), ("at", pa.int32()), ("width", pa.int32()),
        ("n_words", pa.int32()), ("as_is", pa.bool_()), ("slots", pa.list_(pa.int64())),
        ("before", pa.list_(_WORD)), ("after", pa.list_(_WORD)),
    ]
)
_ROWS_SQL = (
    "key long, hash long, at int, width int, n_words int, as_is boolean, slots array<long>, "
    "before array<struct<word: long, slot: long>>, after array<struct<word: long, slot: long>>"
)
#: Item words that travel beside a window: no item is longer.
NO_LIMIT = 1 << 30


def _window_rows(column: str, choose: Callable, most: int) -> Callable:
    """A function over batches: the windows that `choose` (templates) gives, as (width, kind, all starts, which, hashes).

    `which` of the windows become rows; the others only bound the words beside them, `most` of them a side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column("text"), SMALL_SLICE):
                own = Templates(texts)
                ids = batch.column(column).slice(texts.first_row, len(texts.offsets) - 1)
                sizes = np.diff(own.first)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                for width, kind, all_starts, which, hashes in choose(own):
                    starts, hashes = all_starts[which], hashes[which]
                    if not len(starts):
                        continue
                    doc = owner[starts]
                    carried = 0 if kind == AS_IS else width
                    slots = own.slots[kind][starts[:, None] + np.arange(carried)].view(np.int64)
                    cuts = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * carried)
                    reach = most if width == WINDOW and kind != AS_IS else 0
                    before, after = own.beside(kind, all_starts, which, reach)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(doc)),
                            pa.array(hashes.view(np.int64)),
                            pa.array((starts - own.first[doc]).astype(np.int32)),
                            pa.array(np.full(len(starts), width, np.int32)),
                            pa.array(sizes[doc].astype(np.int32)),
                            pa.array(np.full(len(starts), kind == AS_IS)),
                            pa.ListArray.from_arrays(cuts, pa.array(slots.ravel())),
                            before,
                            after,
                        ],
                        schema=_ROWS,
                    )

    return run


def _kinds(width: int) -> range:
    return range(AS_IS if width < SHORTEST else 0, AS_IS + 1)


def _item_windows(own: Templates) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    sizes = np.diff(own.first)
    for width in range(VERBATIM, WINDOW + 1):
        for kind in _kinds(width):
            starts, hashes = own.windows(width, kind)
            which = np.arange(len(starts))
            if width < WINDOW:
                which = np.flatnonzero(np.isin(starts, own.first[:-1][sizes == width]))
            yield width, kind, starts, which, hashes


def item_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    rows = keyed_texts(benchmark, key, text)
    windows = rows.mapInArrow(_window_rows("doc_id", _item_windows, NO_LIMIT), _ROWS_SQL)
    return windows.select(
        F.col("key").alias("item_id"), "hash", F.col("at").alias("item_at"), "width",
        F.col("n_words").alias("item_words"), F.col("slots").alias("item_slots"),
        F.col("before").alias("item_before"), F.col("after").alias("item_after"),
    )


def _agreeing(side: str, first: Column, step: int) -> Column:
    """The words on one side of a match up to the first that differ: item place, item's and document's slot."""
    both = F.arrays_zip(F.col(f"item_{side}").alias("item"), F.col(side).alias("doc"))
    # The shorter side is filled up with nulls, which differ from all words.
    same = F.transform(both, lambda p: p["item"]["word"].eqNullSafe(p["doc"]["word"]))
    differ = F.array_position(same, False).cast("int")
    agreeing = F.when(differ == 0, both).otherwise(F.slice(both, 1, F.greatest(differ - 1, F.lit(0))))
    return F.transform(
        agreeing,
        lambda p, i: F.struct(
            (first + step * i).cast("int").alias("at"), p["item"]["slot"].alias("item"), p["doc"]["slot"].alias("doc")
        ),
    )


def _consistent_words(pairs: Column, beside: Column) -> Column:
    """Spans of the words beside matches that are literal, or slots whose item value has one value in the document."""
    slots = F.transform(F.filter(beside, lambda w: w["item"] != 0), lambda w: F.struct(w["item"].alias("item"), w["doc"].alias("doc")))
    # As the one element of an array it is computed once, not for each word.
    known = F.array(F.array_distinct(F.concat(pairs, slots)))
    agrees = F.transform(
        known,
        lambda all_pairs: F.filter(
            beside,
            lambda w: (w["item"] == 0)
            | F.exists(pairs, lambda p: (p["item"] == w["item"]) & (p["doc"] == w["doc"]))
            | (F.size(F.filter(all_pairs, lambda p: p["item"] == w["item"])) == 1),
        ),
    )[0]
    return F.transform(agrees, lambda w: F.struct(w["at"].alias("at"), F.lit(1).alias("width")))


def covered_words(spans: Column) -> Column:
    """Words in at least one of the spans (at, width), an array sorted by `at`."""
    def add(done: Column, span: Column) -> Column:
        end = span["at"] + span["width"]
        gained = F.greatest(F.lit(0), end - F.greatest(span["at"], done["end"]))
        return F.struct((done["words"] + gained).alias("words"), F.greatest(done["end"], end).alias("end"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")), add, lambda done: done["words"])


def common_windows(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hash and width of the windows that more than COMMON items hold, and their spans by item (item, shared, own: the
    number of other words), of the items that have other words."""
    held = windows.groupBy("hash", "width").agg(F.count_distinct("item_id").alias("items")).filter(F.col("items") > COMMON)
    held = held.select("hash", "width", F.lit(True).alias("common"))
    span = F.struct(F.col("item_at").alias("at"), "width")
    spans = windows.join(held, ["hash", "width"], "left_semi").groupBy("item_id", "item_words").agg(
        F.sort_array(F.collect_set(span)).alias("shared")
    )
    own = (F.col("item_words") - covered_words(F.col("shared"))).alias("own")
    item = F.struct("item_id", "item_words").alias("item")
    return held, spans.select(item, "shared", own).filter("own > 0")


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """doc_id, item_id, item_words, covered (words of the item found, without those under common windows, which count
    only in items that have no others) and consistent (share of slot values)."""
    spark = docs.sparkSession
    windows = settle(item_windows(benchmark, item_key, item_text))
    held, partly = common_windows(windows)
    partly = settle(partly)
    of_item = partly.select("item").withColumn("partly", F.lit(True))
    flagged = windows.join(held, ["hash", "width"], "left").withColumn("of", F.struct("item_id", "item_words"))
    flagged = flagged.join(of_item, F.col("of").eqNullSafe(F.col("item")), "left")
    items = settle(flagged.filter("common is null or partly is null").drop("common", "partly", "of", "item"))
    slots = items.select(F.pmod("hash", F.lit(1 << MAP_BITS)).cast("int").alias("slot"), "width").distinct().toArrow()
    marked = np.zeros(1 << MAP_BITS, bool)
    marked[slots.column("slot").to_numpy()] = True
    widths = sorted(set(slots.column("width").to_pylist()))
    longest = items.agg(F.max("item_words")).first()[0] or 0
    shared = spark.sparkContext.broadcast((np.packbits(marked), widths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = shared.value
        possible = np.unpackbits(bits).astype(bool)

        def choose(own: Templates) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
            for width in lengths:
                for kind in _kinds(width):
                    starts, hashes = own.windows(width, kind)
                    hit = possible[(hashes & np.uint64(len(possible) - 1)).astype(np.int64)]
                    yield width, kind, starts, np.flatnonzero(hit), hashes

        yield from _window_rows("doc_id", choose, longest)(batches)

    found = keyed_texts(docs, key, text).mapInArrow(run, _ROWS_SQL).withColumnRenamed("key", "doc_id")
    pairs = F.filter(
        F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc")), lambda p: p["item"] != 0
    )
    matched = found.join(items, ["hash", "width"]).select(
        "doc_id", "item_id", "item_words", "as_is", "item_at", "width", (F.col("at") - F.col("item_at")).alias("distance"),
        pairs.alias("pairs"),
        F.concat(
            _agreeing("before", F.col("item_at") - 1, -1), _agreeing("after", F.col("item_at") + F.col("width"), 1)
        ).alias("beside"),
    )
    # An item's length bounds what is gathered for one distance.
    lined_up = matched.groupBy("doc_id", "item_id", "item_words", "as_is", "distance").agg(
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
        F.flatten(F.collect_set("beside")).alias("beside"),
        F.collect_set(F.struct(F.col("item_at").alias("at"), "width")).alias("spans"),
    )
    values = F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"])))
    consistent = F.when(F.size("pairs") == 0, F.lit(1.0)).otherwise(values / F.size("pairs"))
    kept = lined_up.withColumn("consistent", consistent).filter(F.col("consistent") >= CONSISTENT)
    kept = kept.withColumn("spans", F.concat("spans", _consistent_words(F.col("pairs"), F.col("beside"))))
    by_item = kept.groupBy("doc_id", "item_id", "item_words").agg(
        F.sort_array(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.max("consistent").alias("consistent"),
    )
    by_item = by_item.withColumn("of", F.struct("item_id", "item_words"))
    judged = by_item.join(partly, F.col("of").eqNullSafe(F.col("item")), "left")
    every = covered_words(F.sort_array(F.concat("spans", "shared"))) - covered_words(F.col("shared"))
    covered = F.when(F.col("shared").isNull(), covered_words(F.col("spans"))).otherwise(every)
    wanted = F.least(F.coalesce("own", "item_words"), F.lit(COVERED))
    return judged.withColumn("covered", covered).filter(F.col("covered") >= wanted).select(
        "doc_id", "item_id", "item_words", "covered", "consistent"
    )
