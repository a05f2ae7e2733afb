"""Token counts of texts under a sentencepiece BPE model, without token ids.

The model's merges never cross the start of a run of spaces: no piece holds a space after another character
(`check_model` raises otherwise). A text is therefore the sequence of its pre-tokens, each a run of spaces and
what follows it, and its token count is the sum over its distinct pre-tokens of frequency times pieces.

1. Hot pre-tokens: the HOT of up to LONGEST_HOT bytes that are in most texts of a random sample of about SAMPLE texts
   are counted once and broadcast. Which they are changes no result: they keep the hash ranges even.
2. A slice of texts is taken apart. Its hot pre-tokens are summed up by text; the others, each once a slice, and their
   frequencies by text go to hash ranges, about RANGE_BYTES of text to a range.
3. A range counts the pieces of each distinct pre-token once, joins the counts to the frequencies and sends one sum a
   text and slice on.
4. Each slice adds up the sums of its texts. A slice whose sums are not all there, as of an input whose rows change with
   each reading, raises an error.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each; a very long text is a slice of its own;
an empty table gives an empty result. Other columns are ignored. Pre-tokens of a slice are told apart by 64-bit hashes,
those of a range by their bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lares.llm.tables import Texts, keyed_texts, text_slices
from lares.llm.words import find_words, mix, prefix_hashes, span_hashes

SAMPLE = 4096
HOT = 1 << 15
LONGEST_HOT = 64
READ_BYTES = 4 << 20
RANGE_BYTES = 32 << 20
_SPACE = "▁"
_IS_SPACE = np.arange(256) == 0x20


def check_model(model) -> None:
    """Raises ValueError if merges of this model could cross the start of a run of spaces."""
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if _SPACE in piece.lstrip(_SPACE):
            raise ValueError(f"piece {i} holds a space after another character: {piece!r}")
    if model.encode("a  b ", out_type=str) == model.encode("a b", out_type=str):
        raise ValueError("the model drops spaces, so pre-tokens can't be told apart")
    if model.encode("", out_type=int) or not model.encode(" ", out_type=str)[0].startswith(_SPACE):
        raise ValueError("the model adds no space before a text")


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    check_model(model)
    return model


def _packed(values: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest needs, compressed."""
    values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return bytes([values.dtype.itemsize]) + zstandard.compress(values.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), f"u{data[0]}").astype(np.int64)


class Pretokens(NamedTuple):
    """Pre-token i belongs to text owner[i]: spaces[i] spaces, the first of them before a text's beginning, and a word."""

    owner: np.ndarray
    spaces: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def find_pretokens(texts: Texts) -> Pretokens:
    words = find_words(texts, _IS_SPACE)
    begins, stops = texts.offsets[:-1], texts.offsets[1:]
    owner = np.repeat(np.arange(len(begins)), np.diff(words.first))
    before = np.append(0, words.ends)[:-1] if len(words.starts) else words.ends
    first = words.first[:-1][np.diff(words.first) > 0]
    before[first] = begins[owner[first]] - 1
    # Spaces at the end of a text are a pre-token without a word; an empty text has none.
    last = np.where(np.diff(words.first) > 0, np.append(words.ends, 0)[words.first[1:] - 1], begins - 1)
    rest = np.flatnonzero((stops > last) & (stops > begins))
    return Pretokens(
        np.append(owner, rest), np.append(words.starts - before, (stops - last)[rest]),
        np.append(words.starts, stops[rest]), np.append(words.ends, stops[rest]),
    )


def names_of(texts: Texts, tokens: Pretokens, some: np.ndarray) -> list[bytes]:
    """Names of some pre-tokens: their bytes without the first space, which the model sets itself."""
    data = texts.data.tobytes()
    spans = zip(tokens.spaces[some].tolist(), tokens.starts[some].tolist(), tokens.ends[some].tolist(), strict=True)
    return [data[a:b] if n == 1 else b" " * (n - 1) + data[a:b] for n, a, b in spans]


class Slice(NamedTuple):
    """A slice of texts by pre-token: token i, called names[i], occurs times[j] times in text owners[j] for the j of
    cuts[i] to cuts[i + 1]."""

    hashes: np.ndarray
    names: list[bytes]
    cuts: np.ndarray
    owners: np.ndarray
    times: np.ndarray


def read_slice(texts: Texts) -> Slice:
    tokens = find_pretokens(texts)
    hashes = span_hashes(prefix_hashes(texts.data), tokens.starts, tokens.ends)
    hashes = mix(hashes + tokens.spaces.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    own, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    n = len(texts.offsets)
    pairs, times = np.unique(place * n + tokens.owner, return_counts=True)
    return Slice(own, names_of(texts, tokens, first), np.searchsorted(pairs // n, np.arange(len(own) + 1)), pairs % n, times)


def pieces_of(encode: Callable[[list[str]], list[list[int]]], names: list[bytes]) -> np.ndarray:
    """How many pieces each name has. An empty one is a single space."""
    return np.array([len(p) if name else 1 for name, p in zip(names, encode([n.decode() for n in names]), strict=True)], np.int64)


_SENT = pa.schema(
    [
        ("part", pa.int64()), ("slice", pa.string()), ("parts", pa.int64()), ("names", pa.binary()), ("sizes", pa.binary()),
        ("documents", pa.binary()), ("owners", pa.binary()), ("times", pa.binary()), ("sums", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.binary()),
    ]
)
_SENT_SQL = (
    "part long, slice string, parts long, names binary, sizes binary, documents binary, owners binary, times binary, "
    "sums binary, doc_ids array<long>, n_bytes binary"
)
_EMPTY = dict.fromkeys(_SENT.names)
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def slice_rows(name: str, own: Slice, parts: int, hot: dict[bytes, int], doc_ids: pa.Array, n_bytes: np.ndarray) -> list[dict]:
    """A row a hash range with the slice's distinct pre-tokens and their frequencies by text, and one with the texts' ids,
    bytes and the sums of the hot pre-tokens."""
    counts = np.array([hot.get(n, -1) for n in own.names], np.int64)
    token = np.repeat(np.arange(len(own.names)), np.diff(own.cuts))
    known = counts[token] >= 0
    sums = np.bincount(own.owners[known], counts[token[known]] * own.times[known], minlength=len(n_bytes)).astype(np.int64)
    rest = np.flatnonzero(counts < 0)
    part = (own.hashes[rest] >> np.uint64(32)).astype(np.int64) * parts >> 32
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(cuts, np.append(cuts, len(rest))[1:], strict=True):
        some = rest[a:b]
        names = [own.names[i] for i in some.tolist()]
        sizes = own.cuts[some + 1] - own.cuts[some]
        pairs = np.repeat(own.cuts[some] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        rows.append(
            _EMPTY
            | {"part": int(part[a]), "slice": name, "names": zstandard.compress(b"".join(names), 3)}
            | {"sizes": _packed(np.array([len(n) for n in names])), "documents": _packed(sizes)}
            | {"owners": _packed(own.owners[pairs]), "times": _packed(own.times[pairs])}
        )
    whole = {"part": zlib.crc32(name.encode()) % parts, "slice": name, "parts": len(rows), "sums": _packed(sums)}
    return [*rows, _EMPTY | whole | {"doc_ids": doc_ids.to_pylist(), "n_bytes": _packed(n_bytes)}]


def count_range(rows: list[dict], encode: Callable[[list[str]], list[list[int]]]) -> list[dict]:
    """The sums that a hash range adds to each slice's texts; each distinct pre-token of the range is counted once."""
    place: dict[bytes, int] = {}
    found = []
    for r in rows:
        names, ends = zstandard.decompress(r["names"]), np.cumsum(_unpacked(r["sizes"])).tolist()
        found.append([place.setdefault(names[a:b], len(place)) for a, b in zip([0, *ends], ends, strict=False)])
    pieces = pieces_of(encode, list(place))
    out = []
    for r, own in zip(rows, found, strict=True):
        counts = np.repeat(pieces[np.array(own, np.int64)], _unpacked(r["documents"]))
        sums = np.bincount(_unpacked(r["owners"]), counts * _unpacked(r["times"])).astype(np.int64)
        out.append(_EMPTY | {"slice": r["slice"], "sums": _packed(sums)})
    return out


def add_up(name: str, rows: list[dict]) -> pa.Table:
    """The counts of one slice's texts."""
    (whole,) = [r for r in rows if r["doc_ids"] is not None]
    if len(rows) != whole["parts"] + 1:
        raise RuntimeError(f"slice {name}: {len(rows) - 1} of {whole['parts']} sums; the input's rows change with each reading")
    total = np.zeros(len(whole["doc_ids"]), np.int64)
    for r in rows:
        sums = _unpacked(r["sums"])
        total[: len(sums)] += sums
    return pa.table([pa.array(whole["doc_ids"], pa.int64()), pa.array(_unpacked(whole["n_bytes"])), pa.array(total)], schema=_COUNTS)


def hot_pretokens(source: DataFrame, rows: int, model_path: str) -> dict[bytes, int]:
    """The pieces of the HOT pre-tokens that are in most texts of a sample of about SAMPLE texts."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(_plain(batch.column("text"))):
                own = read_slice(texts)
                short = [(n, k) for n, k in zip(own.names, np.diff(own.cuts).tolist(), strict=True) if len(n) <= LONGEST_HOT]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in short], pa.binary()), pa.array([k for _, k in short], pa.int64())], ["name", "n"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(pieces_of(_encode(model_path), batch.column("name").to_pylist()))], ["name", "pieces"])

    counted = source.select("text").sample(min(1.0, SAMPLE / max(1, rows)), seed=1).mapInArrow(names, "name binary, n long").groupBy("name").agg(F.sum("n").alias("n"))
    most = counted.orderBy(F.desc("n"), "name").limit(HOT).select("name")
    return {bytes(r["name"]): r["pieces"] for r in most.mapInArrow(pieces, "name binary, pieces long").collect()}


def _plain(column: pa.Array) -> pa.Array:
    """The model reads its own mark of a space as a space."""
    return pc.replace_substring(column, _SPACE, " ")


def _encode(path: str) -> Callable[[list[str]], list[list[int]]]:
    model = _model(path)
    return lambda names: model.encode(names, out_type=int, num_threads=1)


def token_counts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the UTF-8 length of its text and n_tokens of each row."""
    source = keyed_texts(docs, key, text)
    rows, n_bytes = source.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = 1 + n_bytes // RANGE_BYTES
    shared = docs.sparkSession.sparkContext.broadcast(hot_pretokens(source, rows, model_path))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, number = shared.value, 0
        for batch in batches:
            column = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            for texts in text_slices(_plain(column), READ_BYTES):
                some = slice(texts.first_row, texts.first_row + len(texts.offsets) - 1)
                own = read_slice(texts)
                # Other rows under the same number, as of an input that changes, would have another name.
                name = f"{TaskContext.get().partitionId()}-{number}-{np.bitwise_xor.reduce(own.hashes, initial=0):x}-{len(own.owners)}"
                ids = batch.column("doc_id").slice(texts.first_row, some.stop - some.start)
                yield pa.RecordBatch.from_pylist(slice_rows(name, own, parts, hot, ids, sizes[some].astype(np.int64)), _SENT)
                number += 1

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        whole = [r for r in rows if r["doc_ids"] is not None]
        return pa.Table.from_pylist(whole + count_range([r for r in rows if r["doc_ids"] is None], _encode(model_path)), _SENT)

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return add_up(key[0].as_py(), table.to_pylist())

    sums = source.mapInArrow(read, _SENT_SQL).groupBy("part").applyInArrow(count, _SENT_SQL)
    return sums.groupBy("slice").applyInArrow(add, "doc_id long, n_bytes long, n_tokens long")


def with_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
