"""Secrets in texts: three patterns, and strings in a sensitive context that their surroundings don't explain.

The patterns are assignments to a secret-like name, access key ids and long hexadecimal runs, each found
leftmost without overlap over the whole text.

Novelty: before and after a sensitive word (`SENSITIVE`), across line breaks and within `REACH` characters, each run of
key characters with at least `SHORTEST` of them, a letter and a digit (or capitals as often after small letters as in
random strings, `HUMPS`) is a candidate. The parts of a sensitive word
may stand apart by a space, hyphen or underscore. The body of a PEM block of a private key is one candidate, until its
END line or the end of the text. A zstandard compressor is primed with the identifier dictionaries and the text around
the candidate, without the candidate; the bytes that the candidate adds to an empty frame are its marginal bytes. Text
that the dictionaries or the surroundings explain (a path, a known identifier, a repeated name) adds few; a random
string adds nearly all of its own.
Candidates of at least `MIN_MARGINAL` marginal bytes a character, `SHORT_MARGINAL` if they have fewer than `SHORT`
characters, are reported, unless a pattern has them already: a short random string is stored as it is, at one byte a
character; in a long one of few different characters each needs fewer bits than eight.

Dictionaries: one is fixed (`IDENTIFIERS`), the other learned. All texts count the parts of their long strings (runs of
letters of one case, with a capital before small ones); the parts that most texts have, and `LEAST_TEXTS` at least, fill
`DICTIONARY_BYTES`, which is what the driver gets and broadcasts. A part has at most 12 letters, so that copies of a
text can't teach its secret.

Spans are in code points, end exclusive. Null and empty texts have none. Repeated rows are scanned each; other
columns are ignored. An empty table gives no rows. Only parts and their counts are shuffled; texts, however long, are
scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lares.llm.tables import SMALL_SLICE, keyed_texts, str_slices

#: Kinds in the order in which spans of one start are listed; the last is the method's own.
KINDS = ("assign", "access", "hex", "novel")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ASSIGN_NEEDLES = ("passw", "secret", "token", "api")
_ASSIGN_SHORTEST = 12
_ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
_HEX = re.compile("[0-9a-f]{16,}")

#: Words that make what stands around them sensitive, lower case; their parts are joined by JOINT.
SENSITIVE = (
    "password", "passwd", "pass phrase", "secret", "token", "api key", "access key", "private key", "account key",
    "credential", "bearer", "authorization", "client id", "signature",
)
JOINT = "[ _-]?"
#: Identifiers, as found around keys in code and settings, that are no secrets themselves.
IDENTIFIERS = (
    "access_key_id secret_access_key client_secret client_id api_key api_version auth_token refresh_token "
    "session_token bearer authorization credentials password passphrase username user_name private_key "
    "public_key certificate signature algorithm sha256 sha512 hmac md5 base64 utf-8 iso-8859-1 aes-256-gcm "
    "http://localhost:8080/api/v1/ https://www.example.com/v2/oauth2/token index.html application/json "
    "text/plain; charset=utf-8 content-type environment variable config.yaml settings.json example "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 xxxxxxxx XXXXXXXX "
    "2020-01-01T00:00:00Z 127.0.0.1 192.168.0.1 test_token_123 your_api_key_here placeholder changeme"
)
#: What stands for a masked secret.
MARK = "[SECRET]"
REACH = 256
SURROUNDINGS = 256
SHORTEST = 16
MIN_MARGINAL = 0.6
SHORT_MARGINAL = 0.85
SHORT = 64
#: Small letters followed by a capital, a character: a quarter in random letters of both cases, fewer in names.
HUMPS = 1 / 6
DICTIONARY_BYTES = 8192
LEAST_TEXTS = 3
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
_SENSITIVE = re.compile("|".join(word.replace(" ", JOINT) for word in SENSITIVE))
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----\s*")
_HUMP = re.compile("[a-z][A-Z]")
_PART = re.compile("[A-Z]?[a-z]{4,11}(?![a-z])|(?<![A-Z])[A-Z]{4,12}(?![A-Za-z])")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base_spans(text: str, lowered: str) -> list[Span]:
    spans: list[Span] = []
    if any(needle in lowered for needle in _ASSIGN_NEEDLES):
        spans += [
            (m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= _ASSIGN_SHORTEST
        ]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def identifier_parts(docs: DataFrame) -> DataFrame:
    """part and texts: in how many texts a long string has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in str_slices(batch.column("text")):
                counts: Counter[str] = Counter()
                for t in texts:
                    counts.update({part for m in _CANDIDATE.finditer(t) for part in _PART.findall(m.group())})
                columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "texts"])

    counted = docs.select("text").mapInArrow(run, "part string, texts long")
    return counted.groupBy("part").agg(F.sum("texts").alias("texts"))


def learned_dictionary(docs: DataFrame) -> str:
    """The most frequent parts, the most frequent ones last. docs: text."""
    frequent = identifier_parts(docs).filter(F.col("texts") >= LEAST_TEXTS).orderBy(F.desc("texts"), "part")
    parts = [r.part for r in frequent.limit(DICTIONARY_BYTES // 5).collect()]
    sizes = accumulate(len(part) + 1 for part in parts)
    return "_".join(reversed([part for part, size in zip(parts, sizes, strict=True) if size <= DICTIONARY_BYTES]))


def marginal_bytes(candidate: str, before: str, after: str, learned: str = "") -> int:
    """Compressed bytes that the candidate adds, given the identifiers and its surroundings."""
    primer = f"{learned}\n{IDENTIFIERS}\n{after}\n{before}".encode()
    known = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(
        level=19, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return len(compressor.compress(candidate.encode())) - len(compressor.compress(b""))


def _is_novel(text: str, start: int, end: int, learned: str) -> bool:
    least = SHORT_MARGINAL if end - start < SHORT else MIN_MARGINAL
    before, after = text[max(0, start - SURROUNDINGS) : start], text[end : end + SURROUNDINGS]
    return marginal_bytes(text[start:end], before, after, learned) >= least * (end - start)


def _looks_random(string: str) -> bool:
    humps = sum(1 for _ in _HUMP.finditer(string))
    return bool(_LETTER.search(string)) and bool(_DIGIT.search(string) or humps >= HUMPS * len(string))


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """The bodies of PEM blocks of private keys."""
    at = 0
    while begin := _PEM.search(text, at):
        start, at = begin.end(), text.find("-----END ", begin.end())
        at = at if at >= 0 else len(text)
        if body := text[start:at].rstrip():
            yield start, start + len(body)


def novel_spans(text: str, lowered: str, taken: list[Span], learned: str = "") -> list[Span]:
    if len(lowered) != len(text):  # a letter whose lower case is longer: places would differ
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans = [(start, 3, end) for start, end in key_blocks(text) if _is_novel(text, start, end, learned)]
    taken = sorted(taken + spans)
    reach = list(accumulate((end for _, _, end in taken), max))
    begins = [start for start, _, _ in taken]
    contexts = [m.span() for m in _SENSITIVE.finditer(lowered)]
    edges = [(0, 0), *contexts, (len(text), len(text))]
    for i, ((_, start), (stop, _)) in enumerate(zip(edges, edges[1:], strict=False)):
        first, last = i == 0, i == len(contexts)
        for m in _CANDIDATE.finditer(text, start, stop):
            near = (not first and m.start() < start + REACH) or (not last and m.end() > stop - REACH)
            if not near or not _looks_random(m.group()):
                continue
            earlier = bisect_left(begins, m.end())
            if earlier and reach[earlier - 1] > m.start():
                continue
            if _is_novel(text, *m.span(), learned):
                spans.append((m.start(), 3, m.end()))
    return spans


def find_spans(text: str, learned: str = "") -> list[Span]:
    """All spans of a text, by start, then kind as listed."""
    lowered = text.lower()
    spans = base_spans(text, lowered)
    if _SENSITIVE.search(lowered):
        spans = sorted(spans + novel_spans(text, lowered, spans, learned))
    return spans


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end) of each row."""
    source = keyed_texts(docs, key, text)
    learned = learned_dictionary(source)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in str_slices(batch.column("text"), SMALL_SLICE):
                found = [
                    [{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in find_spans(t, learned)]
                    for t in texts
                ]
                ids = batch.column("doc_id").slice(row, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    return source.mapInArrow(run, schema)


def masked(text: str, learned: str = "") -> str:
    """The text with a mark in place of each stretch of reported spans."""
    out, done = [], 0
    for start, _, end in find_spans(text, learned):
        if end > done:
            if start >= done:
                out += [text[done:start], MARK]
            done = end
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The same rows and columns with masked texts, and their length in code points if there is such a column."""
    learned = learned_dictionary(docs.select(docs[text].cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for row, texts in str_slices(batch.column(at), SMALL_SLICE):
                part = batch.slice(row, len(texts))
                empty = part.column(at).is_null().to_numpy(zero_copy_only=False)
                clean = pa.array([masked(t, learned) for t in texts], pa.string(), mask=empty)
                columns = [clean if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    clean = docs.mapInArrow(run, docs.schema)
    if length not in docs.columns:
        return clean
    counted = F.length(text).cast(docs.schema[length].dataType)
    return clean.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(counted))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def span_digests(scanned: DataFrame) -> DataFrame:
    """Counts of the pattern kinds, the digest of their spans, and all spans as text."""
    spans = F.col("spans")

    def number(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return scanned.select(
        "doc_id",
        *[number(kind) for kind in KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(spans).alias("spans"),
    )
