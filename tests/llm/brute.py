"""Plain versions of the operators' results, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def low_words(text):
    return words((text or "").translate(ASCII_LOWER))


def crc(key):
    return zlib.crc32(str(key).encode())


def shingles(text):
    w = low_words(text)
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)] if w else [])


def groups(texts):
    """For each place of a list of texts, the places it is linked with, itself included."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            owners[g].append(i)
    common = Counter((a, b) for own in owners.values() for a in own for b in own if a < b)
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(b)] = find(a)
    members = defaultdict(list)
    for i in range(len(texts)):
        members[find(i)].append(i)
    return [members[find(i)] for i in range(len(texts))]


def rule_counts(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in t)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def without_repeats(rows):
    """rows: (doc_id, text) in the order that counts. n_bytes, n_removed, n_spans, digest of the rest for each."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            string = data[p : p + 100]
            if string in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(string)
        spans = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def unigram_scores(rows):
    """rows: (doc_id, text). held_out, n_tokens, n_known, train_tokens, base_score for each."""
    held = [key is not None and crc(key) % 5 == 1 for key, _ in rows]
    tokens = [[*low_words(t), None] for _, t in rows]
    count = Counter(w for out, ts in zip(held, tokens, strict=True) if not out for w in ts)
    total, kinds = sum(count.values()), len(count)
    return [
        (
            out, len(ts), sum(w in count for w in ts), total,
            sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ts),
        )
        for out, ts in zip(held, tokens, strict=True)
    ]


ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def base_spans(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found)


PART = re.compile("[A-Z]?[a-z]{4,11}(?![a-z])|(?<![A-Z])[A-Z]{4,12}(?![A-Za-z])")


def identifier_parts(rows):
    counts = Counter()
    for _, text in rows:
        strings = re.findall(r"[A-Za-z0-9+/_=-]{16,}", text or "")
        counts.update({part for string in strings for part in PART.findall(string)})
    return counts


def learned_dictionary(rows):
    frequent = sorted((-n, part) for part, n in identifier_parts(rows).items() if n >= 3)
    parts, size = [], 0
    for _, part in frequent:
        size += len(part) + 1
        if size > 8192:
            break
        parts.append(part)
    return "_".join(reversed(parts))
