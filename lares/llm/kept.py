"""A bounded table of results that a task keeps for keys it meets again."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: What an entry takes beside its key's and its result's own bytes, about.
ENTRY = 200


class Kept:
    """Results (bytes) by key, of about `limit` bytes. Of those not used lately, some are forgotten; that costs time and
    changes no result."""

    def __init__(self, limit: int):
        self.half, self.size, self.recent, self.older = max(1, limit // 2), 0, {}, {}

    def table(self, keys: Iterable[str], learn: Callable[[list[str]], Iterable[bytes]]) -> dict[str, bytes]:
        """A table with at least these keys; `learn` gives the results of new ones."""
        keys = set(keys)
        missing = keys.difference(self.recent)
        if self.size + ENTRY * len(missing) > self.half:
            self.older, self.recent, self.size = self.recent, {}, 0
            missing = keys
        again = missing.intersection(self.older) if self.older else ()
        new = list(missing.difference(again))
        self._add({k: self.older[k] for k in again})
        self._add(dict(zip(new, learn(new), strict=True)))
        return self.recent

    def clear(self) -> None:
        self.size, self.recent, self.older = 0, {}, {}

    def _add(self, entries: dict[str, bytes]) -> None:
        self.recent.update(entries)
        self.size += ENTRY * len(entries) + sum(map(len, entries)) + sum(map(len, entries.values()))
