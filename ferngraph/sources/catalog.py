"""Fact sets kept by (folder, patterns): least recently used go first, and
requests for a set that is being loaded wait for it."""

from __future__ import annotations

import hashlib
import os
import threading
from collections import OrderedDict
from collections.abc import Callable

from ferngraph.sources.gotypes import FactSet

CAPACITY = 2


def key_of(root: str, patterns: list[str]) -> str:
    """The same for patterns in any order."""
    return hashlib.sha256("\0".join([os.path.abspath(root), *sorted(patterns)]).encode()).digest()[:8].hex()


class FactCatalog:
    def __init__(self, load: Callable[[str, list[str]], FactSet], capacity: int = CAPACITY):
        self._load, self.capacity = load, capacity
        self._sets: OrderedDict[str, tuple[str, list[str], FactSet]] = OrderedDict()
        self._lock, self._loading = threading.Lock(), {}
        self.hits = self.misses = 0

    def get(self, root: str, patterns: list[str]) -> FactSet:
        key = key_of(root, patterns)
        with self._lock:
            if key in self._sets:
                self._sets.move_to_end(key)
                self.hits += 1
                return self._sets[key][2]
            gate = self._loading.setdefault(key, threading.Lock())
        with gate:
            with self._lock:
                if key in self._sets:
                    self.hits += 1
                    return self._sets[key][2]
                self.misses += 1
            facts = self._load(root, patterns)
            with self._lock:
                self._sets[key] = (os.path.abspath(root), list(patterns), facts)
                self._loading.pop(key, None)
                self._trim()
            return facts

    def _trim(self) -> None:
        while len(self._sets) > max(1, self.capacity):
            self._drop(next(iter(self._sets)))

    def _drop(self, key: str) -> None:
        self._sets.pop(key)

    def held(self, root: str, patterns: list[str]) -> FactSet | None:
        """The set, if it is kept; no request for the counts."""
        with self._lock:
            return self._sets.get(key_of(root, patterns), (None, None, None))[2]

    def set_capacity(self, n: int) -> None:
        with self._lock:
            self.capacity = n if n > 0 else CAPACITY
            self._trim()

    def clear(self, root: str | None = None, patterns: list[str] | None = None) -> int:
        """Drop all sets, those of a folder, or the one of a folder and patterns."""
        with self._lock:
            gone = [k for k, (r, p, _) in self._sets.items() if root is None or (r == os.path.abspath(root) and (patterns is None or sorted(p) == sorted(patterns)))]
            for k in gone:
                self._drop(k)
            return len(gone)

    def status(self) -> dict:
        with self._lock:
            records = [{"key": k, "root_path": r, "package_patterns": p} for k, (r, p, _) in reversed(self._sets.items())]
        return {"capacity": self.capacity, "entries": len(records), "hits": self.hits, "misses": self.misses, "records": records}
