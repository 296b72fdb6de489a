"""A cache of table columns on top of ``persist``: complete or absent, bounded, invalidated by writes."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from .cost import CACHE_SHARE


@dataclass
class Entry:
    columns: tuple[str, ...]
    frame: DataFrame
    rows: int
    size: int
    hits: int = 0


class ColumnCache:
    """Column sets by table identity.

    An entry is filled by an action that reads the whole column set, and is registered
    only if the rows counted then are the rows of the table.  A request for some of an
    entry's columns is served from it; a request for more is a miss.  The least recently
    used entries leave when the budget is exceeded, and a set beyond ``CACHE_SHARE`` of the
    budget is never cached.
    """

    def __init__(self, budget: int = 1 << 30, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.budget, self.level = budget, level
        self.entries: OrderedDict[tuple[Any, tuple[str, ...]], Entry] = OrderedDict()
        self.hits = self.misses = 0

    @property
    def size(self) -> int:
        return sum(e.size for e in self.entries.values())

    def get(self, table: Any, columns: Iterable[str]) -> DataFrame | None:
        """The columns from a cached superset, or None."""
        wanted = list(dict.fromkeys(columns))
        fits = [(len(k[1]), k) for k in self.entries if k[0] == table and set(wanted) <= set(k[1])]
        if not fits:
            self.misses += 1
            return None
        key = min(fits)[1]
        self.entries.move_to_end(key)
        entry = self.entries[key]
        entry.hits += 1
        self.hits += 1
        return entry.frame.select(*wanted)

    def put(self, table: Any, frame: DataFrame, columns: Iterable[str], width: Callable[[DataFrame], int] | None = None) -> bool:
        """Cache columns of a complete table scan.  False if they do not fit or the read was not whole."""
        names = tuple(sorted(set(columns)))
        if not names:
            return False
        chosen = frame.select(*names)
        rows = frame.count()
        row = width(chosen) if width else sum(max(1, f.dataType.__class__.__name__ in {"ByteType", "BooleanType"} or _WIDTH.get(f.dataType.typeName(), 16)) for f in chosen.schema.fields)
        size = rows * row
        if size > self.budget * CACHE_SHARE:
            return False
        chosen = chosen.persist(self.level)
        try:
            if chosen.count() != rows:
                chosen.unpersist()
                return False
        except BaseException:
            chosen.unpersist()
            raise
        for key in [k for k in self.entries if k[0] == table and set(k[1]) <= set(names)]:
            self._drop(key)
        self.entries[table, names] = Entry(names, chosen, rows, size)
        while self.size > self.budget:
            self._drop(next(iter(self.entries)))
        return (table, names) in self.entries

    def hold(self, table: Any, frame: DataFrame, size: int) -> bool:
        """Keep a whole table as it stands in plans, so that any query on it reads the copy; False if it is too large."""
        if size > self.budget * CACHE_SHARE:
            return False
        names = tuple(sorted(frame.columns))
        self.invalidate(table)
        self.entries[table, names] = Entry(names, frame.persist(self.level), -1, size)
        while self.size > self.budget:
            self._drop(next(iter(self.entries)))
        return (table, names) in self.entries

    def touch(self, table: Any) -> bool:
        """Count a read of a whole table that is held."""
        for key, entry in self.entries.items():
            if key[0] == table and entry.rows < 0:
                entry.hits += 1
                self.hits += 1
                self.entries.move_to_end(key)
                return True
        self.misses += 1
        return False

    def serve(self, table: Any, frame: Callable[[], DataFrame], columns: Iterable[str], populate: bool = True) -> DataFrame:
        """Columns from the cache, or from ``frame()``, which then fills the cache if ``populate``."""
        columns = list(columns)
        found = self.get(table, columns)
        if found is not None:
            return found
        fresh = frame()
        if populate and self.put(table, fresh, columns):
            return self.entries[table, tuple(sorted(set(columns)))].frame.select(*columns)
        return fresh.select(*columns)

    def invalidate(self, table: Any | None = None) -> int:
        """Forget one table, or everything; the number of entries dropped."""
        keys = [k for k in self.entries if table is None or k[0] == table]
        for k in keys:
            self._drop(k)
        return len(keys)

    def _drop(self, key: tuple[Any, tuple[str, ...]]) -> None:
        self.entries.pop(key).frame.unpersist()


_WIDTH = {"short": 2, "integer": 4, "long": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}
