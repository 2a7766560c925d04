"""Results kept by key: at most so many, for so long."""

from __future__ import annotations

import re
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame


class ResultCache:
    """Persisted DataFrames, least recently used out first."""

    def __init__(self, size: int = 100, ttl: float = 86_400, clock: Callable[[], float] = time.monotonic):
        self._size, self._ttl, self._clock = size, ttl, clock
        self._held: OrderedDict[str, tuple[float, DataFrame]] = OrderedDict()

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        if key in self._held and self._clock() - self._held[key][0] < self._ttl:
            self._held.move_to_end(key)
            return self._held[key][1]
        self.drop(key)
        self._held[key] = (self._clock(), make().persist())
        while len(self._held) > self._size:
            self.drop(next(iter(self._held)))
        return self._held[key][1]

    def drop(self, key: str) -> None:
        if key in self._held:
            self._held.pop(key)[1].unpersist()

    def clear(self, pattern: str = "") -> None:
        for key in [k for k in self._held if re.search(pattern, k)]:
            self.drop(key)

    def warm(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        for key, make in makers.items():
            self.get(key, make)

    def __len__(self) -> int:
        return len(self._held)
