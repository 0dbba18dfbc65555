"""Results that stay for a while: a table is made on first use, written into the shared folder, and made anew when it is older
than its time to live."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from lodestone.session import materialize, release


class TimedCache:
    def __init__(self, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.seconds, self.clock = seconds, clock
        self._kept: dict[object, tuple[float, DataFrame]] = {}

    def get(self, key: object, make: Callable[[], DataFrame]) -> DataFrame:
        """The kept table of ``key``, or a new one if there is none younger than the time to live."""
        now = self.clock()
        if key in self._kept and now - self._kept[key][0] < self.seconds:
            return self._kept[key][1]
        self.drop(key)
        df = materialize(make(), "cached")
        self._kept[key] = (now, df)
        return df

    def drop(self, key: object) -> None:
        if key in self._kept:
            release(self._kept.pop(key)[1])

    def clear(self) -> None:
        for key in list(self._kept):
            self.drop(key)
