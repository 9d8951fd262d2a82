"""Point reads, scans, pages and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from keystrata.model import KeyNotFound, guard, is_reserved
from keystrata.operators.merge import latest


def get_row(log: DataFrame, key: str) -> DataFrame:
    """At most one live row; the filter on ``key`` reaches the scan."""
    if is_reserved(key):
        return latest(log).where(F.lit(False))
    return latest(log.where(F.col("key") == key)).where(~F.col("tombstone"))


def get(log: DataFrame, key: str) -> bytes:
    rows = get_row(log, key).collect()
    if not rows:
        raise KeyNotFound("key not found")
    return rows[0]["value"]


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Live rows of the keys in ``keys (key)``; versions of other keys are dropped before they are reduced."""
    return latest(log.join(keys.select("key").distinct(), "key", "left_semi")).where(~F.col("tombstone"))


def _scan(log: DataFrame, condition: Column, include_tombstones: bool) -> DataFrame:
    rows = latest(log.where(condition))
    return rows if include_tombstones else rows.where(~F.col("tombstone"))


def prefix_rows(log: DataFrame, prefix: str, include_tombstones: bool = True) -> DataFrame:
    return _scan(log, F.col("key").startswith(prefix), include_tombstones)


def range_rows(log: DataFrame, low: str, high: str, include_tombstones: bool = True) -> DataFrame:
    if low > high:
        raise ValueError("invalid range given")
    return _scan(log, F.col("key").between(low, high), include_tombstones)


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """The ``number``-th page, from 1, in key order; page 0, size 0 and pages past the end are empty."""
    if number < 1 or size < 1:
        return rows.limit(0)
    return rows.orderBy("key").offset((number - 1) * size).limit(size)


def prefix_scan(log: DataFrame, prefix: str, number: int, size: int, include_tombstones: bool = True) -> DataFrame:
    guard(prefix)
    return page(prefix_rows(log, prefix, include_tombstones), number, size)


def range_scan(log: DataFrame, low: str, high: str, number: int, size: int, include_tombstones: bool = True) -> DataFrame:
    guard(low, high)
    return page(range_rows(log, low, high, include_tombstones), number, size)


def after(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Keyset page: the ``size`` rows after ``key``; its cost doesn't grow with the page number."""
    return rows.where(F.col("key") > key).orderBy("key").limit(size)


class Cursor:
    """Next, previous and stop over sorted rows, fetched a keyset page at a time.

    Opening takes the first row into ``current`` (None if there is none). ``next`` past
    the end raises StopIteration and stays one step beyond, so ``previous`` then gives the last row again.
    """

    def __init__(self, rows: DataFrame, fetch: int = 100) -> None:
        self._rows, self._fetch = rows, fetch
        self._seen: list[Row] = []
        self._at, self._ended, self._open = 0, False, True
        self._more()
        self.current = self._seen[0] if self._seen else None

    def _more(self) -> None:
        if self._ended:
            return
        got = (after(self._rows, self._seen[-1]["key"], self._fetch) if self._seen else self._rows.orderBy("key").limit(self._fetch)).collect()
        self._ended = len(got) < self._fetch
        self._seen += got

    def _check(self) -> None:
        if not self._open:
            raise RuntimeError("cursor is stopped")

    def next(self) -> Row:
        self._check()
        self._at = min(self._at + 1, len(self._seen))
        if self._at == len(self._seen):
            self._more()
        if self._at >= len(self._seen):
            raise StopIteration("no records left")
        self.current = self._seen[self._at]
        return self.current

    def previous(self) -> Row:
        self._check()
        if self._at == 0:
            raise StopIteration("no records left")
        self._at -= 1
        self.current = self._seen[self._at]
        return self.current

    def stop(self) -> None:
        self._open, self._seen = False, []


def prefix_iterate(log: DataFrame, prefix: str, fetch: int = 100) -> Cursor:
    return Cursor(prefix_rows(log, prefix), fetch)


def range_iterate(log: DataFrame, low: str, high: str, fetch: int = 100) -> Cursor:
    return Cursor(range_rows(log, low, high), fetch)
