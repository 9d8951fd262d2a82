"""Token buckets over logged operations.

A bucket is refilled, fully, by the first operation more than ``period`` seconds after
the last refill, so its state is a fold in time order; windows can't express it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.sources.scratch import ship

#: Tokens that an operation costs.
COST = {"put": 1, "get": 1, "delete": 1, "sketch_write": 1, "scan": 0, "iterate": 0, "sketch_read": 0, "sketch_delete": 0}


def varint(n: int) -> bytes:
    """Seven bits a byte, the low ones first; all bytes but the last have the high bit set."""
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


class TokenBucket:
    """State of one bucket; starts full."""

    def __init__(self, capacity: int, period: int, tokens: int | None = None, last: int | None = None) -> None:
        self.capacity, self.period = capacity, period
        self.tokens = capacity if tokens is None else tokens
        self.last = last

    def to_bytes(self) -> bytes:
        """Tokens and the time of the last refill, as variable-length numbers."""
        return varint(self.tokens) + varint(self.last or 0)

    @classmethod
    def from_bytes(cls, state: bytes, capacity: int, period: int) -> TokenBucket:
        numbers, n, shift = [], 0, 0
        for b in state:
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                numbers.append(n)
                n = shift = 0
        return cls(capacity, period, numbers[0], numbers[1] or None)

    def use(self, now: int) -> bool:
        if self.last is None:
            self.last = now
        if now - self.last > self.period:
            self.tokens, self.last = self.capacity, now
        if self.tokens == 0:
            return False
        self.tokens -= 1
        return True


def token_bucket(ops: DataFrame, capacity: int = 3, period: int = 10, bucket: str = "bucket", at: str = "op_ts", seq: str = "seq") -> DataFrame:
    """``ops (bucket, op_ts in seconds, seq)`` with ``allowed`` and, after each operation, ``state``: the bucket's bytes.

    Operations are sorted within partitions and folded as a stream of batches, so no bucket is held in memory.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, TokenBucket(capacity, period)
        for frame in frames:
            allowed, states = [], []
            for b, t in zip(frame["bucket"], frame["op_ts"], strict=True):
                if b != name:
                    name, state = b, TokenBucket(capacity, period)
                allowed.append(state.use(t))
                states.append(state.to_bytes())
            yield frame.assign(allowed=allowed, state=states)

    ship(ops.sparkSession)
    rows = ops.select(F.col(bucket).cast("string").alias("bucket"), F.col(at).cast("long").alias("op_ts"), F.col(seq).cast("long").alias("seq"))
    ordered = rows.where("bucket is not null").repartition("bucket").sortWithinPartitions("bucket", "op_ts", "seq")
    return ordered.mapInPandas(run, "bucket string, op_ts long, seq long, allowed boolean, state binary")


def bucket_states(ops: DataFrame, capacity: int = 3, period: int = 10, **columns: str) -> DataFrame:
    """``bucket, state``: the bytes to store for each bucket after its last operation."""
    last = F.max_by("state", F.struct("op_ts", "seq"))
    return token_bucket(ops, capacity, period, **columns).groupBy("bucket").agg(last.alias("state"))
