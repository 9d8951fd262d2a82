"""Streams of versions into a store, and rate limits on streams of operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keystrata.operators.merge import latest
from keystrata.operators.ratelimit import TokenBucket
from keystrata.sources.scratch import ship
from keystrata.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:  # noqa: ANN003
    """Each micro-batch is reduced to its newest versions and appended as a run's worth of log.

    The checkpoint's offsets take the place of the log's replay after a failure. A batch that
    is written again repeats versions, which the newest-version view absorbs.
    """

    def write(batch: DataFrame, _: int) -> None:
        store.append(latest(batch))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def limit_stream(ops: DataFrame, capacity: int = 3, period: int = 10) -> DataFrame:
    """``ops (bucket, op_ts, seq)`` with ``allowed``; a bucket's tokens live in the state store."""

    ship(ops.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        bucket = TokenBucket(capacity, period, tokens, last)
        rows = pd.concat(list(frames)).sort_values(["op_ts", "seq"])
        rows["allowed"] = [bucket.use(int(t)) for t in rows["op_ts"]]
        state.update((int(bucket.tokens), int(bucket.last)))
        yield rows[["bucket", "op_ts", "seq", "allowed"]]

    return ops.groupBy("bucket").applyInPandasWithState(run, "bucket string, op_ts long, seq long, allowed boolean", "tokens long, last long", "append", GroupStateTimeout.NoTimeout)
