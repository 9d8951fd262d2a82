"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from keystrata.sources import scratch
from keystrata.sources.scratch import delete_tables, materialize, new_path, shared_dir  # noqa: F401

#: Bytes that a side may have, by a count and its columns' widths, to be broadcast; anything larger is joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Bytes of an Arrow batch, about: rows are whole texts, and each task holds several copies of a batch.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, and cut the session's Arrow batches by ``BATCH_BYTES``.

    The size that the cluster's own configuration gives, if any, stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(BATCH_BYTES))
    scratch.ship(spark)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is written inside: for rows of many kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join, broadcasting ``small`` only if a count shows that its rows take at most ``limit`` bytes.

    Its columns must have a fixed width; those that haven't rule a broadcast out.
    """
    kinds = [f.dataType for f in small.schema.fields]
    fixed = all(isinstance(k, (NumericType, BooleanType)) for k in kinds)
    rows = limit // (32 + 8 * len(kinds))  # a row's header and its values, beside the hash table's own words
    if fixed and small.limit(rows + 1).count() <= rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def text_hashes(name: str = "text") -> tuple[Column, Column]:
    """Two 64-bit hashes that together name a text; null for null."""
    t = F.col(name)
    return F.when(t.isNotNull(), F.xxhash64(t)), F.when(t.isNotNull(), F.xxhash64(F.lit(7), t))


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """Each row as a struct ``row`` beside ``keys``, so that no column name of ``df`` can clash with another."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(n) for n, c in keys.items()))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into blocks of about ``max_bytes`` of ``column``, one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker returns the memory that it no longer uses to the system.

    Workers are used again by later tasks and stages, and wait idle beside others; what the allocators would keep
    of a task's peak counts for each of them.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    """Return free memory of Python, Arrow and the C library to the system, where the library can."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ordered_positions(df: DataFrame, keys: list[str], amount: str, label: str) -> DataFrame:
    """Global order by ``keys`` with two running totals, without a single-task sort.

    ``df`` is range-partitioned and sorted, each partition adds up its own rows, and
    the totals of the partitions before it are added. Columns ``position`` (from 0)
    and ``before`` (sum of ``amount`` over all earlier rows) are new. One small row
    for each partition is all that meets in one place. Keys must order the rows
    totally up to identical rows.
    """
    ship(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            sums = pc.cumulative_sum(b.column(amount).cast(pa.int64()))
            n = b.num_rows
            before = pc.add(pc.subtract(sums, b.column(amount).cast(pa.int64())), total)
            extra = [pa.array([part] * n, pa.int32()), pa.array(range(rows, rows + n), pa.int64()), before]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "_part", "_row", "_sum"])
            if n:
                rows, total = rows + n, total + sums[-1].as_py()

    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = materialize(ranged.mapInArrow(tidy(run), f"{schema}, _part int, _row long, _sum long"), label)
    totals = kept.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(amount).alias("_t"))
    offsets = totals.selectExpr(
        "_part",
        "coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _n0",
        "coalesce(sum(_t) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _t0",
    )
    return (
        kept.join(F.broadcast(offsets), "_part")  # one row a partition
        .withColumn("position", F.col("_row") + F.col("_n0"))
        .withColumn("before", F.col("_sum") + F.col("_t0"))
        .drop("_part", "_row", "_sum", "_n0", "_t0")
    )
