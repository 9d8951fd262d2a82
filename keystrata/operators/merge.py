"""The newest version of each key, and merging runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.operators.order import positions


def latest(log: DataFrame) -> DataFrame:
    """The version with the greatest ``ts`` of each key; tombstones count.

    Of versions with the same ``ts`` a tombstone wins, then the greater value. Versions are
    reduced before the shuffle, so a key with very many is no hot spot.
    """
    newest = F.max_by(F.struct("value", "tombstone", "ts"), F.struct("ts", "tombstone", "value"))
    return log.groupBy("key").agg(newest.alias("v")).select("key", "v.*")


def live(log: DataFrame) -> DataFrame:
    return latest(log).where(~F.col("tombstone"))


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """Sorted, deduplicated union of runs, oldest first; tombstones stay, also on the last level.

    Of versions with the same ``ts`` that of the older run wins.
    """
    numbered = [r.select("key", "value", "tombstone", "ts", F.lit(-i).alias("age")) for i, r in enumerate(runs)]
    newest = F.max_by(F.struct("value", "tombstone", "ts"), F.struct("ts", "age"))
    merged = reduce(DataFrame.unionByName, numbered).groupBy("key").agg(newest.alias("v")).select("key", "v.*")
    return merged.repartitionByRange("key").sortWithinPartitions("key")


def newest_timestamp(log: DataFrame) -> DataFrame:
    return log.agg(F.max("ts").alias("newest_ts"))


def key_dictionary(log: DataFrame) -> DataFrame:
    """``key, id``: keys numbered from 1 in the order of their first version.

    Keys are numbered by ranges; prefer Parquet's own dictionaries for storage.
    """
    first = log.groupBy("key").agg(F.min("ts").alias("first_ts"))
    return positions(first, ["first_ts", "key"]).select("key", (F.col("idx") + 1).alias("id"))
