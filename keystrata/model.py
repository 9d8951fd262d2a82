"""The only row type: a version of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_SCHEMA = "key string, value binary, tombstone boolean, ts bigint"

#: Prefixes of internal keys.
RESERVED = ("tb_", "bf_", "cms_", "hll_", "simhash_")


class KeyNotFound(KeyError):
    """No live version of the key."""


def is_reserved(key: str) -> bool:
    return key.startswith(RESERVED)


def reserved_column(key: str = "key") -> Column:
    return F.col(key).rlike("^(" + "|".join(RESERVED) + ")")


def guard(*arguments: str, message: str = "invalid prefix") -> None:
    if any(is_reserved(a) for a in arguments):
        raise ValueError(message)


def as_log(df: DataFrame, key: Column, value: Column, ts: Column, tombstone: Column | None = None) -> DataFrame:
    """Any table as a log; a tombstone has no value."""
    dead = F.coalesce(tombstone, F.lit(False)) if tombstone is not None else F.lit(False)
    return df.select(key.alias("key"), F.when(~dead, value.cast("binary")).alias("value"), dead.alias("tombstone"), ts.cast("long").alias("ts"))
