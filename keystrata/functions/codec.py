"""Record layouts as column functions.

Plain: ``crc 4 | ts 8 | tombstone 1 | key size 8 | value size 8 | key | value``, big
endian; a tombstone ends after the key size and key in a run, and keeps an empty value in the log.
The checksum covers what follows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _big_endian(x: Column, size: int) -> Column:
    return F.lpad(F.hex(x.cast("bigint")), 2 * size, "0")


def payload(in_log: bool = False) -> Column:
    """The bytes after the checksum, from the columns of a log."""
    key, value, dead = F.col("key").cast("binary"), F.coalesce("value", F.unhex(F.lit(""))), F.col("tombstone")
    short = dead if not in_log else F.lit(False)
    head = F.concat(_big_endian(F.col("ts"), 8), F.when(dead, "01").otherwise("00"), _big_endian(F.octet_length(key), 8))
    return F.unhex(F.concat(head, F.when(short, "").otherwise(_big_endian(F.octet_length(value), 8)), F.hex(key), F.when(short, "").otherwise(F.hex(value))))


def record_crc(in_log: bool = True) -> Column:
    return F.crc32(payload(in_log))


def encode_record(in_log: bool = False) -> Column:
    p = payload(in_log)
    return F.unhex(F.concat(_big_endian(F.crc32(p), 4), F.hex(p)))


def _number(record: Column, start: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(record, start, size)), 16, 10).cast("bigint")


def decode_record(records: DataFrame, column: str = "record", in_log: bool = False) -> DataFrame:
    """``key, value, tombstone, ts, crc, crc_ok`` of encoded records; a wrong checksum is told, not hidden."""
    r = F.col(column)
    dead = F.hex(F.substring(r, 13, 1)) == "01"
    size = _number(r, 14, 8)
    start = F.when(dead, 22).otherwise(30) if not in_log else F.lit(30)
    key = F.substring(r, start, size.cast("int"))
    value = F.when(~dead, F.substring(r, (F.lit(30) + size).cast("int"), F.octet_length(r)))
    return records.select(key.cast("string").alias("key"), value.alias("value"), dead.alias("tombstone"), _number(r, 5, 8).alias("ts"), _number(r, 1, 4).alias("crc"), (F.crc32(F.substring(r, F.lit(5), F.octet_length(r))) == _number(r, 1, 4)).alias("crc_ok"))


def encode_compact(log: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``key, ts, record``: variable-length numbers, and the key as its number in ``dictionary (key, id)``."""

    @F.pandas_udf("binary")
    def pack(crc: pd.Series, ts: pd.Series, dead: pd.Series, key: pd.Series, value: pd.Series) -> pd.Series:
        def number(n: int) -> bytes:
            out = bytearray()
            while n >= 0x80:
                out.append(n & 0x7F | 0x80)
                n >>= 7
            return bytes([*out, n])

        parts = zip(crc, ts, dead, key, value, strict=True)
        return pd.Series([number(c) + number(t) + bytes([d]) + number(k) + (b"" if d else number(len(v or b"")) + (v or b"")) for c, t, d, k, v in parts])

    joined = log.join(dictionary, "key")
    return joined.select("key", "ts", pack(record_crc(False), F.col("ts"), F.col("tombstone"), F.col("id"), F.col("value")).alias("record"))


def decode_compact(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``key, value, tombstone, ts, crc, crc_ok`` of compact records; a wrong checksum is told, not hidden."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def number(raw: bytes, at: int) -> tuple[int, int]:
            n = shift = 0
            while True:
                n |= (raw[at] & 0x7F) << shift
                shift, at = shift + 7, at + 1
                if raw[at - 1] < 0x80:
                    return n, at

        for frame in frames:
            rows = []
            for raw in frame["record"]:
                crc, at = number(raw, 0)
                ts, at = number(raw, at)
                dead = bool(raw[at])
                key, at = number(raw, at + 1)
                size, at = (0, at) if dead else number(raw, at)
                rows.append((key, None if dead else bytes(raw[at : at + size]), dead, ts, crc))
            yield pd.DataFrame(rows, columns=["id", "value", "tombstone", "ts", "crc"])

    out = records.select("record").mapInPandas(run, "id long, value binary, tombstone boolean, ts long, crc long")
    named = out.join(dictionary, "id").select("key", "value", "tombstone", "ts", "crc")
    return named.withColumn("crc_ok", F.col("crc") == record_crc(False))
