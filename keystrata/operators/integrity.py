"""Checksums and hash trees over runs."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.codec import encode_record
from keystrata.functions.hashing import fnv1, fnv_hex
from keystrata.operators.order import positions

#: Fixed value: the record of the empty key and value at time 0, with its checksum.
EMPTY_RECORD = zlib.crc32(bytes(25)).to_bytes(4, "big") + bytes(25)
#: Levels that are paired between two shuffles: a task holds some subtrees of 2**LEVELS leaves.
LEVELS = 12


def _empty(seed: int) -> Column:
    return fnv_hex(fnv1(F.unhex(F.lit(EMPTY_RECORD.hex())), seed))


def merkle_leaves(rows: DataFrame, segment: str = "segment", seed: int = 1) -> DataFrame:
    """``segment, idx, h``: the hash of each row's record, checksum included, at its place in key order."""
    named = rows.withColumn("segment", F.col(segment))
    return positions(named, ["key", "ts"], ["segment"]).select("segment", "idx", fnv_hex(fnv1(encode_record(), seed)).alias("h"))


def merkle_levels(leaves: DataFrame, depth: int | None = None, seed: int = 1) -> list[DataFrame]:
    """The levels above the leaves; each pairs its nodes' hashes.

    Leaves are padded to a power of two with the hash of the empty record. Subtrees are dealt to tasks, so no task holds
    a large segment; smaller segments' roots are passed up. ``depth`` is that of the largest segment, counted if not given.
    """
    counts = leaves.groupBy("segment").agg(F.count("*").alias("n"))
    if depth is None:
        most = counts.agg(F.max("n")).first()[0] or 1
        depth = (most - 1).bit_length()
    sized = counts.withColumn("size", F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long")).where("size > n")
    pad = sized.select("segment", F.explode(F.sequence(F.col("n"), F.col("size") - 1)).alias("idx"), _empty(seed).alias("h"))
    level, out = leaves.unionByName(pad), []
    for k in range(depth):
        if k % LEVELS == 0:
            part = F.floor(F.col("idx") / (1 << LEVELS)).alias("part")
            level = level.select("segment", part, "idx", "h").repartition("segment", "part")
        both = F.min_by("h", "idx").alias("l"), F.max_by("h", "idx").alias("r")
        joined = level.groupBy("segment", "part", F.floor(F.col("idx") / 2).alias("idx")).agg(F.count("*").alias("n"), *both)
        pair = fnv_hex(fnv1(F.unhex(F.concat("l", "r")), seed))
        level = joined.select("segment", "part", "idx", F.when(F.col("n") == 1, F.col("l")).otherwise(pair).alias("h"))
        out.append(level.select("segment", "idx", "h"))
    return out


def merkle_root(leaves: DataFrame, depth: int | None = None, seed: int = 1) -> DataFrame:
    """``segment, h``."""
    levels = merkle_levels(leaves, depth, seed)
    return (levels[-1] if levels else leaves).select("segment", "h")


def merkle_nodes(leaves: DataFrame, seed: int = 1) -> DataFrame:
    """``segment, level, idx, h``: all nodes, leaves at level 0; a stored tree is this table."""
    out = leaves.select("segment", F.lit(0).alias("level"), "idx", "h")
    sizes = leaves.groupBy("segment").agg(F.ceil(F.log2(F.count("*"))).cast("int").alias("height"))
    for k, nodes in enumerate(merkle_levels(leaves, seed=seed), 1):
        own = nodes.join(sizes.where(F.col("height") >= k), "segment", "left_semi")
        out = out.unionByName(own.select("segment", F.lit(k).alias("level"), "idx", "h"))
    return out


def corrupted(now: DataFrame, stored: DataFrame) -> DataFrame:
    """``segment, idx``: leaves whose hash isn't the stored one. Raises if a segment's size differs."""
    a, b = now.select("segment", "idx", F.col("h").alias("h1")), stored.select("segment", "idx", F.col("h").alias("h2"))
    both = a.join(b, ["segment", "idx"], "full")
    gone = F.col("h1").isNull() | F.col("h2").isNull()
    differ = F.when(gone, F.raise_error(F.lit("too many deleted entries")).cast("boolean")).otherwise(F.col("h1") != F.col("h2"))
    return both.where(differ).select("segment", "idx")


def verify_segment(rows: DataFrame, stored: DataFrame, seed: int = 1) -> DataFrame:
    """The rows that were changed since ``stored`` leaves were made; none if all is well."""
    placed = positions(rows, ["key", "ts"], ["segment"])
    now = placed.select("segment", "idx", fnv_hex(fnv1(encode_record(), seed)).alias("h"))
    return placed.join(corrupted(now, stored), ["segment", "idx"], "left_semi")
