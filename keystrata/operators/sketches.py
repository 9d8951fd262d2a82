"""Bloom filters, Count-Min sketches, HyperLogLog and SimHash as aggregates of rows.

A sketch is a table of its set positions, cells or registers, so building is one
partially aggregated groupBy, merging is a union and an aggregate, and none is held in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.hashing import fnv1, modulo, top_bits, trailing_zeros

#: Common English words that SimHash leaves out.
STOP_WORDS = tuple("a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves".split())


# Bloom


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions for ``n`` items at the false positive rate ``p``."""
    m = int(-n * math.log(p) / math.log(2) ** 2)
    return m, int(m / n * math.log(2))


def bloom_positions(items: DataFrame, item: str, m: int, k: int, first_seed: int = 1) -> DataFrame:
    """``items`` with a row for each of its positions ``pos``."""
    seeds = F.sequence(F.lit(first_seed), F.lit(first_seed + k - 1))
    return items.withColumn("_seed", F.explode(seeds)).withColumn("pos", modulo(fnv1(F.col(item), F.col("_seed")), m)).drop("_seed")


def bloom_build(items: DataFrame, item: str, m: int, k: int, first_seed: int = 1) -> DataFrame:
    """``pos``: the set bits."""
    return bloom_positions(items.select(item).distinct(), item, m, k, first_seed).select("pos").distinct()


def bloom_probe(bits: DataFrame, items: DataFrame, item: str, m: int, k: int, first_seed: int = 1) -> DataFrame:
    """``item, present``: false is certain."""
    wanted = bloom_positions(items.select(F.col(item).alias("item")).distinct(), "item", m, k, first_seed).distinct()
    found = bits.select("pos", F.lit(1).alias("hit"))
    return wanted.join(found, "pos", "left").groupBy("item").agg((F.count("hit") == F.count("*")).alias("present"))


# Count-Min


def cms_size(epsilon: float, delta: float) -> tuple[int, int]:
    """Columns and rows."""
    return math.ceil(math.e / epsilon), math.ceil(math.log(math.e / delta))


def cms_cells(items: DataFrame, item: str, m: int, k: int, first_seed: int = 1) -> DataFrame:
    """``row, col, cnt``; items are counted before they are hashed."""
    counts = items.groupBy(F.col(item).alias("item")).count()
    rows = counts.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.groupBy("row", modulo(fnv1(F.col("item"), F.col("row") + first_seed), m).alias("col")).agg(F.sum("count").alias("cnt"))


def cms_frequency(cells: DataFrame, items: DataFrame, item: str, m: int, k: int, first_seed: int = 1) -> DataFrame:
    """``item, freq``: never too small."""
    wanted = items.select(F.col(item).alias("item")).distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    wanted = wanted.withColumn("col", modulo(fnv1(F.col("item"), F.col("row") + first_seed), m))
    return wanted.join(cells, ["row", "col"], "left").groupBy("item").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("freq"))


def cms_merge(*cells: DataFrame) -> DataFrame:
    out = cells[0]
    for c in cells[1:]:
        out = out.unionByName(c)
    return out.groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))


# HyperLogLog


def hll_registers(items: DataFrame, item: str, p: int, seed: int = 1) -> DataFrame:
    """``bucket, rank`` of the non-empty registers."""
    if not 4 <= p <= 16:
        raise ValueError("precision must be between 4 and 16")
    h = items.select(F.col(item).alias("item")).distinct().select(fnv1(F.col("item"), seed).alias("h"))
    return h.groupBy(top_bits(F.col("h"), p).alias("bucket")).agg(F.max(trailing_zeros(F.col("h")) + 1).alias("rank"))


def hll_merge(*registers: DataFrame) -> DataFrame:
    out = registers[0]
    for r in registers[1:]:
        out = out.unionByName(r)
    return out.groupBy("bucket").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, p: int) -> DataFrame:
    """``estimate``, with the corrections for small and large counts."""
    m = float(1 << p)
    sums = registers.agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("s"), F.count("*").alias("n"))
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("s") + (m - F.col("n")))
    big = F.lit(2.0**32)
    empty = m - F.col("n")
    e = F.col("e")
    fixed = F.when((e <= 2.5 * m) & (empty > 0), m * F.log(m / empty)).when(e > big / 30, -big * F.log(1 - e / big)).otherwise(e)
    return sums.withColumn("e", raw).select(F.round(fixed, 4).alias("estimate"))


# SimHash


def simhash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, hi, lo``: for each bit, words that have it against words that don't.

    Words are the lower-case text cut at spaces, without stop words; a text without
    words counts as one empty word. Each different word is hashed once.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), " "), lambda w: ~w.isin(*STOP_WORDS))
    words = F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(words)
    pairs = docs.select(F.col(id_col).alias("id"), F.explode(words).alias("word")).groupBy("id", "word").count()
    hashed = pairs.select("word").distinct().withColumn("h", fnv1(F.col("word")))
    bit = lambda half, k: F.shiftright(F.col(f"h.{half}"), k).bitwiseAND(1)
    sums = [F.sum(F.col("count") * (2 * bit(half, k) - 1)).alias(f"{half}{k}") for half in ("hi", "lo") for k in range(32)]
    votes = pairs.join(hashed, "word").groupBy("id").agg(*sums)

    def number(half: str) -> Column:
        out = F.lit(0).cast("bigint")
        for k in range(32):
            out = out + F.when(F.col(f"{half}{k}") > 0, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return out.alias(half)

    return votes.select("id", number("hi"), number("lo"))


def hamming(a: str, b: str) -> Column:
    """Differing bits of two fingerprints ``struct(hi, lo)``; fewer is closer."""
    return F.bit_count(F.col(f"{a}.hi").bitwiseXOR(F.col(f"{b}.hi"))) + F.bit_count(F.col(f"{a}.lo").bitwiseXOR(F.col(f"{b}.lo")))


# Sketches as one binary each, for storage beside other values. A sketch's size is set by its parameters, not by its items.


def _hex(x: Column, size: int) -> Column:
    return F.lpad(F.hex(x.cast("bigint")), 2 * size, "0")


#: Cells that one row holds on the way to and from a binary.
PIECE = 1024


def _packed(cells: DataFrame, size: int, cell_bytes: int, head: str, seeds: list[int]) -> DataFrame:
    """``sketch``: head, the cells ``at, n`` of 0 to ``size`` - 1 in big-endian order, seeds of 4 bytes.

    Cells are joined by pieces; what meets in one row is a binary for each piece.
    """
    every = cells.sparkSession.range(size).withColumnRenamed("id", "at").join(cells, "at", "left")
    one = F.struct("at", _hex(F.coalesce("n", F.lit(0)), cell_bytes).alias("x"))
    in_order = lambda rows: F.array_join(F.transform(F.sort_array(F.collect_list(rows)), lambda c: c["x"]), "")
    pieces = every.groupBy(F.floor(F.col("at") / PIECE).alias("piece")).agg(in_order(one).alias("x"))
    body = pieces.agg(in_order(F.struct("piece", "x")).alias("body"))
    return body.select(F.unhex(F.concat(F.lit(head), "body", F.lit("".join(f"{s:08x}" for s in seeds)))).alias("sketch"))


def _cells(sketch: DataFrame, start: int, size: int, cell_bytes: int) -> DataFrame:
    """``at, n`` of the cells that aren't 0; no row carries more than a piece of the binary."""
    cut = lambda i: F.struct(i.alias("piece"), F.substring("sketch", i * (PIECE * cell_bytes) + (start + 1), F.lit(PIECE * cell_bytes)).alias("x"))
    pieces = sketch.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit((size - 1) // PIECE)), cut)).alias("p")).select("p.*")
    number = lambda j: F.conv(F.hex(F.substring("x", j * cell_bytes + 1, F.lit(cell_bytes))), 16, 10).cast("bigint")
    inside = F.sequence(F.lit(0), F.least(F.lit(PIECE), size - F.col("piece") * PIECE) - 1)
    found = F.transform(inside, lambda j: F.struct((F.col("piece").cast("bigint") * PIECE + j).alias("at"), number(j).alias("n")))
    return pieces.repartition("piece").select(F.explode(F.filter(found, lambda c: c["n"] > 0)).alias("c")).select("c.*")


def bloom_pack(bits: DataFrame, m: int, k: int, first_seed: int = 1) -> DataFrame:
    """One row ``sketch``: m and k in 4 bytes each, a byte for each bit, the seeds."""
    return _packed(bits.select(F.col("pos").alias("at"), F.lit(1).alias("n")), m, 1, f"{m:08x}{k:08x}", list(range(first_seed, first_seed + k)))


def bloom_unpack(sketch: DataFrame, m: int) -> DataFrame:
    return _cells(sketch, 8, m, 1).select(F.col("at").alias("pos"))


def cms_pack(cells: DataFrame, m: int, k: int, first_seed: int = 1) -> DataFrame:
    """One row ``sketch``: m and k in 4 bytes each, rows of cells of 4 bytes, the seeds."""
    flat = cells.select((F.col("row") * m + F.col("col")).alias("at"), F.col("cnt").alias("n"))
    return _packed(flat, m * k, 4, f"{m:08x}{k:08x}", list(range(first_seed, first_seed + k)))


def cms_unpack(sketch: DataFrame, m: int, k: int) -> DataFrame:
    cells = _cells(sketch, 8, m * k, 4)
    return cells.select(F.floor(F.col("at") / m).cast("int").alias("row"), (F.col("at") % m).alias("col"), F.col("n").alias("cnt"))


def hll_pack(registers: DataFrame, p: int, seed: int = 1) -> DataFrame:
    """One row ``sketch``: the number of registers in 8 bytes, p in one, a byte for each register, the seed."""
    flat = registers.select(F.col("bucket").cast("bigint").alias("at"), F.col("rank").alias("n"))
    return _packed(flat, 1 << p, 1, f"{1 << p:016x}{p:02x}", [seed])


def hll_unpack(sketch: DataFrame, p: int) -> DataFrame:
    return _cells(sketch, 9, 1 << p, 1).select(F.col("at").cast("int").alias("bucket"), F.col("n").cast("int").alias("rank"))


def simhash_pack(hi: str = "hi", lo: str = "lo") -> Column:
    """A fingerprint as 8 big-endian bytes."""
    return F.unhex(F.concat(_hex(F.col(hi), 4), _hex(F.col(lo), 4)))


def simhash_unpack(packed: Column) -> Column:
    half = lambda start: F.conv(F.hex(F.substring(packed, start, 4)), 16, 10).cast("bigint")
    return F.struct(half(1).alias("hi"), half(5).alias("lo"))
