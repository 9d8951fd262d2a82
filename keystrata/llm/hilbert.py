"""Shards along a Hilbert curve.

Several metadata columns are quantised to the same number of bits, each row gets its
index on the Hilbert curve through these cells, rows are ordered by the index, and the
order is cut into runs. Rows that are close in all columns share a shard, so a reader
can skip files by the minimum and maximum of any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import ordered_positions, packed, ship, text_or_empty

BITS = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of ``cells`` (n, d), every cell in 0 to 2**bits - 1; bits * d <= 62.

    Skilling's transposition: undo the rotations from the high bit down, Gray-decode,
    then interleave the axes' bits.
    """
    x = np.array(cells, np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _value_bins(df: DataFrame, column: str, bits: int, name: str) -> DataFrame:
    """Equal-depth bins of a column's distinct values in their order, null first: ``_v`` and ``name``, one row for each value."""
    counts = df.groupBy(F.col(f"`{column}`").alias("_v")).agg(F.count("*").alias("_n"))
    placed = ordered_positions(counts, ["_v"], "_n", "values")
    total = df.count()
    share = F.floor(F.lit(1 << bits) * F.col("before") / F.lit(max(1, total))).cast("int")
    return placed.select("_v", F.least(F.lit((1 << bits) - 1), share).alias(name))


def _number_bin(df: DataFrame, column: str, bits: int) -> Column:
    """Number of the column's 2**bits quantiles that a value exceeds; null is 0."""
    share = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = sorted(set(df.agg(F.percentile_approx(column, share, 10_000)).first()[0] or []))
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(column))), F.lit(0))


def with_hilbert_index(df: DataFrame, values: list[str], numbers: list[str], bits: int = BITS, name: str = "hilbert") -> DataFrame:
    """``df`` with its curve index over ``values`` (binned by distinct value) and ``numbers`` (by quantile).

    Null has the first bin. A column called ``name`` is replaced.
    """
    ship(df.sparkSession)
    columns = [c for c in df.columns if c != name]
    out = packed(df, **{f"_value{i}": F.col(f"`{c}`") for i, c in enumerate(values)}, **{f"_bin{len(values) + i}": _number_bin(df, c, bits) for i, c in enumerate(numbers)})
    for i, c in enumerate(values):
        bins = _value_bins(df, c, bits, f"_bin{i}")
        out = out.join(bins, out[f"_value{i}"].eqNullSafe(bins["_v"]), "left").drop("_v")  # Spark broadcasts the bins only below its threshold
    dims = [F.coalesce(F.col(f"_bin{i}"), F.lit(0)) for i in range(len(values) + len(numbers))]

    @F.pandas_udf("long")
    def index(cells):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(hilbert_index(np.stack(cells.to_numpy()), bits) if len(cells) else [], dtype="int64")

    return out.select(*(F.col(f"row.`{c}`") for c in columns), index(F.array(*dims)).alias(name))


def hilbert_shards(docs: DataFrame, shards: int = 8, bits: int = BITS, values: tuple[str, ...] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard under the law ``rows``: shard sizes in rows are at most one apart.

    Equal texts (a group) are told by ``text_crc32`` and ``size``; under this law they needn't share a shard, which may
    be cut between them, as rows alone are counted.

    ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and ``hilbert``; size is
    the text's bytes and 1; ``slot`` counts from 0 in each shard in curve order.
    Null texts count as empty, nulls in other columns come first, rows with equal keys
    are ordered by id, repeated rows each get a slot of their own, an empty table
    gives no rows. Texts are read whole, however long, rows without an id come first among equal keys. Extra columns are ignored.
    """
    text = text_or_empty(text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), *values, (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    keyed = with_hilbert_index(narrow, list(values), ["size"], bits).withColumn("_one", F.lit(1).cast("long"))
    placed = ordered_positions(keyed.select("doc_id", "size", "text_crc32", "hilbert", "_one"), ["hilbert", "doc_id", "text_crc32", "size"], "_one", "hilbert")
    total = placed.agg(F.count("*")).first()[0]
    at, n = F.col("position"), F.lit(total)
    first = F.ceil(F.col("shard") * n / F.lit(shards).cast("decimal(20,0)")).cast("long")
    return placed.withColumn("shard", F.floor(at * shards / F.greatest(n, F.lit(1)).cast("decimal(20,0)")).cast("int")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (at - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> None:  # noqa: ANN003
    """Write ``docs`` as ``shard=N`` folders of files sorted along the curve; a column called ``shard`` is replaced.

    A sorted run of a shard can be several files: rows are dealt by range of position. Rows may repeat a ``doc_id``:
    the rows of an id are matched with its slots in any order.
    """
    id_col = options.get("id_col", "doc_id")
    docs = docs.drop("shard")
    placed = hilbert_shards(docs, shards, **options).select("doc_id", "text_crc32", "size", "shard", "slot")
    text = text_or_empty(options.get("text_col", "text"))
    # Rows alike in all that the curve's order looks at are numbered on both sides, so each meets one slot.
    alike = ["doc_id", "text_crc32", "size"]
    keys = {"doc_id": F.col(id_col), "text_crc32": F.crc32(F.encode(text, "UTF-8")), "size": F.octet_length(text).cast("long") + 1}
    nth = f"row_number() over (partition by {', '.join(alike)} order by {{}}) as nth"
    rows = packed(docs, **keys).selectExpr("*", nth.format("xxhash64(row)"))
    slots = placed.selectExpr("*", nth.format("shard, slot"))
    met = rows["nth"] == slots["nth"]
    for c in alike:
        met = met & rows[c].eqNullSafe(slots[c])
    out = rows.join(slots, met).select("row.*", "shard", "slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
