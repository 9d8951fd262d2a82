"""FNV-1, 64 bits, as two 32-bit halves, since Spark's long is signed.

The fold over bytes has no built-in function, and an interpreted one costs microseconds a byte, so it runs in
Arrow batches: one numpy step for each byte position, over all rows that are long enough.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV's offset basis and prime.
BASIS, PRIME = 14695981039346656037, 1099511628211


def fnv1(data: Column, seed: Column | int | None = None) -> Column:
    """``struct(hi, lo)`` of the bytes of ``data``, followed by ``seed`` as 4 big-endian bytes; null for null."""
    basis, prime = BASIS, PRIME

    @F.pandas_udf("hi bigint, lo bigint")
    def fold(values, seeds):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        none = values.isna().to_numpy()
        raw = [b"" if gone else bytes(x) for x, gone in zip(values, none, strict=True)]
        size = np.array([len(x) for x in raw], np.int64)
        order = np.argsort(-size, kind="stable")
        buffer = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        starts = (np.cumsum(size) - size)[order]
        long_enough = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), side="right")
        h, p = np.full(len(raw), basis, np.uint64), np.uint64(prime)
        for j, n in enumerate(long_enough.tolist()):
            h[:n] = h[:n] * p ^ buffer[starts[:n] + j]
        back = np.empty_like(h)
        back[order] = h
        given = ~seeds.isna().to_numpy()
        s = seeds.fillna(0).to_numpy().astype(np.int64)
        for shift in (24, 16, 8, 0):
            back = np.where(given, back * p ^ ((s >> shift) & 255).astype(np.uint64), back)
        out = pd.DataFrame({"hi": (back >> np.uint64(32)).astype(np.int64), "lo": (back & np.uint64(0xFFFFFFFF)).astype(np.int64)})
        return out.astype("Int64").mask(none, pd.NA) if none.any() else out

    s = F.lit(None).cast("bigint") if seed is None else F.lit(seed).cast("bigint") if isinstance(seed, int) else seed.cast("bigint")
    return fold(data.cast("binary"), s)


def fnv_hex(h: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))


def modulo(h: Column, m: Column | int) -> Column:
    """The unsigned 64-bit value modulo ``m``, below 2**31."""
    m = F.lit(m).cast("bigint") if isinstance(m, int) else m
    return ((h["hi"] % m) * (F.lit(1 << 32).cast("bigint") % m) + h["lo"] % m) % m


def trailing_zeros(h: Column) -> Column:
    """0 to 64."""
    in_half = lambda x: F.bit_count(x.bitwiseAND(-x) - 1)
    return F.when(h["lo"] != 0, in_half(h["lo"])).when(h["hi"] != 0, in_half(h["hi"]) + 32).otherwise(64)


def top_bits(h: Column, p: int) -> Column:
    return F.shiftright(h["hi"], 32 - p)
