"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import materialize, ship, tidy

#: Links up to which one task joins them, in bounded memory; more are joined by all.
ONE_TASK = 1_000_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """``id, root`` by union-find over at most ``ONE_TASK`` links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not pairs:
            return
        u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, j in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)  # ids are sorted, so the smallest becomes the root
        top = np.array([find(i) for i in range(len(ids))], np.int64)
        keep = top != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[top[keep]])], ["id", "root"])

    ship(edges.sparkSession)
    return materialize(edges.coalesce(1).mapInArrow(tidy(run), "id long, root long"), "roots")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """``id, root``: for each id in ``links``, other than roots, the smallest id that it is connected to.

    Up to ``one_task`` links, which are counted, are joined in one task; more are not. Then it
    alternates large-star and small-star steps (Kiveris et al., 2014) until the links no
    longer change. Each step's table is written to the shared folder; nothing but a
    count and a checksum comes to the driver. A vertex with very many links costs no more than its
    links: minima are pre-aggregated, and the joins can be split by the adaptive skew join.
    """
    edges = materialize(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")

    if edges.count() <= one_task:
        return _in_one_task(edges)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    seen = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each vertex's smaller neighbours, and itself, link to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = materialize(small, "links")
        now = mark(edges)
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = now
