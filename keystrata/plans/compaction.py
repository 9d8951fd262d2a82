"""Which runs to merge. Runs are rows ``level, segment, min_key, max_key, n``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Run:
    level: int
    segment: int
    min_key: str
    max_key: str


def zone_map(rows: DataFrame) -> DataFrame:
    return rows.groupBy("level", "segment").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n"))


def overlaps(zones: DataFrame) -> DataFrame:
    """``a, b``: segments of a level whose key ranges meet."""
    a = zones.select("level", F.col("segment").alias("a"), F.col("min_key").alias("a_min"), F.col("max_key").alias("a_max"))
    b = zones.select("level", F.col("segment").alias("b"), F.col("min_key").alias("b_min"), F.col("max_key").alias("b_max"))
    return a.join(b, "level").where("a < b and a_min <= b_max and a_max >= b_min").select("level", "a", "b")


def level_limit(level: int, algorithm: str, size: int = 2, multiplier: int = 1) -> int:
    """Runs at which a level is merged."""
    return size if algorithm == "sizetiered" else (size + 1) * multiplier ** (level - 1)


def due(counts: DataFrame, algorithm: str, size: int = 2, multiplier: int = 1, levels: int = 4) -> Column:
    """Whether each row ``level, runs`` has reached its limit; the last of ``levels`` is never merged on."""
    out = F.lit(False)
    for level in range(1, levels):
        out = F.when(counts["level"] == level, counts["runs"] >= level_limit(level, algorithm, size, multiplier)).otherwise(out)
    return out


def tiered(runs: list[Run], level: int, size: int) -> list[list[Run]]:
    """Full groups of the level's runs, oldest first."""
    own = sorted((r for r in runs if r.level == level), key=lambda r: r.segment)
    return [own[i : i + size] for i in range(0, len(own) - size + 1, size)]


def leveled(runs: list[Run], level: int) -> list[Run]:
    """The level's oldest run and the next level's runs that it overlaps."""
    own = sorted((r for r in runs if r.level == level), key=lambda r: r.segment)
    if not own:
        return []
    first = own[0]
    return [first, *(r for r in runs if r.level == level + 1 and r.min_key <= first.max_key and r.max_key >= first.min_key)]


def leveled_groups(runs: list[Run], level: int) -> list[list[Run]]:
    """The runs that end in each run of the next level when all of the level's runs, oldest first, are merged as ``leveled`` says."""
    below = [(r, [r]) for r in runs if r.level == level + 1]
    for run in sorted((r for r in runs if r.level == level), key=lambda r: r.segment):
        group = leveled([run, *(r for r, _ in below)], level)
        parts = [run, *(p for r, ps in below if r in group for p in ps)]
        merged = Run(level + 1, min(p.segment for p in parts), min(r.min_key for r in group), max(r.max_key for r in group))
        below = [*((r, ps) for r, ps in below if r not in group), (merged, parts)]
    return [ps for _, ps in below]
