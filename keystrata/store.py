"""A store on Parquet: a log, sorted runs in levels, compaction, reads, sketches."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.config import Config
from keystrata.model import LOG_SCHEMA, KeyNotFound, guard
from keystrata.operators import integrity, read, sketches
from keystrata.operators.merge import latest, merge_runs
from keystrata.operators.ratelimit import TokenBucket
from keystrata.plans import compaction
from keystrata.sources.logs import append_wal, read_wal, remove_files, wal_files


class RateLimited(RuntimeError):
    """No token left."""


class Store:
    """Layout: ``path/wal`` and ``path/runs/level=L/segment=S``; each run is sorted by key, with a Parquet Bloom filter on it."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None) -> None:
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        jvm = spark._jvm.org.apache.hadoop.fs
        self._p = jvm.Path
        self._fs = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.bucket = self._load_bucket()

    # files

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._p(f"{self.path}/{name}"))

    def _numbers(self, name: str, field: str) -> list[int]:
        if not self._exists(name):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._p(f"{self.path}/{name}"))]
        return sorted(int(x.removeprefix(f"{field}=")) for x in found if x.startswith(f"{field}="))

    def _run_path(self, level: int, segment: int) -> str:
        return f"{self.path}/runs/level={level}/segment={segment}"

    def runs(self) -> list[tuple[int, int]]:
        return [(n, s) for n in self._numbers("runs", "level") for s in self._numbers(f"runs/level={n}", "segment")]

    def run(self, level: int, segment: int) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(self._run_path(level, segment))

    def zones(self) -> list[compaction.Run]:
        """Key ranges of all runs, from their statistics; one row for each run."""
        if not (found := self.runs()):
            return []
        rows = None
        for n, s in found:
            part = self.run(n, s).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key")).select(F.lit(n).alias("level"), F.lit(s).alias("segment"), "min_key", "max_key")
            rows = part if rows is None else rows.unionByName(part)
        return [compaction.Run(r.level, r.segment, r.min_key or "", r.max_key or "") for r in rows.collect()]

    # writing

    def _load_bucket(self) -> TokenBucket:
        """The bucket as it was stored last: a file's name holds its state, so it is there whole or not at all."""
        size = (self.config.bucket_capacity, self.config.bucket_period)
        states = self._numbers("bucket", "charge")
        if not states:
            return TokenBucket(*size)
        name = next(s.getPath().getName() for s in self._fs.listStatus(self._p(f"{self.path}/bucket/charge={states[-1]}")))
        return TokenBucket.from_bytes(bytes.fromhex(name), *size)

    def charge(self, now: int | None = None) -> None:
        """Take a token and store the bucket's state, so that a store opened anew has no more tokens than this one."""
        if not self.config.rate_limit:
            return
        self.bucket = self._load_bucket()
        allowed = self.bucket.use(int(time.time()) if now is None else now)
        states = self._numbers("bucket", "charge")
        self._fs.create(self._p(f"{self.path}/bucket/charge={max(states, default=0) + 1}/{self.bucket.to_bytes().hex()}"), True).close()
        for n in states:
            self._fs.delete(self._p(f"{self.path}/bucket/charge={n}"), True)
        if not allowed:
            raise RateLimited("rate limit exceeded")

    def append(self, records: DataFrame) -> None:
        """Versions ``key, value, tombstone, ts``, checked against reserved prefixes."""
        bad = F.raise_error(F.lit("invalid key prefix")).cast("boolean")
        checked = records.where(F.when(F.col("key").rlike("^(tb_|bf_|cms_|hll_|simhash_)"), bad).otherwise(True))
        append_wal(checked, f"{self.path}/wal")

    def _one(self, key: str, value: bytes | None) -> None:
        row = [(key, None if value is None else bytearray(value), value is None, time.time_ns())]
        self.append(self.spark.createDataFrame(row, LOG_SCHEMA))
        self.flush_if_full()

    def flush_if_full(self) -> bool:
        """Flush when the log holds as many different keys as all tables together may."""
        log = read_wal(self.spark, f"{self.path}/wal", verify=False)
        full = log.select("key").distinct().count() >= self.config.table_size * self.config.number_of_tables
        if full:
            self.flush()
        return full

    def put(self, key: str, value: bytes) -> None:
        self.charge()
        guard(key, message="invalid key prefix")
        self._one(key, value)

    def delete(self, key: str) -> None:
        """Blind: unknown keys get a tombstone too."""
        self.charge()
        if key.startswith(("tb_", "bf_", "cms_", "hll_", "simhash_")):
            raise KeyNotFound("key not found")
        self._one(key, None)

    def _write(self, rows: DataFrame, level: int) -> int:
        segment = max(self._numbers(f"runs/level={level}", "segment"), default=0) + 1
        ordered = rows.repartitionByRange("key").sortWithinPartitions("key")
        ordered.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.config.bloom_fpp)).parquet(self._run_path(level, segment))
        return segment

    def flush(self, compact: bool = True) -> None:
        """The log's files become a run of level 1 and go."""
        files = wal_files(self.spark, f"{self.path}/wal")
        if not files:
            return
        # These files and no others, so what is appended meanwhile stays; a crash before the end leaves versions twice, which changes nothing.
        rows = read_wal(self.spark, f"{self.path}/wal", files=files)
        if rows.isEmpty():
            return
        self._write(latest(rows), 1)
        remove_files(self.spark, files)
        if compact:
            self.compact()

    def _replace(self, old: list[compaction.Run], level: int) -> None:
        self._write(merge_runs([self.run(r.level, r.segment) for r in old]), level)
        for r in old:
            self._fs.delete(self._p(self._run_path(r.level, r.segment)), True)

    def compact(self) -> None:
        """Merge levels that have reached their number of runs, upwards; the last level is never merged on."""
        c = self.config
        for level in range(1, c.max_level):
            while True:
                zones = self.zones()
                if sum(r.level == level for r in zones) < compaction.level_limit(level, c.compaction, c.level_size, c.level_multiplier):
                    break
                groups = compaction.tiered(zones, level, c.level_size) if c.compaction == "sizetiered" else [compaction.leveled(zones, level)]
                for g in groups:
                    self._replace(g, level + 1)

    # reading

    def log(self) -> DataFrame:
        """All versions in runs and log. Filters on ``key`` reach each file."""
        parts = [self.run(n, s) for n, s in self.runs()]
        if wal_files(self.spark, f"{self.path}/wal"):
            parts.append(read_wal(self.spark, f"{self.path}/wal"))
        out = self.spark.createDataFrame([], LOG_SCHEMA)
        for p in parts:
            out = out.unionByName(p)
        return out

    def get(self, key: str) -> bytes:
        self.charge()
        return bytes(read.get(self.log(), key))

    def prefix_scan(self, prefix: str, page: int, size: int, **options) -> DataFrame:  # noqa: ANN003
        return read.prefix_scan(self.log(), prefix, page, size, **options)

    def range_scan(self, low: str, high: str, page: int, size: int, **options) -> DataFrame:  # noqa: ANN003
        return read.range_scan(self.log(), low, high, page, size, **options)

    def prefix_iterate(self, prefix: str) -> read.Cursor:
        return read.prefix_iterate(self.log(), prefix)

    def range_iterate(self, low: str, high: str) -> read.Cursor:
        return read.range_iterate(self.log(), low, high)

    # integrity

    def seal(self, level: int, segment: int) -> None:
        """Store the leaves of a run's hash tree beside the runs."""
        rows = self.run(level, segment).withColumn("segment", F.lit(segment))
        integrity.merkle_leaves(rows).write.mode("overwrite").parquet(f"{self.path}/merkle/{level}-{segment}")

    def check(self, level: int, segment: int) -> DataFrame:
        """Rows changed since ``seal``."""
        stored = self.spark.read.parquet(f"{self.path}/merkle/{level}-{segment}")
        return integrity.verify_segment(self.run(level, segment).withColumn("segment", F.lit(segment)), stored)

    # sketches, in a namespace of their own

    def _sketch(self, kind: str, name: str) -> str:
        return f"{self.path}/sketches/{kind}/{name}"

    def save_sketch(self, kind: str, name: str, rows: DataFrame) -> None:
        """``kind`` is bf, cms, hll or simhash. Adding is saving the merge of old and new rows under the name."""
        self.charge()
        versions = self._numbers(f"sketches/{kind}/{name}", "version")
        rows.write.parquet(f"{self._sketch(kind, name)}/version={max(versions, default=0) + 1}")
        for n in versions:  # the new version is whole before the old ones go
            self._fs.delete(self._p(f"{self._sketch(kind, name)}/version={n}"), True)

    def load_sketch(self, kind: str, name: str) -> DataFrame:
        place = f"sketches/{kind}/{name}"
        whole = [n for n in self._numbers(place, "version") if self._exists(f"{place}/version={n}/_SUCCESS")]
        if not whole:
            raise KeyNotFound(f"{kind}_{name} not found")
        return self.spark.read.parquet(f"{self._sketch(kind, name)}/version={whole[-1]}")

    def compare_fingerprints(self, a: str, b: str) -> int:
        """Differing bits of two stored fingerprints, each a table of one row ``hi, lo``."""
        one, two = (self.load_sketch("simhash", n).select(F.struct("hi", "lo").alias(c)) for n, c in ((a, "x"), (b, "y")))
        return one.join(two, F.lit(True)).select(sketches.hamming("x", "y")).first()[0]

    def delete_sketch(self, kind: str, name: str) -> None:
        if kind == "simhash":
            raise ValueError("fingerprints can't be deleted")
        self.load_sketch(kind, name)
        self._fs.delete(self._p(self._sketch(kind, name)), True)

    def add_to_sketch(self, kind: str, name: str, items: DataFrame, item: str, **size: int) -> None:
        build = {"bf": sketches.bloom_build, "cms": sketches.cms_cells, "hll": sketches.hll_registers}[kind]
        merge = {"bf": lambda a, b: a.unionByName(b).distinct(), "cms": sketches.cms_merge, "hll": sketches.hll_merge}[kind]
        new = build(items, item, **size)
        try:
            new = merge(self.load_sketch(kind, name), new)
        except KeyNotFound:
            pass
        self.save_sketch(kind, name, new)
