"""Logs over tables, and the write-ahead log on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.codec import record_crc
from keystrata.model import LOG_SCHEMA, as_log


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return as_log(e, F.concat(F.lit("user"), F.lpad(F.col("user_id").cast("string"), 6, "0")), F.col("event_type"), F.col("event_id"), F.col("event_type") == "error")


def order_log(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return as_log(o, F.concat(F.lit("cust"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")), F.col("o_orderstatus"), F.col("o_orderkey"))


def bulk_load(spark: SparkSession, n: int = 100_000, distinct: int = 100) -> DataFrame:
    """The load workload: ``n`` puts over ``distinct`` keys."""
    i = F.col("id")
    return as_log(spark.range(n), F.concat(F.lit("key"), (i % distinct).cast("string")), F.concat(F.lit("value"), (i % distinct).cast("string")), i)


def append_wal(records: DataFrame, path: str, max_records_per_file: int = 1_000_000) -> None:
    """Append versions with their checksum; Spark rolls the files over."""
    records.withColumn("crc", record_crc()).write.mode("append").option("maxRecordsPerFile", max_records_per_file).parquet(path)


def wal_files(spark: SparkSession, path: str) -> list[str]:
    """The log's files as they are now."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path(path)):
        return []
    return sorted(f"{path}/{s.getPath().getName()}" for s in fs.listStatus(fs_path(path)) if s.getPath().getName().endswith(".parquet"))


def low_watermark(spark: SparkSession, path: str) -> int | None:
    """The version up to which the log needn't be replayed; None if it was never moved."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path(f"{path}/_lwm")):
        return None
    marks = [s.getPath().getName() for s in fs.listStatus(fs_path(f"{path}/_lwm"))]
    return max((int(m) for m in marks if m.lstrip("-").isdigit()), default=None)


def move_low_watermark(spark: SparkSession, path: str, newest: int) -> None:
    """Versions up to ``newest`` needn't be replayed. A mark is an empty file of that name, so it is there whole or not at all."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.create(fs_path(f"{path}/_lwm/{newest}"), True).close()


def read_wal(spark: SparkSession, path: str, after: int | None = None, verify: bool = True, files: list[str] | None = None) -> DataFrame:
    """Replay the log, or some of its ``files``, from the low watermark ``after`` on, the stored one if none is given.

    Fails on a checksum that doesn't match.
    """
    rows = spark.read.schema(f"{LOG_SCHEMA}, crc bigint").parquet(*(files or [path]))
    after = low_watermark(spark, path) if after is None else after
    if after is not None:
        rows = rows.where(F.col("ts") > after)
    if verify:
        # Not in a filter: next to a filter on the key, the optimizer would put that key into the checksum of other rows.
        checked = F.when(F.col("crc") == record_crc(), F.col("ts")).otherwise(F.raise_error(F.lit("CRC does not match")).cast("long"))
        rows = rows.withColumn("ts", checked)
    return rows.drop("crc")


def remove_files(spark: SparkSession, files: list[str]) -> None:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for f in files:
        fs_path(f).getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path(f), False)


def truncate_wal(spark: SparkSession, path: str, watermark: int) -> None:
    """Drop versions up to the low watermark: the rest of the files there now is appended as new files, then these go.

    A crash between the two leaves versions twice, which changes no result; what is appended meanwhile stays.
    """
    files = wal_files(spark, path)
    if files:
        rows = spark.read.schema(f"{LOG_SCHEMA}, crc bigint").parquet(*files)
        rows.where(F.col("ts") > watermark).write.mode("append").parquet(path)
        remove_files(spark, files)
