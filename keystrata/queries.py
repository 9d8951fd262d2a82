"""Queries over the driver tables, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.codec import decode_compact, decode_record, encode_compact, encode_record, record_crc
from keystrata.functions.hashing import fnv1, fnv_hex
from keystrata.model import LOG_SCHEMA, reserved_column
from keystrata.operators import integrity, merge, ratelimit, read, sketches
from keystrata.plans import compaction
from keystrata.sources.logs import append_wal, bulk_load, event_log, move_low_watermark, order_log, read_wal, table, truncate_wal
from keystrata.sources.scratch import materialize, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def shown(rows: DataFrame) -> DataFrame:
    """Versions with the value as text."""
    return rows.select("key", F.col("value").cast("string").alias("value"), "tombstone", "ts")


# SQL pieces. L: the event log; V: its newest versions; R: with levels and segments.
L = "l as (select 'user' || lpad(user_id::varchar, 6, '0') as key, case when event_type = 'error' then null else event_type end as value, event_type = 'error' as tombstone, event_id::bigint as ts from events)"
V = f"{L}, v as (select key, value, tombstone, ts from (select *, row_number() over (partition by key order by ts desc) as rn from l) where rn = 1)"
R = f"{L}, r as (select *, 1 as level, ts // 1000 as segment from l)"
RUNS = f"{R}, d as (select * from (select *, row_number() over (partition by segment, key order by ts desc) as rn from r) where rn = 1)"
COLUMNS = "key, value, tombstone, ts"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """The event log as runs of level 1: newest version of each key and segment of 1000 versions."""
    log = event_log(spark, sf).withColumn("segment", F.floor(F.col("ts") / 1000).cast("long"))
    newest = log.groupBy("segment", "key").agg(F.max_by(F.struct("value", "tombstone", "ts"), "ts").alias("v"))
    return newest.select(F.lit(1).alias("level"), "segment", "key", "v.*")


def sql_fnv(hexed: str, seed: str | None = None) -> str:
    """FNV-1 of the bytes in an upper-case hex string, as a HUGEINT."""
    tail = f"[0::hugeint, 0::hugeint, 0::hugeint, ({seed})::hugeint]" if seed else "[]::hugeint[]"
    digit = "(instr('0123456789ABCDEF', substr({h}, {i}, 1)) - 1)"
    byte = f"(16 * {digit.format(h=hexed, i='2 * i + 1')} + {digit.format(h=hexed, i='2 * i + 2')})::hugeint"
    items = f"list_transform(range(0, length({hexed}) // 2), lambda i: {byte})"
    return f"list_reduce(list_concat([14695981039346656037::hugeint], {items}, {tail}), lambda a, b: xor((a * 1099511628211::hugeint) % 18446744073709551616::hugeint, b))"


def hex_of(text: str) -> str:
    return f"hex(encode({text}))"


SQL_HEX = "lpad(lower(to_hex(({})::uhugeint)), 16, '0')"


# --- versions


@query(f"with {V} select {COLUMNS} from v")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return shown(merge.latest(event_log(spark, sf)))


@query(f"with {V} select {COLUMNS} from v where not tombstone")
def live_view(spark: SparkSession, sf: str) -> DataFrame:
    return shown(merge.live(event_log(spark, sf)))


@query("select key, value, false as tombstone, ts from (select 'cust' || lpad(o_custkey::varchar, 9, '0') as key, o_orderstatus as value, o_orderkey as ts, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders) where rn = 1")
def latest_orders(spark: SparkSession, sf: str) -> DataFrame:
    return shown(merge.latest(order_log(spark, sf)))


@query(f"with {L}, x as ({' union all '.join(['select key, value, tombstone, ts from l', *(f'select {k!r}, {v}, {t}, {n}' for k, v, t, n in (('user000001', 'null', 'true', 10**9), ('user000002', chr(39) + 'put' + chr(39), 'false', 10**9), ('zz_new', chr(39) + 'put' + chr(39), 'false', 10**9), ('zz_gone', 'null', 'true', 10**9)))])}) select {COLUMNS} from (select *, row_number() over (partition by key order by ts desc) as rn from x) where rn = 1 and not tombstone")
def put_and_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Writes are appended versions: an overwrite, an insert, a delete, and a blind delete."""
    rows = [("user000001", None, True, 10**9), ("user000002", bytearray(b"put"), False, 10**9), ("zz_new", bytearray(b"put"), False, 10**9), ("zz_gone", None, True, 10**9)]
    new = spark.createDataFrame(rows, "key string, value binary, tombstone boolean, ts bigint")
    return shown(merge.live(event_log(spark, sf).unionByName(new)))


@query(f"with {L} select tombstone, count(*) as n, count(distinct key) as keys from l group by tombstone")
def tombstone_stats(spark: SparkSession, sf: str) -> DataFrame:
    return event_log(spark, sf).groupBy("tombstone").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query(f"with {L} select max(ts) as newest_ts from l")
def newest_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return merge.newest_timestamp(event_log(spark, sf))


@query(f"with {L} select key, row_number() over (order by first_ts, key) as id from (select key, min(ts) as first_ts from l group by key)")
def key_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return merge.key_dictionary(event_log(spark, sf))


@query("select key, value, max(i) as ts from (select i, 'key' || (i % 50000) as key, 'value' || (i % 50000) as value from range(100000) t(i)) group by key, value")
def bulk_load_latest(spark: SparkSession, sf: str) -> DataFrame:
    return shown(merge.latest(bulk_load(spark, 100_000, 50_000))).select("key", "value", "ts")


@query(f"with {L} select key, regexp_matches(key, '^(tb_|bf_|cms_|hll_|simhash_)') as reserved from (select key from l union select unnest(['tb_', 'bf_x', 'cms_', 'hll_', 'simhash_a', 'tb', '_bf_']))")
def reserved_keys(spark: SparkSession, sf: str) -> DataFrame:
    some = spark.createDataFrame([(k,) for k in ("tb_", "bf_x", "cms_", "hll_", "simhash_a", "tb", "_bf_")], "key string")
    return event_log(spark, sf).select("key").distinct().unionByName(some).select("key", reserved_column().alias("reserved"))


# --- reads


@query(f"with {V} select {COLUMNS} from v where key = 'user000042' and not tombstone")
def get_point(spark: SparkSession, sf: str) -> DataFrame:
    return shown(read.get_row(event_log(spark, sf), "user000042"))


@query(f"with {V} select {COLUMNS} from v where not tombstone and key in (select 'user' || lpad((c_custkey % 200)::varchar, 6, '0') from customer)")
def multi_get(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "customer").select(F.concat(F.lit("user"), F.lpad((F.col("c_custkey") % 200).cast("string"), 6, "0")).alias("key"))
    return shown(read.multi_get(event_log(spark, sf), keys))


@query(f"with {V} select {COLUMNS} from v where starts_with(key, 'user00001') order by key limit 4 offset 4")
def prefix_scan_page(spark: SparkSession, sf: str) -> DataFrame:
    return shown(read.prefix_scan(event_log(spark, sf), "user00001", 2, 4))


@query(f"with {V} select {COLUMNS} from v where key between 'user000010' and 'user000099' order by key limit 10 offset 10")
def range_scan_page(spark: SparkSession, sf: str) -> DataFrame:
    return shown(read.range_scan(event_log(spark, sf), "user000010", "user000099", 2, 10))


@query(f"with {V} select {COLUMNS} from v where key between 'user000010' and 'user000099' and not tombstone order by key limit 10 offset 10")
def range_scan_live(spark: SparkSession, sf: str) -> DataFrame:
    return shown(read.range_scan(event_log(spark, sf), "user000010", "user000099", 2, 10, include_tombstones=False))


@query(f"with {V} select {COLUMNS} from v where key between 'user000010' and 'user000099' and false")
def scan_past_end(spark: SparkSession, sf: str) -> DataFrame:
    return shown(read.range_scan(event_log(spark, sf), "user000010", "user000099", 1000, 10))


@query(f"with {V} select {COLUMNS} from v where starts_with(key, 'user') and key > 'user000050' order by key limit 20")
def cursor_next_keyset(spark: SparkSession, sf: str) -> DataFrame:
    return shown(read.after(read.prefix_rows(event_log(spark, sf), "user"), "user000050", 20))


@query(f"with {V} select {COLUMNS} from v where starts_with(key, 'user0000') order by key")
def prefix_scan_all(spark: SparkSession, sf: str) -> DataFrame:
    return shown(read.prefix_rows(event_log(spark, sf), "user0000").orderBy("key"))


@query(f"with {V}, n as (select *, row_number() over (order by key) as step from v where key between 'user000010' and 'user000099') select step, {COLUMNS} from (select step, {COLUMNS} from n union all select 2 * (select count(*) from n) + 1 - step, {COLUMNS} from n)")
def range_iterator_walk(spark: SparkSession, sf: str) -> DataFrame:
    """A range iterator to its end, and by Previous back to its start: Previous after a failed Next gives the last row again."""
    return _walk(read.range_iterate(event_log(spark, sf), "user000010", "user000099", 16), spark)


@query(f"with {V}, n as (select *, row_number() over (order by key) as step from v where starts_with(key, 'user00002')) select step, {COLUMNS} from (select step, {COLUMNS} from n union all select 2 * (select count(*) from n) + 1 - step, {COLUMNS} from n)")
def prefix_iterator_walk(spark: SparkSession, sf: str) -> DataFrame:
    return _walk(read.prefix_iterate(event_log(spark, sf), "user00002", 4), spark)


def _walk(cursor: read.Cursor, spark: SparkSession) -> DataFrame:
    """The rows that a caller sees who calls Next to the end and then Previous to the start; a cursor's rows come to its caller one by one."""
    seen = [cursor.current] if cursor.current else []
    for move in (cursor.next, cursor.previous):
        try:
            while seen:
                seen.append(move())
        except StopIteration:
            pass
    cursor.stop()
    rows = [(i, r["key"], None if r["value"] is None else bytes(r["value"]).decode(), r["tombstone"], r["ts"]) for i, r in enumerate(seen, 1)]
    return spark.createDataFrame(rows, "step long, key string, value string, tombstone boolean, ts long")


# --- the log on storage


@query(f"with {L}, m as (select max(ts) // 2 as mark from l) select {COLUMNS} from l, m where ts > mark")
def wal_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The log written in small files, its low watermark moved, and replayed from there."""
    path, log = new_path(spark, "wal"), event_log(spark, sf)
    append_wal(log, path, 1_000)
    move_low_watermark(spark, path, log.agg(F.max("ts")).first()[0] // 2)
    return shown(read_wal(spark, path))


@query(f"with {L}, m as (select max(ts) // 3 as mark from l) select {COLUMNS} from l, m where ts > mark union all select 'late', 'x', false, 10000000000 from m")
def wal_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """The log cut at a watermark, with a version that came later."""
    path, log = new_path(spark, "wal"), event_log(spark, sf)
    append_wal(log, path)
    truncate_wal(spark, path, log.agg(F.max("ts")).first()[0] // 3)
    append_wal(spark.createDataFrame([("late", bytearray(b"x"), False, 10**10)], LOG_SCHEMA), path)
    return shown(read_wal(spark, path))


@query(f"with {L} select {COLUMNS}, true as crc_ok from l")
def compact_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Records with variable-length numbers and keys as numbers, written and read back."""
    log = event_log(spark, sf)
    words = materialize(merge.key_dictionary(log), "dictionary")
    return shown_ok(decode_compact(materialize(encode_compact(log, words), "records"), words))


# --- runs


def compacted(r: DataFrame, plan: Callable[[list[compaction.Run]], list[list[compaction.Run]]]) -> DataFrame:
    """All runs of level 1 after the merges of a plan: each group as a run of level 2 named by its oldest segment, and the runs in no group."""
    zones = [compaction.Run(z["level"], z["segment"], z["min_key"], z["max_key"]) for z in compaction.zone_map(r).collect()]  # one row a run
    moves = [(run.segment, 2, min(g.segment for g in group)) for group in plan(zones) for run in group]
    to = r.sparkSession.createDataFrame(moves, "segment long, new_level int, run long")
    placed = r.join(F.broadcast(to), "segment", "left").withColumn("level", F.coalesce("new_level", "level")).withColumn("segment", F.coalesce("run", "segment"))
    merged = placed.groupBy("level", "segment", "key").agg(F.max_by(F.struct("value", "tombstone", "ts"), "ts").alias("v")).select("level", "segment", "key", "v.*")
    return merged.withColumn("value", F.col("value").cast("string"))


SQL_COMPACTED = f"m as (select h.level, h.run as segment, {COLUMNS}, row_number() over (partition by h.run, key order by ts desc) as rm from d join h using (segment)) select level, segment, {COLUMNS} from m where rm = 1"


@query(f"with {RUNS}, s as (select segment, row_number() over (order by segment) - 1 as i, count(*) over () as n from (select distinct segment from d)), g as (select segment, i < n - n % 2 as whole, i // 2 as grp from s), h as (select segment, case when whole then 2 else 1 end as level, case when whole then min(segment) over (partition by grp) else segment end as run from g), {SQL_COMPACTED}")
def merge_runs_tiered(spark: SparkSession, sf: str) -> DataFrame:
    """Every full group of two runs merged, over the whole log; a run left over stays on level 1."""
    return compacted(runs(spark, sf), lambda zones: compaction.tiered(zones, 1, 2))


@query(f"with {RUNS}, z as (select segment, min(key) as lo, max(key) as hi from d group by segment), p as (select *, max(hi) over (order by lo, segment rows between unbounded preceding and 1 preceding) as seen from z), o as (select segment, sum(case when seen is null or lo > seen then 1 else 0 end) over (order by lo, segment rows unbounded preceding) as island from p), h as (select segment, 2 as level, min(segment) over (partition by island) as run from o), {SQL_COMPACTED}")
def merge_runs_leveled(spark: SparkSession, sf: str) -> DataFrame:
    """Every run of level 1, oldest first, merged with the runs of level 2 that it overlaps, over the whole log."""
    return compacted(runs(spark, sf), lambda zones: compaction.leveled_groups(zones, 1))


@query(f"with {RUNS} select level, segment, min(key) as min_key, max(key) as max_key, count(*) as n from d group by level, segment")
def segment_zone_map(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.zone_map(runs(spark, sf))


@query(f"with {RUNS}, z as (select level, segment, min(key) as lo, max(key) as hi from d group by level, segment) select a.level, a.segment as a, b.segment as b from z a join z b on a.level = b.level and a.segment < b.segment and a.lo <= b.hi and a.hi >= b.lo")
def segment_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Overlaps of all runs, with all their keys."""
    return compaction.overlaps(compaction.zone_map(runs(spark, sf)))


@query(f"with {RUNS}, c as (select level, count(distinct segment) as n from d group by level) select level, n as runs, n >= 2 as tiered_due, n >= 3 * power(2, level - 1) as leveled_due from c")
def level_compaction_plan(spark: SparkSession, sf: str) -> DataFrame:
    counts = runs(spark, sf).groupBy("level").agg(F.count_distinct("segment").alias("runs"))
    return counts.select("level", "runs", compaction.due(counts, "sizetiered").alias("tiered_due"), compaction.due(counts, "leveled", 2, 2).alias("leveled_due"))


# --- hashes and sketches

NAMES = "select distinct c_name as item from customer"


@query(f"select item, {SQL_HEX.format(sql_fnv(hex_of('item')))} as h from ({NAMES} union all select '' union all select 'žćš')")
def fnv1_keys(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").select(F.col("c_name").alias("item")).distinct()
    more = spark.createDataFrame([("",), ("žćš",)], "item string")
    return names.unionByName(more).select("item", fnv_hex(fnv1(F.col("item"))).alias("h"))


@query(f"select item, seed, {SQL_HEX.format(sql_fnv(hex_of('item'), 'seed'))} as h from ({NAMES}), (values (1), (2), (3)) s(seed)")
def fnv1_seeded(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").select(F.col("c_name").alias("item")).distinct()
    return names.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("item", "seed", fnv_hex(fnv1(F.col("item"), F.col("seed"))).alias("h"))


@query("select n, p, floor(-n * ln(p) / power(ln(2), 2))::bigint as m, floor(floor(-n * ln(p) / power(ln(2), 2)) / n * ln(2))::bigint as k from (values (100::bigint, 0.0001::double), (1500, 0.01), (100000, 0.001)) t(n, p)")
def bloom_params(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(n, p, *sketches.bloom_size(n, p)) for n, p in ((100, 0.0001), (1500, 0.01), (100_000, 0.001))]
    return spark.createDataFrame(rows, "n long, p double, m long, k long")


SQL_SIZED = f"c as (select count(*) as n from ({NAMES} where c_custkey % 3 <> 0)), s as (select floor(-n * ln(0.01) / power(ln(2), 2))::bigint as m, floor(floor(-n * ln(0.01) / power(ln(2), 2)) / n * ln(2))::bigint as k from c)"
SQL_SIZED_POSITION = f"({sql_fnv(hex_of('item'), 'seed')} % m)::bigint"


@query(f"with {SQL_SIZED}, q as (select item, {SQL_SIZED_POSITION} as pos from (select item, m, unnest(range(1, k + 1)) as seed from ({NAMES}), s)), b as (select distinct pos from q where item in ({NAMES} where c_custkey % 3 <> 0)) select item, count(b.pos) = count(*) as present from q left join b using (pos) group by item")
def bloom_probe(spark: SparkSession, sf: str) -> DataFrame:
    """A filter sized by the count of the distinct names that it holds; a third of the names is absent."""
    names = table(spark, sf, "customer")
    held = names.where("c_custkey % 3 <> 0")
    size = sketches.bloom_size(held.select("c_name").distinct().count(), 0.01)
    return sketches.bloom_probe(sketches.bloom_build(held, "c_name", *size), names, "c_name", *size)


SQL_BLOOM = f"c as (select count(*) as n from ({NAMES})), s as (select floor(-n * ln(0.01) / power(ln(2), 2))::bigint as m, floor(floor(-n * ln(0.01) / power(ln(2), 2)) / n * ln(2))::bigint as k from c), b as (select distinct {SQL_SIZED_POSITION} as pos from (select item, m, unnest(range(1, k + 1)) as seed from ({NAMES}), s))"


def named_filter(spark: SparkSession, sf: str) -> tuple[DataFrame, int, int]:
    """The bits of a filter of all names, sized by their count, with its bits and hash functions."""
    names = table(spark, sf, "customer")
    size = sketches.bloom_size(names.select("c_name").distinct().count(), 0.01)
    return sketches.bloom_build(names, "c_name", *size), *size


@query(f"with {SQL_BLOOM} select pos from b")
def bloom_build(spark: SparkSession, sf: str) -> DataFrame:
    return named_filter(spark, sf)[0]


def digest(sketch: DataFrame) -> DataFrame:
    """``bytes, md5`` of the hexadecimal form of one binary."""
    return sketch.select(F.octet_length("sketch").cast("bigint").alias("bytes"), F.md5(F.hex("sketch").cast("binary")).alias("md5"))


def sql_digest(hexed: str, source: str) -> str:
    return f"select (length(x) // 2)::bigint as bytes, md5(x) as md5 from (select {hexed} as x from {source})"


SQL_BLOOM_HEX = "lpad(upper(to_hex(m)), 8, '0') || lpad(upper(to_hex(k)), 8, '0') || (select string_agg(case when b.pos is null then '00' else '01' end, '' order by i) from range((select m from s)) t(i) left join b on b.pos = i) || (select string_agg(lpad(upper(to_hex(i)), 8, '0'), '' order by i) from range(1, (select k from s) + 1) t(i))"


@query(f"with {SQL_BLOOM} {sql_digest(SQL_BLOOM_HEX, 's')}")
def bloom_codec(spark: SparkSession, sf: str) -> DataFrame:
    """The filter as one binary, from bits that went through a binary before."""
    bits, m, k = named_filter(spark, sf)
    return digest(sketches.bloom_pack(sketches.bloom_unpack(sketches.bloom_pack(bits, m, k), m), m, k))


@query("select e as epsilon, d as delta, ceil(exp(1) / e)::bigint as m, ceil(ln(exp(1) / d))::bigint as k from (values (0.01::double, 0.01::double), (0.001, 0.05)) t(e, d)")
def cms_params(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(e, d, *sketches.cms_size(e, d)) for e, d in ((0.01, 0.01), (0.001, 0.05))], "epsilon double, delta double, m long, k long")


CMS = sketches.cms_size(0.01, 0.01)
SQL_CELLS = f"{L}, i as (select key as item, count(*) as n from l group by key), c as (select item, n, seed - 1 as row, ({sql_fnv(hex_of('item'), 'seed')} % {CMS[0]})::bigint as col from i, range(1, {CMS[1] + 1}) s(seed)), t as (select row, col, sum(n)::bigint as cnt from c group by row, col)"


@query(f"with {SQL_CELLS} select row::int as row, col, cnt from t")
def cms_cells(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.cms_cells(event_log(spark, sf), "key", *CMS)


@query(f"with {SQL_CELLS} select item, min(cnt) as freq from c join t using (row, col) group by item")
def cms_frequency(spark: SparkSession, sf: str) -> DataFrame:
    log = event_log(spark, sf)
    return sketches.cms_frequency(sketches.cms_cells(log, "key", *CMS), log, "key", *CMS)


SQL_CMS_HEX = f"'{CMS[0]:08X}{CMS[1]:08X}' || (select string_agg(lpad(upper(to_hex(coalesce(cnt, 0))), 8, '0'), '' order by i) from range({CMS[0] * CMS[1]}) g(i) left join t on t.row * {CMS[0]} + t.col = i) || '{''.join(f'{k:08X}' for k in range(1, CMS[1] + 1))}'"


@query(f"with {SQL_CELLS} {sql_digest(SQL_CMS_HEX, '(select 1)')}")
def cms_codec(spark: SparkSession, sf: str) -> DataFrame:
    cells = sketches.cms_cells(event_log(spark, sf), "key", *CMS)
    return digest(sketches.cms_pack(sketches.cms_unpack(sketches.cms_pack(cells, *CMS), *CMS), *CMS))


SQL_HLL = f"h as (select {sql_fnv(hex_of('item'), '1')} as h from ({NAMES})), g as (select (h // 18014398509481984)::int as bucket, max((case when h = 0 then 64 else bit_count(xor(h, h - 1)) - 1 end) + 1)::int as rank from (select h::hugeint as h from h) group by 1)"


@query(f"with {SQL_HLL} select bucket, rank from g")
def hll_registers(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.hll_registers(table(spark, sf, "customer"), "c_name", 10).select(F.col("bucket").cast("int").alias("bucket"), F.col("rank").cast("int").alias("rank"))


@query(f"with {SQL_HLL}, e as (select 0.7213 / (1 + 1.079 / 1024) * 1024 * 1024 / (sum(power(2.0, -rank)) + 1024 - count(*)) as e, 1024 - count(*) as empty from g) select round(case when e <= 2560 and empty > 0 then 1024 * ln(1024 / empty::double) when e > power(2, 32) / 30 then -power(2, 32) * ln(1 - e / power(2, 32)) else e end, 4)::double as estimate from e")
def hll_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.hll_estimate(sketches.hll_registers(table(spark, sf, "customer"), "c_name", 10), 10)


SQL_HLL_HEX = "'00000000000004000A' || (select string_agg(lpad(upper(to_hex(coalesce(rank, 0))), 2, '0'), '' order by i) from range(1024) t(i) left join g on g.bucket = i) || '00000001'"


@query(f"with {SQL_HLL} {sql_digest(SQL_HLL_HEX, '(select 1)')}")
def hll_codec(spark: SparkSession, sf: str) -> DataFrame:
    registers = sketches.hll_registers(table(spark, sf, "customer"), "c_name", 10)
    return digest(sketches.hll_pack(sketches.hll_unpack(sketches.hll_pack(registers, 10), 10), 10))


@query()
def approx_distinct_native(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").agg(F.approx_count_distinct("c_name").alias("estimate"))


_stop = ", ".join(f"'{w}'" for w in sketches.STOP_WORDS)
_bits = lambda lo, hi: " + ".join(f"(case when sum(n * (2 * ((h // {1 << k}::hugeint) % 2) - 1)) > 0 then {1 << k}::hugeint else 0 end)" for k in range(lo, hi))
SQL_SIMHASH = f"w as (select doc_id as id, list_filter(string_split(lower(coalesce(text, '')), ' '), lambda x: x not in ({_stop})) as ws from documents), p as (select id, word, count(*) as n from (select id, unnest(case when len(ws) = 0 then [''] else ws end) as word from w) group by id, word), u as (select word, {sql_fnv(hex_of('word'))} as h from (select distinct word from p)), f as (select id, ({_bits(0, 64)}) as fp from p join u using (word) group by id)"


@query(f"with {SQL_SIMHASH} select id, {SQL_HEX.format('fp')} as fingerprint from f")
def simhash_docs(spark: SparkSession, sf: str) -> DataFrame:
    stored = sketches.simhash(table(spark, sf, "documents"), "doc_id", "text").select("id", sketches.simhash_pack().alias("packed"))
    return stored.select("id", fnv_hex(sketches.simhash_unpack(F.col("packed"))).alias("fingerprint"))


@query(f"with {SQL_SIMHASH} select a.id as a, b.id as b, bit_count(xor(a.fp, b.fp))::int as distance from f a join f b on b.id = a.id + 1")
def simhash_hamming_pairs(spark: SparkSession, sf: str) -> DataFrame:
    f = sketches.simhash(table(spark, sf, "documents"), "doc_id", "text").select("id", F.struct("hi", "lo").alias("fp"))
    pairs = f.select(F.col("id").alias("a"), F.col("fp").alias("x")).join(f.select(F.col("id").alias("b"), F.col("fp").alias("y")), F.expr("b = a + 1"))
    return pairs.select("a", "b", sketches.hamming("x", "y").alias("distance"))


# --- integrity

_crc_step = "list_reduce([xor({c}, {b}), 0::hugeint, 0::hugeint, 0::hugeint, 0::hugeint, 0::hugeint, 0::hugeint, 0::hugeint, 0::hugeint], lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384::hugeint) else x // 2 end)".format(c="c", b="b")
SQL_PAYLOAD = "lpad(upper(to_hex(ts)), 16, '0') || case when tombstone then '01' else '00' end || lpad(upper(to_hex(length(encode(key)::blob::varchar)::bigint)), 16, '0') || {value} || hex(encode(key)) || coalesce(hex(encode(value)), '')"
IN_LOG = SQL_PAYLOAD.replace("length(encode(key)::blob::varchar)::bigint", "strlen(key)").format(value="lpad(upper(to_hex(coalesce(strlen(value), 0))), 16, '0')")
IN_RUN = SQL_PAYLOAD.replace("length(encode(key)::blob::varchar)::bigint", "strlen(key)").format(value="case when tombstone then '' else lpad(upper(to_hex(strlen(value))), 16, '0') end")


def sql_bytes(hexed: str) -> str:
    digit = "(instr('0123456789ABCDEF', substr({h}, {i}, 1)) - 1)"
    return f"list_transform(range(0, length({hexed}) // 2), lambda i: (16 * {digit.format(h=hexed, i='2 * i + 1')} + {digit.format(h=hexed, i='2 * i + 2')})::hugeint)"


@query(f"with {L}, x as (select *, {IN_LOG} as p from l) select key, ts, xor(list_reduce(list_concat([4294967295::hugeint], {sql_bytes('p')}), lambda c, b: {_crc_step}), 4294967295::hugeint)::bigint as crc from x")
def record_crcs(spark: SparkSession, sf: str) -> DataFrame:
    return event_log(spark, sf).select("key", "ts", record_crc().alias("crc"))


@query(f"with {L} select {COLUMNS}, true as crc_ok from l")
def record_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return shown_ok(decode_record(event_log(spark, sf).select(encode_record().alias("record"))))


def shown_ok(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.col("value").cast("string").alias("value"), "tombstone", "ts", "crc_ok")


SQL_CRC = f"xor(list_reduce(list_concat([4294967295::hugeint], {sql_bytes('p')}), lambda c, b: {_crc_step}), 4294967295::hugeint)"
SQL_LEAVES = f"{RUNS}, o as (select segment, row_number() over (partition by segment order by key, ts) - 1 as idx, {IN_RUN} as p from d), e as (select segment, idx, lpad(upper(to_hex({SQL_CRC}::bigint)), 8, '0') || p as p from o), m as (select segment, idx, {SQL_HEX.format(sql_fnv('p', '1'))} as h from e)"


@query(f"with {SQL_LEAVES} select segment, idx, h from m")
def merkle_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.merkle_leaves(runs(spark, sf))


# Trees of any height: a level's nodes are paired until one is left. The empty record is 25 zero bytes after their checksum.
_empty_payload = f"(select {SQL_CRC}::bigint from (select repeat('00', 25) as p))"
SQL_NODES = f"""{SQL_LEAVES}, s as (select segment, count(*) as n, power(2, ceil(log2(count(*))))::bigint as size from m group by segment),
z as (select {SQL_HEX.format(sql_fnv('x', '1'))} as h from (select lpad(upper(to_hex({_empty_payload})), 8, '0') || repeat('00', 25) as x)),
n0 as (select segment, idx, h from m union all select segment, i as idx, z.h from (select segment, unnest(range(n, size)) as i from s), z),
t as (select segment, 0 as level, list(h order by idx) as hs from n0 group by segment
  union all select segment, level + 1, list_transform(range(1, len(hs) // 2 + 1), lambda i: {SQL_HEX.format(sql_fnv("upper(hs[2 * i - 1] || hs[2 * i])", '1')).replace('lambda i:', 'lambda y:').replace('2 * i + 1', '2 * y + 1').replace('2 * i + 2', '2 * y + 2')}) from t where len(hs) > 1)"""


@query(f"with recursive {SQL_NODES} select segment, hs[1] as h from t where len(hs) = 1")
def merkle_root(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.merkle_root(integrity.merkle_leaves(runs(spark, sf)))


@query(f"with recursive {SQL_NODES}, u as (select segment, level, unnest(range(len(hs))) as idx, unnest(hs) as h from t) select segment, level, idx, h from u where level > 0 or idx < (select n from s where s.segment = u.segment)")
def merkle_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """All nodes of all trees: what is stored of a tree, without the leaves that only pad it."""
    return integrity.merkle_nodes(integrity.merkle_leaves(runs(spark, sf)))


@query(f"with {RUNS} select segment, {COLUMNS} from (select segment, key, case when ts % 97 = 0 and not tombstone then 'flipped' else value end as value, tombstone, ts from d) where ts % 97 = 0 and not tombstone")
def check_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that were changed since their runs were sealed."""
    r = runs(spark, sf)
    hit = (F.col("ts") % 97 == 0) & ~F.col("tombstone")
    changed = r.withColumn("value", F.when(hit, F.lit("flipped").cast("binary")).otherwise(F.col("value")))
    bad = integrity.verify_segment(changed, integrity.merkle_leaves(r))
    return bad.select("segment", "key", F.col("value").cast("string").alias("value"), "tombstone", "ts")


@query(f"with {RUNS}, e as (select segment, row_number() over (partition by segment order by key, ts) - 1 as idx, ts, tombstone from d) select segment, idx from e where ts % 97 = 0 and not tombstone")
def merkle_corrupted(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves that differ after the values of some versions were changed."""
    r = runs(spark, sf)
    hit = (F.col("ts") % 97 == 0) & ~F.col("tombstone")
    changed = r.withColumn("value", F.when(hit, F.lit("flipped").cast("binary")).otherwise(F.col("value")))
    return integrity.corrupted(integrity.merkle_leaves(changed), integrity.merkle_leaves(r))


# --- rate limits

PERIOD = 259_200


SQL_BUCKETS = f"""with recursive o as (select user_id, event_id, epoch_us(ts) // 1000000 as t, row_number() over (partition by user_id order by epoch_us(ts) // 1000000, event_id) as rn from events),
r as (select user_id, event_id, rn, t, 2 as tokens, t as last, true as ok from o where rn = 1
union all select o.user_id, o.event_id, o.rn, o.t, case when o.t - r.last > {PERIOD} then 2 when r.tokens > 0 then r.tokens - 1 else 0 end, case when o.t - r.last > {PERIOD} then o.t else r.last end, o.t - r.last > {PERIOD} or r.tokens > 0 from r join o on o.user_id = r.user_id and o.rn = r.rn + 1)"""


@query(f"{SQL_BUCKETS} select user_id::varchar as bucket, t as op_ts, event_id as seq, ok as allowed from r")
def token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    ops = table(spark, sf, "events").select(F.col("user_id").alias("bucket"), F.floor(F.unix_micros(F.col("ts").cast("timestamp_ltz")) / 1_000_000).alias("op_ts"), F.col("event_id").alias("seq"))
    return ratelimit.token_bucket(ops, 3, PERIOD).drop("state")


def _varint_hex(x: str) -> str:
    """A number as a variable-length one in hexadecimal: five groups of seven bits at most."""
    return " || ".join(f"case when {k} = 0 or ({x}) >> {7 * k} > 0 then lpad(upper(to_hex((({x}) >> {7 * k}) & 127 | case when ({x}) >> {7 * k + 7} > 0 then 128 else 0 end)), 2, '0') else '' end" for k in range(5))


@query(f"{SQL_BUCKETS} select user_id::varchar as bucket, {_varint_hex('tokens')} || {_varint_hex('last')} as state from r qualify row_number() over (partition by user_id order by rn desc) = 1")
def bucket_states(spark: SparkSession, sf: str) -> DataFrame:
    """What is stored of each bucket after its last operation."""
    ops = table(spark, sf, "events").select(F.col("user_id").alias("bucket"), F.floor(F.unix_micros(F.col("ts").cast("timestamp_ltz")) / 1_000_000).alias("op_ts"), F.col("event_id").alias("seq"))
    return ratelimit.bucket_states(ops, 3, PERIOD).select("bucket", F.hex("state").alias("state"))


@query("select op, cost from (values ('put', 1), ('get', 1), ('delete', 1), ('sketch_write', 1), ('scan', 0), ('iterate', 0), ('sketch_read', 0), ('sketch_delete', 0)) t(op, cost)")
def operation_costs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(ratelimit.COST.items()), "op string, cost int")
