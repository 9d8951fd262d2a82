import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from keystrata import queries
from keystrata.config import Config
from keystrata.functions import codec
from keystrata.functions.hashing import fnv1, fnv_hex
from keystrata.model import LOG_SCHEMA, KeyNotFound
from keystrata.operators import integrity, merge, ratelimit, read, sketches
from keystrata.operators.order import positions
from keystrata.plans import compaction
from keystrata.sources import logs
from keystrata.store import RateLimited, Store
from keystrata.streaming import ingest

SF = "/root/testdata/sf0.001"


def log(spark, rows):
    return spark.createDataFrame([(k, None if v is None else bytearray(v.encode()), v is None, t) for k, v, t in rows], LOG_SCHEMA)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("customer", "orders", "events", "documents"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_oracle(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    if name not in queries.ORACLES:
        assert got.count() == 1
        return
    columns = sorted(got.columns)
    assert sorted(con.sql(queries.ORACLES[name]).columns) == columns
    want = con.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["merge_runs_tiered", "merge_runs_leveled"])
def test_every_run_is_compacted(spark, name):
    """At a scale with ten runs: equal to the SQL, and no newest version is missing."""
    folder, c = "/root/testdata/sf0.01", duckdb.connect()
    c.sql(f"create view events as select * from '{folder}/events.parquet'")
    got = queries.QUERIES[name](spark, folder).cache()
    columns = sorted(got.columns)
    want = c.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))
    whole = queries.QUERIES["latest_per_key"](spark, folder)
    assert whole.exceptAll(got.select(whole.columns)).count() == 0


def test_all_overlaps_and_a_filter_of_the_right_size(spark):
    """At sf0.1. FNV's seeds give positions close together, so a filter of the right size is far above its rate of 0.01."""
    folder = "/root/testdata/sf0.1"
    zones = queries.QUERIES["segment_zone_map"](spark, folder).collect()
    want = {(a.segment, b.segment) for a in zones for b in zones if a.segment < b.segment and a.min_key <= b.max_key and a.max_key >= b.min_key}
    assert {(r.a, r.b) for r in queries.QUERIES["segment_overlap"](spark, folder).collect()} == want
    absent = logs.table(spark, folder, "customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("item")).distinct()
    present = queries.QUERIES["bloom_probe"](spark, folder)
    assert present.join(absent, "item").agg(F.avg(F.col("present").cast("int"))).first()[0] < 0.2
    assert present.join(absent, "item", "left_anti").where("not present").count() == 0


def test_leveled_groups():
    runs = [compaction.Run(1, 3, "d", "e"), compaction.Run(1, 1, "a", "b"), compaction.Run(1, 2, "m", "n"), compaction.Run(2, 0, "b", "d"), compaction.Run(2, 9, "x", "z")]
    groups = compaction.leveled_groups(runs, 1)
    assert sorted(sorted(r.segment for r in g) for g in groups) == [[0, 1, 3], [2], [9]]


def test_newest_wins_and_tombstones(spark):
    df = log(spark, [("k", "a", 1), ("k", "c", 3), ("k", None, 2)])
    assert bytes(read.get(df, "k")) == b"c"
    gone = df.unionByName(log(spark, [("k", None, 4)]))
    with pytest.raises(KeyNotFound):
        read.get(gone, "k")
    assert read.prefix_scan(gone, "k", 1, 5).collect()[0]["value"] is None
    assert read.prefix_scan(gone, "k", 1, 5, include_tombstones=False).collect() == []


def test_pages_and_ranges(spark):
    df = log(spark, [(k, "v", i) for i, k in enumerate(["a", "ab", "abc", "b"])])
    keys = lambda rows: [r["key"] for r in rows.collect()]
    assert keys(read.prefix_scan(df, "ab", 1, 9)) == ["ab", "abc"]
    assert keys(read.range_scan(df, "ab", "b", 1, 9)) == ["ab", "abc", "b"]
    assert keys(read.prefix_scan(df, "", 2, 2)) == ["abc", "b"]
    assert keys(read.prefix_scan(df, "", 3, 2)) == keys(read.prefix_scan(df, "", 0, 2)) == keys(read.prefix_scan(df, "", 1, 0)) == []
    with pytest.raises(ValueError, match="invalid range given"):
        read.range_scan(df, "b", "a", 1, 1)
    with pytest.raises(ValueError, match="invalid prefix"):
        read.prefix_scan(df, "bf_x", 1, 1)


def test_cursor_walks(spark):
    df = log(spark, [(f"k{i}", "v", i) for i in range(5)])
    c = read.prefix_iterate(df, "k", fetch=2)
    assert c.current["key"] == "k0"
    assert [c.next()["key"] for _ in range(4)] == ["k1", "k2", "k3", "k4"]
    with pytest.raises(StopIteration):
        c.next()
    assert c.previous()["key"] == "k4" and c.previous()["key"] == "k3"
    c.stop()
    with pytest.raises(RuntimeError):
        c.next()
    empty = read.range_iterate(df, "x", "y")
    assert empty.current is None
    with pytest.raises(StopIteration):
        empty.previous()


@pytest.mark.parametrize("size", [1, 7, 100])
def test_merge_does_not_depend_on_runs(spark, size):
    df = logs.event_log(spark, SF)
    parts = [merge.latest(df.where(F.col("ts") % size == i)) for i in range(min(size, 5))]
    rest = df.where(F.col("ts") % size >= 5)
    key = lambda d: sorted(map(str, d.select("key", "value", "tombstone", "ts").collect()))
    assert key(merge.merge_runs([*parts, rest])) == key(merge.latest(df))


def test_fnv_vectors(spark):
    rows = [("", "cbf29ce484222325"), ("a", "af63bd4c8601b7be"), ("foobar", "340d8765a4dda9c2"), ("key99", "d5b41c71fdc93874"), ("žćš", "4d3d11779722350d")]
    df = spark.createDataFrame(rows, "x string, want string")
    assert df.where(fnv_hex(fnv1(F.col("x"))) != F.col("want")).count() == 0


def test_codecs_round_trip(spark):
    df = log(spark, [("k", "value", 5), ("", "", 1), ("ž", None, 2**40)])
    for in_log in (False, True):
        back = codec.decode_record(df.select(codec.encode_record(in_log).alias("record")), in_log=in_log)
        assert back.where("not crc_ok").count() == 0
        assert sorted(map(str, back.select("key", "value", "tombstone", "ts").collect())) == sorted(map(str, df.collect()))
    broken = df.select(F.unhex(F.concat(F.hex(F.substring(codec.encode_record(), F.lit(1), F.octet_length(codec.encode_record()) - 1)), F.lit("07"))).alias("record"))
    assert not any(r.crc_ok for r in codec.decode_record(broken.limit(1)).collect())
    words = merge.key_dictionary(df)
    small = codec.decode_compact(codec.encode_compact(df, words), words)
    assert sorted(map(str, small.select("key", "value", "tombstone", "ts").collect())) == sorted(map(str, df.collect()))


def test_sizes():
    assert sketches.bloom_size(100, 0.0001) == (1917, 13) and sketches.bloom_size(1500, 0.01) == (14377, 6)
    assert sketches.cms_size(0.01, 0.01) == (272, 6)


def test_sketch_properties(spark):
    names = spark.createDataFrame([(f"n{i % 40}",) for i in range(200)], "x string")
    bits = sketches.bloom_build(names, "x", 1917, 13)
    assert sketches.bloom_probe(bits, names, "x", 1917, 13).where("not present").count() == 0
    cells = sketches.cms_cells(names, "x", 27, 3)
    assert sketches.cms_frequency(cells, names, "x", 27, 3).where("freq < 5").count() == 0
    a, b = names.where("x < 'n2'"), names.where("x >= 'n2'")
    pairs = [(sketches.cms_merge(sketches.cms_cells(a, "x", 27, 3), sketches.cms_cells(b, "x", 27, 3)), cells), (sketches.hll_merge(sketches.hll_registers(a, "x", 6), sketches.hll_registers(b, "x", 6)), sketches.hll_registers(names, "x", 6))]
    for got, want in pairs:
        assert sorted(got.collect()) == sorted(want.collect())
    with pytest.raises(ValueError):
        sketches.hll_registers(names, "x", 3)


def test_flipped_value_is_found(spark):
    rows = log(spark, [(f"k{i:03}", f"v{i}", i) for i in range(37)]).withColumn("segment", F.lit(1))
    stored = integrity.merkle_leaves(rows)
    bad = rows.withColumn("value", F.when(F.col("key") == "k017", F.lit("x").cast("binary")).otherwise(F.col("value")))
    assert [r["key"] for r in integrity.verify_segment(bad, stored).collect()] == ["k017"]
    assert integrity.verify_segment(rows, stored).count() == 0
    assert integrity.merkle_root(stored, 6).first()["h"] != integrity.merkle_root(integrity.merkle_leaves(bad), 6).first()["h"]
    with pytest.raises(Exception, match="too many deleted entries"):
        integrity.verify_segment(rows.where("key > 'k001'"), stored).collect()


def fnv_model(data):
    h = 0xCBF29CE484222325
    for b in data + (1).to_bytes(4, "big"):
        h = h * 0x100000001B3 % 2**64 ^ b
    return h.to_bytes(8, "big")


def record_model(key, value, dead, ts):
    """crc 4 | ts 8 | tombstone 1 | key size 8 | value size 8 unless dead | key | value."""
    body = ts.to_bytes(8, "big") + bytes([dead]) + len(key).to_bytes(8, "big") + (b"" if dead else len(value).to_bytes(8, "big")) + key + (b"" if dead else value)
    return zlib.crc32(body).to_bytes(4, "big") + body


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 21])
def test_tree_equals_a_plain_model(spark, monkeypatch, n):
    """Leaves hash the whole record with its checksum; the record of the empty key at time 0 pads them."""
    monkeypatch.setattr(integrity, "LEVELS", 2)
    rows = [(f"k{i:03}", None if i % 4 == 3 else f"v{i}", i + 5) for i in range(n)]
    level = [fnv_model(record_model(k.encode(), (v or "").encode(), v is None, t)) for k, v, t in rows]
    leaves = integrity.merkle_leaves(log(spark, rows).withColumn("segment", F.lit(4)))
    assert [r.h for r in leaves.orderBy("idx").collect()] == [x.hex() for x in level]
    want = {(0, i, x.hex()) for i, x in enumerate(level)}
    level += [fnv_model(record_model(b"", b"", False, 0))] * ((1 << (n - 1).bit_length()) - n)
    height = 0
    while len(level) > 1:
        height += 1
        level = [fnv_model(a + b) for a, b in zip(level[::2], level[1::2], strict=True)]
        want |= {(height, i, x.hex()) for i, x in enumerate(level)}
    assert [r.h for r in integrity.merkle_root(leaves).collect()] == [level[0].hex()]
    assert {(r.level, r.idx, r.h) for r in integrity.merkle_nodes(leaves).collect()} == want


def test_places_in_a_global_order(spark):
    rows = spark.createDataFrame([(i % 3, i * 7 % 100) for i in range(100)], "s long, k long").repartition(5)
    got = positions(rows, ["k"], ["s"]).collect()
    want = {(s, k): n for s in range(3) for n, k in enumerate(sorted(i * 7 % 100 for i in range(100) if i % 3 == s))}
    assert {(r.s, r.k): r.idx for r in got} == want
    assert {r.k: r.idx for r in positions(rows, ["k"]).collect()} == {k: k for k in range(100)}


def test_equal_times(spark):
    old, new = log(spark, [("a", "old", 1), ("b", "x", 2)]), log(spark, [("a", "new", 1), ("b", None, 2)])
    got = {r.key: (None if r.value is None else bytes(r.value), r.tombstone) for r in merge.merge_runs([old, new]).collect()}
    assert got == {"a": (b"old", False), "b": (b"x", False)}
    assert {r.key: r.tombstone for r in merge.latest(old.unionByName(new)).collect()} == {"a": False, "b": True}


def test_sketch_bytes(spark):
    bits = spark.createDataFrame([(1,), (4,)], "pos long")
    assert bytes(sketches.bloom_pack(bits, 6, 2).first()[0]) == bytes.fromhex("0000000600000002" + "000100000100" + "0000000100000002")
    cells = spark.createDataFrame([(0, 1, 7), (1, 2, 300)], "row int, col long, cnt long")
    assert bytes(sketches.cms_pack(cells, 3, 2).first()[0]) == bytes.fromhex("0000000300000002" + "00000000" + "00000007" + "00000000" * 3 + "0000012c" + "0000000100000002")
    registers = spark.createDataFrame([(0, 3), (15, 9)], "bucket int, rank int")
    assert bytes(sketches.hll_pack(registers, 4).first()[0]) == bytes.fromhex("000000000000001004" + "03" + "00" * 14 + "09" + "00000001")
    fingerprint = spark.createDataFrame([(2**32 - 1, 5)], "hi long, lo long").select(sketches.simhash_pack().alias("p"))
    assert bytes(fingerprint.first()[0]).hex() == "ffffffff00000005"
    assert fingerprint.select(sketches.simhash_unpack(F.col("p")).alias("u")).first()["u"] == (2**32 - 1, 5)


@pytest.mark.parametrize("size", [sketches.PIECE - 1, sketches.PIECE, 5 * sketches.PIECE + 7])
def test_sketch_bytes_of_many_pieces(spark, size):
    """Cells at both sides of each cut, and pieces without any."""
    places = sorted({at for at in (0, 1, sketches.PIECE - 1, sketches.PIECE, 4 * sketches.PIECE, size - 1) if at < size})
    sketch = sketches.bloom_pack(spark.createDataFrame([(at,) for at in places], "pos long"), size, 1)
    want = bytearray(size)
    for at in places:
        want[at] = 1
    assert bytes(sketch.first()[0])[8:-4] == bytes(want)
    assert sorted(r.pos for r in sketches.bloom_unpack(sketch, size).collect()) == places
    counts = [(0, at, 70_000 + at) for at in places]
    cells = sketches.cms_pack(spark.createDataFrame(counts, "row int, col long, cnt long"), size, 1)
    assert sorted(map(tuple, sketches.cms_unpack(cells, size, 1).collect())) == counts


def test_a_large_filter_is_read_in_time(spark):
    sketch = spark.range(1).select(F.unhex(F.concat(F.lit("000f424000000001"), F.expr("repeat('00', 999999)"), F.lit("0100000001"))).alias("sketch"))
    began = time.time()
    assert [r.pos for r in sketches.bloom_unpack(sketch, 1_000_000).collect()] == [999_999]
    assert time.time() - began < 60


def test_bucket_bytes():
    b = ratelimit.TokenBucket(300, 10, 200, 1_700_000_000)
    assert b.to_bytes().hex() == "c801" + "80e2cfaa06"
    same = ratelimit.TokenBucket.from_bytes(b.to_bytes(), 300, 10)
    assert (same.tokens, same.last) == (200, 1_700_000_000)


def test_the_log_on_storage(spark, tmp_path):
    path = str(tmp_path / "wal")
    logs.append_wal(log(spark, [("a", "1", 1), ("b", "2", 2), ("c", "3", 3)]), path)
    assert logs.low_watermark(spark, path) is None and logs.read_wal(spark, path).count() == 3
    logs.move_low_watermark(spark, path, 1)
    logs.move_low_watermark(spark, path, 2)
    assert logs.low_watermark(spark, path) == 2 and [r.key for r in logs.read_wal(spark, path).collect()] == ["c"]
    logs.truncate_wal(spark, path, 1)
    logs.append_wal(log(spark, [("d", None, 0)]), path)
    assert sorted(r.key for r in logs.read_wal(spark, path, after=-1).collect()) == ["b", "c", "d"]


def test_flush_leaves_what_came_meanwhile(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "s"))
    s.append(log(spark, [("a", "1", 1)]))
    write = s._write

    def slow(rows, level):
        out = write(rows, level)
        s.append(log(spark, [("late", "x", 0)]))
        return out

    monkeypatch.setattr(s, "_write", slow)
    s.flush()
    assert s.get("late") == b"x" and s.get("a") == b"1" and s.runs() == [(1, 1)]


def test_a_full_table_is_flushed(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Config(table_size=2))
    s.put("a", b"1")
    s.put("a", b"2")
    assert s.runs() == []
    s.put("b", b"3")
    assert s.runs() == [(1, 1)] and s.get("a") == b"2" and s.get("b") == b"3"


def test_a_store_opened_anew_has_no_more_tokens(spark, tmp_path):
    for at in (100, 101, 102):
        Store(spark, str(tmp_path / "s"), Config(rate_limit=True)).charge(at)
    with pytest.raises(RateLimited):
        Store(spark, str(tmp_path / "s"), Config(rate_limit=True)).charge(103)


def test_fingerprints_in_a_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for name, hi, lo in (("x", 1, 7), ("y", 0, 5)):
        s.save_sketch("simhash", name, spark.createDataFrame([(hi, lo)], "hi long, lo long"))
    assert s.compare_fingerprints("x", "y") == 2 and s.compare_fingerprints("x", "x") == 0


def test_token_bucket_trace(spark):
    times, want = [0, 1, 2, 3, 9, 11, 12, 13, 14, 22, 23], "TTTFFTTTFTT"
    ops = spark.createDataFrame([("b", t, i) for i, t in enumerate(times)] + [("c", 5, 99)], "bucket string, op_ts long, seq long")
    rows = ratelimit.token_bucket(ops).where("bucket = 'b'").orderBy("seq").collect()
    assert "".join("T" if r.allowed else "F" for r in rows) == want


def test_plans():
    runs = [compaction.Run(1, 1, "a", "f"), compaction.Run(1, 2, "g", "k"), compaction.Run(1, 3, "a", "z"), compaction.Run(2, 1, "a", "c"), compaction.Run(2, 2, "m", "z")]
    assert [[r.segment for r in g] for g in compaction.tiered(runs, 1, 2)] == [[1, 2]]
    assert [(r.level, r.segment) for r in compaction.leveled(runs, 1)] == [(1, 1), (2, 1)]
    assert compaction.level_limit(2, "leveled", 2, 3) == 9 and compaction.level_limit(3, "sizetiered", 2, 3) == 2


def test_config(tmp_path):
    path = tmp_path / "config.json"
    assert Config.load(str(path)) == Config() == Config.load(str(path))
    path.write_text('{"max_level": 1}')
    assert Config.load(str(path)) == Config()
    path.write_text('{"level_size": 3, "unknown": 1}')
    assert Config.load(str(path)).level_size == 3
    for bad in ({"data_structure": "list"}, {"bloom_fpp": 0}, {"compaction": "none"}):
        with pytest.raises(ValueError):
            Config(**bad)


@pytest.mark.parametrize("algorithm", ["sizetiered", "leveled"])
def test_store(spark, tmp_path, algorithm):
    s = Store(spark, str(tmp_path / "s"), Config(compaction=algorithm))
    df = logs.event_log(spark, SF).where("ts < 400")
    for i in range(4):
        s.append(df.where(F.col("ts") % 4 == i))
        s.flush()
    assert sorted(map(str, merge.latest(s.log()).collect())) == sorted(map(str, merge.latest(df).collect()))
    assert len(s.runs()) < 4
    s.put("user1", b"x")
    assert s.get("user1") == b"x"
    s.delete("user1")
    with pytest.raises(KeyNotFound):
        s.get("user1")
    with pytest.raises(ValueError, match="invalid key prefix"):
        s.put("hll_x", b"")
    assert s.prefix_iterate("user1").current["tombstone"]
    level, segment = s.runs()[0]
    s.seal(level, segment)
    assert s.check(level, segment).count() == 0
    names = spark.createDataFrame([("a",), ("b",)], "x string")
    s.add_to_sketch("cms", "c", names, "x", m=27, k=3)
    s.add_to_sketch("cms", "c", names, "x", m=27, k=3)
    assert sketches.cms_frequency(s.load_sketch("cms", "c"), names, "x", 27, 3).where("freq < 2").count() == 0
    s.delete_sketch("cms", "c")
    with pytest.raises(KeyNotFound):
        s.load_sketch("cms", "c")


def test_rate_limit(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Config(rate_limit=True))
    for _ in range(3):
        s.charge(100)
    with pytest.raises(RateLimited):
        s.charge(110)
    s.charge(111)


def test_streams(spark, tmp_path):
    rows = log(spark, [("a", "1", 1), ("a", "2", 2), ("b", None, 3)])
    rows.write.parquet(str(tmp_path / "in"))
    s = Store(spark, str(tmp_path / "s"))
    q = ingest.ingest(spark.readStream.schema(LOG_SCHEMA).parquet(str(tmp_path / "in")), s, str(tmp_path / "c"))
    assert q.awaitTermination(120)
    assert bytes(read.get(s.log(), "a")) == b"2"
    ops = spark.createDataFrame([("b", t, i) for i, t in enumerate([0, 1, 2, 3, 11])], "bucket string, op_ts long, seq long")
    ops.write.parquet(str(tmp_path / "ops"))
    name = f"limited{time.time_ns()}"
    q = ingest.limit_stream(spark.readStream.schema(ops.schema).parquet(str(tmp_path / "ops"))).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [r.allowed for r in spark.table(name).orderBy("seq").collect()] == [True, True, True, False, True]
