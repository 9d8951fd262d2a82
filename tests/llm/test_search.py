import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from keystrata.llm import hilbert, mixing, queries, vptree
from keystrata.llm.shared import ordered_positions


def brute(ids, pts, q, k, exclude):
    d = vptree.distances(pts, q)
    return sorted((float(x), int(i)) for x, i in zip(d, ids, strict=True) if i != exclude)[:k]


def test_tree_is_exact_with_factor_one():
    rng = np.random.default_rng(1)
    pts = np.round(rng.normal(size=(900, 5)), 1)
    pts[100:400] = pts[7]  # one very common vector
    ids = rng.permutation(5000)[:900]
    tree = vptree.VPTree(ids, pts)
    for q in range(0, 900, 37):
        assert tree.search(pts[q], 10, int(ids[q])) == brute(ids, pts, pts[q], 10, ids[q])


def test_recall_with_a_relaxed_bound():
    rng = np.random.default_rng(2)
    pts, ids = rng.normal(size=(3000, 8)), np.arange(3000)
    tree, hits = vptree.VPTree(ids, pts), 0
    for q in range(0, 3000, 100):
        hits += len({i for _, i in tree.search(pts[q], 10, q, 1.5)} & {i for _, i in brute(ids, pts, pts[q], 10, q)})
    assert hits >= 0.9 * 300


def test_neighbours_over_many_shards_and_blocks(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = v.collect()
    ids, pts = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = vptree.nearest_neighbours(v, v.where("vec_id % 10 = 0"), 7, shard=60).orderBy("query_id", "rank").collect()
    want = [(q, n + 1, i, d) for q in sorted(ids[ids % 10 == 0]) for n, (d, i) in enumerate(brute(ids, pts, pts[ids == q][0], 7, q))]
    assert [tuple(r) for r in got] == want


def planted(spark, n, seed=3):
    """Forty clusters, a third of all rows one vector, and a few far-off vectors."""
    rng = np.random.default_rng(seed)
    pts = (rng.normal(size=(40, 6)) * 20)[rng.integers(0, 40, n)] + rng.normal(size=(n, 6))
    pts[: n // 3], pts[-5:] = pts[0], pts[-5:] * 1e3
    pts = pts.astype(np.float32).astype(np.float64)[rng.permutation(n)]
    return pts, spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "vec_id long, embedding array<float>").repartition(4)


def test_regions_lose_nothing_and_a_relaxed_bound_little(spark):
    pts, v = planted(spark, 3000)
    ids = np.arange(3000)
    want = [(q, n + 1, i, d) for q in range(0, 3000, 50) for n, (d, i) in enumerate(brute(ids, pts, pts[q], 10, q))]
    run = lambda **kw: [tuple(r) for r in vptree.nearest_neighbours(v, v.where("vec_id % 50 = 0"), shard=100, **kw).orderBy("query_id", "rank").collect()]
    assert run() == want and run(pivots=3) == want and run(pivots=1) == want
    loose = run(factor=1.5)
    kth = {q: d for q, rank, _, d in want if rank == 10}  # equal distances count alike: a third of the rows are one vector
    assert sum(d <= kth[q] for q, _, _, d in loose) >= 0.9 * len(want)


def test_a_tree_is_built_once_and_its_bytes_give_it_back(spark):
    pts, v = planted(spark, 3000)
    tree = vptree.VPTree(np.arange(3000), pts)
    again = vptree.VPTree.unpack(tree.pack("<f4"))
    assert all(tree.search(pts[q], 5, q) == again.search(pts[q], 5, q) for q in range(0, 3000, 100))
    near = tree.search(pts[7], 5, 7)
    assert again.search(pts[7], 5, 7, within=near[2][0]) == [x for x in near if x[0] <= near[2][0]]


def test_repeated_ids_and_lengths_over_several_shards(spark):
    rows = [(i % 50, [float(i % 7), float(i // 50) + 1]) for i in range(100)] + [(100 + i, [1.0, 2.0, float(i)]) for i in range(30)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = {}
    for i, e in rows:
        kept[i] = min(kept.get(i, e), e)
    want = []
    for q, e in sorted(kept.items()):
        others = [(math.dist(e, x), i) for i, x in kept.items() if i != q and len(x) == len(e)]
        want += [(q, n + 1, i, pytest.approx(d)) for n, (d, i) in enumerate(sorted(others)[:4])]
    assert [tuple(r) for r in vptree.nearest_neighbours(v, v, 4, shard=8).orderBy("query_id", "rank").collect()] == want


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as shard", "3 as score")
    got = [tuple(r) for r in vptree.nearest_neighbours(v, v).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 1.0), (0, 2, 7, 1.0), (6, 1, 7, 0.0), (6, 2, 0, 1.0), (7, 1, 6, 0.0), (7, 2, 0, 1.0)]
    assert vptree.nearest_neighbours(v.limit(0), v.limit(0)).collect() == []


@pytest.mark.parametrize(("d", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    index = hilbert.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    walk = cells[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shards_obey_the_law(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = hilbert.hilbert_shards(docs).collect()
    assert Counter(r.shard for r in rows) == dict.fromkeys(range(8), 125)
    for s in range(8):
        own = sorted((r.slot, r.hilbert, r.doc_id) for r in rows if r.shard == s)
        assert [x[0] for x in own] == list(range(125)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, hilbert.hilbert_shards(docs.repartition(5)).collect()))


def test_shards_of_odd_rows(odd_docs, no_docs):
    rows = hilbert.hilbert_shards(odd_docs, 3).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [2, 3, 3] and len({(r.shard, r.slot) for r in rows}) == 8
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id in (2, 3)} == {(1, 0)}
    assert {r.grown_shard for r in rows} == {None}
    assert hilbert.hilbert_shards(no_docs).collect() == []


def test_shard_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hilbert.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def test_shards_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    n, bits = len(rows), 5
    size = [len((r.text or "").encode()) + 1 for r in rows]

    def value_bins(values):
        order = sorted(values, key=lambda v: (v is not None, v or ""))
        return [min(31, 32 * order.index(v) // n) for v in values]

    cuts = {sorted(size)[math.ceil(k / 32 * n) - 1] for k in range(1, 32)}
    cells = np.array([value_bins([r.source for r in rows]), value_bins([r.lang for r in rows]), [sum(c < x for c in cuts) for x in size]]).T
    curve = hilbert.hilbert_index(cells, bits).tolist()
    crc = [zlib.crc32((r.text or "").encode()) for r in rows]
    order = sorted(range(n), key=lambda i: (curve[i], rows[i].doc_id, crc[i], size[i]))
    shard = [at * 8 // n for at in range(n)]
    want = {(rows[i].doc_id, size[i], crc[i], curve[i], shard[at], at - shard.index(shard[at])) for at, i in enumerate(order)}
    got = hilbert.hilbert_shards(docs).select("doc_id", "size", "text_crc32", "hilbert", "shard", "slot").collect()
    assert len(got) == n and {tuple(r) for r in got} == want


def test_written_shards_keep_repeated_rows(spark, odd_docs, tmp_path):
    twice = odd_docs.unionByName(odd_docs)
    hilbert.write_shards(twice, str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 16 and Counter(r.n for r in back.groupBy("shard").agg({"*": "count"}).toDF("shard", "n").collect()) == {5: 2, 6: 1}
    plain = [c for c in back.columns if c != "shard"]
    assert back.select(plain).exceptAll(twice.select(plain)).count() == 0


def test_positions(spark):
    df = spark.createDataFrame([(i * 7 % 100, i % 4) for i in range(100)], "k long, n long").repartition(5)
    rows = ordered_positions(df, ["k"], "n", "t").orderBy("position").collect()
    assert [r.k for r in rows] == list(range(100))
    assert [r.position for r in rows] == list(range(100))
    assert [r.before for r in rows] == [0, *itertools.accumulate(r.n for r in rows)][:-1]


def fill(sizes, budget, weights, limit=2.0):
    out, free, left = {}, dict(sizes), budget
    while free:
        w = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / w > limit * sizes[s]]
        if not over:
            out |= {s: left * weights[s] / w for s in free}
            break
        for s in over:
            out[s] = limit * sizes[s]
            del free[s]
        left = budget - sum(out.values())
    return out


def test_targets_by_repeated_resharing(spark):
    rng = np.random.default_rng(3)
    for trial in range(6):
        sizes = {f"s{i:02}": int(x) for i, x in enumerate(rng.integers(0, 10 ** (trial + 1), 9))}
        weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, source_rows long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = fill(sizes, 1.5 * sum(sizes.values()), weights)
        assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in sizes)


def test_mix_comes_near_its_targets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    taken, target = Counter(), {}
    for r in rows:
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        target[r.source] = r.target
    biggest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - t) <= biggest for s, t in target.items())
    assert sum(taken.values()) <= 1.5 * sum(r["size"] for r in rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(tuple(r)[:5] if len(r) == 5 else (r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in rows)
    copies = Counter(r.doc_id for r in mixing.mixed_documents(docs).select("doc_id").collect())
    assert all(copies[r.doc_id] * r["size"] == r.taken for r in rows)


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in mixing.mix(odd_docs).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6, None} and rows[2]["size"] == 0 and rows[2].source_size == 4
    assert mixing.mix(no_docs).collect() == [] and mixing.mixed_documents(no_docs).collect() == []
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns


def brute_mix(rows, weights=(3, 1, 2), share=1.5, copies=2):
    """(row number, size, source's size, target, taken) by a sort of all copies."""
    n = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    size = Counter()
    for (_, _, s), k in zip(rows, n, strict=True):
        size[s] += k
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = fill({s: size[s] for s in names}, share * sum(n), {s: weights[i % len(weights)] for i, s in enumerate(names)}, copies)
    place = lambda d, t: hashlib.md5(f"mix:{':' + hashlib.md5((t or '').encode()).hexdigest() if d is None else d}".encode()).hexdigest()
    order, run, out = [], Counter(), [0] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: (place(*rows[i][:2]), rows[i][0] is not None, rows[i][0] or 0, n[i])):
        run[rows[i][2]] += n[i]
        for c in range(copies):
            if goal[rows[i][2]] > 0:
                finish = (c * size[rows[i][2]] + run[rows[i][2]]) / goal[rows[i][2]]
                order.append((finish, place(*rows[i][:2]), rows[i][0] or 0, c, n[i], len(order), i))
    used = 0
    for *_, i in sorted(order):
        used += n[i]
        if used <= int(share * sum(n)):
            out[i] += n[i]
    return [(d, k, size[s], goal[s], x) for (d, _, s), k, x in zip(rows, n, out, strict=True)]


def test_repeated_and_nameless_rows_are_documents_of_their_own(spark, monkeypatch):
    rng = np.random.default_rng(11)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rows = [(int(rng.integers(0, 9)) if k % 4 else None, " ".join(["w"] * int(rng.integers(0, 4))) + "x" * (k % 3), "abc"[k % 3] if k % 7 else None) for k in range(120)]
    rows += [(1, "one two three four", "a")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as _cuts", "2 as _n", "3 as u", "4 as cuts", "5 as row", "6 as size")
    got, want = mixing.mix(docs).collect(), brute_mix(rows)
    flat = lambda rs: sorted(((d or -1, n, s, round(g, 6), t) for d, n, s, g, t in rs))
    assert flat(map(tuple, got)) == flat(want) and len(got) == len(rows)
    assert all(r.taken <= 2 * r["size"] for r in got) and any(0 < r.taken < 2 * r["size"] for r in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    count = lambda rs: Counter({k: v for k, v in rs.items() if v})
    words, taken = Counter(), Counter()
    for r in mixed.collect():
        words[r.doc_id, r.source] += len(r.text.split())
    for (d, _, s), (*_, t) in zip(rows, want, strict=True):
        taken[d, s] += t
    assert count(words) == count(taken)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = queries.QUERIES[name](spark, small)
    want = con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(con.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall(), key=str)
