import html as h
import itertools
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import decontaminate, html_extract, line_dedup, near_dup, toxicity, wordhash
from keystrata.llm.components import connected_components

LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat".split()


# --- toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    out = Counter((r.toxic, r.predicted) for r in rows if r.held_out)
    right = out[1, 1] / (out[1, 0] + out[1, 1])
    wrong = out[0, 1] / (out[0, 0] + out[0, 1])
    assert right > 0.85 and wrong < 0.01, out


def test_labels_held_out_are_never_read(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert a == b


def test_risk_is_minimised_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    toxic = [np.array([0, *rng.integers(2, 30, 3)]) for _ in range(300)]
    clean = [np.array([1, *rng.integers(2, 30, 3)]) for _ in range(700)]
    w, b = toxicity.fit_nnpu(toxic[:150], toxic[150:] + clean, 30, 150 / 850)
    z = lambda x: w[x].sum() + b
    assert np.mean([z(x) > 0 for x in toxic]) > 0.98 and np.mean([z(x) > 0 for x in clean]) < 0.02


def test_risk_equals_the_least_of_a_grid():
    """One feature: the non-negative risk of all weights and biases on a grid is no smaller than the fitted one's."""
    prior, pos, unl = 0.3, [1] * 8 + [0] * 2, [1] * 12 + [0] * 28
    loss = lambda z: np.logaddexp(0, -z)

    def risk(w, b):
        zp, zu = np.array(pos) * w + b, np.array(unl) * w + b
        return prior * loss(zp).mean() + max(0.0, loss(-zu).mean() - prior * loss(-zp).mean())

    rows = lambda xs: [np.zeros(x, np.int64) for x in xs]
    w, b = toxicity.fit_nnpu(rows(pos), rows(unl), 1, prior, steps=3_000, decay=0.0, rate=0.01)
    least = min(risk(x, y) for x in np.linspace(-6, 6, 121) for y in np.linspace(-6, 6, 121))
    assert risk(w[0], b) <= least + 0.005


def test_words_of_any_length_are_told_apart():
    a, b = "x" * 60 + "a", "x" * 60 + "b"
    assert a in toxicity.features(a) and a not in toxicity.features(b)
    model = toxicity.Model({a: 2.0}, -1.0, 0.1)
    assert model.score(f"{a} {b}") > 0.5 > model.score(b)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, None, None), (99, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = toxicity.toxicity(odd_docs, known).collect()
        assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(no_docs, labels).collect() == []
    assert toxicity.drop_toxic(odd_docs, labels.limit(0)).count() == 8
    assert toxicity.drop_toxic(odd_docs, labels.limit(0)).columns == odd_docs.columns
    clash = odd_docs.withColumn("_toxicity", F.lit(3))
    assert toxicity.drop_toxic(clash, labels).columns == clash.columns
    assert toxicity.score(odd_docs, toxicity.Model({}, 0.0, 0.5)).select("score").distinct().collect()[0].score == 0.5


# --- pages


def article(page):
    """The test tables' pages: what is in <article>, blocks apart."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inside)
    return "\n".join(x for x in (" ".join(h.unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p)).split()) for p in parts) if x)


def test_pages_of_the_table(spark, small):
    rows = html_extract.extract(spark.read.parquet(f"{small}/pages.parquet")).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_marks_are_only_labels(spark, small):
    """Weights learned from some pages give the same text on others whose mark has another name."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    weights = html_extract.learn_weights(pages.where("page_id % 2 = 0"))
    for r in pages.where("page_id % 2 = 1").collect():
        renamed = re.sub(r"(</?)article\b", r"\1div", r.html)
        assert html_extract.Page(renamed).text(weights) == article(r.html), r.page_id


def test_the_run_has_the_greatest_sum(spark, small):
    rng = np.random.default_rng(12)
    for r in spark.read.parquet(f"{small}/pages.parquet").limit(12).collect():
        page = html_extract.Page(r.html)
        page.items = page.items[:60]
        weights = html_extract.DEFAULT | {x[1]: float(rng.integers(-8, 9)) / 8 for x in page.items}
        value = lambda x: (x[3] * (-abs(weights["w:"]) if x[4] else weights[x[1]])) if x[0] == "w" else weights[x[1]]  # noqa: E731, B023
        sums = [0.0, *itertools.accumulate(map(value, page.items))]
        first, end = page.best_run(weights)
        best = max(b - a for a, b in itertools.combinations(sums, 2))
        assert abs(sums[end] - sums[first] - max(best, 0)) < 1e-9


@pytest.mark.parametrize("piece", ['<a href="x ', "<a href=x ", "<span></b>", '<a b=">" ', "<!", "<a>", '<a href="x>', "<div><a>", "<p class='", "</", "<script", "<i></div>"])
def test_broken_pages_take_one_pass(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    html_extract.Page(page).text(html_extract.DEFAULT)
    assert time.process_time() - began < 5


def test_unclosed_quotes_end_with_the_tag():
    page = html_extract.Page('<p title="x>one two</p><p>three <b c=d>four</b> five</p>')
    assert page.text(html_extract.DEFAULT | {"t:": -0.1}) == "one two\nthree four five"


def test_kinds_of_any_name_count(spark):
    page = f"<{'x' * 30}>menu</{'x' * 30}><article><p>one two three</p></article>"
    weights = html_extract.learn_weights(spark.createDataFrame([(page,)], "html string"))
    assert weights["t:-"] < 0 < weights["w:p"]


BODY = "".join(f"<p>{' '.join(LOREM[i:] + LOREM[:i])} &amp;amp; caf&eacute;&nbsp;x</p>" for i in range(6))


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='post-body'>{}</div>", "<div>{}</div>", "<td>{}"])
def test_page_with_everything_around(wrap):
    extra = "<aside><p>aside one two</p></aside><form><input><label>name</label></form><div class='share-links'>share me</div><section id=comments><p>nice post of mine</p></section>"
    page = f"<html><head><title>t</title><style>p>a{{}}</style></head><body class=home><header><p>site head words</p></header><nav><a href=/>home</a></nav><div class='cookie-notice'><p>we use cookies to do things</p></div>{wrap.format('<h1>The <b>great</b>\n title</h1>' + BODY + extra)}<footer>foot words</footer><script>if(a<b)document.write('<p>x</p>')"
    text = html_extract.Page(page).text(html_extract.DEFAULT)
    lines = text.split("\n")
    assert lines[-6:] == [" ".join(LOREM[i:] + LOREM[:i]) + " &amp; café x" for i in range(6)]
    assert lines[:-6] == ["The great title"]


@pytest.mark.parametrize("page", ["", "<", "<<<", "<p", "</p></p>", "<!--", "<!-- x", "<script>", "<a href='", "&lt;", "<p>a<p>b", "<title>only", "\x00<b>", "<div " * 500])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html_extract.Page(page).text(html_extract.DEFAULT), str)


def test_odd_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>one two three four</p>", "x"), (3, "u", "<p>one two three four</p>", "x"), (3, "u", "<p>one two three four</p>", "x"), (4, "u", "<p>" + "word " * 100_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract(pages).collect())
    assert got[:5] == [(0, "one two three four", 18), (1, "", 0), (2, "", 0), (3, "one two three four", 18), (3, "one two three four", 18)] and got[5][2] == 499_999
    assert html_extract.extract(pages.limit(0)).collect() == []


# --- decontamination


def test_masks_find_any_two_substitutions():
    w = decontaminate.WINDOW
    for bad in itertools.combinations(range(w), 2):
        assert any(not {o + s for o in m} & set(bad) for m in decontaminate.MASKS for s in range(w - m[-1]))


def brute_leaks(docs, items):
    words = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    out = set()
    for (d, x), (i, y) in itertools.product(docs, items):
        a, b = words(x), words(y)
        for diagonal in range(-len(b), len(a)):
            e = [int(0 <= j + diagonal < len(a) and a[j + diagonal] == b[j]) for j in range(len(b))]
            n = min(13, len(b))
            if len(b) >= 5 and any(sum(e[s : s + n]) >= (11 if len(b) >= 13 else n) for s in range(len(b) - n + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_leaks_equal_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    rng = np.random.default_rng(5)
    text = lambda n: [LOREM[i] for i in rng.integers(0, len(LOREM), n)]
    items = [(i, text(int(rng.integers(3, 40)))) for i in range(12)] + [(20 + n, text(n)) for n in (4, 5, 7, 8, 12, 13)]
    docs = [(200 + i, " ".join(["before", *y, "after"][i % 2 :])) for i, y in items]
    for d in range(60):
        x = text(int(rng.integers(0, 60)))
        if d % 3:
            y = list(items[int(rng.integers(0, 12))][1])
            for at in rng.integers(0, len(y), int(rng.integers(0, 5))):
                y[at] = "other"
            cut = slice(0, None) if d % 3 == 1 else slice(3, 18)
            at = int(rng.integers(0, len(x) + 1))
            x = x[:at] + y[cut] + x[at:]
        docs.append((d, ", ".join(x).upper() if d % 2 else " ".join(x)))
    items = [(i, " ".join(y)) for i, y in items]
    got = decontaminate.leaks(spark.createDataFrame([*docs, docs[1], (None, docs[1][1]), (99, None), (98, "")], "doc_id long, text string"), spark.createDataFrame([*items, items[0], (77, None), (78, ""), (None, "x")], "item_id long, text string"))
    rows = [(r.doc_id, r.item_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_leaks(docs, items) and len(rows) > 20
    assert {(225, 25), (227, 27), (232, 32), (233, 33)} <= set(rows) and not any(i == 24 for _, i in rows)


def test_leaks_of_odd_rows(spark, odd_docs, no_docs):
    """Rows without an id, repeated ids with other texts, long texts, clashing columns, empty tables, every short item."""
    words = [f"w{i}" for i in range(3_000)]
    item, short = " ".join(words[1_000:1_014]), "alpha beta gamma"
    rows = [(None, item), (1, item), (1, "clean text of some words"), (2, " ".join(words)), (3, None), (4, ""), (5, short), (None, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h1", "2 as item_id", "'x' as row", "3 as _at", "4 as _item")
    items = spark.createDataFrame([(7, item), (8, short), (9, None), (9, ""), (None, item)], "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as _hash")
    found = {(r.doc_id, r.item_id): (r.position, r.matched, r.window_matched) for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(1, 7): (0, 14, 13), (2, 7): (1_000, 14, 13)}
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "clean"), (1, rows[2][1]), (3, ""), (4, ""), (5, short)]
    assert sorted(r.doc_id or 0 for r in decontaminate.clean_documents(docs, items, shortest=1).collect()) == [0, 1, 3, 4]
    assert {r.doc_id for r in decontaminate.leaks(odd_docs, items, shortest=1).collect()} == {1, 5}
    for a, b in ((no_docs, items), (docs, items.limit(0))):
        assert decontaminate.leaks(a, b).collect() == [] and decontaminate.clean_documents(a, b).count() == a.count()


def test_leaks_on_the_table(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    flat = lambda s: " " + " ".join(re.findall(r"\w+", s.lower())) + " "
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if flat(i.text) in flat(d.text)}
    assert got == want and got
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - len({d for d, _ in want})


# --- near duplicates


def plain_sets(texts, n=5):
    out = []
    for t in texts:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        out.append(Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter())
    return out


def jp(x, y):
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def test_shingles_equal_plain_python():
    texts = ["", None, "One two", "a b c d e f a b c d e", "É,è ß x1 y2 z3", " ".join(LOREM * 3), "!!"]
    who, what, count = wordhash.shingles(texts, 5)
    for i, want in enumerate(plain_sets(texts)):
        assert sorted(count[who == i]) == sorted(want.values()) and len(set(what[who == i])) == len(want)
    both = wordhash.shingles(["x " + " ".join(LOREM), " ".join(LOREM)], 5)
    assert len(np.intersect1d(both[1][both[0] == 0], both[1][both[0] == 1])) == len(plain_sets([" ".join(LOREM)])[0])


def as_arrays(x):
    keys = sorted(x)
    h = np.array([hash(k) & (2**63 - 1) for k in keys], np.uint64)
    order = np.argsort(h)
    return h[order], np.array([x[k] for k in keys], np.uint32)[order]


def test_similarity_and_its_estimate():
    rng = np.random.default_rng(4)
    for _ in range(12):
        x = Counter({int(i): int(rng.integers(1, 6)) for i in rng.integers(0, 40, 25)})
        y = Counter({int(i): int(rng.integers(1, 6)) for i in rng.integers(0, 40, 25)})
        exact, plain = near_dup.similarities(as_arrays(x), as_arrays(y))
        assert abs(exact - jp(x, y)) < 1e-9 and abs(plain - len(x.keys() & y.keys()) / len(x.keys() | y.keys())) < 1e-12
        ax, ay = as_arrays(x), as_arrays(y)
        who = np.repeat([0, 1], [len(ax[0]), len(ay[0])])
        sig = near_dup.signatures(who, np.concatenate([ax[0], ay[0]]), np.concatenate([ax[1], ay[1]]).astype(float), 2, 4000)
        assert abs((sig[0] == sig[1]).mean() - exact) < 0.04


def brute_classes(ids, texts, least):
    sets = [as_arrays(x) for x in plain_sets(texts)]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        same = texts[i] is not None and texts[i] == texts[j]
        if not same and min(len(sets[i][0]), len(sets[j][0])) and np.intersect1d(sets[i][0], sets[j][0], assume_unique=True).size:
            same = max(near_dup.similarities(sets[i], sets[j])) >= least
        if same:
            a, b = find(i), find(j)
            root[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return {(ids[i], ids[find(i)]) for i in range(len(ids))}


def test_classes_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    got = {tuple(r) for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute_classes([r.doc_id for r in rows], [r.text for r in rows], 0.8)
    assert len(got) == len(rows) and any(a != b for a, b in got)


def test_chains_of_copies(spark):
    """A big family of edited copies, most of which aren't similar to the first one."""
    rng = np.random.default_rng(6)
    base = [f"{LOREM[i % len(LOREM)]}{i}" for i in range(200)]
    docs = []
    for d in range(150):
        x = list(base)
        for at in rng.integers(0, 200, 3):
            x[at] = f"new{d}"
        docs.append((d, " ".join(x)))
    base = [*base[:120], *(f"tail{i}" for i in range(80))]
    docs += [(200 + d, " ".join([f"z{d}", *base])) for d in range(20)] + [(300, "short one"), (301, "short one"), (302, ""), (303, ""), (304, None), (305, None), (306, "!!"), (None, "short one")]
    got = {tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    named = [r for r in docs if r[0] is not None]
    assert got - {(None, 300)} == brute_classes([d for d, _ in named], [x for _, x in named], 0.8)
    assert {(d, 200) for d in range(200, 220)} <= got and {(303, 302), (304, 304), (305, 305), (306, 306), (None, 300)} <= got
    assert Counter(c for _, c in got)[0] > 100


def test_single_partners_in_large_buckets(spark):
    """Edited copies of one text, most of them similar to few others or to none: no bucket's pairs may be left out."""
    rng, n = np.random.default_rng(8), 700
    docs = []
    for d in range(n):
        x = [f"{LOREM[i % len(LOREM)]}{i}" for i in range(200)]
        for at in rng.integers(0, 200, 4):
            x[at] = f"new{d}x{at}"
        docs.append((d, " ".join(x)))
    who, what, count = wordhash.shingles([x for _, x in docs], 5)
    assert count.max() == 1  # both similarities are the same
    values, column = np.unique(what, return_inverse=True)
    has = np.zeros((n, len(values)), np.float32)
    has[who, column] = 1
    both, size = has @ has.T, has.sum(axis=1)
    near = both / (size[:, None] + size[None, :] - both) >= 0.8
    root = np.arange(n)
    while (low := np.where(near, root[None, :], n).min(axis=1)).tolist() != root.tolist():
        root = low
    got = dict(near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert [got[d] for d in range(n)] == root.tolist()
    assert len(set(root.tolist())) > 50


def test_a_block_compares_as_single_pairs_do():
    rng = np.random.default_rng(9)
    sets = []
    for d in range(60):
        ids = np.unique(np.concatenate([np.arange(50), rng.integers(0, 70, rng.integers(1, 15))]).astype(np.uint64))
        ids = ids[rng.random(len(ids)) < 0.95]
        sets.append((ids, rng.integers(1, 2 + d % 3, len(ids)).astype(np.uint32)))
    s, w = map(list, zip(*sets, strict=True))
    cell = near_dup._Cell(s, w, np.arange(60))
    for i in range(60):
        want = [j for j in range(60) if max(near_dup.similarities(sets[i], sets[j])) >= 0.8]
        assert cell.linked(i, 0.8, np.zeros(60, bool)).tolist() == want
        assert i or 0 < len(want) < 60


def test_classes_of_a_thousand_documents_equal_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    who, what, count = wordhash.shingles([r.text for r in rows], 5)
    _, code = np.unique(what, return_inverse=True)
    n, mark = len(rows), np.zeros(code.max() + 1)
    size, cut = np.bincount(who, minlength=n), np.searchsorted(who, np.arange(n + 1))
    assert n >= 1_000
    root = list(range(n))
    for i in range(n):
        own = slice(cut[i], cut[i + 1])
        mark[code[own]] = 1
        both = np.bincount(who, mark[code], n)
        mark[code[own]] = 0
        for j in np.flatnonzero((both > 0) & (np.arange(n) < i)).tolist():
            other = slice(cut[j], cut[j + 1])
            near = both[j] / (size[i] + size[j] - both[j]) >= 0.8
            if near or max(count[own].max(), count[other].max()) > 1 and near_dup.similarities((what[own], count[own]), (what[other], count[other]))[0] >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r == max(a, b) else r for r in root]
    first = {}
    for i, r in enumerate(rows):
        if r.text is not None and not size[i]:
            root[i] = first.setdefault(r.text, i)
    got = dict(near_dup.near_duplicates(docs).collect())
    assert [got[r.doc_id] for r in rows] == [rows[i].doc_id for i in root]


def test_texts_under_one_id_are_judged_each_for_itself(spark):
    x, y = " ".join(LOREM), " ".join(reversed(LOREM))
    docs = [(1, x), (1, y), (2, x + " end"), (3, y + " end"), (None, y + " other"), (None, "no copy"), (4, None), (4, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h1", "2 as rep", "3 as row")
    got = sorted(((r.doc_id or 0, r.class_id or 0) for r in near_dup.near_duplicates(table).collect()))
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]
    kept = near_dup.one_of_each(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, x), (1, y), (0, "no copy"), (4, ""), (4, "")])


def test_one_repeated_line_does_not_hide_a_copy(spark):
    """Plain Jaccard similarity 0.9 and more, probability Jaccard similarity far less."""
    text = " ".join(f"w{i}" for i in range(400))
    line = " ".join(f"again{i}" for i in range(20))
    docs = [(d, " ".join([text, *[line] * times, f"d{d}"])) for d, times in enumerate([1, 30, 60, 90])]
    got = dict(near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == dict.fromkeys(range(4), 0)


def test_one_of_each(spark, odd_docs, no_docs):
    kept = near_dup.one_of_each(odd_docs)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6] and kept.columns == odd_docs.columns
    assert near_dup.near_duplicates(no_docs).collect() == [] and near_dup.one_of_each(no_docs).collect() == []


def test_rows_without_an_id_stay_beside_a_repeated_id(spark):
    docs = [(1, "one text"), (1, "one text"), (2, "one text"), (None, "some other text"), (None, "yet another one"), (None, None)]
    kept = near_dup.one_of_each(spark.createDataFrame(docs, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([docs[0], *docs[3:]])


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 300), (201, 200), (200, 201)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(links, "a long, b long"), one_task=one_task).collect()}
    assert got == {*((i, 0) for i in range(1, 41)), *((i, 100) for i in range(101, 160)), (201, 200)}


# --- lines


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute_lines(docs, near):
    seen, out = [], {}
    places = sorted((d, n, x) for d, t in docs if t is not None for n, x in enumerate(t.split("\n")))
    gone = set()
    for d, n, x in places:
        if not x.strip(" \t\r\x0b\x0c"):
            continue
        if any(x == y or (len(x) >= near and len(y) >= near and one_edit(x, y)) for y in seen):
            gone.add((d, n))
        seen.append(x)
    for d, t in docs:
        out[d] = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)
    return out


def test_lines_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    base = ["".join(rng.choice(list("abcdé "), int(n))).strip() or "x" for n in [*rng.integers(1, 60, 25), 255, 256, 257, 511, 512, 513, 900]]
    docs = []
    for d in range(120):
        lines = []
        for _ in range(int(rng.integers(0, 6))):
            x = base[int(rng.integers(0, len(base)))]
            for _ in range(int(rng.integers(0, 3))):
                at, kind, c = int(rng.integers(0, len(x) + 1)), int(rng.integers(0, 3)), str(rng.choice(list("abé")))
                x = x[:at] + (c if kind else "") + x[at + (kind != 1) :]
            lines.append(x)
        docs.append((d, "\n".join(lines)))
    docs += [(400 + k, x) for k, x in enumerate(["a", "b", "ab", "ba", "\t", "x" * 19, "x" * 18 + "y", "x" * 20, "x" * 21, "\t\r\n \n\t", "q\r", "q"])]
    docs += [(500, None), (501, ""), (502, "\n\n"), (503, " \n" + base[0]), (504, "same line that is long enough\n" * 3)]
    got = line_dedup.dedup_lines(spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, line string, n int"))
    want = brute_lines(docs, line_dedup.NEAR)
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "line", "n", "n_lines", "n_dropped"]
    assert {r.doc_id: r.text for r in rows} == want
    assert sum(r.n_dropped for r in rows) > 100


def test_lines_of_texts_under_one_id(spark):
    """The line of one text must not be taken for that of another at the same place."""
    rows = [(1, "first line of one text\nshared by two"), (1, "other line of the same id\nfirst line of one texts"), (1, "first line of one text\nshared by two"), (2, "other line of the samE id\nnew"), (None, "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as _lines", "9 as n_lines", "8 as kept", "7 as version", "6 as row")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "_lines", "kept", "version", "row", "n_lines", "n_dropped"]
    found = sorted((r.doc_id or 0, r.text, r.n_dropped) for r in got.collect())
    assert found[0] == (0, "new", 0) and found[-1] == (2, "new", 1) and {r._lines for r in got.collect()} == {"x"}
    # Of the two texts the one with the smaller hash comes first, so the other's near line goes.
    texts = {x for i, x, _ in found if i == 1}
    assert texts in ({rows[0][1], "other line of the same id"}, {"shared by two", rows[1][1]})


def test_equal_lines_only(spark):
    docs = spark.createDataFrame([(1, "one line\none lime\none line")], "doc_id long, text string")
    assert [r.text for r in line_dedup.dedup_lines(docs, edits=0).collect()] == ["one line\none lime"]
    assert [r.text for r in line_dedup.dedup_lines(docs, near=9).collect()] == ["one line\none lime"]
    assert [r.text for r in line_dedup.dedup_lines(docs).collect()] == ["one line"]
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs, edits=2)


def test_lines_of_odd_rows(odd_docs, no_docs):
    rows = line_dedup.dedup_lines(odd_docs).collect()
    assert sorted((r.doc_id or 0, r.text is None, r.n_dropped) for r in rows) == [(0, False, 0), (1, False, 0), (2, True, 0), (3, False, 0), (4, False, 0), (5, False, 1), (5, False, 1), (6, False, 0)]
    assert line_dedup.dedup_lines(no_docs).collect() == []


def test_hashing_a_large_block_takes_little_memory(monkeypatch):
    """Texts are hashed by runs, which give the hashes of one pass."""
    import tracemalloc

    texts = ["words of a text, " * 1_000, None, "", "ünd"] * 250
    monkeypatch.setattr(wordhash, "RUN_BYTES", 1 << 30)
    want = wordhash.word_hashes(texts)
    monkeypatch.undo()
    wordhash._powers[:] = [np.ones(1, np.uint64)] * 2
    tracemalloc.start()
    got = wordhash.word_hashes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(got, want, strict=True))
    assert peak < 100e6  # 165 MB in one pass over these 4 MB


def test_counts_passed_on_early_give_the_same_model(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "HELD", 200)
    assert toxicity.train(docs, labels) == want


def test_a_task_gives_its_memory_back(monkeypatch):
    from keystrata.llm import shared

    calls = []
    monkeypatch.setattr(shared, "release", lambda: calls.append(1))
    assert list(shared.tidy(iter)([1, 2])) == [1, 2] and calls == [1]
