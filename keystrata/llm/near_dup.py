"""Near-duplicate documents by ProbMinHash.

Texts are weighted sets of five-word shingles, weighted by how often they occur. The
signature (Ertl, 2020) gives each shingle a Poisson process of arrivals with its weight
as the rate; each arrival falls on a random component, and a component keeps the
shingle that arrived first. The share of equal components estimates the probability
Jaccard similarity. Shingles whose next arrival is later than all that a signature
holds end early. Signatures are cut into bands; texts that share a band are compared
on their whole shingle sets, and links are joined to classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.components import connected_components
from keystrata.llm.shared import batches_of, blocks, join_checked, materialize, packed, ship, text_hashes, tidy
from keystrata.llm.wordhash import mix, shingles

#: Words in a shingle and least similarity.
WORDS, SIMILARITY = 5, 0.8
#: 32 bands of 5 components miss a pair of similarity 0.8 with probability 3e-6.
BANDS, ROWS = 32, 5

#: In buckets of up to so many texts all pairs are compared; members of larger ones meet in blocks.
FEW = 8
#: Texts and bytes of sets that one side of a block holds, about.
BLOCK, BLOCK_BYTES = 500, 8 << 20

_U = np.uint64


def signatures(who: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """ProbMinHash signatures (texts, size) of weighted sets given as sorted triples; 0 where a set is empty."""
    when = np.full(texts * size, np.inf)
    what = np.zeros(texts * size, np.uint64)
    live, time, step = np.arange(len(who)), np.zeros(len(who)), 0
    while len(live):
        step += 1
        draw = mix(shingle[live] + _U(step * 0xD1342543DE82EF95 & (2**64 - 1)))
        u = ((draw >> _U(11)).astype(np.float64) + 0.5) / 2.0**53
        time = time - np.log(u) / weight[live]
        cell = who[live] * size + (mix(draw ^ _U(0x5851F42D4C957F2D)) % _U(size)).astype(np.int64)
        better = np.flatnonzero(time < when[cell])
        # Of several arrivals at a component in this step the first wins, ties by shingle.
        order = better[np.lexsort((shingle[live[better]], -time[better]))]
        near = order[time[order] <= when[cell[order]]]
        when[cell[near]] = time[near]  # the last written is the earliest
        what[cell[near]] = shingle[live[near]]
        worst = when.reshape(texts, size).max(axis=1)
        go = time < worst[who[live]]
        live, time = live[go], time[go]
    return what.reshape(texts, size)


def band_keys(what: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(what), bands)).copy()
    cut = what.reshape(len(what), bands, rows)
    for r in range(rows):
        key = mix(key ^ cut[:, :, r])
    return key.view(np.int64)


def similarities(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Exact probability Jaccard and plain Jaccard similarity of two weighted sets (sorted shingles, weights)."""
    both, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    union = len(x[0]) + len(y[0]) - len(both)
    if not len(both):
        return 0.0, 0.0
    plain = len(both) / union
    wx, wy = x[1][i].astype(float), y[1][j].astype(float)
    # sum over d of 1 / sum over e of max(x_e / x_d, y_e / y_d): for ratio t = y_e / x_e, the max
    # is x_e / x_d where t < y_d / x_d, so sorted ratios and running sums give all sums at once.
    t = wy / wx
    order = np.argsort(t, kind="stable")
    only_x, only_y = x[1].sum() - wx.sum(), y[1].sum() - wy.sum()
    t, wx, wy = t[order], wx[order], wy[order]
    cum_x, cum_y = np.cumsum(wx), np.cumsum(wy)
    last = np.searchsorted(t, t, side="right") - 1
    total = (only_x + cum_x[last]) / wx + (only_y + cum_y[-1] - cum_y[last]) / wy
    return float((1 / total).sum()), plain


def _sketches(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """``id, h1, h2, bands``; bands is null for texts without words, all but id are null for null texts.

    A text in which a shingle occurs twice also gets the bands of its unweighted set, so that
    candidates are found for plain Jaccard similarity too; for other texts both are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text", 2 << 20):
            texts = b.column("_text").to_pylist()
            n, size = len(texts), bands * rows
            who, what, count = shingles(texts, words)
            has = np.bincount(who, minlength=n) > 0
            keys = band_keys(signatures(who, what, count.astype(float), n, size), bands, rows)
            again = np.bincount(who, count > 1, n) > 0
            some = again[who]
            number = np.cumsum(again) - 1
            plain = band_keys(signatures(number[who[some]], what[some], np.ones(some.sum()), int(again.sum()), size), bands, rows)
            out = [np.concatenate([k, plain[number[i]]]) if again[i] else k for i, k in enumerate(keys) if has[i]]
            ends = np.cumsum(np.where(has, np.where(again, 2 * bands, bands), 0))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            column = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*out, np.empty(0, np.int64)])), mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), column], ["id", "h1", "h2", "bands"])

    h1, h2 = text_hashes(text_col)
    hashed = docs.select(F.col(id_col).cast("long").alias("id"), h1.alias("h1"), h2.alias("h2"), F.col(text_col).alias("_text"))
    return hashed.mapInArrow(tidy(run), "id long, h1 long, h2 long, bands array<long>")


def _id_or_flag(name: str) -> tuple[Column, Column]:
    """An id as a key that joins match where it is null too."""
    return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long")).alias("rep"), F.col(name).isNull().alias("none")


def _sets(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id, s, w``: shingles and weights, as binaries, of ``texts`` (id, h1, h2, rep), each found in a row whose id is ``rep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text", 1 << 20):
            n = b.num_rows
            who, what, count = shingles(b.column(1).to_pylist(), words)
            cut = np.searchsorted(who, np.arange(n + 1))
            s = [what[cut[i] : cut[i + 1]].tobytes() for i in range(n)]
            w = [count[cut[i] : cut[i + 1]].astype(np.uint32).tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.binary()), pa.array(w, pa.binary())], ["id", "s", "w"])

    h1, h2 = text_hashes(text_col)
    there = docs.select(h1.alias("h1"), h2.alias("h2"), *_id_or_flag(id_col), F.col(text_col).alias("_text"))
    wanted = join_checked(there, texts.select("id", "h1", "h2", *_id_or_flag("rep")), ["h1", "h2", "rep", "none"])
    return wanted.select("id", "_text").mapInArrow(tidy(run), "id long, s binary, w binary")


def _verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose probability Jaccard or plain Jaccard similarity is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_, b_, keep, score = b.column(0), b.column(1), [], []
            for sa, wa, sb, wb in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                p, j = similarities((np.frombuffer(sa, np.uint64), np.frombuffer(wa, np.uint32)), (np.frombuffer(sb, np.uint64), np.frombuffer(wb, np.uint32)))
                keep.append(max(p, j) >= least)
                score.append(p)
            yield pa.RecordBatch.from_arrays([a_, b_, pa.array(score, pa.float64()), pa.array(keep, pa.bool_())], ["a", "b", "similarity", "keep"])

    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"), F.col("w").alias("wa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"), F.col("w").alias("wb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "wa", "sb", "wb")
    # A link is one comparison, but sets can be long: many small tasks rather than few.
    return joined.mapInArrow(tidy(run), "a long, b long, similarity double, keep boolean").where("keep").drop("keep")


class _Cell:
    """Texts that meet in one task: each row is compared with all columns by a few passes over the columns' shingles."""

    def __init__(self, s: list[np.ndarray], w: list[np.ndarray], columns: np.ndarray) -> None:
        self.s, self.w, self.columns = s, w, columns
        self.length = np.array([len(x) for x in s])
        self.total = np.array([x.sum() for x in w], float)
        self.kinds, codes = np.unique(np.concatenate(s), return_inverse=True)
        ends = np.cumsum(self.length)
        own = [codes[e - n : e] for e, n in zip(ends.tolist(), self.length.tolist(), strict=True)]
        self.own = own
        self.codes = np.concatenate([own[j] for j in columns])
        self.starts = np.concatenate([[0], np.cumsum(self.length[columns])[:-1]])
        share = [w[j] / self.total[j] for j in columns]
        self.share = np.concatenate(share)
        self.mark = np.zeros(len(self.kinds))

    def linked(self, i: int, least: float, known: np.ndarray) -> np.ndarray:
        """The columns whose plain or probability Jaccard similarity to text ``i`` is at least ``least``, those ``known`` aside."""
        self.mark[self.own[i]] = self.w[i] / self.total[i]
        here = self.mark[self.codes]
        self.mark[self.own[i]] = 0
        both = np.add.reduceat((here > 0).astype(np.int64), self.starts)
        n = self.length[self.columns]
        link = both / (self.length[i] + n - both) >= least
        # The probability Jaccard similarity is at most the sum of the smaller shares; with weights of 1 it is the plain one.
        most = np.add.reduceat(np.minimum(here, self.share), self.starts)
        repeats = (self.total > self.length)[self.columns] | (self.total[i] > self.length[i])
        for k in np.flatnonzero(~link & ~known & repeats & (most >= least - 1e-9)):
            j = self.columns[k]
            link[k] = similarities((self.s[i], self.w[i]), (self.s[j], self.w[j]))[0] >= least
        return self.columns[link & ~known]


def spanning_links(table: pa.Table, least: float) -> list[tuple[int, int]]:
    """Links that join the classes of a block: each text flagged ``row`` was compared with each that isn't.

    ``table`` has ``id, class, row, s, w``. Pairs of one class, or of classes that a link has joined, need no link.
    """
    ids, classes, is_row = (table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "class", "row"))
    _, at, text = np.unique(ids, return_index=True, return_inverse=True)
    s = [np.frombuffer(x, np.uint64) for x in table.column("s").take(pa.array(at)).to_pylist()]
    w = [np.frombuffer(x, np.uint32) for x in table.column("w").take(pa.array(at)).to_pylist()]
    ids, classes = ids[at], classes[at]
    rows, columns = np.unique(text[is_row]), np.unique(text[~is_row])
    if not len(rows) or not len(columns):
        return []
    cell, links = _Cell(s, w, columns), []
    for i in rows:
        for j in cell.linked(i, least, classes[columns] == classes[i]):
            if classes[i] != classes[j]:
                links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                classes[classes == max(classes[i], classes[j])] = min(classes[i], classes[j])
    return links


def _meet(members: DataFrame, roots: DataFrame, sets: DataFrame, least: float) -> DataFrame | None:
    """Links (a, b) among texts of different classes in ``members`` (hub, id); None where no group holds several classes.

    Only texts outside a group's largest class meet all of its texts. Both sides are dealt in blocks, so a task holds
    two blocks at most, whatever the size of a group, and what comes out are links, not pairs.
    """

    def run(table: pa.Table) -> pa.Table:
        links = spanning_links(table, least)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    named = members.join(roots, "id", "left").select("hub", "id", F.coalesce("root", "id").alias("class"))
    open_ = named.groupBy("hub").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("hub")
    sized = materialize(named.join(open_, "hub").join(sets.select("id", (F.length("s") + F.length("w")).alias("bytes")), "id"), "open")
    if sized.isEmpty():
        return None
    classes = sized.groupBy("hub", "class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    groups = classes.groupBy("hub").agg(F.max(F.struct("n", "class", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("long")
    cut = groups.select(
        "hub",
        F.col("top.class").alias("largest"),
        parts(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("down"),
        parts(F.col("n"), F.col("bytes")).alias("across"),
    )
    dealt = sized.drop("bytes").join(cut, "hub")
    rows = dealt.where("class <> largest").selectExpr(
        "hub", "id", "class", "true as row", "pmod(xxhash64(id, 1), down) as i", "explode(sequence(0L, across - 1)) as j"
    )
    columns = dealt.selectExpr(
        "hub", "id", "class", "false as row", "explode(sequence(0L, down - 1)) as i", "pmod(xxhash64(id, 2), across) as j"
    )
    met = rows.unionByName(columns).join(sets, "id").select("hub", "i", "j", "id", "class", "row", "s", "w")
    return materialize(met.groupBy("hub", "i", "j").applyInArrow(run, "a long, b long"), "met")


def _classes(docs: DataFrame, similarity: float, words: int, bands: int, rows: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``id, h1, h2`` of every row, and ``h1, h2, rep, class_id, first`` of each different text.

    ``rep`` is the smallest id that a text occurs under, ``class_id`` the smallest of its class, and ``first``
    whether it is the text that stands for its class.
    """
    spark = docs.sparkSession
    ship(spark)
    with batches_of(spark, 1_000):
        sketch = materialize(_sketches(docs, id_col, text_col, words, bands, rows), "sketches")
    # Equal texts are counted before they meet, and a number names each text, whatever ids it occurs under.
    copies = sketch.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    copies = materialize(copies.select(F.monotonically_increasing_id().alias("no"), "h1", "h2", "rep"), "copies")
    named = copies.select(F.col("no").alias("text"), "h1", "h2", *_id_or_flag("rep"))
    reps = sketch.where("bands is not null").select("h1", "h2", *_id_or_flag("id"), "bands").join(named, ["h1", "h2", "rep", "none"])
    banded = reps.select(F.col("text").alias("id"), F.explode(F.array_distinct("bands")).alias("key")).distinct()
    banded = materialize(banded, "banded")
    held = banded.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
    shared = materialize(banded.join(held.where("lo < hi").select("key", "n"), "key"), "shared")
    few, many = shared.where(F.col("n") <= FEW).select("key", "id"), shared.where(F.col("n") > FEW)
    close = few.select("key", F.col("id").alias("a")).join(few.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b")
    # A text that shares buckets with many is near the middle of its family, so it links more of them than any other.
    degrees = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    hubs = many.join(degrees, "id").groupBy("key").agg(F.max(F.struct("degree", "id")).getField("id").alias("hub"))
    members = materialize(many.join(hubs, "key").select("hub", "id").distinct(), "members")
    spokes = members.where("hub <> id").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"))
    pairs = materialize(close.unionByName(spokes).distinct(), "pairs")
    wanted = copies.withColumnRenamed("no", "id").join(shared.select("id").distinct(), "id")
    with batches_of(spark, 500):
        sets = materialize(_sets(docs, wanted, id_col, text_col, words).dropDuplicates(["id"]), "sets")
    with batches_of(spark, 250):
        links = materialize(_verify(pairs, sets, similarity), "found").select("a", "b")
    roots = connected_components(links)
    with batches_of(spark, 250):
        more = _meet(members, roots, sets, similarity)
    if more is not None:
        roots = connected_components(links.unionByName(more))
    rooted = copies.join(roots.select(F.col("id").alias("no"), "root"), "no", "left").withColumn("root", F.coalesce("root", "no"))
    rooted = materialize(rooted, "rooted")
    chosen = rooted.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "h1", "h2")).alias("top"))
    texts = rooted.join(chosen, "root").select(
        "h1", "h2", "rep", F.col("top.rep").alias("class_id"), ((F.col("top.h1") == F.col("h1")) & (F.col("top.h2") == F.col("h2"))).alias("first")
    )
    return sketch.select("id", "h1", "h2"), materialize(texts, "classes")


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    words: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, class_id`` for every row; class_id is the smallest id of the documents it is linked to.

    Equal texts are one class without comparison. Texts of the same class are connected by links: pairs whose
    probability Jaccard or plain Jaccard similarity is at least ``similarity``. All pairs that share a bucket are
    compared unless they are in one class already: in buckets of up to ``FEW`` texts as pairs; in larger ones first
    with the bucket's hub (the text that shares most buckets), and then, where several classes are left, those
    outside the largest class with all others, in blocks of bounded size. So nothing but the signatures decides
    what is found, and rows are linear in a bucket's size; comparisons within blocks are not, where many texts share
    a bucket without being similar.

    A null text is a class of its own, as is each text without words unless it is equal to another; whole texts are
    read, however long. Rows that repeat an id with different texts are judged by their texts, each row for itself.
    Rows without an id are compared like all others; a class none of whose rows has an id has a null class_id. An
    empty table gives no rows. Other columns are ignored.
    """
    each, texts = _classes(docs, similarity, words, bands, rows, id_col, text_col)
    found = each.join(texts.select("h1", "h2", "class_id"), ["h1", "h2"], "left")
    return found.select(F.col("id").alias("doc_id"), F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def one_of_each(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    words: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id, those without an id last.

    Rows with a null text all stay. Of rows that repeat both id and text one stays. All columns stay as they are.
    """
    each, texts = _classes(docs, similarity, words, bands, rows, id_col, text_col)
    keys = ["h1", "h2", "rep", "none"]
    kept = texts.where("first").select("h1", "h2", *_id_or_flag("rep"))
    mine = each.where("h1 is not null").select("h1", "h2", *_id_or_flag("id"))
    gone = materialize(mine.join(kept, keys, "left_anti").distinct(), "gone")
    again = materialize(mine.join(kept, keys, "left_semi").groupBy(*keys).count().where("count > 1").select(*keys), "again")
    h1, h2 = text_hashes(text_col)
    rep, none = _id_or_flag(id_col)
    out = join_checked(packed(docs, h1=h1, h2=h2, rep=rep, none=none), gone, keys, "left_anti")
    if not again.isEmpty():
        repeated = join_checked(out, again, keys, "left_semi").dropDuplicates(keys)
        out = join_checked(out, again, keys, "left_anti").unionByName(repeated)
    return out.select("row.*")
