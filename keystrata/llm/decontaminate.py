"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts become lower-case words. Fixed masks pick some positions of a window and ignore
the others, so a hash of the picked words survives substitutions at the ignored ones.
Hashes of the benchmark and of the documents are joined, and each hit is verified:
document and item are laid over each other at the hit, and the item has leaked if in
some window of ``WINDOW`` words at least ``SIMILARITY`` of the words are equal. An item
of fewer words has leaked if all its words are there, next to each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import join_checked, materialize, packed, text_hashes

#: Positions that each mask picks. Found by search: for any two substituted words in a
#: window of 13, one of the masks fits somewhere between them (tests check all pairs).
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
WINDOW, SIMILARITY = 13, 0.8
#: Words that an item must have: shorter ones are common speech, which clean texts hold too. 1 takes every item.
SHORTEST = 5
#: Hashes of the benchmark up to which they are broadcast (some 50 bytes each); beyond, the documents' hashes are shuffled.
BROADCAST_SEEDS = 400_000
#: Words of a text that are hashed together.
CHUNK = 256


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; null and empty texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _masks(items: DataFrame) -> list[tuple[int, ...]]:
    """``MASKS``, and a run of n words for each number of words under a mask's length that an item has."""
    reach = min(m[-1] for m in MASKS) + 1
    short = items.select(F.size("_item").alias("n")).where(F.col("n") < reach).distinct().collect()  # at most 7 numbers
    return [*MASKS, *(tuple(range(r["n"])) for r in sorted(short))]


def _seeds(texts: DataFrame, words: str, masks: list[tuple[int, ...]]) -> DataFrame:
    """A row for each position and mask: the other columns of ``texts``, ``_at``, ``_hash`` and ``_fits``.

    A text is cut into chunks that overlap by a mask's length, so that no row holds a whole long text for
    each of its positions; words are hashed once, and positions from these hashes. Where a mask sticks out
    at a text's end, ``_fits`` is false, and the hash is that of fewer words, which equals no hash that fits:
    documents need no filter, which would take every hash twice.
    """
    reach = max(m[-1] for m in masks)
    others = [c for c in texts.columns if c != words]
    hashed = texts.select(*others, F.transform(words, lambda w: F.xxhash64(w)).alias("_w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(CHUNK))
    cut = hashed.select(*others, "_w", F.explode(starts).alias("_from"))
    cut = cut.select(*others, "_from", F.slice("_w", F.col("_from") + 1, F.lit(CHUNK + reach)).alias("_c"))
    places = F.sequence(F.lit(0), F.greatest(F.least(F.size("_c"), F.lit(CHUNK)) * len(masks) - 1, F.lit(0)))
    each = cut.select(*others, "_from", "_c", F.explode(places).alias("_p"))
    each = each.selectExpr(*others, "_from", "_c", f"cast(_p div {len(masks)} as int) as _in", f"_p % {len(masks)} as _mask")
    hashes = [F.xxhash64(F.lit(k), *(F.get("_c", F.col("_in") + o) for o in m)) for k, m in enumerate(masks)]
    value, fits = hashes[-1], F.lit(masks[-1][-1])
    for k in range(len(masks) - 1):
        value = F.when(F.col("_mask") == k, hashes[k]).otherwise(value)
        fits = F.when(F.col("_mask") == k, masks[k][-1]).otherwise(fits)
    return each.select(*others, (F.col("_from") + F.col("_in")).alias("_at"), value.alias("_hash"), (F.col("_in") + fits < F.size("_c")).alias("_fits"))


def _verified(hits: DataFrame) -> DataFrame:
    """Hits with ``_words``, ``_item`` and ``_diagonal`` whose best window is similar enough."""
    window = F.least(F.size("_item"), F.lit(WINDOW))
    need = F.when(F.size("_item") < WINDOW, F.size("_item")).otherwise(math.ceil(WINDOW * SIMILARITY - 1e-9))
    steps = F.sequence(F.lit(0), F.size("_item") - 1)
    # get() takes positions from 0; what sticks out on the left must be ruled out by hand.
    same = lambda j: (j + F.col("_diagonal") >= 0) & (F.get("_words", j + F.col("_diagonal")) == F.get("_item", j))
    equal = F.transform(steps, lambda j: F.when(same(j), 1).otherwise(0))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    laid = hits.withColumn("_equal", equal).withColumn("matched", total("_equal")).where(F.col("matched") >= need)
    starts = F.sequence(F.lit(1), F.size("_item") - (window - 1))
    best = F.array_max(F.transform(starts, lambda s: total(F.slice("_equal", s, window))))
    return laid.withColumn("window_matched", best).where(F.col("window_matched") >= need)


def _leaked_texts(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, shortest: int) -> DataFrame:
    """``h1, h2, item_id, position, matched, item_tokens, window_matched`` for each different text and item that overlap."""
    spark_items = benchmark.where(F.col(item_col).isNotNull())
    items = spark_items.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("_item")).where(F.size("_item") >= max(1, shortest))
    items = materialize(items.distinct(), "items")
    masks = _masks(items)
    seeds = _seeds(items, "_item", masks).where("_fits").select("item_id", F.col("_at").alias("_item_at"), "_hash")
    seeds = materialize(seeds, "seeds")
    found = F.array_agg(F.struct("item_id", "_item_at")).alias("_found")
    h1, h2 = text_hashes(text_col)
    words = docs.where(F.col(text_col).isNotNull()).select(h1.alias("h1"), h2.alias("h2"), tokens(F.col(text_col)).alias("_words"))
    seen = _seeds(words, "_words", masks).drop("_fits")
    if seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        # One row for each hash, so that each position probes once.
        hits = seen.join(F.broadcast(seeds.groupBy("_hash").agg(found)), "_hash").select("h1", "h2", "_at", F.inline("_found"))
    else:
        hits = seen.join(seeds, "_hash")
    diagonals = hits.select("h1", "h2", "item_id", (F.col("_at") - F.col("_item_at")).alias("_diagonal")).distinct()
    diagonals = materialize(diagonals, "hits")
    # Only texts with a hit are read again, and copies of a text once.
    texts = docs.select(h1.alias("h1"), h2.alias("h2"), F.col(text_col).alias("_text"))
    texts = join_checked(texts, diagonals.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    laid = diagonals.join(texts.select("h1", "h2", tokens(F.col("_text")).alias("_words")), ["h1", "h2"]).join(items, "item_id")
    columns = [F.col("_diagonal").alias("position"), "matched", F.size("_item").alias("item_tokens"), "window_matched"]
    found = _verified(laid).select("h1", "h2", "item_id", *columns)
    best = F.max_by(F.struct("position", "matched", "item_tokens", "window_matched"), F.struct("matched", "window_matched", -F.col("position")))
    return materialize(found.groupBy("h1", "h2", "item_id").agg(best.alias("b")).select("h1", "h2", "item_id", "b.*"), "leaked")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    shortest: int = SHORTEST,
) -> DataFrame:
    """``doc_id, item_id, position, matched, item_tokens, window_matched``: each document and item that overlap.

    ``position`` is the document's word that the item's first word would lie on, at the
    best match (ties to the first). Items of under ``shortest`` words, null and empty texts
    and items without an id match nothing; documents of any length are searched whole. Rows that
    repeat a document's or an item's id count as one, with the best match of their texts. Rows of documents without an id
    are left out here, as they can't be named; ``clean_documents`` takes them too. Empty
    tables give no rows. Other columns are ignored.
    """
    leaked = _leaked_texts(docs, benchmark, text_col, item_col, item_text, shortest)
    h1, h2 = text_hashes(text_col)
    named = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), h1.alias("h1"), h2.alias("h2"))
    rows = join_checked(named, leaked, ["h1", "h2"])
    best = F.max_by(F.struct("position", "matched", "item_tokens", "window_matched"), F.struct("matched", "window_matched", -F.col("position")))
    return rows.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """``docs`` without the rows whose text holds a leaked item, whatever their id; all other rows and all columns stay."""
    defaults = {"item_col": "item_id", "item_text": "text", "shortest": SHORTEST} | options
    bad = _leaked_texts(docs, benchmark, text_col, **defaults).select("h1", "h2").distinct()
    h1, h2 = text_hashes(text_col)
    return join_checked(packed(docs, h1=h1, h2=h2), bad, ["h1", "h2"], "left_anti").select("row.*")


#: The same rows in DuckDB, by another way: of 13 words of which at most two differ, four in a row are equal, so
#: runs of four words are joined (items have five at least), and all words are compared at each place found.
ORACLE = r"""
with d as (select distinct doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents where doc_id is not null and text is not null),
i as (select distinct item_id, w from (select item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark where item_id is not null and text is not null) where len(w) >= 5),
dp as (select doc_id, w, unnest(range(1, len(w) - 2)) as p from d where len(w) >= 4),
ip as (select item_id, w, unnest(range(1, len(w) - 2)) as p from i),
ig as (select item_id, p, w[p : p + 3] as g from ip),
dg as (select doc_id, p, w[p : p + 3] as g from dp),
hits as (select distinct dg.doc_id, ig.item_id, dg.p - ig.p as diagonal from dg join ig using (g)),
laid as (select h.*, len(i.w) as n, [case when j + diagonal >= 1 and d.w[(j + diagonal)::int] = i.w[j] then 1 else 0 end for j in range(1, len(i.w) + 1)] as e
  from hits h join d on d.doc_id = h.doc_id join i on i.item_id = h.item_id),
best as (select doc_id, item_id, diagonal, n, list_sum(e) as matched, list_max([list_sum(e[s : s + least(n, 13) - 1]) for s in range(1, (n - least(n, 13) + 2)::bigint)]) as window_matched from laid)
select doc_id, item_id, diagonal::int as position, matched::int as matched, n::int as item_tokens, window_matched::int as window_matched
from best where window_matched >= case when n < 13 then n else 11 end
qualify row_number() over (partition by doc_id, item_id order by matched desc, window_matched desc, diagonal) = 1
"""
