"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash; a copy of a document gets a virtual
finish time, the source's running number of words divided by the source's target. All
copies are range-sorted by finish time and the order is cut at the total budget. A
source's documents come again, once, where its target exceeds its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import materialize, ordered_positions, packed

#: Rows of a source in a bucket of its shuffled order, about.
BUCKET_ROWS = 4_000
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, COPIES, SEED = 1.5, 2, "mix"


def words(text: Column) -> Column:
    """Number of runs of characters other than space, tab, newline, VT, FF and CR; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, share: float = SHARE, copies: int = COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, source_rows, target`` from one row for each source.

    ``share`` of all words is dealt by weight; what exceeds ``copies`` times a source's
    words is dealt again by weight. The level at which no source exceeds its limit is found directly:
    with sources ordered by limit / weight, the first k at their limits leave a level
    for the others that the next one's limit isn't below.
    """
    pattern = "element_at(array({}), cast((r - 1) % {} + 1 as int))".format(", ".join(map(str, weights)), len(weights))
    ranked = sizes.selectExpr("*", "row_number() over (order by source is null, source) as r")
    ranked = ranked.selectExpr("*", f"cast({pattern} as double) as w", f"{float(copies)}D * source_size as lim")
    ordered = ranked.selectExpr(
        "*",
        f"{float(share)}D * sum(source_size) over () as budget",
        "sum(lim) over (order by lim / w, r rows between unbounded preceding and 1 preceding) as lim_before",
        "sum(w) over (order by lim / w, r rows between current row and unbounded following) as w_from",
    )
    levelled = ordered.selectExpr("*", "(budget - coalesce(lim_before, 0D)) / w_from as level")
    found = levelled.selectExpr("*", "max(case when level <= lim / w then level end) over () as lambda")
    target = "case when lambda is null then lim else least(lim, lambda * w) end as target"
    return found.selectExpr("source", "source_size", "source_rows", target, "cast(budget as long) as budget")


def _place(seed: str, id_col: str, text_col: str) -> Column:
    """What a source's rows are shuffled by: a hash of the id, and of the text where there is no id."""
    nameless = F.concat(F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), nameless)).cast("binary"))


def plan(
    docs: DataFrame,
    share: float = SHARE,
    copies: int = COPIES,
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """A row for each document and copy: ``doc_id, source, size, u, nth, of, source_size, target, copy, finish, taken``.

    Rows that are alike in id, source and size are counted before they are dealt, so that a
    repeated id fills no task; ``nth`` of ``of`` then numbers them.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), _place(seed, id_col, text_col).alias("u")
    )
    base = materialize(narrow.groupBy("doc_id", "source", "size", "u").agg(F.count("*").alias("of")), "sizes")
    sources = base.groupBy("source").agg(F.sum(F.col("size") * F.col("of")).alias("source_size"), F.sum("of").alias("source_rows"))
    goals = materialize(targets(sources, share, copies, weights), "targets")
    joined = base.join(goals, base["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    # Running sums in two levels, so that no task holds a source: buckets of the shuffled order, then rows in a bucket.
    bucket = F.floor(F.conv(F.substring("u", 1, 7), 16, 10).cast("long") * F.ceil(F.col("source_rows") / BUCKET_ROWS) / F.lit(1 << 28)).cast("long")
    dealt = materialize(joined.withColumn("bucket", bucket), "dealt")
    sums = dealt.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("of")).alias("n"))
    before = sums.selectExpr(
        "source as _s",
        "bucket as _b",
        "coalesce(sum(n) over (partition by source order by bucket rows between unbounded preceding and 1 preceding), 0) as base",
    )
    inside = dealt.selectExpr(
        "*", "sum(size * of) over (partition by source, bucket order by u, doc_id, size rows between unbounded preceding and current row) as run"
    )
    placed = inside.join(before, inside["source"].eqNullSafe(before["_s"]) & (inside["bucket"] == before["_b"]))
    each = placed.withColumn("_e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") * copies - 1)))
    each = each.selectExpr("*", f"_e div {copies} + 1 as nth", f"cast(_e % {copies} as int) + 1 as copy")
    cum = F.col("base") + F.col("run") - (F.col("of") - F.col("nth")) * F.col("size")
    finish = F.when(F.col("target") > 0, ((F.col("copy") - 1) * F.col("source_size") + cum) / F.col("target")).otherwise(F.lit(float("inf")))
    columns = ["doc_id", "source", "size", "u", "nth", "of", "source_size", "target", "budget", "copy", "finish"]
    timed = each.withColumn("finish", finish).select(*columns)
    ordered = ordered_positions(timed, ["finish", "u", "doc_id", "copy", "size", "nth"], "size", "finish")
    fits = (F.col("before") + F.col("size") <= F.col("budget")) & (F.col("finish") < float("inf"))
    return ordered.withColumn("taken", fits)


def mix(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    ``taken`` counts the words of the copies before the cut. Null texts have size 0,
    a null source is a source of its own, sources without words get the target 0, an
    empty table gives no rows. Rows that repeat an id, and rows without one, are each a document
    of their own. Whole texts are counted, however long; other columns are ignored.
    Reruns give the same rows: order depends on ids alone, or on texts where there is no id.
    """
    rows = plan(docs, **options)
    taken = F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken")
    each = rows.groupBy("doc_id", "source", "size", "u", "nth", "source_size", "target").agg(taken)
    return each.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The documents of the mix, repeated as often as they are taken; the columns stay as they are.

    In a source and copy, the taken documents are those up to a point of the shuffled
    order, so one such point for each source and copy tells them; texts aren't shuffled.
    Only rows alike in id, source and size that such a point divides are numbered, by their texts.
    """
    seed, id_col, text_col, source_col = (options.get(*x) for x in (("seed", SEED), ("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    # Nulls come first, as in the order of the plan.
    here = lambda: F.struct("u", F.col("doc_id").isNotNull().alias("named"), "doc_id")
    points = plan(docs, **options).where("taken").groupBy("source", "copy").agg(F.max(F.struct(here().alias("at"), "size", "nth", "of")).alias("last"))
    cuts = materialize(points.groupBy("source").agg(F.array_agg("last").alias("cuts")), "cuts")
    row = packed(docs, u=_place(seed, id_col, text_col), doc_id=F.col(id_col), origin=F.col(source_col))
    chosen = row.withColumn("at", here()).join(cuts, F.col("origin").eqNullSafe(F.col("source"))).select("row", "at", "origin", "cuts")
    # Words are counted only where a point's id is a row's own.
    size = words(F.col(f"row.`{text_col}`"))
    whole = lambda c: (F.col("at") < c["at"]) | ((F.col("at") == c["at"]) & ((size < c["size"]) | ((size == c["size"]) & (c["nth"] == c["of"]))))
    part = lambda c: (c["nth"] < c["of"]) & (F.col("at") == c["at"]) & (size == c["size"])
    plain = chosen.withColumn("n", F.size(F.filter("cuts", whole)))
    taken = plain.select("row", "n")
    if not cuts.where(F.exists("cuts", lambda c: c["nth"] < c["of"])).isEmpty():
        divided = plain.where(F.exists("cuts", part)).select("*", size.alias("size"), F.col(f"row.`{text_col}`").alias("text"))
        divided = divided.selectExpr("*", "row_number() over (partition by origin, at, size order by xxhash64(text), text) as nth")
        more = F.size(F.filter("cuts", lambda c: (c["nth"] < c["of"]) & (F.col("at") == c["at"]) & (F.col("size") == c["size"]) & (F.col("nth") <= c["nth"])))
        taken = plain.where(~F.exists("cuts", part)).select("row", "n").unionByName(divided.select("row", (F.col("n") + more).alias("n")))
    return taken.where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


#: The same rows in DuckDB: levels, running sums and the cut, on whole tables.
ORACLE = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5('mix:' || coalesce(doc_id::varchar, ':' || md5(coalesce(text, '')))) as u, row_number() over () as rid from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, ([3, 1, 2])[((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as w, 2.0::double * source_size as lim, row_number() over (order by source is null, source) as rn from s),
o as (select *, 1.5::double * (sum(source_size) over ())::double as budget, sum(lim) over (order by lim / w, rn rows between unbounded preceding and 1 preceding) as lim_before, sum(w) over (order by lim / w, rn rows between current row and unbounded following) as w_from from r),
l as (select *, (budget - coalesce(lim_before, 0)) / w_from as level from o),
g as (select source, source_size, case when lam is null then lim else least(lim, lam * w) end as target, floor(budget)::bigint as budget from (select *, max(case when level <= lim / w then level end) over () as lam from l)),
c as (select d.*, g.source_size, g.target, g.budget, sum(size) over (partition by d.source order by u, doc_id, size rows between unbounded preceding and current row) as cum from d join g on d.source is not distinct from g.source),
e as (select *, case when target > 0 then ((k - 1) * source_size + cum)::double / target else 'inf'::double end as finish from c, (values (1), (2)) v(k)),
t as (select *, sum(size) over (order by finish, u, doc_id, k, size rows between unbounded preceding and current row) as run from e)
select doc_id, size, source_size, target, sum(case when run <= budget and finish < 'inf'::double then size else 0 end)::bigint as taken from t group by rid, doc_id, size, source_size, target
"""
