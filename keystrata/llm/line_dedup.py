"""Line deduplication within one edit, in DataFrame operations only.

A line is dropped if an earlier line (by ``doc_id``, then line number) is equal to it
or one edit away: a character inserted, deleted or substituted. Two lines are one edit
apart only if deleting at most one character from each gives the same string, so each
line's variants with one character deleted are hashed and joined. Variants are made only
for lines that can have a partner: an edit leaves the first or the last half of a line as it was.

All variants with a character deleted at the same place are one substitution apart, and
all lines one of whose variants is a given line are one insertion from that line; in such a group a
line need only be compared with the earliest, so no group's pairs are emitted. A group has
at most as many lines as there are characters to put in at each place of its variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.llm.shared import join_checked, materialize, packed

#: Edits that two lines may differ by: 1, or 0 for equal lines only.
EDITS = 1
#: Characters from which lines are compared within an edit; 1 takes all of them.
NEAR = 1
#: Characters in a block of a line; a variant's hash joins those of what lies before, in and after the block.
BLOCK = 256
#: White space of which a blank line consists.
BLANK = " \t\r\x0b\x0c"


def _version(text_col: str) -> Column:
    """Tells texts under one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, version, line_no, line`` of every line that isn't blank."""
    cut = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), _version(text_col).alias("version"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line")
    )
    return cut.where(F.btrim("line", F.lit(BLANK)) != "")


def _identity(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"), F.char_length(line).alias("n")]


def _halves() -> Column:
    """Hashes of a line's first and last half, for its own length and for one less."""
    at = lambda n: (F.floor(n / 2)).cast("int")
    n = F.col("n")
    one = lambda side, length: F.xxhash64(F.lit(side), length, F.substring("line", F.lit(1), at(length)) if side == "first" else F.substring("line", n - at(length) + 1, at(length)))
    return F.array(one("first", n), one("last", n), one("first", n - 1), one("last", n - 1))


def earlier_lines(docs: DataFrame, edits: int = EDITS, near: int = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``h1, h2, n, first, partner``: a row for each different line.

    ``first`` is its first place (doc_id, version, line_no), where ``version`` is a hash of the text;
    ``partner`` the place of an earlier line one edit away, or null. The line can be found by its hashes and length.
    """
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    lines = _lines(docs, id_col, text_col)
    place = F.struct("doc_id", "version", "line_no")
    narrow = lines.select(place.alias("at"), *_identity(F.col("line")), "line")
    if not edits:
        only = narrow.groupBy("h1", "h2", "n").agg(F.min("at").alias("first"))
        return materialize(only.withColumn("partner", F.lit(None).cast(only.schema["first"].dataType)), "lines")
    narrow = narrow.withColumn("halves", F.when(F.col("n") >= near, _halves()))
    keys = [f"k{k}" for k in range(4)]
    spread = narrow.select("at", "h1", "h2", "n", *(F.col("halves")[k].alias(f"k{k}") for k in range(4)))
    distinct = materialize(spread.groupBy("h1", "h2", "n", *keys).agg(F.min("at").alias("first")), "lines")
    halves = distinct.where("k0 is not null").select("h1", "h2", "n", "first", F.explode(F.array(*keys)).alias("key"))
    shared = halves.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("key")
    able = halves.join(shared, "key", "left_semi").select("h1", "h2", "n", "first.*").distinct()
    able = materialize(able, "able")
    # A place names a line: only the texts of lines that can have a partner are read again.
    at = ["doc_id", "version", "line_no"]
    texts = join_checked(lines, able, at).dropDuplicates(at).select("h1", "h2", "n", place.alias("first"), "line")
    texts = materialize(texts, "able_lines")

    last = F.floor((F.col("n") - 1) / BLOCK)
    front = F.xxhash64(F.substring("line", F.lit(1), F.col("q") * BLOCK))
    # A line with one character less, hashed as a variant whose deleted character was in block q would be.
    own = texts.withColumn("q", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / BLOCK).cast("int"))))
    mine = F.substring("line", F.col("q") * BLOCK + 1, F.lit(BLOCK - 1))
    rest = F.xxhash64(F.expr(f"substring(line, q * {BLOCK} + {BLOCK})"))
    own = own.select(F.xxhash64(front, mine, rest).alias("v"), F.col("n").alias("vn"), F.lit(0).alias("place"), "first")
    cut = texts.withColumn("q", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    after = F.xxhash64(F.expr(f"substring(line, (q + 1) * {BLOCK} + 1)"))
    cut = cut.select("n", "first", "q", front.alias("before"), after.alias("after"), F.substring("line", F.col("q") * BLOCK + 1, F.lit(BLOCK)).alias("mid"))
    cut = cut.withColumn("i", F.explode(F.sequence(F.lit(1), F.char_length("mid"))))
    variant = F.concat(F.substring("mid", F.lit(1), F.col("i") - 1), F.expr("substring(mid, i + 1)"))
    where = (F.col("q") * BLOCK + F.col("i")).cast("int")
    deleted = cut.select(F.xxhash64("before", variant, "after").alias("v"), (F.col("n") - 1).alias("vn"), where.alias("place"), "first")
    # One shuffle by the variant serves both windows. A line's first place names it.
    same_place, same_line = Window.partitionBy("v", "vn", "place"), Window.partitionBy("v", "vn")
    rows = own.unionByName(deleted)
    rows = rows.withColumn("shorter", F.min(F.when(F.col("place") == 0, F.col("first"))).over(same_line))
    rows = rows.withColumn("longer", F.min(F.when(F.col("place") > 0, F.col("first"))).over(same_line))
    rows = rows.withColumn("substituted", F.when(F.col("place") > 0, F.min("first").over(same_place)))
    other = F.when(F.col("place") > 0, F.least("substituted", "shorter")).otherwise(F.col("longer"))
    named = rows.withColumn("partner", other).where(F.col("partner") < F.col("first")).groupBy("first").agg(F.min("partner").alias("partner"))
    theirs = texts.select(F.col("line").alias("other_line"), F.col("first").alias("partner"))
    checked = named.join(texts, "first").join(theirs, "partner")
    verified = checked.where(F.levenshtein("line", "other_line", 1).between(0, 1)).select("h1", "h2", "n", "partner")
    return distinct.select("h1", "h2", "n", "first").join(materialize(verified, "partners"), ["h1", "h2", "n"], "left")


def dedup_lines(docs: DataFrame, edits: int = EDITS, near: int = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with dropped lines taken out of the text, and ``n_lines`` and ``n_dropped``, which replace columns of these names.

    Lines of white space alone are blank and stay. Null and empty texts, and rows without an id, stay as they are; a
    text whose lines all go becomes empty. Rows that repeat both id and text are the same document; of different texts
    under one id the one with the smaller hash comes first. Lines and texts of any length are read whole, an empty
    table gives no rows, other columns stay as they are.
    """
    kept = earlier_lines(docs, edits, near, id_col, text_col).where("partner is null").select("first.*")
    by_doc = kept.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list("line_no")).alias("kept"))
    keyed = packed(docs, doc_id=F.col(id_col), version=_version(text_col)).join(by_doc, ["doc_id", "version"], "left")
    text = F.col(f"row.`{text_col}`")
    split = keyed.select("row", "kept", F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("lines"), (F.col("doc_id").isNull() | text.isNull()).alias("whole"))
    # Places of blank lines, and of those kept, in order.
    blank = F.filter(F.transform("lines", lambda x, i: F.when(F.btrim(x, F.lit(BLANK)) == "", i)), lambda i: i.isNotNull())
    places = F.array_sort(F.array_union(blank, F.coalesce("kept", F.array().cast("array<int>"))))
    out = split.withColumn("places", places)
    left = F.array_join(F.transform("places", lambda i: F.get("lines", i)), "\n")
    row = F.col("row").withField(f"`{text_col}`", F.when(F.col("whole"), text).otherwise(left))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_dropped = F.when(F.col("whole"), 0).otherwise(F.size("lines") - F.size("places")).cast("long")
    columns = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(row.alias("row"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped")).select(*columns, "n_lines", "n_dropped")


#: The same rows in DuckDB, for tables whose ids differ: lines and variants themselves are joined, not their hashes.
ORACLE = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as ls from documents where doc_id is not null and text is not null),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as no from d),
f as (select line, min(struct_pack(d := doc_id, n := no)) as first from l where trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' group by line),
v as (select line, first, i, substr(line, 1, i - 1) || substr(line, i + 1) as variant from (select line, first, unnest(range(1, length(line) + 1)) as i from f)),
substituted as (select line from (select line, first, min(first) over (partition by variant, i) as least from v) where least < first),
inserted as (select case when v.first < f.first then f.line else v.line end as line from v join f on f.line = v.variant),
gone as (select line from substituted union select line from inserted),
kept as (select l.doc_id, l.no, l.line from l left join f on f.line = l.line left join gone g on g.line = l.line
  where f.line is null or (g.line is null and f.first = struct_pack(d := l.doc_id, n := l.no))),
whole as (select doc_id, string_agg(line, chr(10) order by no) as text, count(*) as n from kept group by doc_id)
select o.doc_id, case when d.doc_id is null then o.text else coalesce(w.text, '') end as text,
  coalesce(len(d.ls), case when o.text is null then 0 else len(string_split(o.text, chr(10))) end)::bigint as n_lines,
  case when d.doc_id is null then 0 else len(d.ls) - coalesce(w.n, 0) end::bigint as n_dropped
from documents o left join d on d.doc_id = o.doc_id left join whole w on w.doc_id = o.doc_id
"""
