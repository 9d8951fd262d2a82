"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative, with
weights learned from pages whose main region is marked (``article`` or ``main``); a
linear scan finds the contiguous run with the greatest sum. The marks only label pages
to learn from: the run, widened to whole blocks, is the region, and the text blocks inside it that
don't belong to menus, forms, adverts, comments and the like are the result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import blocks, ship

#: Pages that the weights are learned from, at most.
LABELLED_PAGES = 2_000

# No part of these can be given back once it has matched, so each takes one pass over what it matches.
_OPEN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]?))*+)>""")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_TEXT = re.compile(r"<?[^<]*+")
_ATTR = re.compile(r"""\b(class|id|role|aria-label|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")

# HTML's element kinds.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
INLINE = frozenset("a abbr audio b bdi bdo button canvas cite code data del dfn em font i ins kbd label map mark meter object output picture progress q ruby s samp select slot small span strong sub sup svg time u var video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKED = frozenset("article main".split())
EXCLUDED = frozenset("head nav footer aside form button select input textarea script style noscript template svg canvas iframe object dialog menu label fieldset title".split())
# Words in class, id or role that name what isn't main text, chosen by hand.
EXCLUDED_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar toolbar footer comment comments reply replies respond disqus share sharing social related recommended pagination pager search complementary contentinfo".split())
#: Elements that weights are learned for; all others share one kind.
KNOWN = RAW | VOID | BLOCK | INLINE

#: Weights before anything is learned: a word, a word in a link, a tag.
DEFAULT = {"w:": 0.5, "w:a": -1.0, "t:": -1.0}


_closing: dict[str, re.Pattern] = {}


def _close(tag: str) -> re.Pattern:
    """The end tag of a raw element."""
    if tag not in _closing:
        _closing[tag] = re.compile(rf"</{tag}\s*+>", re.I)
    return _closing[tag]


def _excluded(tag: str, attrs: str, in_marked: bool) -> bool:
    if tag in EXCLUDED or (tag == "header" and not in_marked):
        return True
    if not attrs or tag in ("body", "html"):
        return False
    names: set[str] = set()
    for m in _ATTR.finditer(attrs):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or (kind == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
        if kind in ("class", "id", "role"):
            names.update(_NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))
    if "header" in names and not in_marked:
        return True
    return bool(names & EXCLUDED_NAMES) and tag not in MARKED


class Page:
    """A page's items in order: ``(kind, type, value, n_words, excluded, marked)``.

    kind is ``w`` for text and ``t`` for a tag; type is what the weights are keyed by;
    marked tells whether it lies in an ``article`` or ``main``. One pass: each character is
    looked at a bounded number of times, however broken the page is. Quotes count after
    ``=`` only; from the first tag on that doesn't end outside its quotes, tags end at the next ``>``.
    """

    def __init__(self, source: str) -> None:
        self.items: list[tuple[str, str, str, int, bool, bool]] = []
        stack: list[list] = []  # name, excluded, opens the mark, is a link, the block around it
        opened: Counter[str] = Counter()
        skipping, marked, block, link = 0, False, "body", None
        at, n, last, pattern = 0, len(source), source.rfind(">"), _OPEN
        add = self.items.append
        while at < n:
            m = None
            if source[at] == "<" and at < last:
                if source.startswith("<!--", at):
                    end = source.find("-->", at + 4)
                    at = end + 3 if end >= 0 else n
                    continue
                m = pattern.match(source, at)
                if m is None and pattern is _OPEN and (m := _PLAIN.match(source, at)):
                    pattern = _PLAIN
                if m is None and source[at + 1] in "/!?":
                    at = source.find(">", at) + 1
                    continue
            elif source.startswith("<!--", at):
                break
            if m is None:
                m = _TEXT.match(source, at)
                at = m.end()
                words = len(m[0].split())
                add(("w", "w:a" if link else f"w:{'skip' if skipping else block}", m[0], words, skipping > 0, marked))
                continue
            at = m.end()
            tag, attrs = m[2].lower(), m[3]
            kind = f"t:{tag if tag in KNOWN else '-'}"
            if m[1]:
                while opened[tag]:
                    name, out, mark, is_link, around = stack.pop()
                    opened[name] -= 1
                    skipping -= out
                    if mark:
                        marked = False
                    if is_link:
                        link = None
                    block = around
                    if name == tag:
                        break
                add(("t", kind, tag, 0, skipping > 0, marked))
                continue
            if tag in RAW and not attrs.endswith("/"):
                close = _close(tag).search(source, at)
                at = close.end() if close else n
                add(("t", kind, tag, 0, True, marked))
                continue
            if tag == "a" and link:  # a link ends where the next one begins
                opened["a"] -= 1
                link[0], link[3], link = "", False, None
                opened[""] += 1
            out = tag not in VOID and _excluded(tag, attrs, marked)
            if tag not in VOID and not attrs.endswith("/"):
                mark = tag in MARKED and not marked and not out and not skipping
                stack.append([tag, out, mark, tag == "a", block])
                opened[tag] += 1
                skipping += out
                marked = marked or mark
                link = stack[-1] if tag == "a" else link
                if tag in BLOCK:
                    block = tag
            add(("t", kind, tag, 0, skipping > 0, marked))

    def best_run(self, weights: dict[str, float]) -> tuple[int, int]:
        """The contiguous run of items with the greatest score, as (first, end); (0, 0) if none is positive."""
        best, span, total, start = 0.0, (0, 0), 0.0, 0
        word, link, tag = weights["w:"], weights["w:a"], weights["t:"]
        for i, (kind, name, _, words, out, _) in enumerate(self.items):
            if kind == "w":
                total += words * (-abs(word) if out else weights.get(name, link if name == "w:a" else word))
            else:
                total += weights.get(name, tag)
            if total <= 0:
                total, start = 0.0, i + 1
            elif total > best:
                best, span = total, (start, i + 1)
        return span

    def region(self, weights: dict[str, float]) -> tuple[int, int]:
        """The best run, widened to whole blocks and a heading just before them."""
        first, end = self.best_run(weights)
        while first > 0 and not (self.items[first - 1][0] == "t" and self.items[first - 1][2] in BLOCK):
            first -= 1
        at = first  # a heading just before the run opens it
        while at > 0 and (self.items[at - 1][0] == "t" or not self.items[at - 1][3] or (self.items[at - 1][1][2:] in HEADINGS and not self.items[at - 1][4])):
            at -= 1
            if self.items[at][1][2:] in HEADINGS and not self.items[at][4]:
                first = at
        while end < len(self.items) and not (self.items[end][0] == "t" and self.items[end][2] in BLOCK):
            end += 1
        return first, end

    def text(self, weights: dict[str, float]) -> str:
        first, end = self.region(weights)
        done: list[str] = []
        now: list[str] = []

        def flush() -> None:
            line = " ".join(html.unescape("".join(now)).split())
            if line:
                done.append(line)
            now.clear()

        for kind, _, value, _, out, _ in self.items[first:end]:
            if kind == "t":
                if value in BLOCK:
                    flush()
                elif value == "br":
                    now.append(" ")
            elif not out:
                now.append(value)
        flush()
        return "\n".join(done)


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Log-odds of each kind of word and tag inside against outside the marked regions.

    Learned from at most ``LABELLED_PAGES`` pages that mark a region, those with the
    smallest hashes. A word's weight is positive where it is commoner inside than tags
    are; weights fall back to ``DEFAULT`` for kinds that don't occur and on an empty table.
    """
    ship(pages.sparkSession)
    h = F.col(html_col)
    marked = pages.where(h.rlike(r"(?i)<(article|main)\b")).select(h.alias("_html"), F.xxhash64(h).alias("_h"))
    # Only hashes are sorted; equal pages count once.
    last = marked.select("_h").distinct().orderBy("_h").limit(LABELLED_PAGES).agg(F.max("_h")).first()[0]
    sample = marked.where(F.col("_h") <= F.lit(last)).dropDuplicates(["_h"]).select("_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for b in blocks(batches, "_html"):
            for x in b.column(0).to_pylist():
                for kind, name, _, words, out, marked in Page(x or "").items:
                    (inside if marked and not out else outside)[name] += words if kind == "w" else 1
        names = list(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[k] for k in names], pa.int64()), pa.array([outside[k] for k in names], pa.int64())], ["kind", "inside", "outside"])

    rows = sample.mapInArrow(run, "kind string, inside long, outside long")
    sums = rows.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    rows = sorted(sums.collect())  # at most two rows for each of KNOWN and a few more
    weights = dict(DEFAULT)
    n_in, n_out = sum(r["inside"] for r in rows) + 1, sum(r["outside"] for r in rows) + 1
    for r in rows:
        odds = math.log((r["inside"] + 1) / n_in) - math.log((r["outside"] + 1) / n_out)
        word = r["kind"].startswith("w:") and r["kind"] not in ("w:a", "w:skip")
        weights[r["kind"]] = max(0.05, min(2.0, odds)) if word and r["inside"] > r["outside"] else max(-4.0, min(-0.05, odds))
    return weights


def main_text(pages: DataFrame, weights: dict[str, float] | None = None, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page in place of its HTML.

    Null and empty HTML, and pages without words, give an empty text; unclosed elements
    and comments reach to the end of what holds them; of runs with equal scores the first counts; every row stays,
    repeated ones too, and pages of any length are read whole, in one pass; an empty table gives no rows. A column of the name of the result is replaced.
    """
    ship(pages.sparkSession)
    learned = weights or learn_weights(pages, html_col)
    others = [c for c in pages.columns if c not in (html_col, name)]
    narrow = pages.select(*others, F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_html"):
            texts = [Page(x).text(learned) if x else "" for x in b.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*others, name])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{schema}`{name}` string")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    return main_text(pages.select("page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("long"))
