"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers in numpy are trained from confirmed toxic texts (P) and unlabelled
texts (U) with the non-negative risk of Kiryo et al. (2017):
``prior * mean_P loss(z) + max(0, mean_U loss(-z) - prior * mean_P loss(-z))``. The
class prior is the share of toxic rows among all labels that may be learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import blocks, materialize, ship, text_or_empty, tidy

#: Bounds of the sample that the classifiers are fitted on, in documents.
POSITIVES, UNLABELLED = 6_000, 18_000
#: Features of a classifier at most.
FEATURES = 4_096
#: A feature must occur in as many positive texts of the sample.
LEAST_POSITIVE = 4
#: Log-likelihood by which it must be commoner in toxic texts than chance among many features makes it.
SURE = 14.0
#: Share of the toxic texts that a feature must explain to get a weight.
SPARSITY = 0.01
CLASSIFIERS, STEPS = 3, 400
#: Features that a task counts before it passes them on; memory only, results are the same.
HELD = 100_000

#: Lengths of word beginnings, and up to how many words that share one are told apart.
PREFIXES, MOST_SHARED = (4, 5, 6, 7), 3

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """A text's words in lower case, and the beginnings of 4 to 7 letters that one, two or three of its different words share."""
    words = set(_WORD.findall(text.lower()))
    shared = Counter(w[:n] for w in words for n in PREFIXES if len(w) > n)
    out = set(words)
    for stem, n in shared.items():
        out.update(f"{stem}*{k}" for k in range(1, min(n, MOST_SHARED) + 1))
    return out


def one_of_each_stem(ranked: list[str]) -> list[str]:
    """The features of ``ranked`` (best first) without those whose letters begin a better one's or begin with a better prefix's."""
    words: set[str] = set()
    prefixes: set[str] = set()
    begun: set[str] = set()
    out = []
    for f in ranked:
        stem, star, _ = f.partition("*")
        if stem in words or stem in begun or any(stem[:n] in prefixes for n in PREFIXES):
            continue
        out.append(f)
        (prefixes if star else words).add(stem)
        begun.update(stem[:n] for n in range(min(PREFIXES), len(stem) + 1))
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing may be learned from: crc32 of the id's text divisible by 5."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


@dataclass
class Model:
    """``score`` is the logistic function of the classifiers' mean; ``prior`` alone if nothing was learned."""

    weights: dict[str, float]
    bias: float
    prior: float

    def __post_init__(self) -> None:
        self.words = {f: w for f, w in self.weights.items() if "*" not in f}
        self.stems: dict[str, list[tuple[int, float]]] = {}
        for f, w in self.weights.items():
            if "*" in f:
                stem, _, n = f.partition("*")
                self.stems.setdefault(stem, []).append((int(n), w))
        self.lengths = sorted({len(x) for x in self.stems})

    def score(self, text: str) -> float:
        words = set(_WORD.findall(text.lower()))
        z = self.bias + sum(self.words[w] for w in words & self.words.keys())
        for n in self.lengths:
            shared = Counter(p for p in (w[:n] for w in words if len(w) > n) if p in self.stems)
            z += sum(weight for p, k in shared.items() for least, weight in self.stems[p] if k >= least)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], n_features: int, prior: float, steps: int = STEPS, decay: float = 1e-4, rate: float = 0.05, seed: int = 0, sparsity: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss (Adam, full batches).

    Where the estimated negative risk falls below 0, the step ascends it instead. With
    ``sparsity``, weights shrink by that much a step's rate and stop at 0, so that features
    which lower the risk by less get none. A seed over 0 draws the rows anew.
    """
    rng = np.random.default_rng(seed)

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        rows = [rows[i] for i in rng.integers(0, len(rows), len(rows))] if seed else rows
        return np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)

    (pi, pr, pn), (ui, ur, un) = flat(pos), flat(unl)
    w = np.zeros(n_features + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    loss = lambda z: np.logaddexp(0, -z)
    for t in range(1, steps + 1):
        zp = np.bincount(pr, w[pi], pn) + w[-1]
        zu = np.bincount(ur, w[ui], un) + w[-1]
        negative = loss(-zu).mean() - prior * loss(-zp).mean()
        gu, gp = _sigmoid(zu) / un, -prior * _sigmoid(zp) / pn  # of the negative risk
        if negative >= 0:
            gp = gp - prior * _sigmoid(-zp) / pn
        else:
            gu, gp = -gu, -gp
        g = np.bincount(pi, gp[pr], n_features + 1).astype(float) + np.bincount(ui, gu[ur], n_features + 1)
        g[-1] = gp.sum() + gu.sum()
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        scale = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= scale * m / (1 - 0.9**t)
        if sparsity:
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - scale[:-1] * sparsity, 0)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample: the ``POSITIVES`` toxic and ``UNLABELLED`` unlabelled rows with the smallest id hashes.

    Labels of rows in ``held_out`` are never read. Null labels and labels without a
    document are ignored, and of a repeated or conflicting label a toxic one counts; of a repeated id one text is in the
    sample (the one with the smallest hash); without positives or unlabelled rows the score is the prior. Weights and bias are
    the means of the classifiers that minimise the risk.
    """
    ship(docs.sparkSession)
    known = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    prior = known.agg(F.avg((F.col("_toxic") == 1).cast("double"))).first()[0] or 0.0
    order = [F.xxhash64("_id"), F.col("_id")]
    ids = docs.where(~held_out(id_col)).select(F.col(id_col).alias("_id"))
    toxic = known.where("_toxic = 1").select("_id").distinct()
    p = toxic.join(ids, "_id", "left_semi").orderBy(*order).limit(POSITIVES)
    u = ids.distinct().orderBy(F.xxhash64("_id", F.lit(1)), F.col("_id")).limit(UNLABELLED)  # labels aren't looked at: toxic texts are among them at the prior's rate
    chosen = p.withColumn("_p", F.lit(1)).unionByName(u.withColumn("_p", F.lit(0)))
    # One text for each id, however often it is repeated, so the bound holds for rows too. Texts aren't shuffled unless an id repeats.
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    some = rows.select("_id", "_h").join(F.broadcast(chosen), "_id").groupBy("_p", "_id")  # at most POSITIVES + UNLABELLED ids
    first = materialize(some.agg(F.min("_h").alias("_h"), F.count("*").alias("_n")), "sample")
    sample = rows.join(F.broadcast(first.drop("_n")), ["_id", "_h"])
    if not first.where("_n > 1").isEmpty():
        sample = sample.groupBy("_p", "_id").agg(F.min("_text").alias("_text"))
    sample = sample.select("_p", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[pa.RecordBatch]:
            names = list(n[0].keys() | n[1].keys())
            for at in range(0, len(names), 50_000):
                some = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([n[k][w] for w in some], pa.int64()) for k in (1, 0))], ["feature", "p", "u"])

        n = (Counter(), Counter())
        for b in blocks(batches, "_text", 1 << 20):
            for is_p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[is_p].update(features(x))
                n[is_p][""] += 1
                if len(n[0]) + len(n[1]) > HELD:  # they are added up again where they meet
                    yield from counted()
                    n = (Counter(), Counter())
        yield from counted()

    counts = sample.mapInArrow(tidy(count), "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where((F.col("p") >= LEAST_POSITIVE) | (F.col("feature") == "")).cache()
    total = counts.where("feature = ''").first()
    if not total or not total["p"] or not total["u"]:
        return Model({}, math.log(max(prior, 1e-6) / max(1 - prior, 1e-6)), prior)
    n_p, n_u = total["p"], total["u"]
    expected = n_p * (F.col("u") + 2.0) / n_u
    sure = F.col("p") * F.log(F.col("p") / expected) - (F.col("p") - expected)  # log-likelihood ratio of Poisson counts
    ranked = counts.where("feature <> ''").withColumn("sure", sure).where((F.col("p") > 3 * expected) & (F.col("sure") > SURE))
    best = ranked.orderBy(F.desc("sure"), F.desc(F.length("feature")), "feature").limit(4 * FEATURES).collect()
    vocabulary = {f: i for i, f in enumerate(one_of_each_stem([r["feature"] for r in best])[:FEATURES])}
    counts.unpersist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text", 1 << 20):
            rows = [[i for i in map(vocabulary.get, sorted(features(x))) if i is not None] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["_p", "at"])

    rows = sample.mapInArrow(tidy(project), "_p int, at array<int>").collect()  # bounded: sample rows of at most FEATURES numbers
    rows.sort(key=lambda r: (r["_p"], r["at"]))
    pos = [np.array(r["at"], np.int64) for r in rows if r["_p"]]
    unl = [np.array(r["at"], np.int64) for r in rows if not r["_p"]]
    sparse = np.abs(fit_nnpu(pos, unl, len(vocabulary), prior, sparsity=SPARSITY * prior)[0])
    keep = np.flatnonzero(sparse > 1e-3)
    new = np.full(len(vocabulary), -1)
    new[keep] = np.arange(len(keep))
    pos, unl = ([n[n >= 0] for n in (new[r] for r in rows)] for rows in (pos, unl))
    vocabulary = {f: int(new[i]) for f, i in vocabulary.items() if new[i] >= 0}
    fitted = [fit_nnpu(pos, unl, len(vocabulary), prior, seed=k) for k in range(CLASSIFIERS)]
    mean, bias = np.mean([w for w, _ in fitted], axis=0), float(np.mean([b for _, b in fitted]))
    return Model({f: float(mean[i]) for f, i in vocabulary.items()}, bias, prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score in 0 to 1 for each whole text, however long; null texts count as empty. Every row stays.

    A column called ``name`` is replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop(name)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text_col, 1 << 20):
            s = [model.score(x or "") for x in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidy(run), f"{schema}, `{name}` double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, also null, empty, nameless and repeated ones.

    Equal texts get equal scores. An empty table gives no rows; other columns are ignored.
    """
    model = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; all columns stay as they are."""
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return score(docs, train(docs, labels), name=name).where(F.col(name) < 0.5).select(*docs.columns)
