"""Mixing sources to target weights: posteriors of a labelled-table classifier, and document rates by projected gradient.

Domains are what labels say (good, poor, toxic); a document belongs to each by its posterior. Rates r >= 0 minimize
|A r - targets|^2 with A_di = tokens_i p_id, in shares of all tokens. A gradient step, scaled by a row's tokens, changes a rate by
the row's posterior alone: rows of equal posterior have equal rates, and a rate follows from the few steps so far. So rows
are summed up by posterior once, and nothing but sums over those groups reaches the driver.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WRITTEN, cut, drop_cut, drop_since, let, literal, table

#: Bound of the labelled rows that the classifier is fitted on, for each domain, by hash of doc_id.
SAMPLE_PER_DOMAIN = 4_000
#: Words that tell a domain: so many at most, so much likelier there than elsewhere.
MOST_WORDS, LEAST_RATIO = 64, 5.0
#: Target shares of tokens.
TARGETS = {"good": 0.60, "poor": 0.38, "toxic": 0.02}
#: A miss, as a share of all tokens, that is as good as none, and a projected gradient step that is as good as no move.
MISS, MOVE = 1e-3, 1e-7
#: Most steps, and most Newton rounds to find one; how long the first step is, in lengths of an explicit one, and how steps grow.
STEPS, ROUNDS, FIRST_STEP, LONGER = 10, 30, 100.0, 10.0
#: Parts of a Newton step that are tried.
PARTS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)
#: Posteriors are those of the classifier to this power: its features are not independent.
TEMPER = 0.7
SYMBOLS = "*#$%&|!"
BINS = {
    "symbols": [0.0005, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2],
    "distinct": [0.02, 0.1, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97],
    "word": [2.0, 3.0, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0, 9.0, 14.0],
    "lines": [0.0005, 0.001, 0.002, 0.004, 0.008, 0.016, 0.05],
    "size": [10.0, 40.0, 160.0, 640.0, 2560.0, 10240.0],
    "good": [1.0, 2.0, 4.0, 8.0],
    "poor": [1.0, 2.0, 4.0, 8.0],
    "toxic": [1.0, 2.0, 4.0, 8.0],
}


def domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), " "), "")


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts a value reaches; the value is computed once."""

    def reached(x: Column) -> Column:
        return sum(((x >= c).cast("int") for c in cuts), F.lit(0))

    return let(value, reached)


def measured(df: DataFrame, telling: dict[str, list[str]], text: str = "text") -> DataFrame:
    """``df`` with mix_tokens and mix_bins (the bin of each feature, in the order of BINS)."""
    value = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("mix_words", _words(F.col(text)))
    every = literal(json.dumps(sorted({w for words in telling.values() for w in words})), "array<string>")
    out = out.withColumns({"mix_tokens": F.size("mix_words").cast("long"), "mix_distinct": F.array_distinct("mix_words")})
    out = out.withColumns({"mix_distinct": F.size("mix_distinct"), "mix_hits": F.array_intersect("mix_distinct", every)})
    chars, tokens = F.greatest(F.length(value), F.lit(1)), F.greatest(F.col("mix_tokens"), F.lit(1))
    without = lambda x: F.length(value) - F.length(F.translate(value, x, ""))
    hits = lambda d: F.size(F.array_intersect("mix_hits", literal(json.dumps(telling.get(d, [])), "array<string>")))
    found = {"symbols": without(SYMBOLS) / chars, "distinct": F.col("mix_distinct") / tokens, "word": chars / tokens, "lines": without("\n") / chars, "size": chars, **{d: hits(d) for d in ("good", "poor", "toxic")}}
    bins = F.array(*[_bin(found[k], cuts) for k, cuts in BINS.items()])
    return out.withColumn("mix_bins", bins).drop("mix_words", "mix_distinct", "mix_hits")


@dataclass
class Classifier:
    domains: list[str]
    telling: dict[str, list[str]]
    prior: list[float]
    #: log likelihoods by feature, bin and domain
    table: list[list[list[float]]]

    def posterior(self, bins: Column) -> Column:
        """array<double> over the domains."""
        known = literal(json.dumps(self.table), "array<array<array<double>>>")
        features = F.array(*map(F.lit, range(len(BINS))))
        term = lambda d: lambda s, k: s + F.get(F.get(F.get(known, k), F.get(bins, k)), F.lit(d))
        logs = [F.lit(p) + F.aggregate(features, F.lit(0.0), term(d)) * F.lit(TEMPER) for d, p in enumerate(self.prior)]
        exp = let(F.array(*logs), lambda each: let(F.array_max(each), lambda top: F.transform(each, lambda x: F.exp(x - top))))
        return let(exp, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda n: F.transform(e, lambda x: x / n)))


def fit(docs: DataFrame, labels: DataFrame, wanted: list[str]) -> Classifier:
    """A naive Bayes classifier of binned features, among them words that tell a domain; counts only reach the driver.

    Of a doc_id that occurs more than once the least text counts, so the sample is as bounded as the labels picked for it.
    """
    rows = labels.select("doc_id", domain().alias("domain")).where("domain IS NOT NULL AND doc_id IS NOT NULL").distinct()
    picked = None
    for d in wanted:
        one = rows.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_DOMAIN)
        picked = one if picked is None else picked.unionByName(one)
    matched = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sample = cut(matched.groupBy("doc_id", "domain").agg(F.min("text").alias("text")), "sample")
    sizes = {r.domain: r["count"] for r in sample.groupBy("domain").count().collect()}
    domains = [d for d in wanted if d in sizes] or wanted[:1]
    total = sum(sizes.values()) or 1
    words = sample.select("domain", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    counts = words.groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in domains])
    telling = {}
    for d in domains:
        others = sum((F.col(o) for o in domains if o != d), F.lit(0))
        gain = F.col(d) / sizes.get(d, 1) - others / max(total - sizes.get(d, 0), 1)
        telling[d] = [r.word for r in counts.where(F.col(d) >= 3).where((F.col(d) + 0.5) * (total - sizes.get(d, 0)) >= LEAST_RATIO * (others + 0.5) * sizes.get(d, 1)).orderBy(F.desc(gain * F.log((F.col(d) + 0.5) / (others + 0.5) * (total / sizes.get(d, 1)))), "word").limit(MOST_WORDS).collect()] if len(domains) > 1 else []
    binned = cut(measured(sample, telling).select("domain", "mix_bins"), "binned")
    bins = binned.select("domain", F.posexplode("mix_bins").alias("feature", "bin")).groupBy("domain", "feature", "bin").count().collect()
    drop_cut(sample, binned)
    seen = {(r.domain, r.feature, r.bin): r["count"] for r in bins}
    table = [[[math.log((seen.get((d, k, b), 0) + 1) / (sizes.get(d, 0) + len(cuts) + 1)) for d in domains] for b in range(len(cuts) + 1)] for k, cuts in enumerate(BINS.values())]
    shares = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}
    every = sum(shares.get(d, 0) for d in domains)
    return Classifier(domains, telling, [math.log((shares.get(d, 0) + 1) / (every + len(domains))) for d in domains], table)


def rate(posterior: Column, steps: list[list[float]], least: float = 0.0) -> Column:
    """A document's rate: from 1, each step goes against the gradient and stays at ``least`` or above."""
    start = F.lit(1.0)
    if not steps:
        return start
    dot = lambda h: F.aggregate(F.zip_with(posterior, h, lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(literal(json.dumps(steps), "array<array<double>>"), start, lambda r, h: F.greatest(F.lit(least), r - dot(h)))


@dataclass
class Solution:
    """Steps that lead from rates of 1 to the solution, target and reached shares of the tokens there were, the largest miss, and whether it is a minimum."""

    steps: list[list[float]]
    targets: list[float]
    reached: list[float]
    miss: float
    converged: bool


def solve(rows: DataFrame, weights: list[float], total: float = 1.0, keep: bool = False, miss: float = MISS) -> Solution:
    """Projected-gradient least squares over ``rows`` (mix_tokens, mix_posterior).

    Minimizes |A r - total * shares|^2 over r >= 0, in shares of all tokens there are. With ``keep`` r >= 1 and the total is what
    comes of it: |A r - shares * sum(A r)|^2. Steps are implicit: each goes against the gradient where it ends, which holds for
    any length, so that a few long steps do what thousands of explicit ones would. Where that is, is an equation in as many
    unknowns as there are domains, solved by Newton's method; each of its rounds is one aggregation over the groups of rows.
    It ends where the targets are missed by ``miss`` at most or a projected gradient step no longer moves.
    """
    n, least = len(weights), 1.0 if keep else 0.0
    share = np.array(weights) / sum(weights)
    groups = cut(rows.groupBy("mix_posterior").agg(F.sum("mix_tokens").cast("double").alias("t")), "groups")
    every = groups.agg(F.sum("t")).first()[0]
    if not every:
        drop_cut(groups)
        return Solution([], (total * share).tolist(), [0.0] * n, 0.0, True)
    shape, goal = (np.eye(n) - np.outer(share, np.ones(n)), np.zeros(n)) if keep else (np.eye(n), total * share)
    t = F.col("t") / F.lit(every)
    p = [F.get(F.col("mix_posterior"), F.lit(d)) for d in range(n)]

    def tried(steps: list[list[float]], ways: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """For each way on from where the steps lead: totals, the Gram matrix of the rows above the least rate, how far rows move."""
        way = F.posexplode(literal(json.dumps([list(map(float, h)) for h in ways]), "array<array<double>>")).alias("k", "h")
        moved = sum(p[d] * F.get(F.col("h"), F.lit(d)) for d in range(n))
        there = groups.select("mix_posterior", "t", rate(F.col("mix_posterior"), steps, least).alias("r"), way).withColumn("x", F.col("r") - moved)
        after, free = F.greatest(F.lit(least), F.col("x")), F.when(F.col("x") > least, t).otherwise(0.0)
        sums = [F.sum(after * t * p[d]) for d in range(n)] + [F.sum(free * p[d] * p[e]) for d in range(n) for e in range(n)] + [F.sqrt(F.sum(t * (after - F.col("r")) ** 2))]
        found = {row.k: row.sums for row in there.groupBy("k").agg(F.array(*sums).alias("sums")).collect()}
        return [(np.array(x[:n]), np.array(x[n:-1]).reshape(n, n), x[-1]) for x in (found[k] for k in range(len(ways)))]

    steps: list[list[float]] = []
    (reached, gram, _), converged = tried(steps, [np.zeros(n)])[0], False
    steepest = 1.0 if keep else max(float(np.linalg.eigvalsh(gram).max()), 1e-12)  # all rows are free to begin with, or held at 1
    for k in range(STEPS):
        off = shape @ reached - goal
        if converged := np.abs(off).max() <= miss or tried(steps, [shape.T @ off / steepest])[0][2] <= MOVE:
            break
        length = FIRST_STEP * LONGER**k / steepest
        step = np.zeros(n)
        gap = lambda h, totals: h - length * shape.T @ (shape @ totals - goal)  # noqa: E731  0 where the step is right
        totals, free, _ = tried(steps, [step])[0]
        for _ in range(ROUNDS):
            if np.linalg.norm(gap(step, totals)) <= 1e-9 * length:
                break
            toward = np.linalg.solve(np.eye(n) + length * shape.T @ shape @ free, gap(step, totals))
            ways = [step - part * toward for part in PARTS]
            found = tried(steps, ways)
            best = min(range(len(ways)), key=lambda i: float(np.linalg.norm(gap(ways[i], found[i][0]))))
            step, (totals, free, _) = ways[best], found[best]
        steps.append(step.tolist())
        reached = totals
    drop_cut(groups)
    if not converged:
        warnings.warn(f"mixing stopped after {STEPS} steps short of a minimum", stacklevel=2)
    ends = share * reached.sum() if keep else goal
    return Solution(steps, ends.tolist(), reached.tolist(), float(np.abs(reached - ends).max()), converged)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: bool = False, drop_text: bool = False) -> DataFrame:
    """``docs`` with mix_tokens, mix_posterior, mix_rate, mix_copies (times to use the document) and mix_miss.

    Copies are the rate rounded up or down by a hash of the row, in expectation the rate itself; with ``keep`` rates are
    1 or more, so every row is used once at least; with ``drop_text`` texts are left out. mix_miss is by how much the
    rates miss a domain's target at most, as a share of all tokens: targets that no rates reach are approached, in least squares.
    Texts are read once, whole. Null and empty texts have no tokens; equal rows get equal answers; a domain without labelled
    rows is left out and its weight dealt to the others; without any labels all rates are 1. Columns with the prefix mix_, in
    whatever case, are ours; an empty table stays empty.
    """
    spark, mark = docs.sparkSession, len(WRITTEN)
    targets = targets or TARGETS
    docs = docs.select(*[c for c in docs.columns if not c.lower().startswith("mix_")])
    model = fit(docs, labels, list(targets))
    even = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("mix")), 11) / F.lit(float(1 << 53))
    with_p = measured(docs, model.telling).withColumns({"mix_posterior": model.posterior(F.col("mix_bins")), "mix_even": even}).drop("mix_bins")
    rows = cut(with_p.drop("text") if drop_text else with_p, "posteriors")
    weights = [targets[d] for d in model.domains]
    found = solve(rows.where("mix_tokens > 0"), weights, keep=keep) if len(weights) > 1 and sum(weights) > 0 else Solution([], [], [], 0.0, True)
    drop_since(spark, mark, rows)
    out = rows.withColumns({"mix_rate": rate(F.col("mix_posterior"), found.steps, 1.0 if keep else 0.0), "mix_miss": F.lit(found.miss)})
    return out.withColumn("mix_copies", F.floor(F.col("mix_rate") + F.col("mix_even")).cast("int")).drop("mix_even")


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row as many times as mix_copies says, without our columns."""
    rows = mixed.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies"))))
    return rows.select(*[c for c in rows.columns if not c.startswith("mix_")])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and copies of every document, and by how much the targets are missed."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), drop_text=True)
    names = {"tokens": "mix_tokens", "posterior": "mix_posterior", "rate": "mix_rate", "copies": "mix_copies", "miss": "mix_miss"}
    return out.select("doc_id", *[F.col(v).alias(k) for k, v in names.items()])
