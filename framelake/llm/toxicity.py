"""Toxicity: a lexicon trie met by Levenshtein automata, context windows that tell quotation from abuse, a small logistic model."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WRITTEN, cut, ddl, drop_since, map_arrow, others, slices, table
from .minhash import signed

#: Bound of the sample that the lexicon and the weights are learned from: labelled rows of each class, by hash of doc_id.
SAMPLE_PER_CLASS = 6_000
#: Terms kept at most, least evidence for one (twice the log-likelihood ratio), least ratio of its rates.
MOST_TERMS, LEAST_EVIDENCE, LEAST_RATIO = 2_000, 25.0, 10.0
PREFIXES = range(4, 9)
#: Clean rows of the sample that use a word near a term, no more often than chance, which make it a word of its own.
REAL = 2
#: Edits allowed by term length; shorter terms must be met exactly.
EDITS = ((10, 2), (5, 1))
#: What an edit leaves of a term's weight.
EDIT_SHARE = 0.7
WINDOW = 60
#: Words that a worker remembers, and letters of one that is worth it; they bound its memory.
MOST_WORDS, MOST_LETTERS = 100_000, 64
WORDS = re.compile(r"\w+").findall
WORD = re.compile(r"\w+")
WORD_AT = WORD.finditer
QUOTES = re.compile("[\"“”„«»]|(?<!\\w)['‘’](?=\\w)|(?<=\\w)['‘’](?!\\w)")
#: Words near a term that announce someone else's speech.
REPORTS = frozenset("said says say wrote writes quoted quote called calls word term dit écrit citation sagte schrieb zitat dijo dice cita".split())
FEATURES = ("exact", "near", "quoted", "density")


class Automaton:
    """A Levenshtein automaton of one word: states are rows of distances capped at edits + 1, met lazily."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits
        self.start = tuple(min(i, edits + 1) for i in range(len(word) + 1))

    def step(self, row: tuple[int, ...], letter: str) -> tuple[int, ...]:
        out = [min(row[0] + 1, self.edits + 1)]
        for i, c in enumerate(self.word):
            out.append(min(row[i] + (c != letter), row[i + 1] + 1, out[i] + 1, self.edits + 1))
        return tuple(out)

    def alive(self, row: tuple[int, ...]) -> bool:
        return min(row) <= self.edits


def shortened(word: str, letters: int) -> set[str]:
    """The word and all that is left of it without up to so many letters."""
    out = last = {word}
    for _ in range(letters):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class Lexicon(dict):
    """Word -> (weight, is exact) of the best term it meets, or None; each edit leaves EDIT_SHARE of a term's weight.

    Terms are whole words, or stems that end in ``*``. Stems are met exactly; the words of a stem that are terms too are what
    misspelled words are near to. Known words are no misspellings, however near a term they are.
    """

    def __init__(self, terms: dict[str, float], known: frozenset[str] = frozenset()):
        super().__init__()
        self.terms, self.known, self.trie = terms, known, {}
        self.stems = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.stem_lengths = sorted({len(t) for t in self.stems})
        #: By number of edits, the terms that allow so many and what is left of them without up to so many letters. A word
        #: within k edits of a term is in here once it has lost up to k letters itself: only such words are worth a walk.
        self.near_by: dict[int, set[str]] = {}
        #: By length of a word, what may stand where in it: of k + 1 parts of a term one outlives k edits, and moves by k
        #: letters at most. This spares most words the loss of letters.
        self.parts: dict[int, dict[tuple[int, int], set[str]]] = {}
        for term, weight in terms.items():
            if term.endswith("*") or not self.edits(term):
                continue
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, weight)
            k = self.edits(term)
            self.near_by.setdefault(k, set()).update(shortened(term, k))
            cuts = [len(term) * i // (k + 1) for i in range(k + 2)]
            for size in range(len(term) - k, len(term) + k + 1):
                for a, b in zip(cuts, cuts[1:]):
                    for at in range(max(0, a - k), min(size - (b - a), a + k) + 1):
                        self.parts.setdefault(size, {}).setdefault((at, at + b - a), set()).add(term[a:b])

    @staticmethod
    def edits(term: str) -> int:
        return next((k for n, k in EDITS if len(term) >= n), 0)

    def worth(self, word: str) -> int:
        """The most edits at which the word may be near a term, 0 if none."""
        if not any(word[a:b] in parts for (a, b), parts in self.parts.get(len(word), {}).items()):
            return 0
        return max((k for k, left in self.near_by.items() if not left.isdisjoint(shortened(word, k))), default=0)

    def near(self, word: str) -> tuple[float, str] | None:
        """The term within its number of edits of the word that keeps the most weight: the automaton runs down the trie."""
        if not (most := self.worth(word)):
            return None
        auto = Automaton(word, most)
        best, stack = None, [(self.trie, auto.start)]
        while stack:
            node, row = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[-1] <= self.edits(child[0]) and (best is None or child[1] * EDIT_SHARE ** row[-1] > best[0]):
                        best = (child[1] * EDIT_SHARE ** row[-1], child[0])
                elif auto.alive(after := auto.step(row, c)):
                    stack.append((child, after))
        return best

    def meet(self, word: str) -> tuple[float, bool] | None:
        if (w := self.terms.get(word)) is not None:
            return w, True
        for n in self.stem_lengths:
            if n < len(word) and (w := self.stems.get(word[:n])) is not None:
                return w, True
        if word not in self.known and (found := self.near(word)):
            return found[0], False
        return None

    def __missing__(self, word: str) -> tuple[float, bool] | None:
        found = self.meet(word)
        if len(word) <= MOST_LETTERS:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = found
        return found


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a term stands in quotation marks, or near a word of reporting, within the window on its line."""
    first = max(text.rfind("\n", 0, start) + 1, start - WINDOW)
    last = min(end + WINDOW, len(text) if (stop := text.find("\n", end)) < 0 else stop)
    before = sum(m.start() < start for m in QUOTES.finditer(text, first, start + 1))
    if before % 2 and QUOTES.search(text, end, last):
        return True
    return not REPORTS.isdisjoint(WORDS(text[first:start].lower())[-3:])


def features(text: str, lexicon: Lexicon) -> tuple[float, ...]:
    """Sums of term weights met exactly, what near ones add to that, met in quotation, and per word; all grow as the logarithm."""
    low = text.lower()
    words = WORDS(low)
    hits = [x for x in map(lexicon.__getitem__, words) if x]
    if not hits:
        return (0.0, 0.0, 0.0, 0.0)
    source = text if len(low) == len(text) else low
    sums = [0.0, 0.0, 0.0]
    for m in WORD_AT(low):
        if found := lexicon[m[0]]:
            sums[2 if quoted(source, m.start(), m.end()) else 0 if found[1] else 1] += found[0]
    exact, both = math.log1p(sums[0]), math.log1p(sums[0] + sums[1])
    return (exact, both - exact, math.log1p(sums[2]), math.log1p(100 * (sums[0] + sums[1]) / len(words)))


def misspelled(text: str, lexicon: Lexicon) -> str:
    """The text in lower case with one wrong letter in each word that is met exactly: one left out, doubled or changed, by a checksum of the word."""

    def wrong(m: re.Match) -> str:
        word, found = m[0], lexicon[m[0]]
        if not found or not found[1] or len(word) < 2:
            return word
        at, kind = divmod(zlib.crc32(word.encode("utf-8", "surrogatepass")) % (3 * len(word)), 3)
        return word[:at] + ("", word[at] * 2, "x" if word[at] != "x" else "y")[kind] + word[at + 1 :]

    return WORD.sub(wrong, text.lower())


def quoting(text: str, terms: list[str]) -> str:
    """The text with a line that quotes one to three of the terms, chosen by a checksum of the text."""
    pick = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    chosen = [terms[(pick >> 3 * k) % len(terms)] for k in range(1 + pick % 3)]
    return f'{text}\n"{" ".join(chosen)}"'


@dataclass
class Model:
    """What is learned: terms with weights, words near them that clean rows use, and the logistic weights of the features."""

    terms: dict[str, float] = field(default_factory=dict)
    known: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (0.0,) * len(FEATURES)
    bias: float = 0.0

    def score(self, x: tuple[float, ...]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(a * b for a, b in zip(x, self.weights, strict=True))))))


def _terms_of(text: str) -> set[str]:
    words = {w for w in WORDS(text.lower()) if len(w) > 2 and not w.isdigit()}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def _evidence(n1: int, n0: int, all1: int, all0: int) -> float:
    """Twice the log-likelihood ratio of a term's rows being split as they are against as the classes are."""
    share = all1 / (all1 + all0)
    n = n1 + n0
    return 2 * sum(k * math.log(k / (n * p)) for k, p in ((n1, share), (n0, 1 - share)) if k)


def unrelated(sample: DataFrame) -> DataFrame:
    """One row of each family of near copies and class of the bounded sample, so that a text's own words don't count as evidence again with each copy.

    Families are rows joined by equal MinHash bands; the driver gets the bands of the sample (24 numbers a row at most).
    """
    rows = sorted(signed(sample.select(F.xxhash64("text").alias("node"), "toxic", "text"), "text").select("node", "toxic", "bands").collect(), key=lambda r: (r.node, r.toxic))
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    holder: dict[int, int] = {}
    for r in rows:
        for band in r.bands or ():
            a, b = find(r.node), find(holder.setdefault(band, r.node))
            up[max(a, b)] = min(a, b)
    first: dict[tuple[int, int], int] = {}
    for r in rows:
        first.setdefault((find(r.node), r.toxic), r.node)
    kept = sample.sparkSession.createDataFrame([(node, toxic) for (_, toxic), node in first.items()], "node bigint, toxic int")
    return sample.withColumn("node", F.xxhash64("text")).join(F.broadcast(kept), ["node", "toxic"]).select("text", "toxic")


def fit(sample: DataFrame) -> Model:
    """Learn from a bounded sample with columns text and toxic (0 or 1); without both classes a model that says 0.

    Near copies count once. Counts of terms are made by the executors, over the whole sample before any is dropped; the driver
    gets at most 20 * MOST_TERMS of them (the model holds MOST_TERMS and as many words of its stems), words of clean rows that
    are near terms, and for each row of the sample up to three sets of features. Labels say nothing of misspelled or quoted
    terms, which hardly occur in the sample, so these are practised. A row shares its weight with itself after a quotation of some terms is added, which makes no clean
    row toxic and no toxic one clean; a toxic row also with itself after a letter of each of its terms went wrong. All weights
    of the model are fitted to that, none is set.
    """
    spark, mark = sample.sparkSession, len(WRITTEN)
    sample = cut(unrelated(sample.select(F.col("text"), F.col("toxic").cast("int").alias("toxic"))), "practice")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    all1, all0 = sizes.get(1, 0), sizes.get(0, 0)
    if not all1 or not all0:
        drop_since(spark, mark)
        return Model(bias=30.0 if all1 else -30.0)

    def count(batches):
        total: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for part, texts in slices(batch, "text"):
                for text, toxic in zip(texts, part.column("toxic").to_pylist(), strict=True):
                    total[toxic].update(_terms_of(text or ""))
        terms = list(total[1].keys() | total[0].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([total[1][t] for t in terms], pa.int64()), pa.array([total[0][t] for t in terms], pa.int64())], names=["term", "n1", "n0"])

    counts = cut(map_arrow(sample.select("text", "toxic"), count, "term string, n1 bigint, n0 bigint").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "counts")
    ratio = (F.col("n1") + 0.5) / (F.col("n0") + 0.5) * ((all0 + 1) / (all1 + 1))
    likely = counts.where((F.col("n1") >= 4) & (ratio >= LEAST_RATIO)).orderBy(F.desc(F.col("n1") - F.col("n0")), "term").limit(20 * MOST_TERMS)
    terms = chosen({r.term: (r.n1, r.n0) for r in likely.collect()}, all1, all0)
    words = sorted(t for t in terms if not t.endswith("*"))

    def real(batches):
        lexicon = Lexicon(terms)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column("term").to_pylist() if lexicon.meet(w) and not lexicon.meet(w)[1]], pa.string())], names=["term"])

    plain = counts.where((F.col("n0") >= REAL) & (ratio < LEAST_RATIO) & ~F.endswith("term", F.lit("*"))).select("term")
    known = frozenset(r.term for r in map_arrow(plain, real, "term string").collect())

    def measure(batches):
        lexicon = Lexicon(terms, known)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                rows, toxic, weight = [], [], []
                for text, label in zip(texts, part.column("toxic").to_pylist(), strict=True):
                    text = text or ""
                    forms = [text, *([quoting(text, words)] if words else []), *([misspelled(text, lexicon)] if label else [])]
                    rows += [features(x, lexicon) for x in forms]
                    toxic += [label] * len(forms)
                    weight += [1 / len(forms)] * len(forms)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(toxic, pa.int32()), pa.array(weight, pa.float64())], names=["x", "toxic", "weight"])

    rows = map_arrow(sample.select("text", "toxic"), measure, "x array<double>, toxic int, weight double").collect()
    drop_since(spark, mark)
    x = np.array([r.x for r in rows]).reshape(-1, len(FEATURES))
    return Model(terms, known, *logistic(x, np.array([r.toxic for r in rows], float), np.array([r.weight for r in rows])))


def chosen(counts: dict[str, tuple[int, int]], all1: int, all0: int) -> dict[str, float]:
    """Terms with weights from their toxic and clean rows: the MOST_TERMS of most evidence, and as many words of stems among them."""
    evidence = {t: e for t, (n1, n0) in counts.items() if (e := _evidence(n1, n0, all1, all0)) >= LEAST_EVIDENCE}
    weigh = lambda t: math.log((counts[t][0] + 0.5) / (counts[t][1] + 0.5) * (all0 + 1) / (all1 + 1))
    whole = sorted(t for t in evidence if not t.endswith("*"))
    terms: dict[str, float] = {}
    stem_of: dict[str, str] = {}
    for term in sorted(evidence, key=lambda t: (len(t), -counts[t][0], t)):
        stem = term.rstrip("*")
        if over := [stem[:n] + "*" for n in PREFIXES if n <= len(stem) and stem[:n] + "*" in terms]:
            if not term.endswith("*"):
                stem_of[term] = over[0]
            continue
        if term.endswith("*"):
            at = bisect_left(whole, stem)
            mine = whole[at : bisect_left(whole, stem + "\U0010ffff")]
            if any(counts[w][0] >= 0.8 * counts[term][0] for w in mine):
                continue  # nearly always one word: the word itself is the term
        terms[term] = weigh(term)
    kept = dict(sorted(terms.items(), key=lambda x: (-evidence[x[0]], x[0]))[:MOST_TERMS])
    members = sorted((w for w, stem in stem_of.items() if stem in kept), key=lambda w: (-counts[w][0], w))[:MOST_TERMS]
    return kept | {w: kept[stem_of[w]] for w in members}  # a word weighs what its stem does, and has more letters to be near to


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> tuple[tuple[float, ...], float]:
    """Weighted ridge logistic regression by Newton's method: weights of the features, and the bias."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w[:-1]), float(w[-1])


def labelled(docs: DataFrame, labels: DataFrame, allowed: Column | None = None) -> DataFrame:
    """The bounded sample: up to SAMPLE_PER_CLASS labelled rows of each class by hash of doc_id, with their texts; equal texts once.

    Of a doc_id that occurs more than once the least text counts. Rows without label, doc_id or document are left out.
    """
    rows = labels.where(F.col("toxic").isin(0, 1)).where(allowed if allowed is not None else F.lit(True)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL").distinct()
    one = lambda k: rows.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS)
    found = docs.select("doc_id", "text").join(F.broadcast(one(0).unionByName(one(1))), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic").distinct()


def learned(docs: DataFrame, labels: DataFrame, allowed: Column | None = None) -> Model:
    """The model of the bounded sample of ``docs``."""
    mark = len(WRITTEN)
    model = fit(cut(labelled(docs, labels, allowed), "labelled"))
    drop_since(docs.sparkSession, mark)
    return model


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with score (0 to 1) and matched (sum of hits as features). Null and empty texts score as texts without hits.

    Whole texts, however long; repeated rows score alike, an empty table stays empty, columns named score or matched, in whatever
    case, give way to ours.
    """
    keep = others(df, "score", "matched")

    def run(batches):
        lexicon = Lexicon(model.terms, model.known)
        for batch in batches:
            for part, texts in slices(batch, text):
                found = [features(x or "", lexicon) for x in texts]
                extra = [pa.array([model.score(x) for x in found], pa.float64()), pa.array(found, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *extra], names=[*keep, "score", "matched"])

    return map_arrow(df.select(*keep), run, f"{ddl(df, keep)}, score double, matched array<double>")


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the rows outside fold 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learned(docs, table(spark, sf_dir, "labels"), fold() != 0))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
