"""Near-duplicates by ProbMinHash: Poisson arrivals of weighted shingles, banding, and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ddl, drop_since, join_spread, map_arrow, others, slices, table, WRITTEN
from .graph import Forest, by_group, components, in_blocks, sized, spanning

WORDS, SIMILARITY = 5, 0.8
#: A pair at 0.8 shares no band of 24 x 4 with chance 3e-6; it looks less than LEAST_ESTIMATE alike with chance 2e-6.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
LEAST_ESTIMATE = 0.6
#: Most members of a bucket, and of a cluster, that meet at once; larger ones are divided into parts that meet two by two.
BUCKET_PART, CLUSTER_PART = 512, 512
#: Characters of a part of a cluster: very long texts meet in smaller parts.
PART_CHARS = 4 << 20
BATCH_WORDS = 100_000
#: Words that a worker remembers, and letters of one that is worth it; they bound its memory.
MOST_WORDS, MOST_LETTERS = 100_000, 64
COLUMNS = 4096
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        found = xxhash.xxh64_intdigest(word) | 1
        if len(word) > MOST_LETTERS:
            return found
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = found
        return found


def shingles(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of up to 65,536 texts: number of the text, 48-bit shingle and its count, by text and shingle.

    Words are lower-cased and cut at white space; a text of fewer than five words is one shingle, one without words none.
    """
    flat: list[str] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        flat += words
        sizes[i] = len(words)
    h = np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    count = np.where(sizes > 0, np.maximum(sizes - WORDS + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + starts[doc]
    ends = (starts + sizes)[doc]
    h = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    total = np.zeros(len(doc), np.uint64)
    for k in range(WORDS):
        total = (total + np.where(at + k < ends, h[at + k], np.uint64(0))) * _A
        total ^= total >> np.uint64(29)
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (mix(total) >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), counts


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """(n, REGISTERS) elements whose point arrived first in each register.

    Every element sends points in a Poisson process of the rate of its weight, each to a register of its own choice;
    elements go on together and stop once their time is past the latest register of their text.
    """
    when = np.full(n * REGISTERS, np.inf)
    who = np.zeros(n * REGISTERS, np.uint64)
    seed = mix(element * _A + _C)
    time = np.zeros(len(doc))
    rate = 1.0 / weight
    live = np.arange(len(doc))
    turn = np.uint64(0)
    while len(live):
        turn += np.uint64(1)
        with np.errstate(over="ignore"):
            x = mix(seed[live] + turn * _A)
            slot = doc[live] * REGISTERS + ((mix(x + _B) >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        t = time[live] - np.log(((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) * rate[live]
        time[live] = t
        better = np.flatnonzero(t < when[slot])
        better = better[np.argsort(-t[better], kind="stable")]  # of equal slots the last, and so the earliest, stays
        when[slot[better]] = t[better]
        who[slot[better]] = element[live[better]]
        latest = when.reshape(n, REGISTERS).max(1)
        live = live[t < latest[doc[live]]]
    return who.reshape(n, REGISTERS)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two (sorted shingles, counts): the sum over common i of 1 / sum_j max(x_j/x_i, y_j/y_i)."""
    common, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1].astype(float), b[1].astype(float)
    xc, yc = x[ia], y[ib]
    only = x.sum() - xc.sum(), y.sum() - yc.sum()
    out = 0.0
    ratio = yc / xc
    for r in np.unique(ratio):
        out += xc[ratio == r].sum() / (only[0] + only[1] / r + np.maximum(xc, yc / r).sum())
    return out


def _runs(texts: list[str]) -> list[tuple[int, int]]:
    """Bounds of runs of texts of about BATCH_WORDS words each."""
    out, at, words = [], 0, 0
    for end, text in enumerate(texts):
        size = len(text) // 5 + 1
        if end > at and (words + size > BATCH_WORDS or end - at >= 20_000):
            out.append((at, end))
            at, words = end, 0
        words += size
    return [*out, (at, len(texts))] if texts else []


def signed(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` without the text, with chars, sig (a byte of each register) and bands; the last two null where a text has no words."""
    keep = others(texts, text, "chars", "bands", "sig")

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part, values in slices(batch, text):
                values = [x or "" for x in values]
                for at, end in _runs(values):
                    doc, element, weight = shingles(values[at:end], hashes)
                    sig = signatures(doc, element, weight, end - at)
                    some = np.zeros(end - at, bool)
                    some[doc] = True
                    h = np.zeros((end - at, BANDS), np.uint64)
                    for k in range(ROWS):
                        h = mix((h + sig[:, k::ROWS]) * _A)
                    h = mix(h + np.arange(1, BANDS + 1, dtype=np.uint64) * _C)
                    rest = mix(sig + _A).astype(np.uint8)
                    bands = pa.array([row if ok else None for row, ok in zip(h.view(np.int64).tolist(), some.tolist(), strict=True)], pa.list_(pa.int64()))
                    bytes_ = pa.array([row.tobytes() if ok else None for row, ok in zip(rest, some.tolist(), strict=True)], pa.binary())
                    chars = pa.array([len(x) for x in values[at:end]], pa.int64())
                    yield pa.RecordBatch.from_arrays([*(part.column(c).slice(at, end - at) for c in keep), chars, bands, bytes_], names=[*keep, "chars", "bands", "sig"])

    return map_arrow(texts.select(*keep, text), run, f"{ddl(texts, keep)}, chars bigint, bands array<bigint>, sig binary")


def _estimated(group: pa.Table) -> list[list]:
    """Spanning forest of the pairs of a bucket that look alike."""
    nodes = group.column("node").to_numpy()
    if len(nodes) < 2:
        return [[], []]
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(nodes), REGISTERS)
    same = np.zeros((len(nodes), len(nodes)), np.int16)
    for k in range(REGISTERS):
        same += sig[:, k, None] == sig[None, :, k]
    found = spanning(same >= LEAST_ESTIMATE * REGISTERS)
    return [[int(nodes[x]) for x, _ in found], [int(nodes[y]) for _, y in found]]


def _verified(group: pa.Table) -> list[list]:
    """Spanning forest of the exact links of a cluster, or of two parts of one."""
    nodes, first = np.unique(group.column("node").to_numpy(), return_index=True)
    texts = group.column("text").take(pa.array(first)).to_pylist()
    n = len(nodes)
    if n < 2:
        return [[], []]
    hashes, found = WordHashes(), []
    for at, end in _runs(texts):
        d, e, w = shingles(texts[at:end], hashes)
        found.append((d + at, e, w))
    doc, element, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    bounds = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(bounds)
    plain = np.ones(n, bool)
    plain[doc[weight > 1]] = False
    forest = Forest(n)
    out: list[tuple[int, int]] = []
    if n == 2 or not plain.any():
        plain[:] = False
    else:
        _, inverse, often = np.unique(element, return_inverse=True, return_counts=True)
        shared = (often[inverse] > 1) & plain[doc]
        columns, place = np.unique(inverse[shared], return_inverse=True)
        rows = doc[shared]
        order = np.argsort(place, kind="stable")
        place, rows = place[order], rows[order]
        common = np.zeros((n, n), np.float32)
        for at in range(0, len(columns), COLUMNS):
            s, e = np.searchsorted(place, (at, at + COLUMNS))
            part = np.zeros((n, min(COLUMNS, len(columns) - at)), np.float32)
            part[rows[s:e], place[s:e] - at] = 1
            common += part @ part.T
        union = size[:, None] + size[None, :] - common
        out += spanning((common >= SIMILARITY * union - 1e-6) & plain[:, None] & plain[None, :], forest)
    own = [(element[bounds[i] : bounds[i + 1]], weight[bounds[i] : bounds[i + 1]]) for i in range(n)]
    for i in np.flatnonzero(~plain).tolist():
        roots = forest.roots()
        mine = element[np.r_[bounds[i] : bounds[i + 1]]]
        both = np.bincount(doc[np.isin(element, mine)], minlength=n)  # if nothing else fits, half of the smaller side must
        for j in np.flatnonzero((roots != roots[i]) & (both > 0) & (plain | (np.arange(n) > i))).tolist():
            if forest.find(i) != forest.find(j) and similarity(own[i], own[j]) >= SIMILARITY - 1e-9:
                forest.join(i, j)
                out.append((i, j))
    return [[int(nodes[x]) for x, _ in out], [int(nodes[y]) for _, y in out]]


def node_of(text):
    """Texts are known by a 64-bit hash; nulls by none."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, node, class_id, kept for each row; rows of one class are joined by links of 0.8 or more, or equal texts.

    class_id is the least doc_id of a class and kept marks it. Links are exact probability Jaccard of five-word
    shingles weighted by their counts, over whole texts. Equal texts are one class whatever they hold, empty ones too; a
    null text is a class by itself (class_id its doc_id); null doc_ids sort after all others; repeated rows are all
    returned; an empty table gives no rows. Other columns are ignored. Steps: collapse copies; sign; bucket by band;
    drop buckets of one; keep what looks 0.6 alike; cluster; verify all pairs of a cluster that aren't joined yet.
    Large buckets and clusters are divided into parts that meet two by two, so that no task holds more than two parts.
    """
    spark, mark = df.sparkSession, len(WRITTEN)
    docs = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).withColumn("node", node_of(F.col("text")))
    rows_signed = cut(signed(docs, "text"), "signed")
    once = cut(
        rows_signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("least"), F.count("*").alias("copies"), F.first("chars").alias("chars"), F.first("bands").alias("bands"), F.first("sig").alias("sig")),
        "once",
    )
    known = once.select("node", "least", "copies")
    banded = once.where("bands IS NOT NULL").select("node", F.explode("bands").alias("band"))
    full = sized(banded, ["band"], once.where("bands IS NOT NULL").count() * BANDS)
    met = in_blocks(full.join(once.select("node", "sig"), "node"), "node", "n", BUCKET_PART)
    alike = by_group(met.select("band", "i", "j", "node", "sig"), ["band", "i", "j"], _estimated, "a bigint, b bigint").distinct()
    clusters = cut(components(alike).join(once.select("node", "least", "chars"), "node"), "clusters")
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"), F.sum("chars").alias("all_chars"))
    whole = F.greatest("n", F.ceil(F.col("all_chars") * CLUSTER_PART / PART_CHARS))
    none = F.lit(-(1 << 63)).cast("long")
    keyed = join_spread(clusters, sizes, ["root"], clusters.count()).select("node", "root", whole.alias("size"), F.coalesce("least", none).alias("doc_key"))
    texts = docs.where("node IS NOT NULL").withColumn("doc_key", F.coalesce("doc", none)).select("node", "doc_key", "text")
    put = in_blocks(keyed.join(texts, ["node", "doc_key"]), "node", "size", CLUSTER_PART)
    links = by_group(put.select("root", "i", "j", "node", "text"), ["root", "i", "j"], _verified, "a bigint, b bigint").distinct()
    joined = cut(components(links), "classes")
    classes = joined.join(known, "node").groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("n"))
    class_of = join_spread(joined, classes, ["root"], joined.count()).select("node", "class_id")
    by_node = cut(known.join(class_of, "node", "left").select("node", F.coalesce("class_id", "least").alias("class_id"), "copies"), "by_node")
    rows = rows_signed.select("doc", "node")
    with_class = join_spread(rows.where("node IS NOT NULL"), by_node, ["node"], rows.count(), "copies").drop("copies")
    drop_since(spark, mark, rows_signed, by_node)
    with_class = with_class.unionByName(rows.where("node IS NULL").withColumn("class_id", F.col("doc")))
    return with_class.select(F.col("doc").alias(doc_id), "node", "class_id", F.expr("doc <=> class_id").alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


#: Names that the rows of a caller are joined by, unlikely to be theirs.
KEYS = ("framelake_doc", "framelake_node", "framelake_copies")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class; of equal rows one."""
    found = near_duplicates(docs).where("kept")
    none = F.lit(-(1 << 63)).cast("long")
    wanted = found.groupBy(F.coalesce("doc_id", none).alias(KEYS[0]), F.coalesce("node", F.lit(0).cast("long")).alias(KEYS[1])).agg(F.count("*").alias(KEYS[2]))
    keyed = docs.withColumns({KEYS[0]: F.coalesce(F.col("doc_id").cast("long"), none), KEYS[1]: F.coalesce(node_of(F.col("text")), F.lit(0).cast("long"))})
    rows = keyed.join(wanted, [*KEYS[:2]])
    single = rows.where(F.col(KEYS[2]) == 1).select(*docs.columns)
    return single.unionByName(rows.where(F.col(KEYS[2]) > 1).dropDuplicates([*KEYS[:2]]).select(*docs.columns))
