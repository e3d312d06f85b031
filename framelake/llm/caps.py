"""Embedding near-duplicates by spherical-cap filters: structured random product codes, list decoding, join, verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WRITTEN, cut, drop_since, join_spread, table
from .graph import Forest, by_group, components, in_blocks, sized, spanning

SIMILARITY = 0.98
#: Codes, and how far below its best cap a vector's threshold lies, in standard deviations of the product of a cap with
#: what sets two vectors at SIMILARITY apart.
CODES, MARGIN = 3, 1.0
#: A code is a product of BLOCKS codebooks of unit vectors after a random rotation, so it has words ** BLOCKS caps; a
#: codebook has so many words that a cap holds about ROWS_PER_CAP of spread-out vectors, within these bounds.
BLOCKS, CAPS_PER_ROW, ROWS_PER_CAP, LEAST_WORDS, MOST_WORDS = 4, 36, 1, 24, 512
#: Most vectors of a bucket that meet at once; larger buckets are divided into parts that meet two by two.
BUCKET_PART = 512
#: Vectors decoded at once, and columns of caps compared at once; they bound a worker's memory.
DECODE_ROWS, COLUMNS = 256, 4096
SEED = 20_240_601


def codewords(vectors: int) -> int:
    """Words of a codebook for so many vectors: caps grow as the vectors do, so buckets of unlike vectors don't."""
    return int(min(MOST_WORDS, max(LEAST_WORDS, np.ceil((vectors * CAPS_PER_ROW / ROWS_PER_CAP) ** (1 / BLOCKS)))))


class Code:
    """One structured random product code: a rotation and BLOCKS codebooks.

    A vector's threshold is its best product less a margin that its dimension fixes, so every vector exceeds some and two
    near ones share some, however the rotation spreads them over the blocks; a threshold that is one for all vectors
    leaves about a tenth of them without any cap.
    """

    def __init__(self, dim: int, words: int, number: int):
        rng = np.random.default_rng([SEED, dim, words, number])
        width = -(-dim // BLOCKS)
        words = min(words, 2 * width * width)  # few dimensions don't hold many directions
        self.dim, self.count = dim, words
        self.rotation, _ = np.linalg.qr(rng.standard_normal((width * BLOCKS, width * BLOCKS)))
        book = rng.standard_normal((BLOCKS, words, width))
        self.book = book / np.linalg.norm(book, axis=2, keepdims=True)
        self.margin = MARGIN * np.sqrt(1 - SIMILARITY**2) * np.sqrt(BLOCKS / dim)

    def near(self, unit: np.ndarray) -> np.ndarray:
        """(n, BLOCKS, words) products of each block with its codewords; a cap's product is a sum of one of each block."""
        padded = np.zeros((len(unit), len(self.rotation)))
        padded[:, : self.dim] = unit
        return np.einsum("nbw,bcw->nbc", (padded @ self.rotation).reshape(len(unit), BLOCKS, -1), self.book)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cap) of every cap whose product reaches the row's threshold.

        What a product loses against the best is a sum of what its words lose, so words and then pairs of words that lose
        more than the margin are left out, and the rest is joined.
        """
        near = self.near(unit)
        loss = near.max(2, keepdims=True) - near
        half = []
        for k in (0, 2):
            words = []
            for b in (k, k + 1):
                most = max(int((loss[:, b] <= self.margin).sum(1).max()), 1)
                word = np.argpartition(loss[:, b], most - 1, axis=1)[:, :most]
                words.append((word, np.take_along_axis(loss[:, b], word, 1)))
            (wa, la), (wb, lb) = words
            both = (la[:, :, None] + lb[:, None, :]).reshape(len(unit), -1)
            number = (wa[:, :, None] * self.count + wb[:, None, :]).reshape(len(unit), -1)
            row, at = np.nonzero(both <= self.margin)
            half.append((row, number[row, at], both[row, at]))
        (ra, na, la), (rb, nb, lb) = half
        start, size = np.searchsorted(rb, np.arange(len(unit))), np.bincount(rb, minlength=len(unit))
        left = np.repeat(np.arange(len(ra)), size[ra])
        right = np.arange(len(left)) - np.repeat(np.cumsum(size[ra]) - size[ra], size[ra]) + start[ra[left]]
        fit = la[left] + lb[right] <= self.margin
        left, right = left[fit], right[fit]
        return ra[left], na[left].astype(np.int64) * self.count**2 + nb[right]


def decoded(unit: np.ndarray, codes: list[Code]) -> list[np.ndarray]:
    """The sorted caps of each vector, over all codes."""
    found = [(row, cap + (number << 40)) for number, code in enumerate(codes) for row, cap in [code.decode(unit)]]
    row, cap = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((cap, row))
    return np.split(cap[order], np.cumsum(np.bincount(row, minlength=len(unit)))[:-1])


def _filtered(vectors: DataFrame, words: int) -> DataFrame:
    """node, space, copies, unit (doubles as bytes), caps (sorted numbers over all codes)."""

    def run(batches):
        books: dict[int, list[Code]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(at, DECODE_ROWS)
                rows = part.column("embedding").to_pylist()
                dims = np.array([len(x) for x in rows])
                caps: list = [None] * len(rows)
                unit: list = [None] * len(rows)
                for dim in np.unique(dims).tolist():
                    which = np.flatnonzero(dims == dim)
                    x = np.array([rows[i] for i in which], float)
                    x /= np.abs(x).max(1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    if dim not in books:
                        books[dim] = [Code(dim, words, c) for c in range(CODES)]
                    found = decoded(x, books[dim])
                    for k, i in enumerate(which.tolist()):
                        caps[i], unit[i] = found[k].tolist(), x[k].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("space"), part.column("copies"), pa.array(unit, pa.binary()), pa.array(caps, pa.list_(pa.int64()))], names=["node", "space", "copies", "unit", "caps"])

    return vectors.select("node", "space", "copies", "embedding").mapInArrow(run, "node bigint, space bigint, copies bigint, unit binary, caps array<bigint>")


def _met_earlier(caps: pa.Array, this: int) -> np.ndarray:
    """Which pairs of a bucket share a cap of a lower number, a few thousand caps at a time."""
    n = len(caps)
    flat = caps.values.to_numpy()
    row = np.repeat(np.arange(n), np.diff(caps.offsets.to_numpy()))
    row, flat = row[flat < this], flat[flat < this]
    value, place, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[place] > 1
    row, place = row[shared], np.unique(place[shared], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((n, n), bool)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        s, e = np.searchsorted(place, (at, at + COLUMNS))
        has = np.zeros((n, min(COLUMNS, int(place[-1]) + 1 - at)), np.float32)
        has[row[s:e], place[s:e] - at] = 1
        out |= has @ has.T > 0
    return out


def _linked(group: pa.Table) -> list[list]:
    """Rows (node, null, copies linked) and (node, node, 0: spanning edges), counting a pair in its first common cap only."""
    node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
    n = len(node)
    if n < 2:
        return [[], [], []]
    x = np.frombuffer(b"".join(group.column("unit").to_pylist())).reshape(n, -1)
    links = x @ x.T >= SIMILARITY
    np.fill_diagonal(links, False)
    part, i, j = group.column("part").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
    if i != j:
        links &= part[:, None] != part[None, :]
    if links.any():
        links &= ~_met_earlier(group.column("caps").combine_chunks(), group.column("cap")[0].as_py())
    if not links.any():
        return [[], [], []]
    counts = links @ copies
    edges = spanning(links, Forest(n))
    some = np.flatnonzero(counts)
    a = [*node[some].tolist(), *(int(node[p]) for p, _ in edges)]
    return [a, [*[None] * len(some), *(int(node[q]) for _, q in edges)], [*counts[some].tolist(), *[0] * len(edges)]]


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row; links join rows of equal label at a cosine of 0.98 or more.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with
    nothing (component_id their own vec_id). Vectors of different length don't meet. Equal vectors are computed once and
    counted each; repeated rows are links of each other; null vec_ids are larger than any other. Other columns are
    ignored, an empty table gives no rows. Steps: collapse copies, list-decode all caps above the threshold, join on
    (label, cap), drop buckets of one, verify in double precision.
    """
    spark, mark = df.sparkSession, len(WRITTEN)
    double = F.col(embedding).cast("array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("vec"), double.alias("embedding"), F.col(label).alias("label"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & good, F.lit(False))
    keyed = cut(rows.withColumn("node", F.when(valid, F.xxhash64("label", "embedding"))), "vectors")
    once = cut(
        keyed.where("node IS NOT NULL").groupBy("node").agg(F.min("vec").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.xxhash64(F.first("label"), F.size(F.first("embedding"))).alias("space")), "nodes"
    )
    known = once.select("node", "least", "copies")
    found_caps = cut(_filtered(once, codewords(once.count())), "caps")
    capped = found_caps.select("node", "space", F.explode("caps").alias("cap"))
    total = found_caps.agg(F.coalesce(F.sum(F.size("caps")), F.lit(0)).cast("long")).first()[0]
    met = in_blocks(sized(capped, ["space", "cap"], total).join(found_caps.select("node", "copies", "unit", "caps"), "node"), "node", "n", BUCKET_PART)
    found = cut(by_group(met.select("space", "cap", "i", "j", "part", "node", "copies", "unit", "caps"), ["space", "cap", "i", "j"], _linked, "a bigint, b bigint, n bigint"), "links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    roots = cut(components(found.where("b IS NOT NULL").select("a", "b").distinct()), "roots")
    least = roots.join(known, "node").groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    component_of = join_spread(roots, least, ["root"], roots.count()).select("node", "component_id")
    per_node = known.join(counts, "node", "left").join(component_of, "node", "left")
    per_node = cut(per_node.select("node", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"), "copies"), "by_node")
    ids = keyed.select("vec", "node")
    linked = join_spread(ids.where("node IS NOT NULL"), per_node, ["node"], ids.count(), "copies").select("vec", "n_links", "component_id")
    alone = ids.where("node IS NULL").select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"))
    drop_since(spark, mark, keyed, per_node)
    return linked.unionByName(alone).select(F.col("vec").alias(vec_id), "n_links", "component_id", F.expr("vec <=> component_id").alias("kept"))


def op3_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Every pair of one label, and everything that links reach.
OP3_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {SIMILARITY}
), reach AS (
  SELECT vec_id AS i, vec_id AS r FROM v UNION SELECT links.j, reach.r FROM reach JOIN links USING (i) WHERE reach.r < links.j
)
SELECT vec_id, (SELECT count(*) FROM links WHERE i = vec_id) AS n_links, (SELECT min(r) FROM reach WHERE i = vec_id)::BIGINT AS component_id,
       (SELECT min(r) FROM reach WHERE i = vec_id) = vec_id AS kept
FROM v
"""
