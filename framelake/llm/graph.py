"""Connected components, and a streaming walk over sorted groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, join_spread, map_arrow


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> node, root: each node of an edge with the least node it reaches.

    Alternating large and small stars, each round written to the shared folder; only a count and a checksum reach the
    driver. Minima are taken by aggregation, and joined to the rows such that the rows of a node with very many
    neighbours stay where they are. Loops and edges with nulls are ignored.
    """
    pairs = edges.where("a <> b")
    now = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        upward = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = cut(join_spread(upward, least, ["a"], mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_spread(large, least, ["a"], large.count()).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop_cut(now, large)
        now, before = new, mark
        mark = _mark(now)
        if mark == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.where("node <> root").unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal integer keys in sorted batches; a run may span batches, so runs must be of bounded size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        bounds = [0, *cuts.tolist(), n]
        for s, e in zip(bounds, bounds[1:], strict=False):
            part = batch.slice(s, e - s)
            if s == 0 and held:
                if any(held[0].column(k)[0].as_py() != part.column(k)[0].as_py() for k in keys):
                    yield pa.Table.from_batches(held)
                    held = []
            elif s:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, keys: list[str], run: Callable[[pa.Table], list[list]], schema: str, batch: int = 20_000) -> DataFrame:
    """Deal rows by ``keys`` (long) and give each group, as an Arrow table, to ``run``, which returns columns."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def go(batches):
        held: list[list] = [[] for _ in names]
        for group in groups(batches, keys):
            for column, more in zip(held, run(group), strict=True):
                column.extend(more)
            if len(held[0]) >= batch:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, types, strict=True)], names=names)
                held = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, types, strict=True)], names=names)

    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys), go, schema)


def sized(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Rows whose keys occur more than once, with the number of their rows in ``n``; counts are summed before any shuffle."""
    return join_spread(rows, rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), keys, total)


def in_blocks(df: DataFrame, member: str, size: str, most: int) -> DataFrame:
    """Divide groups of more than ``most`` rows: adds part (of the row), i and j, a row for each pair of parts it is in.

    Every two rows of a group meet in some (i, j); those of different parts in exactly one. Groups up to ``most`` have
    the one pair (0, 0).
    """
    parts = F.ceil(F.col(size) / F.lit(most)).cast("int")
    part = F.pmod(F.xxhash64(F.col(member), F.lit("block")), F.greatest(parts, F.lit(1))).cast("int")
    rows = df.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return rows.withColumns({"i": F.least("part", "other").cast("long"), "j": F.greatest("part", "other").cast("long")}).drop("other")


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def spanning(links: np.ndarray, known: Forest | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean matrix, beyond what ``known`` has joined."""
    forest = known or Forest(len(links))
    out = []
    todo = np.ones(len(links), bool)
    while todo.any():
        stack = [int(np.argmax(todo))]
        todo[stack[0]] = False
        while stack:
            x = stack.pop()
            new = np.flatnonzero(links[x] & todo)
            todo[new] = False
            for y in new.tolist():
                if forest.join(x, y):
                    out.append((x, y))
                stack.append(y)
    return out
