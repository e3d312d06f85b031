"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, subdivided ranges."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, literal, table

#: Sampled keys for each range; more make the ranges more even, never the result different.
SAMPLES_PER_RANGE = 16
#: Rows aimed at in one range, and the least and most ranges. The driver holds one boundary and one total for each.
ROWS_PER_RANGE, LEAST_RANGES, MOST_RANGES = 100_000, 320, 8192
#: A range with more than so many times the mean rows is cut again.
OVERFULL = 4
KEY = "struct<k:bigint,d:bigint,r:bigint>"


@dataclass
class Layout:
    """Rows in key order: ``df`` has ``at`` (index from 0) and ``before`` (bytes of earlier rows) besides its columns."""

    df: DataFrame
    rows: int
    size: int


def _key() -> Column:
    return F.struct(F.col("k"), F.col("d"), F.col("r"))


def _range_of(splitters: list[dict]) -> Column:
    """How many splitters are not above a row's key, by a binary search in a constant array."""
    top = 1 << max(len(splitters) - 1, 0).bit_length()
    steps = [top >> i for i in range(top.bit_length())]
    found = literal(json.dumps(splitters), f"array<{KEY}>")
    key = _key()
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, step: F.when(F.get(found, low + step - 1) <= key, low + step).otherwise(low),
    )


def _sample(df: DataFrame, weight: Column, per_unit: float, ranges: int) -> list[dict]:
    """Quantile boundaries of a size-weighted sample: each row is taken with a chance of its weight times ``per_unit``."""
    even = F.shiftrightunsigned(F.xxhash64("k", "d", "r", F.lit("sample")), 11) / F.lit(float(1 << 53))
    taken = df.select("k", "d", "r", (weight * per_unit).alias("w")).where(even < F.col("w")).withColumn("w", F.greatest("w", F.lit(1.0)))
    total = F.sum("w").over(Window.partitionBy())
    upto = F.sum("w").over(Window.orderBy("k", "d", "r"))
    part = F.floor((upto - F.col("w")) * ranges / total)
    rows = taken.withColumn("part", part).groupBy("part").agg(F.min(_key()).alias("key")).where("part > 0").collect()
    return [r.key.asDict() for r in rows]


def lay_out(df: DataFrame, key: Column, tie: Column, size: Column, ranges: int | None = None) -> Layout:
    """Put all rows in the order of (key, tie) and give each its index and the bytes before it.

    Only narrow columns should be in ``df``: it is written twice. Names k, d, r, s, range, at and before are ours.
    Rows that are equal in key and tie get consecutive places, so a key or a row that repeats without end is
    divided over ranges as any other; nulls sort first. Sampling decides how work is split, never a row's place.
    """
    kept = df.columns
    narrow = cut(df.select(*kept, key.alias("k"), tie.cast("long").alias("d"), size.cast("long").alias("s"), F.monotonically_increasing_id().alias("r")), "keys")
    got = narrow.agg(F.count("*").alias("n"), F.coalesce(F.sum("s"), F.lit(0)).alias("s")).first()
    if not got.n:
        empty = narrow.select(*kept, F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("before"), "s")
        return Layout(empty, 0, 0)
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, got.n // ROWS_PER_RANGE))
    mean = got.s / got.n + 1
    weight = F.col("s") + mean  # so that a range of many small rows is not long either
    splitters = _sample(narrow, weight, SAMPLES_PER_RANGE * ranges / (2 * mean * got.n), ranges)
    for _ in range(8):
        splitters = sorted({json.dumps(x): x for x in splitters}.values(), key=lambda x: [(v is not None, v or 0) for v in (x["k"], x["d"], x["r"])])
        ranged = narrow.withColumn("range", _range_of(splitters))
        sums = {r.range: (r.n, r.s) for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("s").alias("s")).collect()}
        over = [k for k, (n, _) in sums.items() if n > OVERFULL * max(1_000, got.n / ranges)]
        if not over:
            break
        part = sum(sums[k][0] for k in over)
        pieces = max(2, min(MOST_RANGES, 2 * part * ranges // got.n))
        more = _sample(ranged.where(F.col("range").isin(over)), F.lit(1.0), SAMPLES_PER_RANGE * pieces / part, pieces)
        if not more:
            break
        splitters += more
    starts, n, s = [], 0, 0
    for k in range(len(splitters) + 1):
        starts.append({"n": n, "s": s})
        n, s = n + sums.get(k, (0, 0))[0], s + sums.get(k, (0, 0))[1]
    start = F.get(literal(json.dumps(starts), "array<struct<n:bigint,s:bigint>>"), F.col("range"))
    order = Window.partitionBy("range").orderBy("k", "d", "r")
    within = F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")
    placed = ranged.select(*kept, "s", (start.n + F.row_number().over(order) - 1).alias("at"), (start.s + within).alias("before"))
    order_kept = cut(placed, "order")
    drop_cut(narrow)
    return Layout(order_kept, got.n, got.s)


def shard(df: DataFrame, shards: int, text: str = "text", tie: str = "doc_id", overhead: int = 16) -> DataFrame:
    """Deal rows into ``shards`` shards of nearly equal bytes; equal texts stay together unless a boundary cuts their run.

    Rows go in the order of (hash of the text, tie) and shard i takes those whose middle byte lies in the i-th part of
    all bytes, so no shard differs from the mean by more than its largest row. Null texts count as empty. Ties and
    repeated rows are kept, each with a slot of its own; whole texts count; an empty table gives an empty one. Other columns
    are ignored.
    Returns tie, size, text_crc32, shard, slot.
    """
    utf8 = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = df.select(F.col(tie).alias("tie"), (F.octet_length(utf8) + overhead).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))
    laid = lay_out(narrow, F.col("hash"), F.col("tie"), F.col("size"))
    middle = (F.col("before") * 2 + F.col("s")) * F.lit(shards)
    number = F.least(F.lit(shards - 1), F.expr("`middle` div `twice`").cast("int"))
    dealt = laid.df.withColumns({"middle": middle, "twice": F.lit(max(2 * laid.size, 1)).cast("long")}).withColumn("shard", number)
    first = {r.shard: r["at"] for r in dealt.groupBy("shard").agg(F.min("at").alias("at")).collect()}
    starts = F.get(literal(json.dumps([first.get(i, 0) for i in range(shards)]), "array<bigint>"), F.col("shard"))
    return dealt.select(F.col("tie").alias(tie), "size", "text_crc32", "shard", (F.col("at") - starts).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards of nearly equal bytes."""
    out = shard(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
