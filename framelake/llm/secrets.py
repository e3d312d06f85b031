"""Secret scans with corpus-wide ownership frequency: what many owners share is an example, the rest looks live."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WRITTEN, cut, ddl, drop_since, join_spread, map_arrow, others, slices, table

#: The kinds of candidates and their patterns, in this order.
KINDS = ("assign", "access", "hex")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile("(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token")) + r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: A value that so many owners or repositories hold is an example; one of fewer bits a character is too plain to be live.
COMMON_OWNERS, COMMON_REPOSITORIES, LEAST_BITS = 3, 6, 2.0
LIVE, EXAMPLE, PLAIN = "live", "example", "plain"
SPANS = "array<struct<kind:int,start:bigint,end:bigint,value_start:bigint,hash:bigint,bits:double>>"
ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("hash", pa.int64()), ("bits", pa.float64())]))


def bits(value: str) -> float:
    """Shannon entropy of a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def candidates(text: str) -> list[dict]:
    """Base spans by start and kind: leftmost, non-overlapping for each kind, failing lengths dropped."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(0, m.start(), m.end(), m.start(2), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.start(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(2, m.start(), m.end(), m.start(), m[0]) for m in HEX.finditer(text)]
    found.sort(key=lambda x: (x[1], x[0]))
    hashed = lambda v: int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True)
    return [dict(zip(("kind", "start", "end", "value_start", "hash", "bits"), (k, s, e, at, hashed(v), bits(v)), strict=True)) for k, s, e, at, v in found]


def find_secrets(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with the column spans: candidates of each whole text (none for a null), positions in code points.

    Columns named spans, in whatever case, give way; an empty table stays empty.
    """
    keep = others(df, text, "spans")
    columns = [*keep, *[text] * keep_text]

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, text):
                spans = pa.array([candidates(x) if x else [] for x in texts], ARROW)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), spans], names=[*columns, "spans"])

    return map_arrow(df.select(*keep, text), run, f"{ddl(df, columns)}, spans {SPANS}" if columns else f"spans {SPANS}")


def ownership(each: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners and n (rows) of a table with hash, repository and owner, summed up before any shuffle by hash alone."""
    by_owner = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"), F.sum("n").alias("n"))


def scan_secrets(df: DataFrame, repository: Column, owner: Column, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` with the column secrets: array of struct(start, kind, end, value_start, verdict) by start and kind.

    A value's verdict is the same wherever it occurs: example if COMMON_OWNERS distinct owners or COMMON_REPOSITORIES
    distinct repositories hold it, else plain if its entropy is low, else live. Whole texts are searched, once. Null texts
    have no secrets, null owners and repositories are one value each, repeated rows count once for an owner, an empty table
    stays empty. The columns spans, secrets, row_key, repository_key and owner_key are ours, in whatever case. Only rows
    with candidates are shuffled, each by a key of its own; a value that very many rows hold stays where they are.
    """
    spark, mark = df.sparkSession, len(WRITTEN)
    ours = ("secrets", "row_key", "repository_key", "owner_key")
    kept = others(df, *ours, "spans")
    keyed = df.select(*kept, F.coalesce(repository.cast("string"), F.lit("")).alias("repository_key"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner_key"))
    found = cut(find_secrets(keyed, text, keep_text).withColumn("row_key", F.monotonically_increasing_id()), "secrets")
    hits = found.where(F.size("spans") > 0)
    each = cut(hits.select("row_key", F.col("repository_key").alias("repository"), F.col("owner_key").alias("owner"), F.explode("spans").alias("s")).select("row_key", "repository", "owner", "s.*"), "spans")
    common = (F.col("n_owners") >= COMMON_OWNERS) | (F.col("n_repositories") >= COMMON_REPOSITORIES)
    verdict = F.when(common, EXAMPLE).when(F.col("bits") < LEAST_BITS, PLAIN).otherwise(LIVE)
    known = join_spread(each.drop("repository", "owner"), ownership(each), ["hash"], each.count())
    told = cut(known.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value_start", verdict.alias("verdict")))).alias("secrets")), "told")
    drop_since(spark, mark, found, told)
    gone = ("row_key", "spans", "repository_key", "owner_key")
    none = F.expr("CAST(array() AS array<struct<start:bigint,kind:int,end:bigint,value_start:bigint,verdict:string>>)")
    return hits.join(told, "row_key").drop(*gone).unionByName(found.where(F.size("spans") == 0).withColumn("secrets", none).drop(*gone))


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Put ``mark`` for each value judged live, examples stay; drops the column secrets. Overlapping values are one; null texts stay null."""
    keep = others(df, text, "secrets")

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, text):
                out = []
                for value, secrets in zip(texts, part.column("secrets").to_pylist(), strict=True):
                    at, parts = 0, []
                    for s, e in sorted((x["value_start"], x["end"]) for x in secrets or () if x["verdict"] == LIVE):
                        if s >= at:
                            parts += [value[at:s], mark]
                        at = max(at, e)
                    out.append(value if not parts else "".join([*parts, value[at:]]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, text])

    clean = df.where(F.size("secrets") == 0).select(*keep, text)
    return clean.unionByName(map_arrow(df.where(F.size("secrets") > 0).select(*keep, text, "secrets"), run, ddl(df, [*keep, text])))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a source is an owner, a source's documents of one language are a repository."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = scan_secrets(docs, F.concat_ws("/", "source", "lang"), F.col("source"))
    base = F.transform("secrets", lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x.kind + 1), x.start, x.end))
    values = F.array_distinct(F.transform(F.filter("secrets", lambda x: x.verdict == LIVE), lambda x: F.struct(x.value_start.alias("start"), F.lit(len(KINDS)).alias("kind"), x.end.alias("end"))))
    plain = F.transform("secrets", lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end")))
    every = F.transform(F.array_sort(F.concat(plain, values)), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, (*KINDS, LIVE))), x.kind + 1), x.start, x.end))
    number = lambda k: F.size(F.filter("secrets", lambda x: x.kind == k)).cast("long")
    return found.select(
        "doc_id", *(number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"),
        F.array_join(F.transform("secrets", lambda x: x.verdict), ",").alias("verdicts"),
    )
