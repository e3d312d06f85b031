"""Merkle fixity audit of WARC replicas: read each replica's records, hash them and ordered ranges of them into trees, descend into mismatches only."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WRITTEN, cut, ddl, drop_since, others, table
from .sharding import lay_out

FANOUT = 16
VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
RECORD = pa.schema([("record_id", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("error", pa.string())])
RECORD_DDL = "record_id string, at bigint, bytes bigint, sha256 string, error string"


def records(data: bytes) -> list[tuple[str | None, int, int, str, str | None]]:
    """Records of a WARC file: id (None without one), offset, bytes, digest of the bytes, and an error (None if the record is whole).

    A record is its header, as many bytes as Content-Length says, and the two line ends. Where a header can't be read or
    the file ends too soon, the rest of the file is one record with an error, so that no byte is left unhashed.
    """
    out, at = [], 0
    while at < len(data):
        end, name, error = len(data), None, "no WARC header"
        body = data.find(b"\r\n\r\n", at)
        if VERSION.match(data, at) and body >= 0:
            fields = dict(line.split(b":", 1) for line in data[at:body].split(b"\r\n")[1:] if b":" in line)
            fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
            name = fields[b"warc-record-id"].decode("utf-8", "replace") if b"warc-record-id" in fields else None
            size = fields.get(b"content-length", b"")
            error = None if size.isdigit() else "no length"
            if error is None:
                end = body + 4 + int(size) + 4
                if end > len(data) or data[end - 4 : end] != b"\r\n\r\n":
                    end, error = len(data), "cut short"
        out.append((name, at, end - at, hashlib.sha256(data[at:end]).hexdigest(), error))
        at = end
    return out


def warc_records(df: DataFrame, content: str = "content") -> DataFrame:
    """One row per record of the WARC files in a binary column, besides the other columns: record_id, at, bytes, sha256, error.

    Null and empty contents give no rows, repeated rows are read again, an empty table gives none; columns named as ours, in
    whatever case, give way. A record's offset is that in its file.
    """
    keep = others(df, content, *RECORD.names)

    def run(batches):
        for batch in batches:
            kept, origin, rows = batch.select(keep), [], []
            for i, data in enumerate(batch.column(content)):
                found = records(data.as_py() or b"")
                origin += [i] * len(found)
                rows += found
            right = [pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(RECORD), RECORD, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept.take(pa.array(origin, pa.int64())).columns, *right], names=[*keep, *RECORD.names])

    return df.select(*keep, content).mapInArrow(run, ", ".join(filter(None, [ddl(df, keep), RECORD_DDL])))


def leaves(found: DataFrame) -> DataFrame:
    """One leaf per key of a replica's records (key: long, bytes, sha256): key, records, first (offset), bytes and hash.

    Records lie in the order of their keys, nulls first, ties by digest. A key's records are one leaf, whose hash is that of
    its record, or a hash of how many there are and what they hold: sums, so a key that very many records share is no group.
    """
    laid = lay_out(found.select("key", F.col("bytes").cast("long").alias("size"), "sha256"), F.col("key"), F.xxhash64("sha256"), F.col("size")).df
    many = F.sha2(F.concat_ws(":", F.count("*"), F.sum(F.xxhash64("sha256").cast("decimal(38,0)"))), 256)
    one = F.when(F.count("*") == 1, F.max("sha256")).otherwise(many)
    return laid.groupBy("key").agg(F.count("*").alias("records"), F.min("before").alias("first"), F.sum("size").alias("bytes"), one.alias("hash"))


def merkle(level: DataFrame) -> list[DataFrame]:
    """Levels of the trees of all replicas, leaves first, up to one node: (replica, node, bytes, hash).

    ``level`` has replica, node (position from 0), bytes and hash of each leaf. A node of the next level covers FANOUT positions
    and hashes its children's positions, bytes and hashes in order, so no group is larger. Offsets are sums of bytes on the left;
    they aren't hashed, or a record put in would change all nodes to its right.
    """
    levels = [level.select("replica", F.col("node").cast("long"), F.col("bytes").cast("long"), "hash")]
    top = level.agg(F.max("node")).first()[0] or 0
    while top:
        kids = levels[-1].groupBy("replica", F.expr(f"node div {FANOUT}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "bytes", "hash"))).alias("kids"))
        text = F.array_join(F.transform("kids", lambda x: F.concat_ws(":", x.node, x.bytes, x.hash)), ",")
        total = F.aggregate("kids", F.lit(0).cast("long"), lambda n, x: n + x.bytes)
        levels.append(cut(kids.select("replica", F.col("up").alias("node"), total.alias("bytes"), F.sha2(text, 256).alias("hash")), "merkle"))
        top //= FANOUT
    return levels


def _differing(level: DataFrame) -> DataFrame:
    side = lambda k: F.max(F.when(F.col("replica") == k, F.concat_ws(":", "bytes", "hash")))
    return level.groupBy("node").agg(side(0).alias("a"), side(1).alias("b")).where("NOT (a <=> b)")


def audit(levels: list[DataFrame]) -> DataFrame:
    """node, status of each leaf that differs between replicas 0 and 1: corrupt, missing or extra in replica 1.

    Starts from the roots; of each level only the children of differing nodes are compared.
    """
    bad = _differing(levels[-1])
    for level in reversed(levels[:-1]):
        parents = bad.select(F.col("node").alias("parent"))
        bad = _differing(level.join(parents, F.expr(f"node div {FANOUT}") == F.col("parent"), "left_semi"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    return bad.select("node", status.alias("status"))


def fixity(first: DataFrame, second: DataFrame) -> DataFrame:
    """Audit of two replicas, each a table of records (key: long, bytes, sha256) that is laid out by itself.

    One row per key that either replica holds: key, position (among all keys), records, offset, bytes and sha256 in the first
    replica, other_offset and other_bytes in the second (null where it has none), and status: ok, corrupt, missing or extra.
    Keys align the replicas, so records put in, lost or resized move the offsets of later ones and nothing else. A null key is
    a key of its own, first in order; records of one key are one leaf; other columns are ignored; two empty tables give no rows.
    """
    spark, mark = first.sparkSession, len(WRITTEN)
    side = lambda name: [F.max(F.when(F.col("replica") == k, F.col(name))).alias(f"{name}{k}") for k in (0, 1)]
    both = leaves(first).withColumn("replica", F.lit(0)).unionByName(leaves(second).withColumn("replica", F.lit(1)))
    keys = both.groupBy("key").agg(*[x for name in ("records", "first", "bytes", "hash") for x in side(name)])
    laid = cut(lay_out(keys, F.col("key"), F.lit(0), F.lit(0)).df.drop("s", "before"), "leaves")
    level = laid.select(F.col("at").alias("node"), F.explode(F.array(*[F.struct(F.lit(k).alias("replica"), F.col(f"bytes{k}").alias("bytes"), F.col(f"hash{k}").alias("hash")) for k in (0, 1)])).alias("x"))
    levels = merkle(level.select("x.replica", "node", "x.bytes", "x.hash").where("hash IS NOT NULL"))
    found = cut(audit(levels).withColumnRenamed("node", "at"), "found")
    drop_since(spark, mark, laid, found)
    return laid.join(found, "at", "left").select(
        "key", F.col("at").alias("position"), F.col("records0").alias("records"), F.col("first0").alias("offset"), F.col("bytes0").alias("bytes"), F.col("hash0").alias("sha256"),
        F.col("first1").alias("other_offset"), F.col("bytes1").alias("other_bytes"), F.coalesce("status", F.lit("ok")).alias("status"),
    )


def warc_record(page_id: Column, url: Column, body: Column) -> Column:
    """A WARC 1.0 response record; nulls are empty."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


#: The damage that the query does to its second replica: the last byte of some records, the last three of some others, all of
#: more, and records that the first replica doesn't have.
FLIPPED, CUT, LOST, ADDED = "page_id % 97 = 13", "page_id % 101 = 7", "page_id % 211 = 5", "page_id % 89 = 3"


def replica(pages: DataFrame, damaged: bool) -> DataFrame:
    """Records (key, bytes, sha256) of the pages, written as WARC files of one page each and read back from their bytes."""
    of = lambda key, rows: rows.select(warc_record(key, F.col("url"), F.col("html")).alias("record"), "page_id")
    files = of(F.col("page_id"), pages)
    if damaged:
        broken = F.when(F.expr(FLIPPED), F.expr("concat(left(record, length(record) - 1), '#')")).when(F.expr(CUT), F.expr("left(record, length(record) - 3)")).otherwise(F.col("record"))
        files = files.where(F.expr(f"NOT coalesce({LOST}, false)")).withColumn("record", broken).unionByName(of(-1 - F.col("page_id"), pages.where(ADDED)))
    read = warc_records(files.select(F.col("record").cast("binary").alias("content")))
    number = F.regexp_extract("record_id", "^<urn:page:(-?[0-9]+)>$", 1)
    return read.select(F.when(number != "", number.cast("long")).alias("key"), "bytes", "sha256")


def op8_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a replica with known damage."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return fixity(replica(pages, False), replica(pages, True)).withColumnRenamed("key", "page_id")


_RECORD = (
    "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || {} || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')"
    " || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')"
    " || chr(13) || chr(10) || chr(13) || chr(10)"
)
OP8_SQL = f"""
WITH a AS (
  SELECT page_id, {_RECORD.format("page_id")} AS record FROM pages
), b AS (
  SELECT page_id, CASE WHEN {FLIPPED} THEN left(record, length(record) - 1) || '#' WHEN {CUT} THEN left(record, length(record) - 3) ELSE record END AS record FROM a WHERE NOT ({LOST})
  UNION ALL SELECT -1 - page_id, {_RECORD.format("(-1 - page_id)")} FROM pages WHERE {ADDED}
), la AS (
  SELECT page_id, strlen(record)::BIGINT AS bytes, sha256(record) AS hash, (sum(strlen(record)) OVER (ORDER BY page_id) - strlen(record))::BIGINT AS first FROM a
), lb AS (
  SELECT page_id, strlen(record)::BIGINT AS bytes, sha256(record) AS hash, (sum(strlen(record)) OVER (ORDER BY page_id) - strlen(record))::BIGINT AS first FROM b
)
SELECT page_id, (row_number() OVER (ORDER BY page_id) - 1)::BIGINT AS position, CASE WHEN la.hash IS NOT NULL THEN 1::BIGINT END AS records, la.first AS "offset", la.bytes AS bytes, la.hash AS sha256,
       lb.first AS other_offset, lb.bytes AS other_bytes, CASE WHEN la.hash IS NULL THEN 'extra' WHEN lb.hash IS NULL THEN 'missing' WHEN la.hash <> lb.hash THEN 'corrupt' ELSE 'ok' END AS status
FROM la FULL JOIN lb USING (page_id)
"""
