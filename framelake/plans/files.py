"""Queries over capture files: written by the sink or by hand, read back by the source, with every way a file can end."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flows as W
from ..operators.decode import decode_frames
from ..operators.fragments import NEEDED, attribute, once
from ..schema import READER_STATUSES
from ..sources.pcap import plain_path, read_captures, register
from ..workspace import shared_dir
from .export import flow_text
from .synth import client_name

#: Records of one file of the queries' captures.
BLOCK = 5_000


def folder(spark: SparkSession, name: str, sf_dir: str) -> str:
    """An empty folder of this session's own, the same for the same query and tables, so that nothing piles up."""
    path = plain_path(f"{shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{hashlib.md5(sf_dir.encode()).hexdigest()}")
    shutil.rmtree(path, ignore_errors=True)
    os.makedirs(path)
    return path


def write_captures(records: DataFrame, path: str, **options) -> None:
    """Captures of records in their order, a block of record numbers never divided."""
    blocks = F.expr(f"record_no div {BLOCK}")
    sorted_ = records.repartition(8, blocks).sortWithinPartitions("record_no")
    register(records.sparkSession)
    sorted_.select("ts_ns", "wirelen", "data").write.format("pcap").mode("append").options(**options).save(path)


def variants(frames: DataFrame, sf_dir: str) -> DataFrame:
    """A quarter of the records in each of the four kinds of files, read back as one table, summed up by kind."""
    spark = frames.sparkSession
    root = folder(spark, "variants", sf_dir)
    for k in range(4):
        write_captures(frames.where(F.col("record_no") % 4 == k), f"{root}/v{k}", bigEndian=k > 1, nsec=k % 2 == 1)
    read = spark.read.format("pcap").option("paths", json.dumps([f"{root}/v{k}" for k in range(4)])).option("rangeBytes", 100_000).load()
    kind = F.regexp_extract("file", "/v([0-3])/[^/]*$", 1).cast("int")
    done = decode_frames(read, fields=["status"])
    return done.groupBy(kind.alias("variant")).agg(
        F.count("*").alias("packets"), F.sum("wirelen").alias("wire_bytes"), F.sum(F.col("caplen").cast("long")).alias("captured_bytes"), F.sum("status").alias("statuses"),
        F.min("ts_ns").alias("first_ts_ns"), F.max("ts_ns").alias("last_ts_ns"),
    )


def flows_of_files(frames: DataFrame, sf_dir: str) -> DataFrame:
    """Flows of a capture in several files, walked and read by tasks."""
    spark = frames.sparkSession
    root = folder(spark, "flows", sf_dir)
    write_captures(frames, root)
    packets = once(decode_frames(read_captures(spark, root, range_bytes=200_000), fields=[*NEEDED, *W.FLOW_FIELDS]))
    return flow_text(W.flows(attribute(packets)), client_name)


def ends(nation: DataFrame, sf_dir: str) -> DataFrame:
    """The files table of captures of a small table's names, whole and damaged in every way there is."""
    spark = nation.sparkSession
    root = folder(spark, "ends", sf_dir)
    rows = [(r.n_nationkey, r.n_name.encode()) for r in nation.orderBy("n_nationkey").collect()]

    def capture(order="<", magic=0xA1B2C3D4, version=(2, 4), link=1, snaplen=4096) -> bytes:
        return struct.pack(order + "IHHIIII", magic, *version, 0, 0, snaplen, link) + b"".join(struct.pack(order + "IIII", k, 0, len(x), len(x)) + x for k, x in rows)

    whole = capture()
    files = {
        "a-whole": whole, "b-big": capture(">"), "c-nano": capture(magic=0xA1B23C4D), "d-link-flags": capture(link=0x14000001), "e-short": whole[:23], "f-magic": b"\x55" * 24, "g-other": b"\x0a\x0d\x0d\x0a" + bytes(24),
        "h-version": capture(version=(2, 3)), "i-link": capture(link=101), "j-record-head": whole + bytes(7), "k-record": whole[:-1], "l-length": whole + struct.pack("<IIII", 0, 0, 262_145, 1), "m-header": whole[:24], "n-empty": b"",
        "o, with a comma [1]": whole,
    }
    for name, data in files.items():
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    register(spark)
    table = spark.read.format("pcap").option("table", "files").option("paths", json.dumps([*(f"{root}/{n}" for n in files), f"{root}/z-missing"])).load()
    return table.withColumn("file", F.substring_index("file", "/", -1))


_COLUMNS = "file, big_endian, nsec, version_major, version_minor, snaplen, linktype, records, status, error_text"


def _ends_sql() -> str:
    head = (False, False, 2, 4, 4096, 1)
    none = (False, False, 0, 0, 0, 0)
    rows = {
        "a-whole": (head, 0, "EOF"), "b-big": ((True, *head[1:]), 0, "EOF"), "c-nano": ((False, True, *head[2:]), 0, "EOF"), "d-link-flags": (head, 0, "EOF"), "e-short": (none, None, "SHORT_HEADER"), "f-magic": (none, None, "BAD_MAGIC"),
        "g-other": (none, None, "PCAPNG"), "h-version": ((False, False, 2, 3, 4096, 1), None, "BAD_VERSION"), "i-link": ((False, False, 2, 4, 4096, 101), None, "BAD_LINKTYPE"), "j-record-head": (head, 0, "TRUNC_RECORD_HDR"),
        "k-record": (head, -1, "TRUNC_RECORD"), "l-length": (head, 0, "BAD_CAPLEN"), "m-header": (head, None, "EOF"), "n-empty": (none, None, "SHORT_HEADER"), "o, with a comma [1]": (head, 0, "EOF"), "z-missing": (none, None, "OPEN"),
    }
    text = lambda s: "" if s == "EOF" else READER_STATUSES[s] + (": No such file or directory" if s == "OPEN" else "")
    parts = [f"SELECT '{n}', {h[0]}, {h[1]}, {h[2]}::INT, {h[3]}::INT, {h[4]}::BIGINT, {h[5]}::BIGINT, {'0::BIGINT' if more is None else f'(SELECT count(*) + {more} FROM nation)'}, '{s}', '{text(s)}'" for n, (h, more, s) in rows.items()]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS t({_COLUMNS})"


ENDS_SQL = _ends_sql()
VARIANTS_SQL = "SELECT (e % 4)::INT AS variant, count(*) AS packets, sum(wirelen)::BIGINT AS wire_bytes, sum(caplen)::BIGINT AS captured_bytes, sum(status)::BIGINT AS statuses, min(ts_ns) AS first_ts_ns, max(ts_ns) AS last_ts_ns FROM p GROUP BY ALL"
