"""Flows and tunnels as text columns and CSV lines, in rank order."""

from __future__ import annotations

import os

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.flows import ranked
from ..schema import TCP

#: The columns of the exports.
FLOW_HEADER = "src_addr,src_port,dst_addr,dst_port,protocol,ip_version,packets,bytes,first_ts,last_ts,duration_s,tcp_flags"
TUNNEL_HEADER = "teid,src_addr,dst_addr,ip_version,packets,bytes,first_ts,last_ts,duration_s"


#: Address text and port to show of one end, from version, address and port.
Name = Callable[[Column, Column, Column], tuple[Column, Column]]


def as_decoded(version: Column, addr: Column, port: Column) -> tuple[Column, Column]:
    return T.address(version, addr), port


def flow_text(flows: DataFrame, name: Name = as_decoded) -> DataFrame:
    """Flows seen from their first sender: src and dst address, port and endpoint, protocol and flag letters."""
    b = F.col("first_from_b")
    pick = lambda x, y: F.when(b, F.col(y)).otherwise(F.col(x))
    (text_a, shown_a), (text_b, shown_b) = (name(F.col("ip_version"), F.col(f"addr_{x}"), F.col(f"port_{x}")) for x in "ab")
    out = flows.withColumns({"text_a": text_a, "text_b": text_b, "shown_a": shown_a, "shown_b": shown_b})
    out = out.withColumns({"src_addr": pick("text_a", "text_b"), "src_port": pick("shown_a", "shown_b"), "dst_addr": pick("text_b", "text_a"), "dst_port": pick("shown_b", "shown_a")})
    v, p = F.col("ip_version"), F.col("proto")
    return out.withColumns({
        "src": T.endpoint(v, p, F.col("src_addr"), F.col("src_port")), "dst": T.endpoint(v, p, F.col("dst_addr"), F.col("dst_port")), "protocol": T.protocol(p),
        "flags": F.when(p == TCP, T.tcp_flags(F.col("tcp_flags"))).otherwise(""), "duration_ns": F.col("last_ts_ns") - F.col("first_ts_ns"),
    }).drop("text_a", "text_b", "shown_a", "shown_b")


def tunnel_text(tunnels: DataFrame) -> DataFrame:
    v = F.col("ip_version")
    return tunnels.withColumns({"src": T.address(v, F.col("addr_a")), "dst": T.address(v, F.col("addr_b")), "teid_text": T.teid_text(F.col("teid")), "duration_ns": F.col("last_ts_ns") - F.col("first_ts_ns")})


def _line(*columns):
    return F.concat_ws(",", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])


def flow_lines(flows: DataFrame, name: Name = as_decoded) -> DataFrame:
    """One column, line; no field can hold a comma or a quote."""
    times = [T.seconds(F.col(c)) for c in ("first_ts_ns", "last_ts_ns", "duration_ns")]
    return flow_text(ranked(flows), name).select(_line("src_addr", "src_port", "dst_addr", "dst_port", "protocol", "ip_version", "packets", "bytes", *times, "flags").alias("line"))


def tunnel_lines(tunnels: DataFrame) -> DataFrame:
    times = [T.seconds(F.col(c)) for c in ("first_ts_ns", "last_ts_ns", "duration_ns")]
    return tunnel_text(ranked(tunnels)).select(_line("teid_text", "src", "dst", "ip_version", "packets", "bytes", *times).alias("line"))


def write_lines(lines: DataFrame, header: str, path: str) -> int:
    """Write ordered lines under a header as one file on the driver's disk; returns how many.

    Lines come to the driver one part after the other, whatever the executors' disks are; the file gets its name once it is whole.
    """
    part = f"{path}.part"
    count = 0
    try:
        with open(part, "w", encoding="utf-8", newline="") as out:
            out.write(header + "\n")
            for row in lines.toLocalIterator(prefetchPartitions=True):
                out.write(row.line + "\n")
                count += 1
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return count
