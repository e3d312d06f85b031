"""Capture-wide counters: one row for all packets, and problems by status."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CODE, ECHO_REQUEST, ECHO_RESPONSE, END_MARKER, ERROR_INDICATION, FIRST, GPDU, GTPU_PORT, ICMP, ICMPV6, IPV4, IPV6, LAST_TRUNCATION, LATER, TCP, UDP, status_dim

#: A broken extension chain leaves the transport protocol unknown.
UNKNOWN_TRANSPORT = (CODE["TRUNC_IPV6_EXT"], CODE["BAD_IPV6_EXT"])


def is_truncation(status: str = "status") -> Column:
    return F.col(status).between(1, LAST_TRUNCATION)


def is_malformed(status: str = "status") -> Column:
    return F.col(status) > LAST_TRUNCATION


def on_gtpu_port() -> Column:
    return F.col("has_l4") & (F.col("ip_proto") == UDP) & ((F.col("src_port") == GTPU_PORT) | (F.col("dst_port") == GTPU_PORT))


def _by_proto(prefix: str, where: Column, proto: str, names: tuple[str, ...]) -> dict[str, Column]:
    known = dict(zip(names, (TCP, UDP, ICMP, ICMPV6), strict=True))
    out = {f"{prefix}{n}": where & (F.col(proto) == k) for n, k in known.items()}
    return out | {f"{prefix}other": where & ~F.col(proto).isin(*known.values())}


def conditions() -> dict[str, Column]:
    """Counter name -> which packets it counts."""
    l3, gtp = F.col("has_l3"), F.col("is_gtpu")
    counted = l3 & ~F.col("status").isin(*UNKNOWN_TRANSPORT)
    out = {
        "ipv4": l3 & (F.col("ip_version") == 4), "ipv6": l3 & (F.col("ip_version") == 6),
        "non_ip": F.col("has_l2") & ~l3 & ~F.col("ethertype").isin(IPV4, IPV6), "vlan_tagged": F.col("vlan_count") > 0,
        **_by_proto("", counted, "ip_proto", ("tcp", "udp", "icmp", "icmpv6")),
        "frag_first": l3 & (F.col("frag") == FIRST), "frag_later": l3 & (F.col("frag") == LATER), "frag_matched": F.col("frag_matched"),
        "truncated": is_truncation(), "malformed": is_malformed(),
        "gtp_fragmented": (F.col("frag") == FIRST) & on_gtpu_port(), "gtp_packets": gtp,
    }
    ok, message = F.col("gtp_msg_ok"), gtp & F.col("gtp_v1u")
    kinds = {"gpdu": GPDU, "echo_request": ECHO_REQUEST, "echo_response": ECHO_RESPONSE, "error_indication": ERROR_INDICATION, "end_marker": END_MARKER}
    out |= {
        "gtp_truncated": gtp & is_truncation("gtp_status"), "gtp_malformed": gtp & is_malformed("gtp_status"),
        "gtp_user_truncated": gtp & ok & is_truncation("gtp_status"), "gtp_user_malformed": gtp & ok & is_malformed("gtp_status"),
        "gtp_not_v1u": gtp & ~F.col("gtp_v1u") & (F.col("gtp_status") == 0),
        **{f"gtp_{n}": message & (F.col("gtp_msg_type") == k) for n, k in kinds.items()},
        "gtp_other_type": message & ~F.col("gtp_msg_type").isin(*kinds.values()),
        "gtp_with_seq": message & (F.col("gtp_flags").bitwiseAND(2) != 0), "gtp_with_ext": message & (F.col("gtp_ext_count") > 0),
        "gtp_inner_ipv4": F.col("has_inner") & (F.col("inner_version") == 4), "gtp_inner_ipv6": F.col("has_inner") & (F.col("inner_version") == 6),
        **_by_proto("gtp_inner_", F.col("has_inner") & ~F.col("gtp_status").isin(*UNKNOWN_TRANSPORT), "inner_proto", ("tcp", "udp", "icmp", "icmpv6")),
        "gtp_nested": F.col("gtp_nested"),
    }
    return out


def _totals() -> dict[str, Column]:
    zero = F.lit(0).cast("long")
    return {
        "packets": F.count("*"), "wire_bytes": F.coalesce(F.sum("wirelen"), zero), "captured_bytes": F.coalesce(F.sum(F.col("caplen").cast("long")), zero),
        "first_ts_ns": F.min("ts_ns"), "last_ts_ns": F.max("ts_ns"),
    }


def fields_of(names: tuple[str, ...], decoded: tuple[str, ...]) -> list[str]:
    """Those of the ``decoded`` fields that the counters of these names look at."""
    wanted = " ".join(repr(c) for n, c in conditions().items() if n in names)
    return [f for f in decoded if re.search(rf"\b{f}\b", wanted)]


def counters(packets: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """One row: packets, bytes, first and last time and every counter (or those named), in one partial and one final aggregation."""
    every = _totals() | {n: F.count_if(c) for n, c in conditions().items()}
    return packets.agg(*[every[n].alias(n) for n in (every if names is None else names)])


def problems(packets: DataFrame, status: str = "status", where: Column | None = None) -> DataFrame:
    """code, text, packets for each status above 0 that occurs, in the order of codes."""
    rows = packets.where(F.col(status) > 0) if where is None else packets.where(where & (F.col(status) > 0))
    counted = rows.groupBy(F.col(status).alias("code")).agg(F.count("*").alias("packets"))
    return counted.join(F.broadcast(status_dim(packets.sparkSession)), "code").select("code", "text", "packets").orderBy("code")
