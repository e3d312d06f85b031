"""Flows and tunnels: keys, aggregates, rank order, top-N and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import GPDU

KEY = ("ip_version", "proto", "addr_a", "port_a", "addr_b", "port_b")
TUNNEL_KEY = ("teid", "ip_version", "proto", "addr_a", "addr_b")


#: Fields of packets that flows and tunnels look at.
FLOW_FIELDS = ("status", "has_l3", "has_l4", "ip_version", "ip_proto", "src_addr", "dst_addr", "src_port", "dst_port", "tcp_flags")
TUNNEL_FIELDS = ("status", "is_gtpu", "gtp_v1u", "gtp_msg_ok", "gtp_msg_type", "teid", "ip_version", "ip_proto", "src_addr", "dst_addr")


def in_flow() -> Column:
    return (F.col("status") == 0) & F.col("has_l3")


def in_tunnel() -> Column:
    return (F.col("status") == 0) & F.col("is_gtpu") & F.col("gtp_v1u") & F.col("gtp_msg_ok") & (F.col("gtp_msg_type") == GPDU)


def reversed_key() -> Column:
    """Whether the sender is endpoint b: its address, or at equal addresses its port, is the larger one."""
    return (F.col("src_addr") > F.col("dst_addr")) | ((F.col("src_addr") == F.col("dst_addr")) & (F.col("src_port") > F.col("dst_port")))


def with_flow_key(packets: DataFrame) -> DataFrame:
    rev = F.col("reversed")
    pick = lambda a, b: F.when(rev, F.col(b)).otherwise(F.col(a))
    return packets.withColumn("reversed", reversed_key()).withColumns(
        {"proto": F.col("ip_proto"), "addr_a": pick("src_addr", "dst_addr"), "port_a": pick("src_port", "dst_port"), "addr_b": pick("dst_addr", "src_addr"), "port_b": pick("dst_port", "src_port")}
    )


def flows(packets: DataFrame) -> DataFrame:
    """One row per bidirectional flow. The first sender is the one of the earliest packet, ties by file and record.

    ``packets`` needs status, has_l3, addresses, ports, ip_version, ip_proto, tcp_flags, has_l4, wirelen, ts_ns, file
    and record_no; one aggregation, partial before the shuffle, so a very large flow costs one row per task.
    """
    keyed = with_flow_key(packets.where(in_flow()))
    tcp = F.when(F.col("has_l4") & (F.col("ip_proto") == 6), F.col("tcp_flags")).otherwise(0)
    grouped = keyed.groupBy(*KEY).agg(
        F.count("*").alias("packets"), F.sum("wirelen").alias("bytes"), F.min("ts_ns").alias("first_ts_ns"), F.max("ts_ns").alias("last_ts_ns"),
        F.min(F.struct("ts_ns", "file", "record_no", "reversed")).getField("reversed").alias("first_from_b"), F.bit_or(tcp).alias("tcp_flags"),
    )
    return grouped


def tunnels(packets: DataFrame) -> DataFrame:
    """One row per direction of a GTP-U tunnel: sender, receiver and TEID."""
    keyed = packets.where(in_tunnel()).select("teid", "ip_version", F.col("ip_proto").alias("proto"), F.col("src_addr").alias("addr_a"), F.col("dst_addr").alias("addr_b"), "wirelen", "ts_ns")
    return keyed.groupBy(*TUNNEL_KEY).agg(F.count("*").alias("packets"), F.sum("wirelen").alias("bytes"), F.min("ts_ns").alias("first_ts_ns"), F.max("ts_ns").alias("last_ts_ns"))


def distinct_teids(tunnel_rows: DataFrame) -> DataFrame:
    return tunnel_rows.agg(F.count_distinct("teid").alias("teids"))


def rank_order(table: DataFrame) -> list[Column]:
    """Bytes, then packets, downwards; then the first packet's time; then the key, so that the order is total."""
    key = [c for c in ("teid", "ip_version", "proto", "addr_a", "port_a", "addr_b", "port_b") if c in table.columns]
    return [F.desc("bytes"), F.desc("packets"), F.asc("first_ts_ns"), *map(F.asc, key)]


def top(table: DataFrame, n: int) -> DataFrame:
    """The n largest flows or tunnels, in rank order; each task keeps n rows."""
    if n < 0 or n > 1_000_000:
        raise ValueError("n must be from 0 to 1000000")
    return table.orderBy(*rank_order(table)).limit(n)


def ranked(table: DataFrame) -> DataFrame:
    return table.orderBy(*rank_order(table))


def each(table: DataFrame):
    """All rows in rank order, one after the other; the driver holds one part at a time."""
    return ranked(table).toLocalIterator(prefetchPartitions=True)


def find(table: DataFrame, **key) -> DataFrame:
    """The row of one key, if there is one."""
    for name, value in key.items():
        table = table.where(F.col(name) == F.lit(value))
    return table
