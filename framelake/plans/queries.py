"""Queries over the driver's tables, and the SQL that must give the same rows.

The SQL never decodes anything: it predicts every packet from the event it was made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import counters as C
from ..operators import flows as W
from ..operators.decode import FIELDS, decode_frames
from ..operators.fragments import NEEDED, attribute, once
from ..schema import STATUSES
from ..sources.pcap import FileInfo, records_of_bytes
from .catalog import catalog_records, predicted
from . import files, report
from .analysis import Analysis
from .export import flow_lines, flow_text, tunnel_lines, tunnel_text
from .synth import captures_of, client_name, host_name, synth_frames, synth_packets


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth_frames(spark.read.parquet(f"{sf_dir}/events.parquet"))


def decoded(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """Packets with just these fields."""
    return decode_frames(frames(spark, sf_dir), fields=list(fields))


def packets(spark: SparkSession, sf_dir: str, *fields: str, lossless: bool = False) -> DataFrame:
    """Packets with just these fields, decoded once, and later fragments with the ports of first ones."""
    return attribute(once(decoded(spark, sf_dir, *NEEDED, *fields)), lossless)


def flow_rows(spark: SparkSession, sf_dir: str, lossless: bool = False) -> DataFrame:
    return W.flows(packets(spark, sf_dir, *W.FLOW_FIELDS, lossless=lossless))


def tunnel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.tunnels(decoded(spark, sf_dir, *W.TUNNEL_FIELDS))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth_packets(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def _counted(*names: str):
    """Some counters; nothing is decoded that none of them looks at."""

    def query(spark, sf_dir):
        fields = C.fields_of(names, tuple(FIELDS))
        if "frag_matched" in names:
            return C.counters(packets(spark, sf_dir, *fields), names)
        return C.counters(decoded(spark, sf_dir, *fields) if fields else frames(spark, sf_dir), names)

    return query


TOTALS = ("packets", "wire_bytes", "captured_bytes", "first_ts_ns", "last_ts_ns")
NETWORK = ("ipv4", "ipv6", "non_ip", "vlan_tagged")
TRANSPORT = ("tcp", "udp", "icmp", "icmpv6", "other", "truncated", "malformed")
FRAGMENTS = ("frag_first", "frag_later", "frag_matched")
GTPU = tuple(f"gtp_{x}" for x in "packets fragmented truncated malformed user_truncated user_malformed not_v1u gpdu echo_request echo_response error_indication end_marker other_type with_seq with_ext nested".split())
INNER = tuple(f"gtp_inner_{x}" for x in "ipv4 ipv6 tcp udp icmp icmpv6 other".split())
FLOW = ("ip_version", "protocol", "src", "dst", "packets", "bytes", "first_ts_ns", "last_ts_ns", "flags")
TUNNEL = ("teid_text", "src", "dst", "packets", "bytes", "first_ts_ns", "last_ts_ns")


def q_flows(spark, sf_dir):
    return flow_text(flow_rows(spark, sf_dir), client_name).select(*FLOW)


def q_top_flows(spark, sf_dir):
    return flow_text(W.top(flow_rows(spark, sf_dir), 10), client_name).select(*FLOW)


def q_first_sender(spark, sf_dir):
    return flow_text(flow_rows(spark, sf_dir), client_name).select("protocol", F.col("src").alias("first_sender"), F.col("dst").alias("first_receiver"), "first_ts_ns")


def q_tcp_flags(spark, sf_dir):
    rows = flow_text(flow_rows(spark, sf_dir).where("proto = 6"))
    return rows.groupBy("flags").agg(F.count("*").alias("flows"), F.sum("packets").alias("packets"))


def _fragment_flows(lossless):
    def query(spark, sf_dir):
        rows = flow_text(flow_rows(spark, sf_dir, lossless).where("proto = 17 AND (port_a = 4500 OR port_b = 4500)"), client_name)
        return rows.select("src", "dst", "packets", "bytes")

    return query


def q_tunnels(spark, sf_dir):
    return tunnel_text(tunnel_rows(spark, sf_dir)).select(*TUNNEL)


def q_top_tunnels(spark, sf_dir):
    return tunnel_text(W.top(tunnel_rows(spark, sf_dir), 10)).select(*TUNNEL)


def q_distinct_teids(spark, sf_dir):
    return W.distinct_teids(tunnel_rows(spark, sf_dir))


def q_vlan_ids(spark, sf_dir):
    rows = decoded(spark, sf_dir, "vlan_count", "vlan_ids").where("vlan_count > 0").select(F.explode("vlan_ids").alias("vlan_id"), "wirelen")
    return rows.groupBy("vlan_id").agg(F.count("*").alias("packets"), F.sum("wirelen").alias("bytes"))


def q_icmp_types(spark, sf_dir):
    rows = decoded(spark, sf_dir, "has_l4", "ip_proto", "icmp_type", "icmp_code").where("has_l4 AND ip_proto = 1")
    return rows.groupBy("icmp_type", "icmp_code").agg(F.count("*").alias("packets"))


def q_span(spark, sf_dir):
    c = C.counters(frames(spark, sf_dir), TOTALS)
    span = F.col("last_ts_ns") - F.col("first_ts_ns")
    return c.select(T.seconds(F.col("first_ts_ns")).alias("first_ts"), T.seconds(F.col("last_ts_ns")).alias("last_ts"), T.seconds(span, 6).alias("duration"))


def q_flow_csv(spark, sf_dir):
    return flow_lines(flow_rows(spark, sf_dir), client_name)


def q_tunnel_csv(spark, sf_dir):
    return tunnel_lines(tunnel_rows(spark, sf_dir))


def q_flows_large(spark, sf_dir):
    f = W.flows(volume(spark, sf_dir))
    return f.select("proto", host_name(F.col("addr_a")).alias("addr_a"), "port_a", host_name(F.col("addr_b")).alias("addr_b"), "port_b", "packets", "bytes", "first_ts_ns", "last_ts_ns")


def q_top_flows_large(spark, sf_dir):
    f = W.top(W.flows(volume(spark, sf_dir)), 100)
    return f.select("proto", host_name(F.col("addr_a")).alias("addr_a"), host_name(F.col("addr_b")).alias("addr_b"), "packets", "bytes")


def q_host_proto(spark, sf_dir):
    p = volume(spark, sf_dir)
    return p.groupBy("src_addr", T.protocol(F.col("ip_proto")).alias("protocol")).agg(F.count("*").alias("packets"), F.sum("wirelen").alias("bytes")).select(host_name(F.col("src_addr")).alias("host"), "protocol", "packets", "bytes")


def q_roundtrip(spark, sf_dir):
    back = records_of_bytes(captures_of(frames(spark, sf_dir)))
    done = decode_frames(back, fields=["status"])
    return done.groupBy("status").agg(F.count("*").alias("packets"), F.sum("wirelen").alias("wire_bytes"), F.sum(F.col("caplen").cast("long")).alias("captured_bytes"), F.min("ts_ns").alias("first_ts_ns"), F.max("ts_ns").alias("last_ts_ns"))


ALL_COUNTERS = (*NETWORK, *TRANSPORT, *FRAGMENTS, *GTPU, *INNER)


def catalog(spark, sf_dir, *fields: str) -> DataFrame:
    return decode_frames(catalog_records(spark.read.parquet(f"{sf_dir}/events.parquet")), fields=list(fields) or None)


def q_catalog_counters(spark, sf_dir):
    return C.counters(attribute(once(catalog(spark, sf_dir, *NEEDED, *C.fields_of(ALL_COUNTERS, tuple(FIELDS))))), (*TOTALS, *ALL_COUNTERS))


def q_catalog_problems(spark, sf_dir):
    rows = catalog(spark, sf_dir, "status", "gtp_status", "is_gtpu")
    outer = C.problems(rows).select(F.lit("frame").alias("layer"), "code", "text", "packets")
    return outer.unionByName(C.problems(rows, "gtp_status", F.col("is_gtpu")).select(F.lit("tunnel").alias("layer"), "code", "text", "packets"))


def _catalog_flows(lossless):
    def query(spark, sf_dir):
        rows = W.flows(attribute(once(catalog(spark, sf_dir, *NEEDED, *W.FLOW_FIELDS)), lossless))
        return flow_text(rows).select("ip_version", F.col("proto").alias("ip_proto"), "src", "dst", "packets", "bytes", "first_ts_ns", "last_ts_ns")

    return query


def q_catalog_tunnels(spark, sf_dir):
    return tunnel_text(W.tunnels(catalog(spark, sf_dir, *W.TUNNEL_FIELDS))).select(*TUNNEL)


def q_capture_ends(spark, sf_dir):
    return files.ends(spark.read.parquet(f"{sf_dir}/nation.parquet"), sf_dir)


def q_flow_lookup(spark, sf_dir):
    """One flow by its key, and no row for a key that there isn't."""
    rows = flow_rows(spark, sf_dir)
    key = rows.where("proto = 17").orderBy(*W.rank_order(rows)).select(*W.KEY).first().asDict()
    return flow_text(W.find(rows, **key).unionByName(W.find(rows, **(key | {"port_a": 1}))), client_name).select(*FLOW)


#: The header that the synthetic capture would have in a file.
SYNTH = FileInfo("synth.pcap", nsec=True, version_major=2, version_minor=4, snaplen=65_535, linktype=1, status="EOF")


def _report_lines(section: str):
    def query(spark, sf_dir):
        analysis = Analysis.of_records(frames(spark, sf_dir))
        lines = report.sections(analysis, SYNTH, 10, client_name)[section].removesuffix("\n").split("\n")
        analysis.free()
        return spark.createDataFrame([(k, line) for k, line in enumerate(lines, 1)], "line_no int, line string")

    return query


QUERIES = {
    "q01_capture_totals": _counted(*TOTALS),
    "q02_network_mix": _counted(*NETWORK),
    "q03_transport_mix": _counted(*TRANSPORT),
    "q04_problems_by_status": lambda s, d: C.problems(decoded(s, d, "status")),
    "q05_fragment_counts": _counted(*FRAGMENTS),
    "q06_flows": q_flows,
    "q07_top_flows": q_top_flows,
    "q08_flow_first_sender": q_first_sender,
    "q09_flow_tcp_flags": q_tcp_flags,
    "q10_fragment_attribution_flows": _fragment_flows(False),
    "q11_gtpu_counters": _counted(*GTPU),
    "q12_gtpu_inner_mix": _counted(*INNER),
    "q13_tunnels": q_tunnels,
    "q14_top_tunnels": q_top_tunnels,
    "q15_distinct_teids": q_distinct_teids,
    "q16_vlan_ids": q_vlan_ids,
    "q17_icmp_types": q_icmp_types,
    "q18_capture_span": q_span,
    "q19_flow_csv_lines": q_flow_csv,
    "q20_tunnel_csv_lines": q_tunnel_csv,
    "q21_flows_large": q_flows_large,
    "q22_top_flows_large": q_top_flows_large,
    "q23_host_proto_counts": q_host_proto,
    "q24_pcap_roundtrip": q_roundtrip,
    "q25_lossless_fragments": _fragment_flows(True),
    "q26_catalog_counters": q_catalog_counters,
    "q27_catalog_problems": q_catalog_problems,
    "q28_catalog_flows": _catalog_flows(False),
    "q29_catalog_flows_lossless": _catalog_flows(True),
    "q30_catalog_tunnels": q_catalog_tunnels,
    "q31_capture_variants": lambda s, d: files.variants(frames(s, d), d),
    "q32_capture_ends": q_capture_ends,
    "q33_capture_flows": lambda s, d: files.flows_of_files(frames(s, d), d).select(*FLOW),
    "q34_report_summary": _report_lines("summary"),
    "q35_report_flows": _report_lines("flows"),
    "q36_report_gtpu": _report_lines("gtpu"),
    "q37_report_tunnels": _report_lines("tunnels"),
    "q38_flow_lookup": q_flow_lookup,
}

#: One row per frame: what the decoder must find.
PREDICTED = """
WITH ev AS (
  SELECT event_id AS e, user_id AS u, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id // 20 AS q, event_id % 20 AS c, epoch_us(ts) * 1000 AS ts_ns FROM events
), j AS (
  SELECT ev.*, coalesce(b.u, ev.u) AS au, coalesce(b.k, ev.k) AS ak, (CASE WHEN ev.c = 18 THEN ev.e - 1 ELSE ev.e END) % 2 = 0 AS up
  FROM ev LEFT JOIN ev b ON ev.c = 18 AND b.e = ev.e - 1
), a AS (
  SELECT *,
    CASE WHEN c IN (15, 16) THEN '172.16.1.' || (u % 4 + 11) WHEN c = 12 THEN '2001:db8::' || format('{:x}', au + 1) ELSE '10.0.' || (au // 256) || '.' || (au % 256) END AS near,
    CASE WHEN c IN (15, 16) THEN '172.16.0.1' WHEN c = 12 THEN '2001:db8:ff::' || format('{:x}', ak + 1) ELSE '198.51.100.' || (ak + 1) END AS far,
    CASE WHEN c <= 6 OR c IN (12, 19) THEN 443 WHEN c <= 10 THEN 53 WHEN c = 11 THEN 0 WHEN c = 13 THEN 5004 WHEN c IN (15, 16) THEN 2152 ELSE 4500 END AS fport,
    CASE WHEN c = 11 THEN 0 WHEN c IN (15, 16) THEN 2152 ELSE 32768 + au END AS nport,
    CASE WHEN c <= 6 THEN 54 + k WHEN c <= 11 THEN 42 + k WHEN c = 12 THEN 74 + k WHEN c = 13 THEN 46 + k WHEN c = 14 THEN 60 WHEN c = 15 THEN 90 + k
         WHEN c = 16 THEN CASE WHEN q % 4 = 3 THEN 50 ELSE 54 END WHEN c = 17 THEN 42 + k WHEN c = 18 THEN 34 + k WHEN q % 6 = 3 THEN 42 + k ELSE 54 + k END AS wirelen,
    CASE WHEN c <> 19 THEN 0 ELSE [15, 16, 21, 22, 6, 1][q % 6 + 1] END AS status,
    CASE WHEN c <= 6 OR c = 12 THEN 6 WHEN c = 11 THEN 1 WHEN c = 14 THEN 0 WHEN c = 19 THEN CASE WHEN q % 6 = 3 THEN 17 WHEN q % 6 IN (2, 4) THEN 6 ELSE 0 END ELSE 17 END AS proto,
    CASE WHEN c = 12 THEN 6 WHEN c = 14 OR (c = 19 AND q % 6 IN (0, 1, 5)) THEN 0 ELSE 4 END AS version,
    CASE WHEN c <= 6 THEN [2, 16, 24, 17][q % 4 + 1] WHEN c = 12 THEN 16 ELSE 0 END AS flags,
    u * 2 + CASE WHEN e % 2 = 0 THEN 1 ELSE 2 END AS teid
  FROM j
), p AS (
  SELECT *, CASE WHEN c = 19 AND q % 6 = 4 THEN 44 WHEN c = 19 AND q % 6 = 5 THEN 10 ELSE wirelen END AS caplen,
    CASE WHEN up THEN near ELSE far END AS sa, CASE WHEN up THEN far ELSE near END AS da, CASE WHEN up THEN nport ELSE fport END AS sp, CASE WHEN up THEN fport ELSE nport END AS dp,
    [CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' END][1] AS protocol
  FROM a
), s AS (
  SELECT *, CASE WHEN proto NOT IN (6, 17) THEN sa WHEN version = 6 THEN '[' || sa || ']:' || sp ELSE sa || ':' || sp END AS src,
    CASE WHEN proto NOT IN (6, 17) THEN da WHEN version = 6 THEN '[' || da || ']:' || dp ELSE da || ':' || dp END AS dst FROM p
), f AS (
  SELECT version AS ip_version, protocol, proto, arg_min(src, e) AS src, arg_min(dst, e) AS dst, arg_min(sa, e) AS sa, arg_min(da, e) AS da, arg_min(sp, e) AS sp, arg_min(dp, e) AS dp,
    count(*) AS packets, sum(wirelen)::BIGINT AS bytes, min(ts_ns) AS first_ts_ns, max(ts_ns) AS last_ts_ns, bit_or(flags) AS bits
  FROM s WHERE status = 0 AND version > 0 GROUP BY version, protocol, proto, least(src, dst), greatest(src, dst)
), ft AS (
  SELECT *, CASE WHEN proto <> 6 THEN '' ELSE concat(CASE WHEN bits & 1 > 0 THEN 'F' ELSE '' END, CASE WHEN bits & 2 > 0 THEN 'S' ELSE '' END, CASE WHEN bits & 8 > 0 THEN 'P' ELSE '' END, CASE WHEN bits & 16 > 0 THEN 'A' ELSE '' END) END AS flags FROM f
), t AS (
  SELECT teid, '0x' || format('{:08x}', teid) AS teid_text, sa AS src, da AS dst, count(*) AS packets, sum(wirelen)::BIGINT AS bytes, min(ts_ns) AS first_ts_ns, max(ts_ns) AS last_ts_ns
  FROM p WHERE c = 15 GROUP BY teid, sa, da
)
"""
_SEC = lambda x: f"(({x}) // 1000000000) || '.' || lpad((({x}) % 1000000000)::VARCHAR, 9, '0')"
_FLOW_SQL = "ip_version, protocol, src, dst, packets, bytes, first_ts_ns, last_ts_ns, flags"
_TUNNEL_SQL = "teid_text, src, dst, packets, bytes, first_ts_ns, last_ts_ns"
_RANK = "ORDER BY bytes DESC, packets DESC, first_ts_ns"
_STATUS_TEXT = {1: "truncated Ethernet header", 6: "truncated TCP header", 15: "IPv4 header length < 20", 16: "IPv4 total length invalid", 21: "TCP data offset invalid", 22: "UDP length invalid"}
_FRAGMENT_SQL = PREDICTED + "SELECT src, dst, packets, bytes FROM f WHERE proto = 17 AND (sp = 4500 OR dp = 4500)"
_VOLUME = """
WITH v AS (
  SELECT CASE WHEN l_returnflag = 'N' THEN 6 ELSE 17 END AS proto, l_suppkey AS s, l_partkey AS p, '10.1.' || (l_suppkey // 256) || '.' || (l_suppkey % 256) AS addr_a, '10.2.' || (l_partkey // 256) || '.' || (l_partkey % 256) AS addr_b,
    1024 + l_suppkey AS port_a, 443 AS port_b, 60 + CAST(trunc(l_quantity) AS BIGINT) AS wirelen, (epoch_us(l_shipdate) + l_orderkey) * 1000 AS ts_ns, l_linenumber % 2 = 1 AS swap FROM lineitem
)
"""


def _sums(*conditions: str) -> str:
    return PREDICTED + "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in (x.split("=", 1) for x in conditions)) + " FROM p"


ORACLE = {
    "q01_capture_totals": PREDICTED + "SELECT count(*) AS packets, sum(wirelen)::BIGINT AS wire_bytes, sum(caplen)::BIGINT AS captured_bytes, min(ts_ns) AS first_ts_ns, max(ts_ns) AS last_ts_ns FROM p",
    "q02_network_mix": _sums("ipv4=version = 4", "ipv6=version = 6", "non_ip=c = 14", "vlan_tagged=c = 13"),
    "q03_transport_mix": _sums("tcp=proto = 6", "udp=proto = 17", "icmp=proto = 1", "icmpv6=false", "other=false", "truncated=status BETWEEN 1 AND 11", "malformed=status > 11"),
    "q04_problems_by_status": PREDICTED + "SELECT status::INT AS code, CASE status " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _STATUS_TEXT.items()) + " END AS text, count(*) AS packets FROM p WHERE status > 0 GROUP BY status",
    "q05_fragment_counts": _sums("frag_first=c = 17", "frag_later=c = 18", "frag_matched=c = 18"),
    "q06_flows": PREDICTED + f"SELECT {_FLOW_SQL} FROM ft",
    "q07_top_flows": PREDICTED + f"SELECT {_FLOW_SQL} FROM ft {_RANK} LIMIT 10",
    "q08_flow_first_sender": PREDICTED + "SELECT protocol, src AS first_sender, dst AS first_receiver, first_ts_ns FROM f",
    "q09_flow_tcp_flags": PREDICTED + "SELECT flags, count(*) AS flows, sum(packets)::BIGINT AS packets FROM ft WHERE proto = 6 GROUP BY flags",
    "q10_fragment_attribution_flows": _FRAGMENT_SQL,
    "q11_gtpu_counters": _sums(
        "gtp_packets=c IN (15, 16)", "gtp_fragmented=false", "gtp_truncated=false", "gtp_malformed=false", "gtp_user_truncated=false", "gtp_user_malformed=false", "gtp_not_v1u=false", "gtp_gpdu=c = 15",
        "gtp_echo_request=c = 16 AND q % 4 = 0", "gtp_echo_response=c = 16 AND q % 4 = 1", "gtp_error_indication=c = 16 AND q % 4 = 2", "gtp_end_marker=c = 16 AND q % 4 = 3", "gtp_other_type=false",
        "gtp_with_seq=c = 16 AND q % 4 < 3", "gtp_with_ext=false", "gtp_nested=false",
    ),
    "q12_gtpu_inner_mix": _sums("gtp_inner_ipv4=c = 15", "gtp_inner_ipv6=false", "gtp_inner_tcp=c = 15", "gtp_inner_udp=false", "gtp_inner_icmp=false", "gtp_inner_icmpv6=false", "gtp_inner_other=false"),
    "q13_tunnels": PREDICTED + f"SELECT {_TUNNEL_SQL} FROM t",
    "q14_top_tunnels": PREDICTED + f"SELECT {_TUNNEL_SQL} FROM t {_RANK} LIMIT 10",
    "q15_distinct_teids": PREDICTED + "SELECT count(DISTINCT teid) AS teids FROM t",
    "q16_vlan_ids": PREDICTED + "SELECT (100 + u % 3)::INT AS vlan_id, count(*) AS packets, sum(wirelen)::BIGINT AS bytes FROM p WHERE c = 13 GROUP BY 1",
    "q17_icmp_types": PREDICTED + "SELECT CASE WHEN up THEN 8 ELSE 0 END AS icmp_type, 0 AS icmp_code, count(*) AS packets FROM p WHERE c = 11 GROUP BY 1",
    "q18_capture_span": PREDICTED + f"SELECT {_SEC('min(ts_ns)')} AS first_ts, {_SEC('max(ts_ns)')} AS last_ts, ((max(ts_ns) - min(ts_ns)) // 1000000000) || '.' || lpad(((max(ts_ns) - min(ts_ns)) % 1000000000 // 1000)::VARCHAR, 6, '0') AS duration FROM p",
    "q19_flow_csv_lines": PREDICTED + f"SELECT concat_ws(',', sa, sp, da, dp, protocol, ip_version, packets, bytes, {_SEC('first_ts_ns')}, {_SEC('last_ts_ns')}, {_SEC('last_ts_ns - first_ts_ns')}, flags) AS line FROM ft {_RANK}",
    "q20_tunnel_csv_lines": PREDICTED + f"SELECT concat_ws(',', teid_text, src, dst, 4, packets, bytes, {_SEC('first_ts_ns')}, {_SEC('last_ts_ns')}, {_SEC('last_ts_ns - first_ts_ns')}) AS line FROM t {_RANK}",
    "q21_flows_large": _VOLUME + "SELECT proto, addr_a, port_a::INT AS port_a, addr_b, port_b, count(*) AS packets, sum(wirelen)::BIGINT AS bytes, min(ts_ns) AS first_ts_ns, max(ts_ns) AS last_ts_ns FROM v GROUP BY proto, addr_a, port_a, addr_b, port_b",
    "q22_top_flows_large": _VOLUME + "SELECT proto, addr_a, addr_b, count(*) AS packets, sum(wirelen)::BIGINT AS bytes FROM v GROUP BY proto, s, p, addr_a, addr_b ORDER BY bytes DESC, packets DESC, min(ts_ns), proto, s, p LIMIT 100",
    "q23_host_proto_counts": _VOLUME + "SELECT CASE WHEN swap THEN addr_b ELSE addr_a END AS host, CASE proto WHEN 6 THEN 'TCP' ELSE 'UDP' END AS protocol, count(*) AS packets, sum(wirelen)::BIGINT AS bytes FROM v GROUP BY 1, 2",
    "q24_pcap_roundtrip": PREDICTED + "SELECT status::INT AS status, count(*) AS packets, sum(wirelen)::BIGINT AS wire_bytes, sum(caplen)::BIGINT AS captured_bytes, min(ts_ns) AS first_ts_ns, max(ts_ns) AS last_ts_ns FROM p GROUP BY status",
    "q25_lossless_fragments": _FRAGMENT_SQL,
}

_CATALOG = predicted()
_KINDS = {"gpdu": 255, "echo_request": 1, "echo_response": 2, "error_indication": 26, "end_marker": 254}
_CATALOG_COUNTERS = {
    "ipv4": "version = 4", "ipv6": "version = 6", "non_ip": "non_ip", "vlan_tagged": "vlans > 0",
    "tcp": "proto = 6", "udp": "proto = 17", "icmp": "proto = 1", "icmpv6": "proto = 58", "other": "proto NOT IN (0, 1, 6, 17, 58)", "truncated": "status BETWEEN 1 AND 11", "malformed": "status > 11",
    "frag_first": "frag = 1", "frag_later": "frag = 2", "frag_matched": "found",
    "gtp_packets": "gtpu", "gtp_fragmented": "frag = 1 AND src LIKE '%:2152'", "gtp_truncated": "gtpu AND gtp BETWEEN 1 AND 11", "gtp_malformed": "gtpu AND gtp > 11",
    "gtp_user_truncated": "whole AND gtp BETWEEN 1 AND 11", "gtp_user_malformed": "whole AND gtp > 11", "gtp_not_v1u": "gtpu AND NOT v1u AND gtp = 0", **{f"gtp_{n}": f"v1u AND kind = {k}" for n, k in _KINDS.items()},
    "gtp_other_type": f"v1u AND kind NOT IN ({', '.join(map(str, _KINDS.values()))})", "gtp_with_seq": "v1u AND seq", "gtp_with_ext": "ext", "gtp_nested": "nested",
    "gtp_inner_ipv4": "iv = 4", "gtp_inner_ipv6": "iv = 6", "gtp_inner_tcp": "ip = 6", "gtp_inner_udp": "ip = 17", "gtp_inner_icmp": "ip = 1", "gtp_inner_icmpv6": "ip = 58", "gtp_inner_other": "ip NOT IN (0, 1, 6, 17, 58)",
}


def _catalog_problem_sql(layer: str, column: str) -> str:
    names = " ".join(f"WHEN {k} THEN '{text}'" for k, (_, text) in enumerate(STATUSES))
    return f"SELECT '{layer}' AS layer, {column}::INT AS code, CASE {column} {names} END AS text, count(*) AS packets FROM p WHERE {column} > 0 GROUP BY {column}"


def _catalog_flow_sql(found: str) -> str:
    ends = f"CASE WHEN {found} THEN fsrc ELSE src END AS s, CASE WHEN {found} THEN fdst ELSE dst END AS d"
    return _CATALOG + f", m AS (SELECT *, {ends} FROM p WHERE status = 0 AND version > 0) SELECT version::INT AS ip_version, proto::INT AS ip_proto, s AS src, d AS dst, count(*) AS packets, sum(wirelen)::BIGINT AS bytes, min(ts_ns) AS first_ts_ns, max(ts_ns) AS last_ts_ns FROM m GROUP BY ALL"


ORACLE |= {
    "q26_catalog_counters": _CATALOG + "SELECT count(*) AS packets, sum(wirelen)::BIGINT AS wire_bytes, sum(caplen)::BIGINT AS captured_bytes, min(ts_ns) AS first_ts_ns, max(ts_ns) AS last_ts_ns, "
    + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _CATALOG_COUNTERS.items()) + " FROM p",
    "q27_catalog_problems": _CATALOG + _catalog_problem_sql("frame", "status") + " UNION ALL " + _catalog_problem_sql("tunnel", "gtp"),
    "q28_catalog_flows": _catalog_flow_sql("found"),
    "q29_catalog_flows_lossless": _catalog_flow_sql("found_all"),
    "q30_catalog_tunnels": _CATALOG + "SELECT '0x' || format('{:08x}', teid) AS teid_text, split_part(src, ':', 1) AS src, split_part(dst, ':', 1) AS dst, count(*) AS packets, sum(wirelen)::BIGINT AS bytes, min(ts_ns) AS first_ts_ns, max(ts_ns) AS last_ts_ns FROM p WHERE v1u AND whole AND kind = 255 GROUP BY ALL",
}


def _count(condition: str) -> str:
    return f"(SELECT count(*) FROM p WHERE {condition})"


def _share(condition: str) -> str:
    return f"{_count(condition)} || ' (' || format('{{:.1f}}', 100.0 * {_count(condition)} / {_count('true')}) || '%)'"


def _cell(kind: str, value: str) -> str:
    """A right-aligned number, a left-aligned text, one as wide as its widest (of w), or a value as it is."""
    if kind.startswith(">"):
        return f"format('{{:{kind}}}', {value}::VARCHAR)"
    return f"rpad({value}, {kind if kind.isdigit() else f'w.{kind}::INT'}, ' ')" if kind else value


def _table_sql(title: str, columns: list[tuple[str, str, str]], source: str) -> str:
    """Lines of a ranked table of ``source``: a blank, the title, the names and ten rows; a column is (name, kind of cell, value)."""
    line = lambda values: " || '  ' || ".join(_cell(kind, value) for (_, kind, _), value in zip(columns, values, strict=True))
    widths = ", ".join(f"greatest(3, max(length({c}))) AS {c}" for c in ("src", "dst"))
    return (
        f", r AS (SELECT *, row_number() OVER ({_RANK}) AS n FROM {source} {_RANK} LIMIT 10), w AS (SELECT {widths} FROM r) "
        f"SELECT 1 AS line_no, '' AS line UNION ALL SELECT 2, {title} UNION ALL SELECT 3, {line([repr(name) for name, _, _ in columns])} FROM w "
        f"UNION ALL SELECT (3 + n)::INT, {line([value for _, _, value in columns])} FROM r, w"
    )


_MILLIS = "((r.last_ts_ns - r.first_ts_ns) // 1000000000) || '.' || lpad(((r.last_ts_ns - r.first_ts_ns) % 1000000000 // 1000000)::VARCHAR, 3, '0') || ' s'"
_SIZES = [("packets", ">8", "r.packets"), ("bytes", ">10", "r.bytes"), ("duration", ">12", _MILLIS)]
_UTC = lambda x: f"strftime(make_timestamp(({x}) // 1000), '%Y-%m-%d %H:%M:%S.%f') || ' UTC'"
_SUMMARY = [
    "'File:        synth.pcap'", "'Format:      pcap 2.4, little-endian, nanosecond timestamps, snaplen 65535, Ethernet'", f"'Packets:     ' || {_count('true')}",
    "'Bytes:       ' || (SELECT sum(wirelen)::BIGINT FROM p) || ' on the wire, ' || (SELECT sum(caplen)::BIGINT FROM p) || ' captured'",
    f"'First:       ' || (SELECT {_UTC('min(ts_ns)')} FROM p)", f"'Last:        ' || (SELECT {_UTC('max(ts_ns)')} FROM p)",
    "(SELECT 'Duration:    ' || ((max(ts_ns) - min(ts_ns)) // 1000000000) || '.' || lpad(((max(ts_ns) - min(ts_ns)) % 1000000000 // 1000)::VARCHAR, 6, '0') || ' s (' || format('{:.1f}', count(*) / ((max(ts_ns) - min(ts_ns)) / 1e9))"
    " || ' packets/s, ' || format('{:.3f}', sum(wirelen) * 8.0::DOUBLE / ((max(ts_ns) - min(ts_ns)) / 1e9) / 1e6) || ' Mbit/s)' FROM p)",
    "''", f"'Network:     IPv4 ' || {_share('version = 4')} || ', IPv6 ' || {_share('version = 6')} || ', non-IP ' || {_share('c = 14')}",
    f"'Transport:   TCP ' || {_count('proto = 6')} || ', UDP ' || {_count('proto = 17')} || ', ICMP ' || {_count('proto = 1')} || ', ICMPv6 0, other 0'", f"'VLAN:        ' || {_count('c = 13')} || ' tagged frames'",
    f"'Fragments:   ' || {_count('c = 17')} || ' first, ' || {_count('c = 18')} || ' non-first (' || {_count('c = 18')} || ' matched to their first fragment''s ports)'", "'Flows:       ' || (SELECT count(*) FROM f)",
    f"'Problems:    ' || {_count('status BETWEEN 1 AND 11')} || ' truncated, ' || {_count('status > 11')} || ' malformed (excluded from flows)'",
]
_GTPU = [
    "''", f"'GTP-U:       ' || {_count('c IN (15, 16)')} || ' packets on UDP port 2152'",
    "'  Messages:  G-PDU ' || " + _count("c = 15") + "".join(f" || ', {n} ' || {_count(f'c = 16 AND q % 4 = {k}')}" for k, n in enumerate(("echo request", "echo response", "error indication", "end marker"))) + " || ', other 0'",
    f"'  Options:   sequence number in ' || {_count('c = 16 AND q % 4 < 3')} || ', extension headers in 0'",
    f"'  Inner IP:  IPv4 ' || {_count('c = 15')} || ', IPv6 0; TCP ' || {_count('c = 15')} || ', UDP 0, ICMP 0, ICMPv6 0, other 0'", "'  Tunnels:   ' || (SELECT count(*) FROM t) || ' (' || (SELECT count(DISTINCT teid) FROM t) || ' distinct TEIDs)'",
    "'  Skipped:   0 GTP'' or other version, 0 GTP-U in GTP-U, 0 fragmented datagrams on port 2152'", "'  Problems:  0 truncated, 0 malformed in GTP-U headers (not added to tunnels)'", "'             0 truncated, 0 malformed in user packets (still added to tunnels)'",
]
_lines = lambda parts: " UNION ALL ".join(f"SELECT {k} AS line_no, {x} AS line" for k, x in enumerate(parts, 1))
ORACLE |= {
    "q31_capture_variants": PREDICTED + files.VARIANTS_SQL,
    "q32_capture_ends": files.ENDS_SQL,
    "q33_capture_flows": ORACLE["q06_flows"],
    "q34_report_summary": PREDICTED + _lines(_SUMMARY) + f" UNION ALL SELECT ({len(_SUMMARY)} + row_number() OVER (ORDER BY status))::INT, '  ' || rpad(CASE status " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _STATUS_TEXT.items()) + " END, 40, ' ') || ' ' || count(*) FROM p WHERE status > 0 GROUP BY status",
    "q35_report_flows": PREDICTED + _table_sql(
        "'Top 10 of ' || (SELECT count(*) FROM f) || ' flows by bytes (src = sender of the first packet seen):'",
        [("#", ">3", "r.n"), ("proto", "6", "r.protocol"), ("src", "src", "r.src"), ("dst", "dst", "r.dst"), *_SIZES, ("tcp flags", "", "CASE WHEN r.proto = 6 THEN r.flags ELSE '-' END")], "ft"),
    "q38_flow_lookup": PREDICTED + f"SELECT {_FLOW_SQL} FROM ft WHERE proto = 17 {_RANK} LIMIT 1",
    "q36_report_gtpu": PREDICTED + _lines(_GTPU),
    "q37_report_tunnels": PREDICTED + _table_sql(
        "'Top 10 of ' || (SELECT count(*) FROM t) || ' GTP-U tunnels by bytes (one direction each; the receiver chose the TEID):'",
        [("#", ">3", "r.n"), ("teid", "10", "r.teid_text"), ("src", "src", "r.src"), ("dst", "dst", "r.dst"), *_SIZES], "t"),
}
