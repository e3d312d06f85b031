"""Fixed values of the packet model: status codes and texts, protocol numbers, and the tables' columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Decode status by code: name and text. Codes 1 to 11 mean that the capture stopped early, later ones that the packet is wrong.
STATUSES = (
    ("OK", "ok"),
    ("TRUNC_ETHERNET", "truncated Ethernet header"),
    ("TRUNC_VLAN", "truncated VLAN tag"),
    ("TRUNC_IPV4", "truncated IPv4 header"),
    ("TRUNC_IPV6", "truncated IPv6 header"),
    ("TRUNC_IPV6_EXT", "truncated IPv6 extension header"),
    ("TRUNC_TCP", "truncated TCP header"),
    ("TRUNC_UDP", "truncated UDP header"),
    ("TRUNC_ICMP", "truncated ICMP header"),
    ("TRUNC_GTPU", "truncated GTP-U header"),
    ("TRUNC_GTPU_EXT", "truncated GTP-U extension header"),
    ("TRUNC_GTPU_INNER", "G-PDU truncated before its IP packet"),
    ("BAD_SHORT_FRAME", "frame too short for its headers"),
    ("BAD_VLAN_DEPTH", "more than 2 VLAN tags"),
    ("BAD_IPV4_VERSION", "IPv4 ethertype with wrong IP version"),
    ("BAD_IPV4_IHL", "IPv4 header length < 20"),
    ("BAD_IPV4_TOTAL_LEN", "IPv4 total length invalid"),
    ("BAD_IPV6_VERSION", "IPv6 ethertype with wrong IP version"),
    ("BAD_IPV6_PAYLOAD_LEN", "IPv6 payload length exceeds frame"),
    ("BAD_IPV6_EXT", "IPv6 extension header invalid"),
    ("BAD_L4_LEN", "IP payload too short for L4 header"),
    ("BAD_TCP_DOFF", "TCP data offset invalid"),
    ("BAD_UDP_LEN", "UDP length invalid"),
    ("BAD_GTPU_LEN", "GTP-U length invalid"),
    ("BAD_GTPU_EXT_LEN", "GTP-U extension header length 0"),
    ("BAD_GTPU_EXT", "GTP-U extension header invalid"),
    ("BAD_GTPU_INNER", "G-PDU payload not IPv4 or IPv6"),
    ("BAD_GTPU_INNER_SHORT", "G-PDU payload too short for IP header"),
)
CODE = {name: code for code, (name, _) in enumerate(STATUSES)}
LAST_TRUNCATION = CODE["TRUNC_GTPU_INNER"]

#: How reading a capture ended: name and text.
READER_STATUSES = {
    "OK": "ok",
    "EOF": "end of file",
    "OPEN": "cannot open file",
    "IO": "read error",
    "NOMEM": "out of memory",
    "SHORT_HEADER": "file too short for a pcap global header",
    "BAD_MAGIC": "not a pcap file (unknown magic number)",
    "PCAPNG": "pcapng files are not supported (convert with: editcap -F pcap in.pcapng out.pcap)",
    "BAD_VERSION": "unsupported pcap version (expected 2.4)",
    "BAD_LINKTYPE": "unsupported link type (only Ethernet, linktype 1, is supported)",
    "TRUNC_RECORD_HDR": "truncated file: record header cut short",
    "TRUNC_RECORD": "truncated file: packet data cut short",
    "BAD_CAPLEN": "corrupt record: captured length exceeds 262144 bytes",
}

IPV4, IPV6, VLAN_TAGS = 0x0800, 0x86DD, (0x8100, 0x88A8, 0x9100)
ICMP, TCP, UDP, ICMPV6 = 1, 6, 17, 58
GTPU_PORT = 2152
ECHO_REQUEST, ECHO_RESPONSE, ERROR_INDICATION, END_MARKER, GPDU = 1, 2, 26, 254, 255
NO_FRAGMENT, FIRST, LATER = 0, 1, 2
FRAGMENT_SLOTS = 4096

RECORDS = "file string, record_no bigint, ts_ns bigint, caplen int, wirelen bigint, data binary"
FILES = "file string, big_endian boolean, nsec boolean, version_major int, version_minor int, snaplen bigint, linktype bigint, records bigint, status string, error_text string"
#: What the decoder adds to a record, in order.
DECODED = (
    "status int, has_l2 boolean, has_l3 boolean, has_l4 boolean, ethertype int, vlan_count int, vlan_ids array<int>, ip_version int, ip_proto int, "
    "src_addr binary, dst_addr binary, frag int, frag_id bigint, src_port int, dst_port int, tcp_flags int, icmp_type int, icmp_code int, "
    "is_gtpu boolean, gtp_status int, gtp_v1u boolean, gtp_flags int, gtp_msg_type int, gtp_msg_ok boolean, gtp_seq int, teid bigint, gtp_ext_count int, "
    "has_inner boolean, inner_has_l4 boolean, gtp_nested boolean, inner_version int, inner_proto int, inner_src binary, inner_dst binary, inner_src_port int, inner_dst_port int, frag_slot int"
)


def status_dim(spark: SparkSession) -> DataFrame:
    """code, name, text, is_truncation: 28 rows, always small enough to broadcast."""
    codes = range(len(STATUSES))
    columns = {"code": pa.array(codes, pa.int32()), "name": [n for n, _ in STATUSES], "text": [t for _, t in STATUSES], "is_truncation": [1 <= k <= LAST_TRUNCATION for k in codes]}
    return spark.createDataFrame(pa.table(columns))
