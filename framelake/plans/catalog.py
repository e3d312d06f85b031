"""One frame for every way a frame can go: built byte by byte here, with what must be found in it stated beside it.

A record of the catalog capture is entry ``event_id % len(ENTRIES)``, so SQL can say what a whole capture must hold
without decoding anything.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import cache
from ipaddress import ip_address

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decode import Packet, fragment_slot
from ..schema import CODE, FIRST

HERE4, THERE4, HERE6, THERE6 = "10.7.0.1", "10.7.0.2", "2001:db8:7::1", "2001:db8:7::2"
RAN, CORE, USER4, SITE4 = "172.20.0.9", "172.20.0.1", "100.70.0.3", "203.0.113.5"


def address(text: str) -> bytes:
    return ip_address(text).packed


def ether(kind: int, rest: bytes) -> bytes:
    return bytes.fromhex("0200000000aa0200000000bb") + struct.pack(">H", kind) + rest


def tag(number: int, kind: int, rest: bytes) -> bytes:
    return struct.pack(">HH", number, kind) + rest


def ip4(proto: int, rest: bytes, src=HERE4, dst=THERE4, first=0x45, total=None, ident=0, word=0) -> bytes:
    size = 20 + len(rest) if total is None else total
    return struct.pack(">BBHHHBBH", first, 0, size, ident, word, 64, proto, 0) + address(src) + address(dst) + rest


def ip6(kind: int, rest: bytes, src=HERE6, dst=THERE6, first=0x60, size=None) -> bytes:
    return struct.pack(">BBHHBB", first, 0, 0, len(rest) if size is None else size, kind, 64) + address(src) + address(dst) + rest


def tcp(sport: int, dport: int, rest: bytes = b"", words=5) -> bytes:
    return struct.pack(">HHIIBBHHH", sport, dport, 1, 1, words << 4, 0x10, 1024, 0, 0) + rest


def udp(sport: int, dport: int, rest: bytes = b"", size=None) -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(rest) if size is None else size, 0) + rest


def echo(kind: int) -> bytes:
    return struct.pack(">BBHHH", kind, 0, 0, 7, 1)


def piece6(kind: int, ident: int, word: int, rest: bytes) -> bytes:
    """A fragment header; ``word`` is offset * 8 + more."""
    return struct.pack(">BBHI", kind, 0, word, ident) + rest


def message(kind: int, teid: int, rest: bytes, flags=0x30, size=None) -> bytes:
    return struct.pack(">BBHI", flags, kind, len(rest) if size is None else size, teid) + rest


@dataclass(frozen=True)
class Entry:
    """A frame, how much of it was captured, and what is in it: proto and inner_proto are 0 where no transport is counted."""

    name: str
    frame: bytes
    status: str = "OK"
    version: int = 0
    proto: int = 0
    src: str = ""
    dst: str = ""
    captured: int = -1
    wire: int = -1
    vlans: int = 0
    non_ip: bool = False
    frag: int = 0
    #: whether a later fragment finds its first one: in a table of slots, and without loss
    found: tuple[bool, bool] = (False, False)
    #: the later fragment's ports if found
    ports: tuple[str, str] = ("", "")
    gtp: str = ""
    v1u: bool = True
    kind: int = 0
    whole: bool = True
    seq: bool = False
    ext: bool = False
    inner: tuple[int, int] = (0, 0)
    nested: bool = False
    teid: int = 0

    @property
    def wirelen(self) -> int:
        return max(len(self.frame), self.wire)

    @property
    def data(self) -> bytes:
        return self.frame if self.captured < 0 else self.frame[: self.captured]


def _tunnel(rest: bytes, sport=2152, dport=2152, src=RAN, dst=CORE) -> bytes:
    return ether(0x0800, ip4(17, udp(sport, dport, rest), src, dst))


@cache
def twins() -> tuple[int, int]:
    """Two identifications of IPv4 datagrams from here to there that fall into one slot of the fragment table."""
    ids = np.arange(65_536)
    p = Packet(len(ids))
    p.version[:], p.proto[:], p.frag[:], p.frag_id[:] = 4, 17, FIRST, ids
    p.src[:, :4], p.dst[:, :4] = (np.frombuffer(address(x), np.uint8) for x in (HERE4, THERE4))
    slots = fragment_slot(p)
    other = np.flatnonzero(slots == slots[100])
    return 100, int(other[other != 100][0])


def _entries() -> list[Entry]:
    out: list[Entry] = []

    def add(name, frame, **what):
        out.append(Entry(name, frame, **what))

    def four(proto, rest, **head):
        return ether(0x0800, ip4(proto, rest, **head))

    def six(kind, rest, **head):
        return ether(0x86DD, ip6(kind, rest, **head))

    at = lambda port: (f"{HERE4}:{port}", f"{THERE4}:{port + 1}")
    at6 = lambda port: (f"[{HERE6}]:{port}", f"[{THERE6}]:{port + 1}")
    on4 = lambda port, proto=6: dict(zip(("version", "proto", "src", "dst"), (4, proto, *at(port)), strict=True))
    on6 = lambda port, proto=6: dict(zip(("version", "proto", "src", "dst"), (6, proto, *at6(port)), strict=True))
    bare4, bare6 = {"version": 4, "src": HERE4, "dst": THERE4}, {"version": 6, "src": HERE6, "dst": THERE6}
    fill = b"\x5a" * 20
    add("tcp", four(6, tcp(1000, 1001, fill)), **on4(1000))
    add("udp", four(17, udp(1010, 1011, fill)), **on4(1010, 17))
    add("icmp", four(1, echo(8)), proto=1, **bare4)
    add("icmpv6", six(58, echo(128)), proto=58, **bare6)
    add("tcp over ipv6", six(6, tcp(1020, 1021)), **on6(1020))
    for port, src, dst in ((1090, "::ffff:192.0.2.1", "::ffff:0.0.0.0"), (1092, "::", "::1"), (1094, "2001:0:0:1::1", "1::2:0:0:3:4"), (1096, "2001:db8:0:1:1:1:1:1", "fe80::"), (1098, "::102:304", "abcd:12:1000:ffff:a:b0:c00:dead")):
        add(f"addresses {src} and {dst}", six(6, tcp(port, port + 1), src=src, dst=dst), version=6, proto=6, src=f"[{src}]:{port}", dst=f"[{dst}]:{port + 1}")
    add("another protocol", four(47, fill), proto=47, **bare4)
    add("no ip", ether(0x0806, bytes(46)), non_ip=True)
    add("one tag", ether(0x8100, tag(7, 0x0800, ip4(17, udp(1030, 1031)))), vlans=1, **on4(1030, 17))
    add("two tags", ether(0x88A8, tag(7, 0x8100, tag(8, 0x86DD, ip6(17, udp(1040, 1041))))), vlans=2, **on6(1040, 17))
    add("three tags", ether(0x8100, tag(1, 0x8100, tag(2, 0x8100, tag(3, 0x0800, fill)))), status="BAD_VLAN_DEPTH", vlans=2)
    add("hop-by-hop, then destination options", six(0, b"\x3c\0" + bytes(6) + b"\x06\0" + bytes(6) + tcp(1050, 1051)), **on6(1050))
    add("cut in ethernet", four(6, tcp(1, 2)), captured=10, status="TRUNC_ETHERNET")
    add("cut in a tag", ether(0x8100, tag(7, 0x0800, ip4(6, tcp(1, 2)))), captured=16, status="TRUNC_VLAN")
    add("cut in ipv4", four(6, tcp(1, 2)), captured=24, status="TRUNC_IPV4")
    add("cut in ipv6", six(6, tcp(1, 2)), captured=30, status="TRUNC_IPV6")
    add("cut in an extension", six(0, b"\x06\0" + bytes(6) + tcp(1, 2)), captured=58, status="TRUNC_IPV6_EXT", version=6)
    add("cut in tcp", four(6, tcp(1, 2)), captured=44, status="TRUNC_TCP", version=4, proto=6)
    add("cut in udp", four(17, udp(1, 2)), captured=38, status="TRUNC_UDP", version=4, proto=17)
    add("cut in icmp", four(1, echo(8)), captured=38, status="TRUNC_ICMP", version=4, proto=1)
    add("short frame", ether(0x0800, bytes(10)), status="BAD_SHORT_FRAME")
    add("version 6 in ipv4", four(6, tcp(1, 2), first=0x65), status="BAD_IPV4_VERSION")
    add("header of 16", four(6, tcp(1, 2), first=0x44), status="BAD_IPV4_IHL")
    add("total of 19", four(6, tcp(1, 2), total=19), status="BAD_IPV4_TOTAL_LEN")
    add("version 4 in ipv6", six(6, tcp(1, 2), first=0x40), status="BAD_IPV6_VERSION")
    add("payload too long", six(6, tcp(1, 2), size=21), status="BAD_IPV6_PAYLOAD_LEN")
    add("extension too long", six(0, b"\x06\x04" + bytes(6)), status="BAD_IPV6_EXT", version=6)
    add("no room for tcp", four(6, fill[:10]), status="BAD_L4_LEN", version=4, proto=6)
    add("tcp offset 4", four(6, tcp(1, 2, words=4)), status="BAD_TCP_DOFF", version=4, proto=6)
    add("udp length 7", four(17, udp(1, 2, size=7)), status="BAD_UDP_LEN", version=4, proto=17)
    # fragments
    add("first of ipv6", six(44, piece6(17, 0x70007, 1, udp(1060, 1061, fill, 900))), frag=1, **on6(1060, 17))
    add("later of ipv6", six(44, piece6(17, 0x70007, 8 << 3, fill)), frag=2, found=(True, True), proto=17, ports=at6(1060), **({k: bare6[k] for k in ("version",)} | {"src": f"[{HERE6}]:0", "dst": f"[{THERE6}]:0"}))
    add("first on the tunnel port", ether(0x0800, ip4(17, udp(2152, 2152, fill, 900), RAN, CORE, ident=5, word=0x2000)), frag=1, version=4, proto=17, src=f"{RAN}:2152", dst=f"{CORE}:2152")
    add("later without first", ether(0x0800, ip4(17, fill, SITE4, USER4, ident=9, word=9)), frag=2, version=4, proto=17, src=f"{SITE4}:0", dst=f"{USER4}:0")
    one, two = twins()
    add("first", four(17, udp(1070, 1071, fill, 900), ident=one, word=0x2000), frag=1, **on4(1070, 17))
    add("first that takes its slot", four(17, udp(1080, 1081, fill, 900), ident=two, word=0x2000), frag=1, **on4(1080, 17))
    add("later of the one that lost it", four(17, fill, ident=one, word=30), frag=2, found=(False, True), ports=at(1070), version=4, proto=17, src=f"{HERE4}:0", dst=f"{THERE4}:0")
    # tunnels
    outer = {"version": 4, "proto": 17, "src": f"{RAN}:2152", "dst": f"{CORE}:2152"}
    user = lambda proto, rest, **head: ip4(proto, rest, USER4, SITE4, **head)

    def tunnelled(name, rest, number, kind=255, flags=0x30, size=None, gtp="OK", **what):
        add(name, _tunnel(message(kind, number, rest, flags, size)), gtp=gtp, kind=kind, teid=number, **(outer | what))

    tunnelled("user tcp", user(6, tcp(1, 2, fill)), 0x1001, inner=(4, 6))
    tunnelled("user udp behind an extension", struct.pack(">HBB", 3, 0, 0x85) + b"\x01\0\0\0" + ip6(17, udp(1, 2)), 0x1002, flags=0x36, inner=(6, 17), seq=True, ext=True)
    tunnelled("user icmp", user(1, echo(0)), 0x1003, inner=(4, 1))
    tunnelled("user icmpv6", ip6(58, echo(129)), 0xF0001004, inner=(6, 58))
    tunnelled("another user protocol", user(47, fill), 0x1005, inner=(4, 47))
    tunnelled("tunnel in a tunnel", user(17, udp(2152, 2152, message(255, 1, fill))), 0x1006, inner=(4, 17), nested=True)
    for name, kind in (("echo request", 1), ("echo response", 2), ("error indication", 26), ("another message", 31)):
        tunnelled(name, struct.pack(">HBB", 9, 0, 0), 0, kind=kind, flags=0x32, seq=True)
    tunnelled("end marker", b"", 0x1007, kind=254)
    tunnelled("charging", fill, 0, flags=0x20, v1u=False)
    tunnelled("version 0", fill, 0, flags=0x10, v1u=False)
    whole = message(255, 0x1008, user(6, tcp(1, 2, fill)))
    add("cut in a tunnel header", _tunnel(whole), captured=46, gtp="TRUNC_GTPU", v1u=False, whole=False, **outer)
    add("cut in a tunnel extension", _tunnel(message(255, 0x1009, struct.pack(">HBB", 0, 0, 0x85) + b"\x02" + bytes(7) + user(6, tcp(1, 2)), 0x34)), captured=58, gtp="TRUNC_GTPU_EXT", kind=255, whole=False, **outer)
    add("cut before the user packet", _tunnel(message(255, 0x100A, user(6, tcp(1, 2)))), captured=50, gtp="TRUNC_GTPU_INNER", kind=255, teid=0x100A, **outer)
    tunnelled("tunnel length too long", fill, 0x100B, size=21, gtp="BAD_GTPU_LEN", whole=False)
    tunnelled("tunnel extension of 0", struct.pack(">HBB", 0, 0, 0x85) + bytes(4) + fill, 0x100C, flags=0x34, gtp="BAD_GTPU_EXT_LEN", whole=False)
    tunnelled("tunnel extension too long", struct.pack(">HBB", 0, 0, 0x85) + b"\x09\0\0\0", 0x100D, flags=0x34, gtp="BAD_GTPU_EXT", whole=False)
    tunnelled("user packet of version 7", b"\x70" + fill, 0x100E, gtp="BAD_GTPU_INNER")
    tunnelled("user packet of 10 bytes", b"\x45" + bytes(9), 0x100F, gtp="BAD_GTPU_INNER_SHORT")
    add("cut in user tcp", _tunnel(message(255, 0x1010, user(6, tcp(1, 2, fill)))), captured=80, gtp="TRUNC_TCP", kind=255, teid=0x1010, inner=(4, 6), **outer)
    tunnelled("user tcp offset 4", user(6, tcp(1, 2, words=4)), 0x1011, gtp="BAD_TCP_DOFF", inner=(4, 6))
    return out


ENTRIES = _entries()


def catalog_records(events: DataFrame) -> DataFrame:
    """Records of the catalog capture: event_id is the record number."""
    kind = dict(events.dtypes)["ts"]
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") if kind == "timestamp_ntz" else F.unix_micros("ts")
    rows = [(k, e.wirelen, len(e.data), bytearray(e.data)) for k, e in enumerate(ENTRIES)]
    table = events.sparkSession.createDataFrame(rows, "k long, wirelen long, caplen int, data binary")
    now = events.select(F.col("event_id").alias("record_no"), (us * 1000).alias("ts_ns"), (F.col("event_id") % len(ENTRIES)).alias("k"))
    return now.join(F.broadcast(table), "k").select(F.lit("catalog").alias("file"), "record_no", "ts_ns", "caplen", "wirelen", "data")


def _sql(value) -> str:
    return "true" if value is True else "false" if value is False else f"'{value}'" if isinstance(value, str) else str(value)


def predicted() -> str:
    """SQL: one row of p for each record, with what must be found in it; f and t are its flows and tunnels in a table of slots."""
    columns = "k wirelen caplen status version proto src dst vlans non_ip frag found found_all fsrc fdst gtpu gtp v1u kind whole seq ext iv ip nested teid"
    rows = []
    for k, e in enumerate(ENTRIES):
        row = (k, e.wirelen, len(e.data), CODE[e.status], e.version, e.proto, e.src, e.dst, e.vlans, e.non_ip, e.frag, *e.found, *(e.ports if any(e.found) else (e.src, e.dst)), bool(e.gtp), CODE[e.gtp or "OK"], bool(e.gtp) and e.v1u, e.kind, bool(e.gtp) and e.whole, e.seq, e.ext, *e.inner, e.nested, e.teid)
        rows.append("(" + ", ".join(map(_sql, row)) + ")")
    return f"""
WITH entry({", ".join(columns.split())}) AS (VALUES {", ".join(rows)}),
p AS (SELECT event_id AS e, epoch_us(ts) * 1000 AS ts_ns, entry.* FROM events JOIN entry ON entry.k = event_id % {len(ENTRIES)})
"""
