"""Frames byte by byte, for tests. Checksums stay 0: nothing verifies them."""

from __future__ import annotations

import ipaddress
import struct

V4_A, V4_B, V6_A, V6_B = "10.0.0.1", "192.168.1.20", "2001:db8::1", "2001:db8::2"
RAN, RAN2, CORE, UE, SERVER = "172.16.1.11", "172.16.1.12", "172.16.0.1", "100.64.0.7", "198.51.100.20"


def ip(text: str) -> bytes:
    return ipaddress.ip_address(text).packed


def eth(kind: int, rest: bytes) -> bytes:
    return bytes.fromhex("020000000002020000000001") + struct.pack(">H", kind) + rest


def vlan(vid: int, kind: int, rest: bytes) -> bytes:
    return struct.pack(">HH", vid, kind) + rest


def v4(proto: int, payload: bytes, src=V4_A, dst=V4_B, word=0, ident=0x1234, options=0, total=None, ihl=None) -> bytes:
    ihl = 5 + options if ihl is None else ihl
    total = 20 + 4 * options + len(payload) if total is None else total
    return struct.pack(">BBHHHBBH", 0x40 | ihl, 0, total, ident, word, 64, proto, 0) + ip(src) + ip(dst) + b"\1" * (4 * options) + payload


def v6(proto: int, payload: bytes, src=V6_A, dst=V6_B, size=None) -> bytes:
    return struct.pack(">IHBB", 0x60000000, len(payload) if size is None else size, proto, 64) + ip(src) + ip(dst) + payload


def tcp(sport: int, dport: int, flags: int, payload=b"", offset=5) -> bytes:
    return struct.pack(">HHIIBBHHH", sport, dport, 1000, 2000, offset << 4, flags, 65535, 0, 0) + payload


def udp(sport: int, dport: int, payload=b"", size=None) -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(payload) if size is None else size, 0) + payload


def icmp(kind: int, code=0) -> bytes:
    return struct.pack(">BBHHH", kind, code, 0, 0x42, 1)


def gtp(kind: int, teid: int, payload=b"", flags=0x30, size=None) -> bytes:
    return struct.pack(">BBHI", flags, kind, len(payload) if size is None else size, teid) + payload


def option(seq=0, following=0) -> bytes:
    return struct.pack(">HBB", seq, 0, following)


def extension(units: int, following=0) -> bytes:
    return bytes([units]) + bytes(max(0, 4 * units - 2)) + (bytes([following]) if units else b"")


def hop_by_hop(following: int, units=0) -> bytes:
    return bytes([following, units, 1, 4, 0, 0, 0, 0]) + bytes(8 * units)


def fragment(following: int, word: int, ident=0xCAFEF00D) -> bytes:
    return struct.pack(">BBHI", following, 0, word, ident)


def tunnel(message: bytes, src=RAN, dst=CORE, sport=2152, dport=2152) -> bytes:
    return eth(0x0800, v4(17, udp(sport, dport, message), src, dst))


def record(frame: bytes, second: float, number: int, wire: int | None = None, file="t") -> tuple:
    return (file, number, int(second * 10**9), len(frame), max(len(frame), wire or 0), bytes(frame))


def seeds() -> list[bytes]:
    """One frame of each kind; property tests cut and mutate them."""
    inner4, inner6 = v4(6, tcp(1, 2, 2), UE, SERVER), v6(17, udp(5, 6, b"x" * 9))
    return [
        eth(0x0800, v4(6, tcp(40000, 80, 2, b"\xab" * 10))), eth(0x0800, v4(6, tcp(1, 2, 16), options=3)), eth(0x0800, v4(17, udp(53, 5353, b"\xcd" * 20))), eth(0x0800, v4(1, icmp(8))),
        eth(0x86DD, v6(6, tcp(9, 10, 24, b"\xef" * 5))), eth(0x86DD, v6(0, hop_by_hop(44) + fragment(17, 1) + udp(7, 8, b"y" * 16, 400))), eth(0x86DD, v6(60, hop_by_hop(43, 1) + hop_by_hop(6) + tcp(3, 4, 17))),
        eth(0x86DD, v6(58, icmp(128))), eth(0x88A8, vlan(5, 0x8100, vlan(6, 0x0800, v4(17, udp(1, 2, b"z" * 4))))), eth(0x8100, vlan(7, 0x86DD, v6(17, udp(1, 2)))),
        eth(0x0800, v4(17, udp(1, 2, b"q" * 24, 900), word=0x2000)), eth(0x0800, v4(17, b"w" * 32, word=185)), eth(0x0806, bytes(46)),
        tunnel(gtp(255, 0x100, inner4)), tunnel(gtp(255, 0x80000001, option(7, 0x85) + extension(1) + inner6, 0x36)),
        eth(0x8100, vlan(300, 0x86DD, v6(17, udp(2152, 2152, gtp(255, 3, option(0, 0xC0) + extension(1, 0x85) + extension(2) + inner4, 0x34))))),
        tunnel(gtp(1, 0, option(1), 0x32)), tunnel(gtp(255, 9, v4(17, udp(2152, 2152, gtp(255, 1, inner4))))),
        eth(0x0800, v4(47, b"gre" * 8)), eth(0x86DD, v6(0, b"".join(hop_by_hop(0) for _ in range(9)) + hop_by_hop(6) + tcp(1, 2, 3))), tunnel(gtp(255, 4, option(0, 1) + b"".join(extension(1, 1) for _ in range(17)) + inner4, 0x34)),
    ]
