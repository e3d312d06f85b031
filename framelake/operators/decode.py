"""The frame decoder: whole Arrow batches of frames at once, with numpy index sets in place of branches.

A cursor is three vectors: where the next byte lies, how many bytes were captured from there (cap) and how many the
packet claims (wire), cap <= wire. A header of n bytes fits if n <= cap; else the capture is to blame if n <= wire, and
the packet if not. Each step works on the indices of the frames that got so far and drops those that fail.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..schema import CODE, DECODED, FIRST, FRAGMENT_SLOTS, GPDU, GTPU_PORT, ICMP, ICMPV6, IPV4, IPV6, LATER, NO_FRAGMENT, TCP, UDP, VLAN_TAGS

#: Bounds on crafted chains: VLAN tags, IPv6 extension headers, GTP-U extension headers.
MOST_VLANS, MOST_IPV6_EXT, MOST_GTPU_EXT = 2, 8, 16
HOP_BY_HOP, ROUTING, FRAGMENT, DESTINATION = 0, 43, 44, 60
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3

Index = np.ndarray


class Cursor:
    def __init__(self, data: np.ndarray, at: np.ndarray, cap: np.ndarray, wire: np.ndarray):
        self.data, self.at, self.cap, self.wire = data, at.astype(np.int64), cap.astype(np.int64), wire.astype(np.int64)

    def u8(self, i: Index, k=0) -> np.ndarray:
        return self.data[self.at[i] + k].astype(np.int64)

    def u16(self, i: Index, k=0) -> np.ndarray:
        return self.u8(i, k) << 8 | self.u8(i, k + 1)

    def u32(self, i: Index, k=0) -> np.ndarray:
        return self.u16(i, k) << 16 | self.u16(i, k + 2)

    def bytes(self, i: Index, k: int, n: int) -> np.ndarray:
        return self.data[self.at[i][:, None] + np.arange(k, k + n)]

    def fits(self, i: Index, n, status: np.ndarray, truncated: str, malformed: str) -> Index:
        """The frames of ``i`` that have n more bytes; the others get their status."""
        short = n > self.cap[i]
        if not short.any():
            return i
        lost = i[short]
        status[lost] = np.where((n[short] if isinstance(n, np.ndarray) else n) <= self.wire[lost], CODE[truncated], CODE[malformed])
        return i[~short]

    def skip(self, i: Index, n) -> None:
        self.at[i] += n
        self.cap[i] -= n
        self.wire[i] -= n

    def clip(self, i: Index, n) -> None:
        self.cap[i] = np.minimum(self.cap[i], n)
        self.wire[i] = n


def _drop(i: Index, wrong: np.ndarray, status: np.ndarray, name: str) -> Index:
    if wrong.any():
        status[i[wrong]] = CODE[name]
        return i[~wrong]
    return i


class Packet:
    """What the IP and transport layers of one packet per frame say; zero where they say nothing."""

    def __init__(self, n: int):
        zero = lambda: np.zeros(n, np.int64)
        self.status, self.version, self.proto, self.frag, self.frag_id = zero(), zero(), zero(), zero(), zero()
        self.sport, self.dport, self.flags, self.icmp_type, self.icmp_code = zero(), zero(), zero(), zero(), zero()
        self.has_l3, self.has_l4 = np.zeros(n, bool), np.zeros(n, bool)
        self.src, self.dst = np.zeros((n, 16), np.uint8), np.zeros((n, 16), np.uint8)

    def on_gtpu_port(self) -> np.ndarray:
        return self.has_l4 & (self.proto == UDP) & ((self.sport == GTPU_PORT) | (self.dport == GTPU_PORT))


def transport(c: Cursor, p: Packet, i: Index) -> None:
    proto = p.proto[i]
    if len(t := i[proto == TCP]):
        t = c.fits(t, 20, p.status, "TRUNC_TCP", "BAD_L4_LEN")
        p.sport[t], p.dport[t], p.flags[t] = c.u16(t), c.u16(t, 2), c.u8(t, 13)
        size = (c.u8(t, 12) >> 4) * 4
        t = _drop(t, wrong := (size < 20) | (size > c.wire[t]), p.status, "BAD_TCP_DOFF")
        t = _drop(t, size[~wrong] > c.cap[t], p.status, "TRUNC_TCP")
        p.has_l4[t] = True
    if len(u := i[proto == UDP]):
        u = c.fits(u, 8, p.status, "TRUNC_UDP", "BAD_L4_LEN")
        p.sport[u], p.dport[u] = c.u16(u), c.u16(u, 2)
        size, whole = c.u16(u, 4), p.frag[u] == NO_FRAGMENT
        wrong = (size < 8) | (whole & (size > c.wire[u]))
        u, size, whole = _drop(u, wrong, p.status, "BAD_UDP_LEN"), size[~wrong], whole[~wrong]
        c.clip(u[whole], size[whole])  # a first fragment holds part of its datagram only
        p.has_l4[u] = True
    if len(m := i[(proto == ICMP) | (proto == ICMPV6)]):
        m = c.fits(m, 8, p.status, "TRUNC_ICMP", "BAD_L4_LEN")
        p.icmp_type[m], p.icmp_code[m] = c.u8(m), c.u8(m, 1)
        p.has_l4[m] = True


def ipv4(c: Cursor, p: Packet, i: Index) -> None:
    i = c.fits(i, 20, p.status, "TRUNC_IPV4", "BAD_SHORT_FRAME")
    i = _drop(i, c.u8(i) >> 4 != 4, p.status, "BAD_IPV4_VERSION")
    i = _drop(i, (c.u8(i) & 15) < 5, p.status, "BAD_IPV4_IHL")
    head, total = (c.u8(i) & 15) * 4, c.u16(i, 2)
    total = np.where(total == 0, c.wire[i], total)  # segmentation offload leaves 0: the packet fills the frame
    wrong = (total < head) | (total > c.wire[i])
    i, head, total = _drop(i, wrong, p.status, "BAD_IPV4_TOTAL_LEN"), head[~wrong], total[~wrong]
    cut = head > c.cap[i]
    i, head, total = _drop(i, cut, p.status, "TRUNC_IPV4"), head[~cut], total[~cut]
    p.version[i], p.proto[i], p.frag_id[i] = 4, c.u8(i, 9), c.u16(i, 4)
    p.src[i, :4], p.dst[i, :4] = c.bytes(i, 12, 4), c.bytes(i, 16, 4)
    word = c.u16(i, 6)
    p.frag[i] = np.where(word & 0x1FFF != 0, LATER, np.where(word & 0x2000 != 0, FIRST, NO_FRAGMENT))
    p.has_l3[i] = True
    c.clip(i, total)
    c.skip(i, head)
    transport(c, p, i[p.frag[i] != LATER])


def ipv6(c: Cursor, p: Packet, i: Index) -> None:
    i = c.fits(i, 40, p.status, "TRUNC_IPV6", "BAD_SHORT_FRAME")
    i = _drop(i, c.u8(i) >> 4 != 6, p.status, "BAD_IPV6_VERSION")
    i = _drop(i, c.u16(i, 4) > c.wire[i] - 40, p.status, "BAD_IPV6_PAYLOAD_LEN")
    size = c.u16(i, 4)
    following = np.zeros(len(p.status), np.int64)
    following[i] = c.u8(i, 6)
    p.version[i], p.src[i], p.dst[i], p.has_l3[i] = 6, c.bytes(i, 8, 16), c.bytes(i, 24, 16), True
    c.skip(i, 40)
    c.clip(i, size)
    ended = []
    for hop in range(MOST_IPV6_EXT + 1):
        kind = following[i]
        more = (kind == HOP_BY_HOP) | (kind == ROUTING) | (kind == FRAGMENT) | (kind == DESTINATION)
        ended.append(i[~more])
        i = i[more]
        if not len(i):
            break
        if hop == MOST_IPV6_EXT:
            p.status[i] = CODE["BAD_IPV6_EXT"]
            break
        f, o = i[following[i] == FRAGMENT], i[following[i] != FRAGMENT]
        f = c.fits(f, 8, p.status, "TRUNC_IPV6_EXT", "BAD_IPV6_EXT")
        word = c.u16(f, 2)
        p.frag_id[f] = c.u32(f, 4)
        p.frag[f] = np.where(word >> 3 != 0, LATER, np.where(word & 1 != 0, FIRST, p.frag[f]))
        following[f] = c.u8(f)
        c.skip(f, 8)
        last = f[p.frag[f] == LATER]
        p.proto[last] = following[last]
        o = c.fits(o, 2, p.status, "TRUNC_IPV6_EXT", "BAD_IPV6_EXT")
        size = (c.u8(o, 1) + 1) * 8
        fit = size <= c.cap[o]
        o = c.fits(o, size, p.status, "TRUNC_IPV6_EXT", "BAD_IPV6_EXT")
        following[o] = c.u8(o)
        c.skip(o, size[fit])
        i = np.concatenate([f[p.frag[f] != LATER], o])
    i = np.concatenate(ended)
    p.proto[i] = following[i]
    transport(c, p, i)


def _gtpu(c: Cursor, out: dict[str, np.ndarray], i: Index) -> Packet:
    """Messages and, for those with user data, the packet inside; one level deep."""
    n = len(c.at)
    status, inner = out["gtp_status"], Packet(n)
    i = c.fits(i, 8, status, "TRUNC_GTPU", "BAD_GTPU_LEN")
    flags = c.u8(i)
    ours = (flags >> 5 == 1) & (flags & 0x10 != 0)
    i, flags = i[ours], flags[ours]
    out["gtp_v1u"][i], out["gtp_flags"][i], out["gtp_msg_type"][i], out["teid"][i] = True, flags, c.u8(i, 1), c.u32(i, 4)
    size = c.u16(i, 2)
    wrong = size > c.wire[i] - 8
    i, size = _drop(i, wrong, status, "BAD_GTPU_LEN"), size[~wrong]
    c.skip(i, 8)
    c.clip(i, size)
    following = np.zeros(n, np.int64)
    plain = out["gtp_flags"][i] & 7 == 0
    done, o = i[plain], c.fits(i[~plain], 4, status, "TRUNC_GTPU", "BAD_GTPU_LEN")
    flags = out["gtp_flags"][o]
    out["gtp_seq"][o] = np.where(flags & 2 != 0, c.u16(o), 0)
    following[o] = np.where(flags & 4 != 0, c.u8(o, 3), 0)
    c.skip(o, 4)
    ended, i = [done], o
    for hop in range(MOST_GTPU_EXT + 1):
        ended.append(i[following[i] == 0])
        i = i[following[i] != 0]
        if not len(i):
            break
        if hop == MOST_GTPU_EXT:
            status[i] = CODE["BAD_GTPU_EXT"]
            break
        i = c.fits(i, 1, status, "TRUNC_GTPU_EXT", "BAD_GTPU_EXT")
        i = _drop(i, c.u8(i) == 0, status, "BAD_GTPU_EXT_LEN")
        size = c.u8(i) * 4
        fit = size <= c.cap[i]
        i, size = c.fits(i, size, status, "TRUNC_GTPU_EXT", "BAD_GTPU_EXT"), size[fit]
        following[i] = c.u8(i, size - 1)
        c.skip(i, size)
        out["gtp_ext_count"][i] = hop + 1
    i = np.concatenate(ended)
    out["gtp_msg_ok"][i] = True
    i = c.fits(i[out["gtp_msg_type"][i] == GPDU], 1, status, "TRUNC_GTPU_INNER", "BAD_GTPU_INNER")
    version = c.u8(i) >> 4
    status[i[(version != 4) & (version != 6)]] = CODE["BAD_GTPU_INNER"]
    four, six = i[version == 4], i[version == 6]
    ipv4(c, inner, four)
    ipv6(c, inner, six)
    i = np.concatenate([four, six])
    status[i] = np.where(inner.status[i] == CODE["BAD_SHORT_FRAME"], CODE["BAD_GTPU_INNER_SHORT"], inner.status[i])
    return inner


def decode(data: np.ndarray, at: np.ndarray, cap: np.ndarray, wire: np.ndarray) -> dict[str, np.ndarray]:
    """All fields of all frames: frame k is data[at[k] : at[k] + cap[k]], of which wire[k] bytes were sent."""
    n = len(at)
    c = Cursor(data, at, cap, np.maximum(cap, wire))
    p = Packet(n)
    out = {k: np.zeros(n, np.int64) for k in ("ethertype", "vlan_count", "gtp_status", "gtp_flags", "gtp_msg_type", "gtp_seq", "teid", "gtp_ext_count")}
    out |= {k: np.zeros(n, bool) for k in ("has_l2", "is_gtpu", "gtp_v1u", "gtp_msg_ok")}
    vlans = np.zeros((n, MOST_VLANS), np.int64)
    kind = np.zeros(n, np.int64)
    i = c.fits(np.arange(n), 14, p.status, "TRUNC_ETHERNET", "BAD_SHORT_FRAME")
    kind[i] = c.u16(i, 12)
    c.skip(i, 14)
    ended = []
    for depth in range(MOST_VLANS + 1):
        tagged = np.isin(kind[i], VLAN_TAGS)
        ended.append(i[~tagged])
        i = i[tagged]
        if depth == MOST_VLANS:
            p.status[i] = CODE["BAD_VLAN_DEPTH"]
            break
        i = c.fits(i, 4, p.status, "TRUNC_VLAN", "BAD_SHORT_FRAME")
        vlans[i, depth] = c.u16(i) & 0xFFF
        out["vlan_count"][i] = depth + 1
        kind[i] = c.u16(i, 2)
        c.skip(i, 4)
    i = np.concatenate(ended)
    out["ethertype"][i], out["has_l2"][i] = kind[i], True
    ipv4(c, p, i[kind[i] == IPV4])
    ipv6(c, p, i[kind[i] == IPV6])
    g = np.flatnonzero((p.status == 0) & (p.frag == NO_FRAGMENT) & p.on_gtpu_port() & (c.wire >= 16))
    out["is_gtpu"][g] = True
    c.skip(g, 8)
    inner = _gtpu(c, out, g)
    out |= {"status": p.status, "has_l3": p.has_l3, "has_l4": p.has_l4, "ip_version": p.version, "ip_proto": p.proto, "src_addr": p.src, "dst_addr": p.dst, "frag": p.frag, "frag_id": p.frag_id}
    out |= {"src_port": p.sport, "dst_port": p.dport, "tcp_flags": p.flags, "icmp_type": p.icmp_type, "icmp_code": p.icmp_code, "vlan_ids": vlans}
    out |= {"has_inner": inner.has_l3, "inner_has_l4": inner.has_l4, "gtp_nested": inner.on_gtpu_port(), "inner_version": inner.version, "inner_proto": inner.proto, "inner_src": inner.src, "inner_dst": inner.dst}
    out |= {"inner_src_port": np.where(inner.has_l4, inner.sport, 0), "inner_dst_port": np.where(inner.has_l4, inner.dport, 0)}
    out["frag_slot"] = fragment_slot(p)
    return out


def fragment_slot(p: Packet) -> np.ndarray:
    """The place of a datagram in a direct-mapped table (64-bit FNV-1a of its key); 0 for whole packets."""
    slot = np.zeros(len(p.status), np.int64)
    i = np.flatnonzero(p.frag != NO_FRAGMENT)
    if len(i):
        ids = p.frag_id[i]
        key = np.column_stack([p.version[i], p.proto[i], ids >> 24 & 255, ids >> 16 & 255, ids >> 8 & 255, ids & 255, p.src[i], p.dst[i]]).astype(np.uint64)
        h = np.full(len(i), FNV_OFFSET, np.uint64)
        for column in key.T:
            h = (h ^ column) * np.uint64(FNV_PRIME)
        slot[i] = (h & np.uint64(FRAGMENT_SLOTS - 1)).astype(np.int64)
    return slot


FIELDS = dict(x.split(" ", 1) for x in DECODED.split(", "))
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _frames(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary column without a copy, and where each value starts and how long it is; nulls are empty."""
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(1, np.uint8)
    return data, bounds[:-1], np.diff(bounds)


def to_arrow(found: dict[str, np.ndarray], fields: list[str]) -> list[pa.Array]:
    n = len(found["status"])
    out = []
    for name in fields:
        kind, x = FIELDS[name], found[name]
        if kind == "binary":
            out.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x))]))
        elif kind == "array<int>":
            used = np.arange(MOST_VLANS) < found["vlan_count"][:, None]
            ends = np.concatenate([[0], np.cumsum(found["vlan_count"])]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(x[used].astype(np.int32))))
        else:
            out.append(pa.array(x).cast(ARROW[kind]))
    return out


def decode_frames(records: DataFrame, data: str = "data", fields: list[str] | None = None) -> DataFrame:
    """``records`` without the bytes, with the decoded fields (all, or those named). A row's result depends on that row alone.

    Null bytes are an empty frame, a null wire length is the captured one; repeated rows are decoded again, an empty table
    stays empty. Columns of ``records`` named as a decoded field, in whatever case, give way to it.
    """
    names = list(FIELDS) if fields is None else [f for f in FIELDS if f in set(fields)]
    ours = {data.lower(), *(f.lower() for f in FIELDS)}
    keep = [c for c in records.columns if c.lower() not in ours]

    def run(batches):
        for batch in batches:
            bytes_, at, cap = _frames(batch.column(data))
            wire = batch.column("wirelen").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = to_arrow(decode(bytes_, at, cap, wire), names)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], names=[*keep, *names])

    kinds = {f.name: f.dataType.simpleString() for f in records.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{n} {FIELDS[n]}" for n in names)])
    return records.select(*keep, data).mapInArrow(run, schema)
