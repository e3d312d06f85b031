"""A plain decoder, one frame at a time, as an independent check of the vectorized one."""

from __future__ import annotations

from framelake.schema import CODE


class Stop(Exception):
    pass


class Span:
    def __init__(self, data: bytes, wire: int):
        self.data, self.wire = data, max(wire, len(data))

    def need(self, n, truncated, malformed):
        if n > len(self.data):
            raise Stop(truncated if n <= self.wire else malformed)

    def step(self, n):
        self.data, self.wire = self.data[n:], self.wire - n

    def clip(self, n):
        self.data, self.wire = self.data[:n], n

    def num(self, at, n):
        return int.from_bytes(self.data[at : at + n], "big")


def blank() -> dict:
    return {"version": 0, "proto": 0, "src": bytes(16), "dst": bytes(16), "frag": 0, "frag_id": 0, "sport": 0, "dport": 0, "flags": 0, "type": 0, "code": 0, "l3": False, "l4": False}


def transport(s: Span, p: dict):
    if p["proto"] == 6:
        s.need(20, "TRUNC_TCP", "BAD_L4_LEN")
        p |= {"sport": s.num(0, 2), "dport": s.num(2, 2), "flags": s.num(13, 1)}
        size = (s.num(12, 1) >> 4) * 4
        if size < 20 or size > s.wire:
            raise Stop("BAD_TCP_DOFF")
        s.need(size, "TRUNC_TCP", "TRUNC_TCP")
    elif p["proto"] == 17:
        s.need(8, "TRUNC_UDP", "BAD_L4_LEN")
        p |= {"sport": s.num(0, 2), "dport": s.num(2, 2)}
        size = s.num(4, 2)
        if size < 8 or (not p["frag"] and size > s.wire):
            raise Stop("BAD_UDP_LEN")
        if not p["frag"]:
            s.clip(size)
    elif p["proto"] in (1, 58):
        s.need(8, "TRUNC_ICMP", "BAD_L4_LEN")
        p |= {"type": s.num(0, 1), "code": s.num(1, 1)}
    else:
        return
    p["l4"] = True


def network4(s: Span, p: dict):
    s.need(20, "TRUNC_IPV4", "BAD_SHORT_FRAME")
    if s.num(0, 1) >> 4 != 4:
        raise Stop("BAD_IPV4_VERSION")
    head = (s.num(0, 1) & 15) * 4
    if head < 20:
        raise Stop("BAD_IPV4_IHL")
    total = s.num(2, 2) or s.wire
    if not head <= total <= s.wire:
        raise Stop("BAD_IPV4_TOTAL_LEN")
    s.need(head, "TRUNC_IPV4", "TRUNC_IPV4")
    word = s.num(6, 2)
    p |= {"version": 4, "proto": s.num(9, 1), "src": s.data[12:16] + bytes(12), "dst": s.data[16:20] + bytes(12), "frag_id": s.num(4, 2), "frag": 2 if word & 0x1FFF else 1 if word & 0x2000 else 0, "l3": True}
    s.clip(total)
    s.step(head)
    if p["frag"] != 2:
        transport(s, p)


def network6(s: Span, p: dict):
    s.need(40, "TRUNC_IPV6", "BAD_SHORT_FRAME")
    if s.num(0, 1) >> 4 != 6:
        raise Stop("BAD_IPV6_VERSION")
    size = s.num(4, 2)
    if size > s.wire - 40:
        raise Stop("BAD_IPV6_PAYLOAD_LEN")
    following = s.num(6, 1)
    p |= {"version": 6, "src": s.data[8:24], "dst": s.data[24:40], "l3": True}
    s.step(40)
    s.clip(size)
    seen = 0
    while following in (0, 43, 44, 60):
        seen += 1
        if seen > 8:
            raise Stop("BAD_IPV6_EXT")
        if following == 44:
            s.need(8, "TRUNC_IPV6_EXT", "BAD_IPV6_EXT")
            word = s.num(2, 2)
            p["frag_id"] = s.num(4, 4)
            p["frag"] = 2 if word >> 3 else 1 if word & 1 else p["frag"]
            n = 8
        else:
            s.need(2, "TRUNC_IPV6_EXT", "BAD_IPV6_EXT")
            n = 8 * (s.num(1, 1) + 1)
            s.need(n, "TRUNC_IPV6_EXT", "BAD_IPV6_EXT")
        following = s.num(0, 1)
        s.step(n)
        if p["frag"] == 2:
            p["proto"] = following
            return
    p["proto"] = following
    transport(s, p)


def tunnelled(s: Span, g: dict):
    s.need(8, "TRUNC_GTPU", "BAD_GTPU_LEN")
    flags = s.num(0, 1)
    if flags >> 5 != 1 or not flags & 16:
        return
    g |= {"gtp_v1u": True, "gtp_flags": flags, "gtp_msg_type": s.num(1, 1), "teid": s.num(4, 4)}
    size = s.num(2, 2)
    if size > s.wire - 8:
        raise Stop("BAD_GTPU_LEN")
    s.step(8)
    s.clip(size)
    following = 0
    if flags & 7:
        s.need(4, "TRUNC_GTPU", "BAD_GTPU_LEN")
        g["gtp_seq"] = s.num(0, 2) if flags & 2 else 0
        following = s.num(3, 1) if flags & 4 else 0
        s.step(4)
    n = 0
    while following:
        n += 1
        if n > 16:
            raise Stop("BAD_GTPU_EXT")
        s.need(1, "TRUNC_GTPU_EXT", "BAD_GTPU_EXT")
        size = 4 * s.num(0, 1)
        if not size:
            raise Stop("BAD_GTPU_EXT_LEN")
        s.need(size, "TRUNC_GTPU_EXT", "BAD_GTPU_EXT")
        following = s.num(size - 1, 1)
        s.step(size)
        g["gtp_ext_count"] = n
    g["gtp_msg_ok"] = True
    if g["gtp_msg_type"] != 255:
        return
    s.need(1, "TRUNC_GTPU_INNER", "BAD_GTPU_INNER")
    kind = s.num(0, 1) >> 4
    if kind not in (4, 6):
        raise Stop("BAD_GTPU_INNER")
    p = blank()
    try:
        (network4 if kind == 4 else network6)(s, p)
    except Stop as stop:
        raise Stop("BAD_GTPU_INNER_SHORT" if stop.args[0] == "BAD_SHORT_FRAME" else stop.args[0]) from None
    finally:
        if p["l3"]:
            g |= {"has_inner": True, "inner_version": p["version"], "inner_proto": p["proto"], "inner_src": p["src"], "inner_dst": p["dst"]}
        if p["l4"]:
            g |= {"inner_has_l4": True, "inner_src_port": p["sport"], "inner_dst_port": p["dport"], "gtp_nested": p["proto"] == 17 and 2152 in (p["sport"], p["dport"])}


def decode(frame: bytes, wire: int) -> dict:
    s, p = Span(frame, wire), blank()
    out = {"status": 0, "has_l2": False, "ethertype": 0, "vlan_count": 0, "vlan_ids": [], "is_gtpu": False, "gtp_status": 0, "gtp_v1u": False, "gtp_flags": 0, "gtp_msg_type": 0, "gtp_msg_ok": False, "gtp_seq": 0, "teid": 0, "gtp_ext_count": 0}
    out |= {"has_inner": False, "inner_has_l4": False, "gtp_nested": False, "inner_version": 0, "inner_proto": 0, "inner_src": bytes(16), "inner_dst": bytes(16), "inner_src_port": 0, "inner_dst_port": 0}
    try:
        s.need(14, "TRUNC_ETHERNET", "BAD_SHORT_FRAME")
        kind = s.num(12, 2)
        s.step(14)
        while kind in (0x8100, 0x88A8, 0x9100):
            if out["vlan_count"] == 2:
                raise Stop("BAD_VLAN_DEPTH")
            s.need(4, "TRUNC_VLAN", "BAD_SHORT_FRAME")
            out["vlan_ids"] = [*out["vlan_ids"], s.num(0, 2) & 0xFFF]
            out["vlan_count"] += 1
            kind = s.num(2, 2)
            s.step(4)
        out |= {"ethertype": kind, "has_l2": True}
        if kind == 0x0800:
            network4(s, p)
        elif kind == 0x86DD:
            network6(s, p)
    except Stop as stop:
        out["status"] = CODE[stop.args[0]]
    if not out["status"] and not p["frag"] and p["l4"] and p["proto"] == 17 and 2152 in (p["sport"], p["dport"]) and s.wire >= 16:
        out["is_gtpu"] = True
        s.step(8)
        try:
            tunnelled(s, out)
        except Stop as stop:
            out["gtp_status"] = CODE[stop.args[0]]
    names = {"has_l3": "l3", "has_l4": "l4", "ip_version": "version", "ip_proto": "proto", "src_addr": "src", "dst_addr": "dst", "frag": "frag", "frag_id": "frag_id", "src_port": "sport", "dst_port": "dport", "tcp_flags": "flags", "icmp_type": "type", "icmp_code": "code"}
    return out | {k: p[v] for k, v in names.items()}
