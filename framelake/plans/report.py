"""The text report. Numbers are formatted here, by Python's %, which rounds half to even as C does.

Fixed values: the labels, titles and widths of its lines, which other programs read.
"""

from __future__ import annotations

import datetime

from ..functions.text import NS
from ..operators.flows import distinct_teids, top
from ..schema import GTPU_PORT
from ..sources.pcap import FileInfo
from .analysis import Analysis
from .export import Name, as_decoded, flow_text, tunnel_text


def percent(part: int, whole: int) -> float:
    return 100.0 * part / whole if whole else 0.0


def utc_text(ns: int) -> str:
    stamp = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=ns // NS)
    return f"{stamp:%Y-%m-%d %H:%M:%S}.{ns % NS // 1000:06d} UTC"


def duration(ns: int, digits: int) -> str:
    return f"{ns // NS}.{ns % NS // 10 ** (9 - digits):0{digits}d} s"


def summary(info: FileInfo, c: dict, problems: list[tuple[str, int]], flow_count: int) -> str:
    """``c`` is the row of counters; problems are (text, packets) by code."""
    lines = [
        f"File:        {info.file}",
        f"Format:      pcap {info.version_major}.{info.version_minor}, {'big' if info.big_endian else 'little'}-endian, {'nano' if info.nsec else 'micro'}second timestamps, snaplen {info.snaplen}, Ethernet",
        f"Packets:     {c['packets']}",
        f"Bytes:       {c['wire_bytes']} on the wire, {c['captured_bytes']} captured",
    ]
    n = c["packets"]
    if n:
        span = c["last_ts_ns"] - c["first_ts_ns"]
        rates = " (%.1f packets/s, %.3f Mbit/s)" % (n / (span / 1e9), c["wire_bytes"] * 8.0 / (span / 1e9) / 1e6) if span else ""
        lines += [f"First:       {utc_text(c['first_ts_ns'])}", f"Last:        {utc_text(c['last_ts_ns'])}", f"Duration:    {duration(span, 6)}{rates}"]
    share = lambda k: "%d (%.1f%%)" % (c[k], percent(c[k], n))
    lines += [
        "",
        f"Network:     IPv4 {share('ipv4')}, IPv6 {share('ipv6')}, non-IP {share('non_ip')}",
        f"Transport:   TCP {c['tcp']}, UDP {c['udp']}, ICMP {c['icmp']}, ICMPv6 {c['icmpv6']}, other {c['other']}",
        f"VLAN:        {c['vlan_tagged']} tagged frames",
        f"Fragments:   {c['frag_first']} first, {c['frag_later']} non-first ({c['frag_matched']} matched to their first fragment's ports)",
        f"Flows:       {flow_count}",
        f"Problems:    {c['truncated']} truncated, {c['malformed']} malformed (excluded from flows)",
        *("  %-40s %d" % p for p in problems),
    ]
    return "\n".join(lines) + "\n"


def _table(title: str, names: tuple[str, ...], align: str, rows: list[tuple[str, ...]]) -> str:
    """Columns as wide as the least width in ``align`` or the widest entry where that is marked *."""
    widths = []
    for k, spec in enumerate(align.split()):
        widths.append(max([3, *(len(r[k]) for r in rows)]) if spec[1:] == "*" else int(spec[1:]))
    put = lambda r: "  ".join(x.rjust(w) if a[0] == ">" else x.ljust(w) for x, w, a in zip(r, widths, align.split(), strict=True))
    return "\n" + "\n".join([title, put(names), *map(put, rows)]) + "\n"


def top_flows(rows: list, total: int) -> str:
    """``rows`` of flow_text in rank order."""
    if not rows:
        return ""
    title = f"Top {len(rows)} of {total} flows by bytes (src = sender of the first packet seen):"
    body = [(str(k), r.protocol, r.src, r.dst, str(r.packets), str(r.bytes), duration(r.duration_ns, 3), r.flags if r.protocol == "TCP" else "-") for k, r in enumerate(rows, 1)]
    return _table(title, ("#", "proto", "src", "dst", "packets", "bytes", "duration", "tcp flags"), ">3 <6 <* <* >8 >10 >12 <0", body)


def top_tunnels(rows: list, total: int) -> str:
    if not rows:
        return ""
    title = f"Top {len(rows)} of {total} GTP-U tunnels by bytes (one direction each; the receiver chose the TEID):"
    body = [(str(k), r.teid_text, r.src, r.dst, str(r.packets), str(r.bytes), duration(r.duration_ns, 3)) for k, r in enumerate(rows, 1)]
    return _table(title, ("#", "teid", "src", "dst", "packets", "bytes", "duration"), ">3 <10 <* <* >8 >10 >12", body)


def gtpu(c: dict, problems: list[tuple[str, int]], tunnels: int, teids: int) -> str:
    """The GTP-U section; empty where no packet touched the port."""
    if not c["gtp_packets"] and not c["gtp_fragmented"]:
        return ""
    g = {k[4:]: v for k, v in c.items() if k.startswith("gtp_")}
    lines = [
        "",
        f"GTP-U:       {g['packets']} packets on UDP port {GTPU_PORT}",
        f"  Messages:  G-PDU {g['gpdu']}, echo request {g['echo_request']}, echo response {g['echo_response']}, error indication {g['error_indication']}, end marker {g['end_marker']}, other {g['other_type']}",
        f"  Options:   sequence number in {g['with_seq']}, extension headers in {g['with_ext']}",
        f"  Inner IP:  IPv4 {g['inner_ipv4']}, IPv6 {g['inner_ipv6']}; TCP {g['inner_tcp']}, UDP {g['inner_udp']}, ICMP {g['inner_icmp']}, ICMPv6 {g['inner_icmpv6']}, other {g['inner_other']}",
        f"  Tunnels:   {tunnels} ({teids} distinct TEIDs)",
        f"  Skipped:   {g['not_v1u']} GTP' or other version, {g['nested']} GTP-U in GTP-U, {g['fragmented']} fragmented datagrams on port {GTPU_PORT}",
        f"  Problems:  {g['truncated'] - g['user_truncated']} truncated, {g['malformed'] - g['user_malformed']} malformed in GTP-U headers (not added to tunnels)",
        f"             {g['user_truncated']} truncated, {g['user_malformed']} malformed in user packets (still added to tunnels)",
        *("    %-38s %d" % p for p in problems),
    ]
    return "\n".join(lines) + "\n"


def sections(analysis: Analysis, info: FileInfo, n: int, name: Name = as_decoded) -> dict[str, str]:
    """The report's parts by name, with the n largest flows and tunnels; only shown rows and single counts reach the driver."""
    c = analysis.counters().first().asDict()
    told = lambda df: [(r.text, r.packets) for r in df.collect()]
    flows, tunnels = analysis.flows().cache(), analysis.tunnels().cache()
    flow_count, tunnel_count = flows.count(), tunnels.count()
    shown = lambda t, text: text(top(t, n)).collect() if n else []
    out = {
        "summary": summary(info, c, told(analysis.problems()), flow_count), "flows": top_flows(shown(flows, lambda t: flow_text(t, name)), flow_count),
        "gtpu": gtpu(c, told(analysis.gtp_problems()), tunnel_count, distinct_teids(tunnels).first().teids), "tunnels": top_tunnels(shown(tunnels, tunnel_text), tunnel_count),
    }
    flows.unpersist()
    tunnels.unpersist()
    return out


def report(analysis: Analysis, info: FileInfo, n: int) -> str:
    return "".join(sections(analysis, info, n).values())
