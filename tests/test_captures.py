"""Golden captures: exact counters, flows, tunnels, CSV and text."""

import io
import random

import pytest

from framelake.__main__ import main, parse
from framelake.functions.text import format_ipv6
from framelake.operators import flows as W
from framelake.operators.decode import decode_frames
from framelake.operators.fragments import attribute
from framelake.plans import export, report
from framelake.plans.analysis import Analysis
from framelake.plans.traffic import traffic
from framelake.schema import CODE, RECORDS
from framelake.sources.pcap import open_survey, parse_header, read_anywhere, read_captures, read_stream, register, survey, write_pcap

from .builder import CORE, RAN, RAN2, SERVER, UE, V4_A, V4_B, V6_A, V6_B, eth, extension, gtp, hop_by_hop, icmp, ip, option, record, tcp, tunnel, udp, v4, v6, vlan


def analyse(spark, rows, **options):
    return Analysis.of_records(spark.createDataFrame(rows, RECORDS), **options)


#: What the captures below must come to (counts, lengths, ranks, texts); their frames are of our own builder.
def mixed():
    there, back = (V4_A, V4_B), (V4_B, V4_A)
    frames = [
        eth(0x0800, v4(6, tcp(40000, 80, 2), *there)), eth(0x0800, v4(6, tcp(80, 40000, 18), *back)), eth(0x0800, v4(6, tcp(40000, 80, 16, b"\xab" * 100), *there)),
        eth(0x86DD, v6(17, udp(5353, 53, b"\xcd" * 30), V6_A, V6_B)), eth(0x86DD, v6(17, udp(53, 5353, b"\xcd" * 90), V6_B, V6_A)), eth(0x0800, v4(1, icmp(8))), eth(0x0806, bytes(46)),
        eth(0x8100, vlan(100, 0x0800, v4(17, udp(1000, 2000, b"x" * 10)))), eth(0x0800, v4(17, b"m" * 40, word=185)), eth(0x0800, v4(6, tcp(1, 2, 2), ihl=3)),
    ]
    last = eth(0x0800, v4(6, tcp(40000, 80, 16, b"\xab" * 100)))
    return [record(f, 10 + k, k) for k, f in enumerate(frames)] + [record(last[:44], 20, 10, len(last))]


def test_mixed_capture(spark, tmp_path):
    a = analyse(spark, mixed())
    c = a.counters().first()
    assert (c.packets, c.ipv4, c.ipv6, c.non_ip, c.tcp, c.udp, c.icmp, c.icmpv6, c.vlan_tagged, c.frag_later, c.frag_matched, c.truncated, c.malformed) == (11, 7, 2, 1, 4, 4, 1, 0, 1, 1, 0, 1, 1)
    assert (c.first_ts_ns, c.last_ts_ns, a.flows().count()) == (10 * 10**9, 20 * 10**9, 5) and c.captured_bytes < c.wire_bytes
    assert [(r.code, r.packets) for r in a.problems().collect()] == [(CODE["TRUNC_TCP"], 1), (CODE["BAD_IPV4_IHL"], 1)]
    path = str(tmp_path / "mixed.pcap")
    write_pcap(path, [(r[2], r[4], r[5]) for r in mixed()])
    text = report.report(Analysis.of_capture(spark, path), open_survey(path)[0], 3)
    assert "IPv4 7 (63.6%), IPv6 2 (18.2%), non-IP 1 (9.1%)" in text and "Top 3 of 5 flows by bytes" in text and "GTP-U" not in text
    assert "  truncated TCP header                     1\n" in text
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-5])
    info, _ = open_survey(path)
    assert (info.records, info.status) == (10, "TRUNC_RECORD")
    out, err = io.StringIO(), io.StringIO()
    assert main(["-n", "0", path], spark, out, err) == 2 and "the 10 records before that" in err.getvalue() and "Packets:     10\n" in out.getvalue()


def test_fragments(spark):
    first = eth(0x0800, v4(17, udp(4444, 5555, b"f" * 1472, 3008), word=0x2000))
    rows = [record(first, 1, 0), record(eth(0x0800, v4(17, b"g" * 1480, word=0x2000 | 185)), 2, 1), record(eth(0x0800, v4(17, b"h" * 48, word=370)), 3, 2), record(eth(0x0800, v4(17, b"h" * 8, word=370, ident=0x9999)), 4, 3)]
    for lossless in (False, True):
        a = analyse(spark, rows, lossless=lossless)
        c = a.counters().first()
        assert (c.frag_first, c.frag_later, c.frag_matched, a.flows().count()) == (1, 3, 2, 2)
        top = export.flow_text(W.top(a.flows(), 1)).first()
        assert (top.packets, top.bytes, top.src, top.dst) == (3, 2 * 1514 + 82, "10.0.0.1:4444", "192.168.1.20:5555")


def test_slot_reuse_against_a_sequential_table(spark):
    rng = random.Random(5)
    rows = []
    for k in range(3000):
        ident, word = rng.randrange(4000), rng.choice([0x2000, 0x2000, 185])
        body = udp(rng.randrange(1, 9), 9, b"x" * 8, 900) if word == 0x2000 else b"y" * 16
        rows.append(record(eth(0x0800, v4(17, body, word=word, ident=ident, src=f"10.0.0.{rng.randrange(1, 4)}")), k, k))
    packets = decode_frames(spark.createDataFrame(rows, RECORDS).repartition(7))
    got = {r.record_no: (r.frag_matched, r.src_port) for r in attribute(packets).select("record_no", "frag_matched", "src_port").collect()}
    slots, want = {}, {}
    for r in packets.orderBy("record_no").collect():
        key = (r.frag_id, bytes(r.src_addr), bytes(r.dst_addr))
        if r.frag == 1:
            slots[r.frag_slot] = (key, r.src_port)
            want[r.record_no] = (False, r.src_port)
        else:
            held = slots.get(r.frag_slot)
            want[r.record_no] = (True, held[1]) if held and held[0] == key else (False, 0)
    assert got == want and any(m for m, _ in want.values())


def test_broken_chain_counts_no_transport(spark):
    c = analyse(spark, [record(eth(0x86DD, v6(0, hop_by_hop(6, 4)[:8])), 1, 0)]).counters().first()
    assert (c.ipv6, c.malformed, c.tcp + c.udp + c.icmp + c.icmpv6 + c.other) == (1, 1, 0)


def gtpu_capture():
    inner = lambda n: v4(6, tcp(1000, 80, 16, b"p" * n), UE, SERVER)
    user = v6(17, udp(5, 6, b"u" * 10))
    messages = [
        tunnel(gtp(255, 0x100, inner(100))), tunnel(gtp(255, 0x100, inner(0))), tunnel(gtp(255, 0x200, inner(500)), CORE, RAN), tunnel(gtp(255, 0x100, inner(0)), RAN2), tunnel(gtp(255, 0x100, inner(0)), CORE, RAN),
        tunnel(gtp(1, 0, option(1), 0x32), sport=50000), tunnel(gtp(2, 0, option(1), 0x32), CORE, RAN, 2152, 50000), tunnel(gtp(254, 0x200), CORE, RAN),
        tunnel(gtp(255, 0x300, option(0, 0x85) + b"\0" * 4 + inner(0), 0x34)), tunnel(gtp(1, 0, b"", 0x20)), tunnel(gtp(26, 0, option(2), 0x32)), tunnel(gtp(31, 0, option(3), 0x32)),
        tunnel(gtp(255, 0x400, option(0, 0x85) + extension(1) + user, 0x34)), tunnel(gtp(255, 0x500, v4(17, udp(2152, 2152, gtp(255, 1)), UE, SERVER))),
        eth(0x0800, v4(17, udp(2152, 2152, b"x" * 24, 2000), RAN, CORE, word=0x2000)),
    ]
    return [record(f, 100 + k, k) for k, f in enumerate(messages)]


def test_gtpu_capture(spark):
    a = analyse(spark, gtpu_capture())
    c = a.counters().first().asDict()
    want = {"packets": 14, "fragmented": 1, "not_v1u": 1, "gpdu": 8, "echo_request": 1, "echo_response": 1, "error_indication": 1, "end_marker": 1, "other_type": 1, "with_seq": 4, "with_ext": 1, "inner_ipv4": 6, "inner_ipv6": 1, "inner_tcp": 5, "inner_udp": 2, "nested": 1, "truncated": 0, "malformed": 1}
    assert {k: c[f"gtp_{k}"] for k in want} == want and (c["packets"], c["udp"], c["malformed"]) == (15, 15, 0)
    assert a.tunnels().count() == 6 and W.distinct_teids(a.tunnels()).first().teids == 4
    rows = export.tunnel_text(W.top(a.tunnels(), 2)).collect()
    assert [(r.teid, r.src, r.packets, r.bytes) for r in rows] == [(0x200, CORE, 1, 590), (0x100, RAN, 2, 280)]
    text = report.gtpu(c, [], 6, 4) + report.top_tunnels(rows, 6)
    assert "Tunnels:   6 (4 distinct TEIDs)" in text and "0x00000200  172.16.0.1" in text and "0 truncated, 1 malformed in GTP-U headers" in text


def test_csv(spark, tmp_path):
    rows = [record(eth(0x0800, v4(6, tcp(40000, 80, 2))), 1.5, 0), record(eth(0x0800, v4(6, tcp(80, 40000, 18), V4_B, V4_A)), 2, 1), record(eth(0x86DD, v6(58, icmp(128))), 3, 2)]
    a = analyse(spark, rows)
    path = str(tmp_path / "flows.csv")
    export.write_lines(export.flow_lines(a.flows()), export.FLOW_HEADER, path)
    assert open(path).read() == export.FLOW_HEADER + "\n10.0.0.1,40000,192.168.1.20,80,TCP,4,2,108,1.500000000,2.000000000,0.500000000,SA\n2001:db8::1,0,2001:db8::2,0,ICMPv6,6,1,62,3.000000000,3.000000000,0.000000000,\n"
    export.write_lines(export.tunnel_lines(a.tunnels()), export.TUNNEL_HEADER, path)
    assert open(path).read() == export.TUNNEL_HEADER + "\n"


def test_flow_times_order_and_ties(spark):
    send = lambda s, k, back=False: record(eth(0x0800, v4(17, udp(*((2, 1) if back else (1, 2))), *((V4_B, V4_A) if back else (V4_A, V4_B)))), s, k)
    f = analyse(spark, [send(5, 0), send(3, 1, True), send(9, 2), send(7, 3)]).flows().first()
    assert (f.first_ts_ns, f.last_ts_ns, f.first_from_b, f.packets) == (3 * 10**9, 9 * 10**9, True, 4)
    assert not analyse(spark, [send(3, 0), send(3, 1, True)]).flows().first().first_from_b
    sizes = [(k, 100 * (1 + k % 13)) for k in range(300)]
    many = [record(eth(0x0800, v4(17, udp(1000 + k, 9, b"x" * n))), k, k) for k, n in sizes]
    flows = analyse(spark, many).flows()
    assert [r.port_a for r in W.top(flows, 50).collect()] == [r.port_a for r in W.ranked(flows).collect()][:50]
    assert W.find(flows, port_a=1007).count() == 1
    same = analyse(spark, many[::-1]).flows().repartition(8)
    assert {tuple(map(str, r)) for r in same.collect()} == {tuple(map(str, r)) for r in flows.collect()}


@pytest.mark.parametrize(
    ("addr", "text"),
    [("::", "::"), ("::1", "::1"), ("2001:db8:0:1:1:1:1:1", "2001:db8:0:1:1:1:1:1"), ("2001:0:0:1:0:0:0:1", "2001:0:0:1::1"), ("1:0:0:2:0:0:3:4", "1::2:0:0:3:4"), ("fe80::", "fe80::"), ("abcd:12:1000:ffff:a:b0:c00:dead", "abcd:12:1000:ffff:a:b0:c00:dead"), ("::ffff:192.0.2.1", "::ffff:192.0.2.1"), ("::fffe:102:304", "::fffe:102:304"), ("::1:ffff:102:304", "::1:ffff:102:304"), ("::102:304", "::102:304")],
)
def test_ipv6_text(addr, text):
    assert format_ipv6(ip(addr)) == text


def test_headers(tmp_path):
    good = str(tmp_path / "a.pcap")
    write_pcap(good, [])
    head = open(good, "rb").read()
    assert open_survey(good)[0].status == "EOF"
    assert [parse_header(head[:n]).status for n in (0, 3, 4, 23)] == ["SHORT_HEADER"] * 4
    assert parse_header(b"\x55" * 6).status == parse_header(b"\x55" * 24).status == "BAD_MAGIC"
    assert parse_header(b"\x0a\x0d\x0d\x0a").status == "PCAPNG"
    assert parse_header(head[:4] + b"\1\0" + head[6:]).status == "BAD_VERSION" and parse_header(head[:20] + b"\x65\0\0\0").status == "BAD_LINKTYPE" and parse_header(head[:20] + b"\1\0\0\x14").status == "OK"
    for size, status in ((262_144, "EOF"), (262_145, "BAD_CAPLEN"), (0xFFFFFFFF, "BAD_CAPLEN")):
        data = head + bytes(8) + size.to_bytes(4, "little") + (10).to_bytes(4, "little") + bytes(262_144)
        assert survey(data, "x")[0].status == status
    assert survey(head + bytes(7), "x")[0].status == "TRUNC_RECORD_HDR"
    assert open_survey(str(tmp_path / "none"))[0].status == "OPEN"


@pytest.mark.parametrize(("nsec", "big"), [(False, False), (True, False), (False, True), (True, True)])
def test_source(spark, tmp_path, nsec, big):
    register(spark)
    rows = [(k * 10**9 + 5000, 100 + k, bytes([k]) * (k + 1)) for k in range(50)]
    folder = tmp_path / "captures"
    folder.mkdir()
    for name in ("a.pcap", "b.pcap"):
        write_pcap(str(folder / name), rows, nsec, big)
    read = spark.read.format("pcap").option("rangeBytes", 200).load(str(folder))
    assert read.rdd.getNumPartitions() > 4
    got = sorted((r.file[-6:], r.record_no, r.ts_ns, r.wirelen, bytes(r.data)) for r in read.collect())
    assert got == sorted((n, k, ts, w, d) for n in ("a.pcap", "b.pcap") for k, (ts, w, d) in enumerate(rows))
    files = spark.read.format("pcap").option("table", "files").load(str(folder)).collect()
    assert [(f.records, f.status, f.nsec, f.big_endian) for f in files] == [(50, "EOF", nsec, big)] * 2
    records, infos = read_anywhere(spark, str(folder))
    assert sorted((r.file[-6:], r.record_no, r.ts_ns, r.wirelen, bytes(r.data)) for r in records.collect()) == got and infos.count() == 2


def test_names_with_commas_and_brackets(spark, tmp_path):
    rows = [(k * 10**9, 60, bytes([k]) * 60) for k in range(2)]
    for name in ("a,b.pcap", "c[1].pcap", "c1.pcap"):
        write_pcap(str(tmp_path / name), rows if name != "c1.pcap" else rows[:1])
    out, err = io.StringIO(), io.StringIO()
    assert main(["-n", "0", str(tmp_path / "a,b.pcap")], spark, out, err) == 0 and "Packets:     2\n" in out.getvalue() and not err.getvalue()
    assert read_captures(spark, str(tmp_path / "c[1].pcap")).count() == 2 and read_captures(spark, str(tmp_path / "c?.pcap")).count() == 1
    register(spark)
    assert spark.read.format("pcap").load(str(tmp_path / "a,b.pcap")).count() == 2


def test_ranges_read_by_tasks_equal_the_walk(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(10**18) // 1000 * 1000, rng.randrange(3000), rng.randbytes(rng.choice([0, 1, 14, 60, 900]))) for _ in range(700)]
    path = str(tmp_path / "x.pcap")
    for big in (False, True):
        write_pcap(path, rows, True, big)
        want = [(k, ts, max(w, len(d)), d) for k, (ts, w, d) in enumerate(rows)]
        for size in (100, 5_000, 1 << 30):
            for read in (read_captures(spark, path, range_bytes=size), spark.read.format("pcap").option("rangeBytes", size).load(path)):
                assert sorted((r.record_no, r.ts_ns, r.wirelen, bytes(r.data)) for r in read.collect()) == want
    whole = open(path, "rb").read()
    for cut in (len(whole) - 1, len(whole) - 700, 30):  # damage ends a file, and what is before it counts
        open(path, "wb").write(whole[:cut])
        n = open_survey(path)[0].records
        assert read_captures(spark, path).count() == spark.read.format("pcap").load(path).count() == n < 700


@pytest.mark.parametrize(("nsec", "big"), [(False, True), (True, False)])
def test_sink(spark, tmp_path, nsec, big):
    register(spark)
    rows = [(k * 10**9 + 7_000, 100, bytearray([k % 250]) * (k % 90)) for k in range(500)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "ts_ns long, wirelen long, data binary, k long").repartitionByRange(3, "k").sortWithinPartitions("k")
    folder = str(tmp_path / "out")
    df.select("ts_ns", "wirelen", "data").write.format("pcap").mode("append").option("nsec", nsec).option("bigEndian", big).save(folder)
    got = sorted((r.ts_ns, r.wirelen, bytes(r.data)) for r in spark.read.format("pcap").load(folder).collect())
    assert got == sorted((ts, w, bytes(d)) for ts, w, d in rows)
    assert {(f.nsec, f.big_endian, f.status) for f in spark.read.format("pcap").option("table", "files").load(folder).collect()} == {(nsec, big, "EOF")}


def test_stream_and_walk(spark, tmp_path):
    path = str(tmp_path / "s.pcap")
    write_pcap(path, [(r[2], r[4], r[5]) for r in mixed()])
    stream = open(path, "rb")
    records, files = read_stream(spark, stream, "pipe")
    assert stream.closed and [(f.file, f.records, f.status) for f in files.collect()] == [("pipe", 11, "EOF")]
    flows = Analysis.of_records(records).flows()
    assert [r.bytes for r in W.each(flows)] == sorted((r.bytes for r in flows.collect()), reverse=True)
    with pytest.raises(ValueError):
        W.top(flows, 1_000_001)
    assert W.top(flows, 0).count() == 0


def test_decoder_takes_odd_tables(spark):
    df = spark.createDataFrame([("f", 0, 5, 0, None, None, 9, "x"), ("f", 1, 5, 60, 60, bytearray(60), 9, "x"), ("f", 1, 5, 60, 60, bytearray(60), 9, "x")], "file string, record_no long, ts_ns long, caplen int, wirelen long, data binary, STATUS int, extra string")
    got = decode_frames(df, fields=["status", "has_l2"])
    assert got.columns == ["file", "record_no", "ts_ns", "caplen", "wirelen", "extra", "status", "has_l2"]
    assert sorted((r.record_no, r.status, r.has_l2) for r in got.collect()) == [(0, CODE["BAD_SHORT_FRAME"], False), (1, 0, True), (1, 0, True)]
    assert not decode_frames(df.limit(0)).collect()


def test_traffic_is_seeded_and_mixed(spark):
    one, two = (traffic(spark, 4_000, 300, 0.5, seed=3, partitions=p) for p in (1, 5))
    key = lambda df: sorted((r.record_no, r.ts_ns, bytes(r.data)) for r in df.collect())
    assert key(one) == key(two) != key(traffic(spark, 4_000, 300, 0.5, seed=4))
    a = Analysis.of_records(one)
    c = a.counters().first()
    assert c.packets == 4_000 and c.malformed == c.truncated == c.gtp_malformed == c.gtp_truncated == 0 and c.non_ip and c.vlan_tagged and c.icmp and 0.3 < c.gtp_gpdu / 4_000 < 0.7
    assert c.gtp_inner_tcp and c.gtp_inner_udp and a.tunnels().count() > 100 and a.flows().count() > 50
    assert not traffic(spark, 100, 10).where("octet_length(data) < 60 OR caplen <> wirelen").count() and not traffic(spark, 0, 1).count()
    a.free()


def test_command_line(tmp_path):
    run = lambda *a: main(list(a), None, io.StringIO(), io.StringIO())
    assert run("-h") == 0 and run() == run("-n") == run("-n", "x", "f") == run("-n", "1000001", "f") == run("-n", "-1", "f") == run("--csv") == run("--bad", "f") == run("f", "g") == 1
    assert run("--csv", "f", "f") == run("--csv", "o", "--tunnels-csv", "o", "f") == 1
    assert run(str(tmp_path / "missing.pcap")) == 2
    assert parse(["-"])["path"] == "-" and parse(["-n", "0", "f"])["n"] == 0
