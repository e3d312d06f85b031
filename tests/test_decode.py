import random

import numpy as np
import pytest

from framelake.operators.decode import decode
from framelake.schema import CODE

from . import scalar
from .builder import eth, record, seeds, tcp, udp, v4, v6, vlan, fragment, hop_by_hop, tunnel, gtp, option, extension


def vector(frames: list[tuple[bytes, int]], tail: bytes = b"") -> list[dict]:
    data = b"".join(f + tail for f, _ in frames) + b"\0"
    caps = np.array([len(f) for f, _ in frames])
    at = np.concatenate([[0], np.cumsum(caps + len(tail))[:-1]])
    found = decode(np.frombuffer(data, np.uint8), at, caps, np.array([w for _, w in frames]))
    rows = []
    for i in range(len(frames)):
        row = {k: (v[i].tobytes() if v.ndim == 2 and k != "vlan_ids" else v[i].tolist()) for k, v in found.items() if k != "frag_slot"}
        row["vlan_ids"] = row["vlan_ids"][: row["vlan_count"]]
        rows.append(row)
    return rows


def agree(frames):
    got = vector(frames)
    assert got == vector(frames, b"\xff\x81\x45\x08"), "bytes past the capture must not matter"
    for (frame, wire), row in zip(frames, got, strict=True):
        want = scalar.decode(frame, wire)
        assert {k: row[k] for k in want} == want, (frame.hex(), wire)
    return got


def test_every_prefix_complete_and_cut():
    frames = [(f[:n], w) for f in seeds() for n in range(len(f) + 1) for w in (n, len(f), len(f) + 500)]
    rows = agree(frames)
    for (frame, wire), r in zip(frames, rows, strict=True):
        if wire <= len(frame):
            assert not 1 <= r["status"] <= 11 and not 1 <= r["gtp_status"] <= 11


def test_mutations():
    rng = random.Random(7)
    frames = []
    for _ in range(6000):
        f = bytearray(rng.choice(seeds()))
        for _ in range(rng.randrange(1, 5)):
            f[rng.randrange(len(f))] = rng.choice([0, 1, 4, 5, 6, 17, 44, 60, 255, rng.randrange(256)])
        n = rng.choice([len(f), rng.randrange(len(f) + 1)])
        frames.append((bytes(f[:n]), rng.choice([n, len(f), 1514])))
    for r in agree(frames):
        assert 0 <= r["status"] <= 8 or 12 <= r["status"] <= 22
        assert r["vlan_count"] <= 2 and (not r["has_l4"] or r["has_l3"]) and (not r["has_l3"] or r["has_l2"])
        assert not (r["frag"] == 2 and r["has_l4"]) and (r["status"] or r["has_l2"])
        assert not r["is_gtpu"] or (r["status"] == 0 and r["frag"] == 0 and 2152 in (r["src_port"], r["dst_port"]))
        assert not r["gtp_v1u"] or r["gtp_msg_ok"] == (r["gtp_status"] not in (9, 10, 23, 24, 25))
        assert not r["has_inner"] or (r["gtp_msg_ok"] and r["gtp_msg_type"] == 255)
        assert r["gtp_ext_count"] <= 16


@pytest.mark.parametrize(
    ("frame", "wire", "status"),
    [
        (eth(0x8100, vlan(1, 0x8100, vlan(2, 0x88A8, vlan(3, 0x0800, v4(6, tcp(1, 2, 2)))))), 0, "BAD_VLAN_DEPTH"),
        (eth(0x0800, v6(6, tcp(1, 2, 2))), 0, "BAD_IPV4_VERSION"),
        (eth(0x86DD, v4(6, tcp(1, 2, 2), total=0) + bytes(30)), 0, "BAD_IPV6_VERSION"),
        (eth(0x0800, v4(6, tcp(1, 2, 2), ihl=3)), 0, "BAD_IPV4_IHL"),
        (eth(0x0800, v4(6, tcp(1, 2, 2), total=19)), 0, "BAD_IPV4_TOTAL_LEN"),
        (eth(0x0800, v4(6, tcp(1, 2, 2), total=0)), 0, "OK"),
        (eth(0x0800, v4(6, tcp(1, 2, 2, offset=4))), 0, "BAD_TCP_DOFF"),
        (eth(0x0800, v4(17, udp(1, 2, size=7))), 0, "BAD_UDP_LEN"),
        (eth(0x0800, v4(17, udp(1, 2, b"x" * 8, size=900), word=0x2000)), 0, "OK"),
        (eth(0x86DD, v6(6, tcp(1, 2, 2), size=100)), 0, "BAD_IPV6_PAYLOAD_LEN"),
        (eth(0x86DD, v6(6, tcp(1, 2, 2), size=0)), 0, "BAD_L4_LEN"),
        (eth(0x86DD, v6(0, hop_by_hop(6, 4)[:8])), 0, "BAD_IPV6_EXT"),
        (eth(0x86DD, v6(44, fragment(6, 0) + tcp(1, 2, 2))), 0, "OK"),
        (eth(0x0800, v4(6, tcp(1, 2, 2)))[:40], 200, "TRUNC_TCP"),
    ],
)
def test_statuses(frame, wire, status):
    (row,) = agree([(frame, max(wire, len(frame)))])
    assert row["status"] == CODE[status]


def test_gtpu_limits():
    inner = v4(6, tcp(1, 2, 2))
    many = lambda n: tunnel(gtp(255, 1, option(0, 1) + b"".join(extension(1, 1 if k < n - 1 else 0) for k in range(n)) + inner, 0x34))
    a, b, c, d, e = agree([(f, len(f)) for f in (many(16), many(17), tunnel(b"1234567"), tunnel(gtp(255, 1, inner, 0x20)), tunnel(gtp(255, 1, option(0, 1) + b"\0" * 8, 0x34)))])
    assert (a["gtp_status"], a["gtp_ext_count"]) == (0, 16) and (b["gtp_status"], b["gtp_ext_count"]) == (CODE["BAD_GTPU_EXT"], 16)
    assert not c["is_gtpu"] and d["is_gtpu"] and not d["gtp_v1u"] and d["teid"] == 0 and e["gtp_status"] == CODE["BAD_GTPU_EXT_LEN"]


def test_record_helper():
    assert record(b"abc", 1.5, 2, 10) == ("t", 2, 1_500_000_000, 3, 10, b"abc")
