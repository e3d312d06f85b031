"""Text forms as column expressions; only IPv6 addresses, on the few rows that are shown or exported, need Python."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import ICMP, ICMPV6, TCP, UDP

NS = 1_000_000_000
#: Letters of TCP flags from bit 0 on.
FLAG_LETTERS = "FSRPAUEC"


def format_ipv4(addr: bytes) -> str:
    return ".".join(str(b) for b in addr[:4])


def format_ipv6(addr: bytes) -> str:
    """RFC 5952: lower case, the longest run of two or more zero groups (the first of equals) as ``::``; mapped IPv4 dotted."""
    if addr[:12] == bytes(10) + b"\xff\xff":
        return "::ffff:" + format_ipv4(addr[12:])
    groups = [addr[i] << 8 | addr[i + 1] for i in range(0, 16, 2)]
    best, length, run = -1, 1, 0
    for i, g in enumerate(groups):
        run = 0 if g else run + 1
        if run > length:
            best, length = i - run + 1, run
    words = [f"{g:x}" for g in groups]
    if best < 0:
        return ":".join(words)
    return ":".join(words[:best]) + "::" + ":".join(words[best + length :])


def format_address(version: int, addr: bytes) -> str:
    return format_ipv4(addr) if version == 4 else format_ipv6(addr)


@F.pandas_udf(StringType())
def _ipv6(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for addr in batches:
        yield addr.map(lambda a: None if a is None else format_ipv6(bytes(a)))


def address(version: Column, addr: Column) -> Column:
    """Address text; IPv4 stays in the JVM."""
    part = lambda i: F.conv(F.hex(F.substring(addr, i, 1)), 16, 10)
    return F.when(version == 4, F.concat_ws(".", *map(part, (1, 2, 3, 4)))).otherwise(_ipv6(F.when(version == 6, addr)))


def protocol(proto: Column) -> Column:
    known = F.when(proto == TCP, "TCP").when(proto == UDP, "UDP").when(proto == ICMP, "ICMP").when(proto == ICMPV6, "ICMPv6")
    return known.otherwise(proto.cast("string"))


def tcp_flags(flags: Column) -> Column:
    return F.concat(*[F.when(flags.bitwiseAND(1 << bit) != 0, letter).otherwise("") for bit, letter in enumerate(FLAG_LETTERS)])


def endpoint(version: Column, proto: Column, addr_text: Column, port: Column) -> Column:
    """``a:p`` or ``[v6]:p`` for TCP and UDP, the bare address for others."""
    with_port = F.when(version == 6, F.concat(F.lit("["), addr_text, F.lit("]:"), port)).otherwise(F.concat(addr_text, F.lit(":"), port))
    return F.when(proto.isin(TCP, UDP), with_port).otherwise(addr_text)


def seconds(ns: Column, digits: int = 9) -> Column:
    """``sec.fraction``, cut off after ``digits``, never rounded."""
    step = 10 ** (9 - digits)
    return F.concat(div(ns, NS).cast("string"), F.lit("."), F.lpad(div(F.pmod(ns, F.lit(NS)), step).cast("string"), digits, "0"))


def div(a: Column, b: int) -> Column:
    """Whole division."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def teid_text(teid: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(teid)), 8, "0"))
