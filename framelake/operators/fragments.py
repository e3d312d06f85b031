"""Later fragments borrow the ports of their datagram's first fragment."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FIRST, LATER

DATAGRAM = ("ip_version", "ip_proto", "frag_id", "src_addr", "dst_addr")


def takes_part() -> Column:
    return (F.col("status") == 0) & F.col("has_l3") & (((F.col("frag") == FIRST) & F.col("has_l4")) | (F.col("frag") == LATER))


#: Fields of packets that attribution looks at.
NEEDED = ("status", "has_l3", "has_l4", "frag", "frag_slot", "src_port", "dst_port", *DATAGRAM)


def attribute(packets: DataFrame, lossless: bool = False) -> DataFrame:
    """``packets`` with frag_matched, and with ports filled in for matched later fragments.

    A later fragment looks at the most recent earlier first fragment of its file and slot, and takes its ports if it is
    of the same datagram. There are 4096 slots, so a newer datagram can have taken the slot: that is the fixed-memory
    result. ``lossless`` looks among the fragments of the datagram itself instead. Only fragments are shuffled.

    ``packets`` is read twice, for whole packets and for fragments; ``once`` keeps that from decoding twice.
    """
    out = [c for c in packets.columns if c.lower() != "frag_matched"]
    whole = packets.where(~takes_part()).select(*out, F.lit(False).alias("frag_matched"))
    keys = DATAGRAM if lossless else ("frag_slot",)
    before = Window.partitionBy("file", *keys).orderBy("record_no").rowsBetween(Window.unboundedPreceding, -1)
    first = F.when(F.col("frag") == FIRST, F.struct(*DATAGRAM, "src_port", "dst_port"))
    seen = packets.where(takes_part()).withColumn("first_seen", F.last(first, ignorenulls=True).over(before))
    same = F.lit(True)
    for name in DATAGRAM:
        same = same & (F.col(f"first_seen.{name}") == F.col(name))
    matched = (F.col("frag") == LATER) & F.coalesce(same, F.lit(False))
    ports = {p: F.when(F.col("frag_matched"), F.col(f"first_seen.{p}")).otherwise(F.col(p)) for p in ("src_port", "dst_port")}
    parts = seen.withColumn("frag_matched", matched).withColumns(ports)
    return whole.unionByName(parts.select(*out, "frag_matched"))


def once(packets: DataFrame) -> DataFrame:
    """Decoded packets kept, in memory as far as it goes and on local disk beyond, so that what reads them twice decodes them once."""
    return packets.persist(StorageLevel.MEMORY_AND_DISK)
