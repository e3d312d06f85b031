"""A seeded generator of traffic: what record k holds follows from k and the seed alone, so any part can be made anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .synth import h

#: Parts of a thousand flows by kind, of flows with one and two VLAN tags, and the time and the gap of packets.
MIX = (("tcp", 600), ("dns", 200), ("bulk", 80), ("ping", 90), ("arp", 30))
ONE_TAG, TWO_TAGS = 80, 20
START_S, MEAN_GAP_NS = 1_700_000_000, 510_000
#: Bytes that payloads are cut from.
FILL = bytes(range(256)) * 6


def traffic(spark: SparkSession, packets: int, flows: int, gtp_fraction: float = 0.0, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """Records in the order of time: ``flows`` conversations of very unequal size, a share of them inside GTP-U tunnels.

    TCP segments are full or bare, DNS and ping packets small, bulk UDP large; frames have 60 bytes at least.
    """
    if not 0 <= gtp_fraction <= 1 or flows < 1 or packets < 0:
        raise ValueError("gtp_fraction must be from 0 to 1, flows 1 or more, packets 0 or more")
    chance = lambda *of: F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(1_000_000)) / F.lit(1e6)
    rows = spark.range(0, packets, numPartitions=partitions).select(F.col("id").alias("k"))
    rows = rows.withColumn("flow", F.floor(F.lit(flows) * F.pow(chance(F.col("k"), F.lit("flow")), F.lit(2.0))))
    rows = rows.withColumns({"up": chance(F.col("k"), F.lit("up")) < 0.5, "part": F.floor(chance(F.col("flow"), F.lit("kind")) * 1000), "tags": F.floor(chance(F.col("flow"), F.lit("tag")) * 1000), "spread": chance(F.col("k"), F.lit("size"))})
    rows = rows.withColumn("gtp", (chance(F.col("flow"), F.lit("gtp")) < gtp_fraction) & (F.col("part") < 970))
    kind, low = F.lit("arp"), 0
    for name, share in MIX[:-1]:
        kind = F.when(F.col("part").between(low, low + share - 1), name).otherwise(kind)
        low += share
    rows = rows.withColumn("kind", kind)
    s = F.col("spread")
    size = F.when(F.col("kind") == "tcp", F.when(s < 0.55, 1400).when(s < 0.6, F.floor(s * 1400)).otherwise(0)).when(F.col("kind") == "dns", 30 + F.floor(s * 120)).when(F.col("kind") == "bulk", 1000 + F.floor(s * 400)).otherwise(56).cast("int")
    rows = rows.withColumn("size", F.when(F.col("kind") == "arp", 46).otherwise(size))
    return _frames(rows)


def _frames(rows: DataFrame) -> DataFrame:
    up, flow, size = F.col("up"), F.col("flow"), F.col("size").cast("long")
    pick = lambda a, b: F.when(up, a).otherwise(b)
    here, there = F.concat(F.lit("0A"), h(flow % 16_000_000, 6)), F.concat(F.lit("C6"), h(F.lit(51 << 16) + flow % 60_000, 6))
    port = F.lit(20_000) + flow % 40_000
    far = F.when(F.col("kind") == "tcp", 443).when(F.col("kind") == "dns", 53).otherwise(4789).cast("long")
    ports = F.concat(h(pick(port, far), 4), h(pick(far, port), 4))
    flags = F.when(size == 0, "10").otherwise("18")
    head4 = F.when(F.col("kind") == "tcp", F.concat(ports, F.lit("0000000100000001" + "50"), flags, F.lit("FFFF00000000"))).when(F.col("kind") == "ping", F.concat(pick(F.lit("08"), F.lit("00")), F.lit("000000" + "00420001"))).otherwise(F.concat(ports, h(size + 8, 4), F.lit("0000")))
    l4 = F.when(F.col("kind") == "tcp", 20).otherwise(8).cast("long")
    proto = F.when(F.col("kind") == "tcp", 6).when(F.col("kind") == "ping", 1).otherwise(17).cast("long")
    ip = lambda number, total, a, b: F.concat(F.lit("4500"), h(total, 4), F.lit("00004000" + "40"), h(number, 2), F.lit("0000"), a, b)
    user = F.concat(ip(proto, size + l4 + 20, pick(here, there), pick(there, here)), head4)
    inside = size + l4 + 20
    ran, core = F.concat(F.lit("AC1400"), h(flow % 4 + 1, 2)), F.lit("AC140064")
    teid = flow * 2 + pick(F.lit(1), F.lit(2))
    outer = F.concat(ip(F.lit(17).cast("long"), inside + 36, pick(ran, core), pick(core, ran)), F.lit("08680868"), h(inside + 16, 4), F.lit("0000" + "30FF"), h(inside, 4), h(teid, 8))
    body = F.when(F.col("kind") == "arp", "").when(F.col("gtp"), F.concat(outer, user)).otherwise(user)
    tags = F.when(F.col("tags") < TWO_TAGS, F.concat(F.lit("88A80064" + "8100"), h(flow % 4000, 4))).when(F.col("tags") < TWO_TAGS + ONE_TAG, F.concat(F.lit("8100"), h(flow % 4000, 4))).otherwise("")
    head = F.concat(F.lit("020000000002020000000001"), tags, F.when(F.col("kind") == "arp", "0806").otherwise("0800"), body)
    whole = F.concat(F.unhex(head), F.substring(F.lit(FILL), F.lit(1), F.col("size")))
    short = F.greatest(F.lit(60) - F.octet_length(whole), F.lit(0))
    made = rows.withColumn("data", F.concat(whole, F.substring(F.lit(bytes(60)), F.lit(1), short)))
    ts = F.lit(START_S * 1_000_000_000) + F.col("k") * MEAN_GAP_NS + F.floor(F.col("spread") * 400) * 1000
    n = F.octet_length("data")
    return made.select(F.lit("traffic").alias("file"), F.col("k").alias("record_no"), ts.cast("long").alias("ts_ns"), n.alias("caplen"), n.cast("long").alias("wirelen"), "data")
