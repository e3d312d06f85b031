"""The whole analysis of a capture as lazy tables over one decoded, persisted packet table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counters as C
from ..operators import flows as W
from ..operators.decode import decode_frames
from ..operators.fragments import attribute, once
from ..sources.pcap import read_captures


@dataclass
class Analysis:
    """``packets`` are attributed; ``decoded`` is what is kept (None: nothing is)."""

    packets: DataFrame
    decoded: DataFrame | None = None

    @classmethod
    def of_records(cls, records: DataFrame, lossless: bool = False, persist: bool = True) -> Analysis:
        """Decode once and keep the packets (``persist``), or decode again in each table."""
        decoded = decode_frames(records)
        if not persist:
            return cls(attribute(decoded, lossless))
        kept = once(decoded)
        return cls(attribute(kept, lossless), kept)

    @classmethod
    def of_capture(cls, spark: SparkSession, *paths: str, **options) -> Analysis:
        """Of files, folders or patterns, that every machine sees."""
        return cls.of_records(read_captures(spark, *paths), **options)

    @classmethod
    def of_packets(cls, packets: DataFrame, lossless: bool = False) -> Analysis:
        """Of decoded packets that were stored, say as parquet by ``store``: for many queries over a large capture."""
        return cls(attribute(packets, lossless))

    @staticmethod
    def store(records: DataFrame, path: str) -> None:
        """Decode once and for all."""
        decode_frames(records).write.parquet(path)

    def counters(self) -> DataFrame:
        return C.counters(self.packets)

    def problems(self) -> DataFrame:
        return C.problems(self.packets)

    def gtp_problems(self) -> DataFrame:
        return C.problems(self.packets, "gtp_status", F.col("is_gtpu"))

    def flows(self) -> DataFrame:
        return W.flows(self.packets)

    def tunnels(self) -> DataFrame:
        """Of packets as decoded: a tunnel takes whole packets only."""
        return W.tunnels(self.packets if self.decoded is None else self.decoded)

    def free(self) -> None:
        if self.decoded is not None:
            self.decoded.unpersist()
