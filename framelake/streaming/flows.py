"""An extension beyond batch captures: running flow totals over a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decode import decode_frames
from ..operators.flows import KEY, in_flow, with_flow_key


def running_flows(records: DataFrame) -> DataFrame:
    """Flow totals for ``outputMode("update")`` or ``"complete"`` from a streaming table of records.

    The decoder looks at one row alone and so runs in a stream as it is. Later fragments keep ports 0 here: borrowing
    ports needs the order of records, which a stream doesn't promise. State grows with the number of flows.
    """
    keyed = with_flow_key(decode_frames(records).where(in_flow()))
    return keyed.groupBy(*KEY).agg(F.count("*").alias("packets"), F.sum("wirelen").alias("bytes"), F.min("ts_ns").alias("first_ts_ns"), F.max("ts_ns").alias("last_ts_ns"))
