"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import shared_dir

#: Paths of tables that ``cut`` wrote and nobody removed yet, in order.
WRITTEN: list[str] = []
#: Keys that hold more than this part of all rows are met by broadcast: there are fewer of them than that.
HOT_KEYS = 4096
#: Bytes of an Arrow batch between the JVM and Python; both sides hold several at a time.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a lineage cut that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.framelake_path = path
    WRITTEN.append(path)
    return back


def remove(spark: SparkSession, path: str) -> None:
    if path in WRITTEN:
        WRITTEN.remove(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_cut(*tables: DataFrame) -> None:
    """Remove what ``cut`` wrote, once nothing reads it any more."""
    for df in tables:
        remove(df.sparkSession, df.framelake_path)


def drop_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Remove what ``cut`` wrote since WRITTEN was ``mark`` long, but for ``keep``."""
    spared = {df.framelake_path for df in keep}
    for path in WRITTEN[mark:]:
        if path not in spared:
            remove(spark, path)


def others(df: DataFrame, *ours: str) -> list[str]:
    """Columns of ``df`` that aren't named as ours, whatever the case of their letters."""
    low = {name.lower() for name in ours}
    return [c for c in df.columns if c.lower() not in low]


def ddl(df: DataFrame, columns: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def literal(value: str, kind: str):
    """A JSON text as a constant of a Spark type; the optimizer folds it once."""
    return F.from_json(F.lit(value), kind)


def let(value, use):
    """``use(value)`` with ``value`` computed once for a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def release() -> None:
    """Give the pages that nothing uses back to the system: a worker stays for later tasks, and neither Arrow nor malloc does so by itself."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not everywhere
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of about ARROW_BYTES, or of one row; once its rows are through, a task leaves no unused memory in its worker.

    Spark bounds batches for a session only, so the session's bound is lowered to that (never raised), and stays so.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    most = int(df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name)))
    if not 0 < most <= ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(lean, schema)


def slices(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch with about so many bytes of text, or one text, and their texts: Python holds no more at once."""
    column = batch.column(text)
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at), column.slice(at, end - at).to_pylist()
        at = end


def join_spread(rows: DataFrame, values: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """``rows`` (of which there are ``total``) joined with ``values``, which has each key once and in ``n`` how many rows hold it.

    Keys of more than total / HOT_KEYS rows, fewer than HOT_KEYS of them, are broadcast; their rows stay where they are.
    Only rows of the others are shuffled, so none of the tasks gets a group that grows with the table. ``rows`` is read twice.
    """
    least = max(total // HOT_KEYS, 1)
    met = rows.join(F.broadcast(values.where(F.col(n) > least)), keys, "left")
    rest = met.where(F.col(n).isNull()).select(*rows.columns).join(values.where(F.col(n) <= least), keys)
    return met.where(F.col(n).isNotNull()).unionByName(rest)
