"""Classic libpcap captures: header checks, the record walk, scans of files, folders and bytes in memory, and a sink.

Records are length-prefixed and nothing marks where one starts, so a file is walked from its start (one length a record),
which finds its end or its first damage. A file of up to one range is walked by the task that reads it. Larger ones are walked
first, ``read_captures`` does that in tasks too, and their ranges are then read in parallel. Damage ends a file: records
before it count, and the file's status says what happened.
"""

from __future__ import annotations

import glob
import json
import mmap
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..schema import FILES, READER_STATUSES, RECORDS

HEADER, RECORD_HEADER = 24, 16
#: First four bytes, as they lie in the file -> byte order and nanosecond times.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", False), b"\x4d\x3c\xb2\xa1": ("<", True), b"\xa1\xb2\xc3\xd4": (">", False), b"\xa1\xb2\x3c\x4d": (">", True)}
PCAPNG = b"\x0a\x0d\x0d\x0a"
ETHERNET, LINKTYPE_MASK, MOST_CAPLEN = 1, 0x03FFFFFF, 262_144
RANGE_BYTES = 32 << 20
RECORDS_ARROW = pa.schema([("file", pa.string()), ("record_no", pa.int64()), ("ts_ns", pa.int64()), ("caplen", pa.int32()), ("wirelen", pa.int64()), ("data", pa.binary())])
BATCH_BYTES = 8 << 20
#: Files that the driver walks at the same time; it waits for the disk, mostly.
WALKERS = 16


@dataclass(frozen=True)
class FileInfo:
    file: str
    big_endian: bool = False
    nsec: bool = False
    version_major: int = 0
    version_minor: int = 0
    snaplen: int = 0
    linktype: int = 0
    records: int = 0
    status: str = "OK"
    error_text: str = ""

    def ended(self, status: str) -> FileInfo:
        return replace(self, status=status, error_text="" if status in ("OK", "EOF") else READER_STATUSES[status])

    @property
    def order(self) -> str:
        return ">" if self.big_endian else "<"


def parse_header(head: bytes, file: str = "") -> FileInfo:
    """Check a global header. The magic comes first, so that short files of another kind are called that."""
    info = FileInfo(file)
    if len(head) < 4:
        return info.ended("SHORT_HEADER")
    if head[:4] == PCAPNG:
        return info.ended("PCAPNG")
    if head[:4] not in MAGICS:
        return info.ended("BAD_MAGIC")
    order, nsec = MAGICS[head[:4]]
    info = replace(info, big_endian=order == ">", nsec=nsec)
    if len(head) < HEADER:
        return info.ended("SHORT_HEADER")
    major, minor, _, _, snaplen, linktype = struct.unpack(order + "HHIIII", head[4:HEADER])
    info = replace(info, version_major=major, version_minor=minor, snaplen=snaplen, linktype=linktype & LINKTYPE_MASK)
    if (major, minor) != (2, 4):
        return info.ended("BAD_VERSION")
    return info if info.linktype == ETHERNET else info.ended("BAD_LINKTYPE")


def headers(data, info: FileInfo, at: int = HEADER, most: int = 1 << 62) -> tuple[list[int], int, str | None]:
    """Offsets of the record headers of whole records, from ``at`` on; where the walk stopped, after about ``most`` bytes or at the end; and how it ended (None: it goes on)."""
    size, length = len(data), struct.Struct(info.order + "I").unpack_from
    found: list[int] = []
    add, stop = found.append, at + most
    while at < stop:
        if at + RECORD_HEADER > size:
            return found, at, "EOF" if at == size else "TRUNC_RECORD_HDR"
        (caplen,) = length(data, at + 8)
        if caplen > MOST_CAPLEN:
            return found, at, "BAD_CAPLEN"
        if at + RECORD_HEADER + caplen > size:
            return found, at, "TRUNC_RECORD"
        add(at)
        at += RECORD_HEADER + caplen
    return found, at, None


@dataclass
class Range(InputPartition):
    """Whole records of one file: bytes start to end (-1: to where the file ends or is damaged), the first of them number first."""

    file: str
    first: int
    start: int
    end: int
    info: FileInfo


def survey(data, file: str, range_bytes: int = RANGE_BYTES) -> tuple[FileInfo, list[Range]]:
    """Walk a whole capture: its file row and the ranges to read."""
    info = parse_header(bytes(data[:HEADER]), file)
    if info.status != "OK":
        return info, []
    ranges, start, first, ended = [], HEADER, 0, None
    while ended is None:
        found, after, ended = headers(data, info, start, range_bytes)
        if found:
            ranges.append((first, start, after))
        first, start = first + len(found), after
    info = replace(info.ended(ended), records=first)
    return info, [Range(file, f, s, e, info) for f, s, e in ranges]


def _batches(data, base: int, part: Range) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the records in ``data``, which starts at offset ``base`` of its file. Bodies are copied once, all at a time."""
    at, number = part.start - base, part.first
    end = len(data) if part.end < 0 else part.end - base
    view = memoryview(data)[:end]
    every = np.frombuffer(view, np.uint8)
    word = np.dtype(part.info.order + "u4")
    ended = None
    while ended is None and at < end:
        found, after, ended = headers(view, part.info, at, BATCH_BYTES)
        if not found:
            break
        place = np.array(found, np.int64)
        head = every[place[:, None] + np.arange(RECORD_HEADER)].view(word).astype(np.int64)
        body = np.ones(after - at, bool)
        body[(place - at)[:, None] + np.arange(RECORD_HEADER)] = False
        caplen = head[:, 2]
        bounds = np.concatenate([[0], np.cumsum(caplen)]).astype(np.int32)
        bodies = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(bounds), pa.py_buffer(every[at:after][body])])
        ts = head[:, 0] * 1_000_000_000 + head[:, 1] * (1 if part.info.nsec else 1000)
        columns = [pa.array(np.full(len(place), part.file, object), pa.string()), np.arange(number, number + len(place)), ts, caplen.astype(np.int32), np.maximum(caplen, head[:, 3])]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), bodies], schema=RECORDS_ARROW)
        number, at = number + len(place), after


def open_survey(path: str, range_bytes: int = RANGE_BYTES) -> tuple[FileInfo, list[Range]]:
    """Survey a file by its path; a file that can't be opened or read has that as its status."""
    try:
        size = os.path.getsize(path)
        with open(path, "rb") as f:
            if not size:
                return parse_header(b"", path), []
            with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                return survey(data, path, range_bytes)
    except FileNotFoundError as error:
        return replace(FileInfo(path).ended("OPEN"), error_text=f"{READER_STATUSES['OPEN']}: {error.strerror}"), []
    except OSError as error:
        status = "OPEN" if isinstance(error, PermissionError) else "IO"
        return replace(FileInfo(path).ended(status), error_text=f"{READER_STATUSES[status]}: {error.strerror}"), []


def expand(path: str) -> list[str]:
    """A file, the captures of a folder, or a pattern. A name that exists is never a pattern; one that matches nothing stays, and so gets a status."""
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(os.path.join(glob.escape(path), "*")) if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_")))
    return [path] if os.path.exists(path) else sorted(glob.glob(path)) or [path]


def plain_path(path: str) -> str:
    """A path as Python opens it, of one that Spark names file:/x or file:///x."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:/") else path


class PcapReader(DataSourceReader):
    def __init__(self, options):
        paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.paths = [p for x in paths for p in expand(plain_path(x))]
        self.files = options.get("table", "records") == "files"
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def _ranges(self, path: str) -> list[Range]:
        """A small file is one range that its task walks; a large one is walked here."""
        try:
            if os.path.getsize(path) <= self.range_bytes:
                return [Range(path, 0, HEADER, -1, FileInfo(path))]
        except OSError:
            return []
        return open_survey(path, self.range_bytes)[1]

    def partitions(self):
        if self.files:
            return [InputPartition(p) for p in self.paths] or [InputPartition(None)]
        with ThreadPoolExecutor(WALKERS) as pool:
            return [r for ranges in pool.map(self._ranges, self.paths) for r in ranges] or [InputPartition(None)]

    def read(self, partition):
        if self.files:
            if partition.value is not None:
                yield tuple(asdict(open_survey(partition.value)[0]).values())
        elif isinstance(partition, Range):
            yield from read_range(partition)


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    with open(part.file, "rb") as f:
        if part.end < 0:
            info = parse_header(f.read(HEADER), part.file)
            if info.status == "OK":
                yield from _batches(f.read(), HEADER, replace(part, info=info))
        else:
            f.seek(part.start)
            yield from _batches(f.read(part.end - part.start), part.start, part)


@dataclass
class Written(WriterCommitMessage):
    path: str


class PcapWriter(DataSourceArrowWriter):
    """Each task writes its records, in their order, as one capture; a name that starts with a dot until all tasks are done."""

    def __init__(self, options, overwrite: bool):
        self.folder = plain_path(options["path"])
        self.order = ">" if options.get("bigendian", options.get("bigEndian", "false")).lower() == "true" else "<"
        self.nsec = options.get("nsec", "false").lower() == "true"
        self.snaplen = int(options.get("snaplen", 65_535))
        if overwrite:
            shutil.rmtree(self.folder, ignore_errors=True)
        os.makedirs(self.folder, exist_ok=True)

    def write(self, iterator):
        from pyspark import TaskContext

        path = os.path.join(self.folder, f".part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.pcap")
        with open(path, "wb") as f:
            f.write(struct.pack(self.order + "IHHIIII", 0xA1B23C4D if self.nsec else 0xA1B2C3D4, 2, 4, 0, 0, self.snaplen, ETHERNET))
            for batch in iterator:
                ts = batch.column("ts_ns").to_numpy(zero_copy_only=False)
                wire = batch.column("wirelen").to_numpy(zero_copy_only=False)
                for ns, n, data in zip(ts.tolist(), wire.tolist(), batch.column("data").to_pylist(), strict=True):
                    f.write(struct.pack(self.order + "IIII", ns // 1_000_000_000, ns % 1_000_000_000 // (1 if self.nsec else 1000), len(data), n) + data)
        return Written(path)

    def commit(self, messages):
        for m in messages:
            if m is not None:
                os.rename(m.path, os.path.join(self.folder, os.path.basename(m.path)[1:]))

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class PcapSource(DataSource):
    """``spark.read.format("pcap").option("table", "records" or "files").load(path)`` over paths that every machine sees.

    ``paths`` (a JSON list) names several; ``df.write.format("pcap").option("nsec", True).save(folder)`` writes ts_ns, wirelen and data.
    """

    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return FILES if self.options.get("table", "records") == "files" else RECORDS

    def reader(self, schema):
        return PcapReader(self.options)

    def writer(self, schema, overwrite):
        return PcapWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)


RANGE_DDL = "file string, first bigint, start bigint, end bigint, big_endian boolean, nsec boolean"


def read_captures(spark: SparkSession, *paths: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of files, folders and patterns: tasks walk the files, each its own, and then read ranges, dealt evenly.

    The driver holds names only. Only ranges (file, bounds) are shuffled, never a packet.
    """
    names = [p for x in paths for p in expand(plain_path(x))]

    def walk(batches):
        for batch in batches:
            rows = [(r.file, r.first, r.start, r.end, r.info.big_endian, r.info.nsec) for p in batch.column("file").to_pylist() for r in open_survey(p, range_bytes)[1]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], names=[x.split()[0] for x in RANGE_DDL.split(", ")])

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from read_range(Range(r["file"], r["first"], r["start"], r["end"], FileInfo(r["file"], r["big_endian"], r["nsec"])))

    size = sum(os.path.getsize(p) for p in names if os.path.isfile(p))
    cores = spark.sparkContext.defaultParallelism
    # sizes and times are part of the plan, so that nothing kept of an earlier state of the files is taken for them
    stamps = [f"{os.path.getsize(p)} {os.stat(p).st_mtime_ns}" if os.path.isfile(p) else "" for p in names]
    files = spark.createDataFrame(pa.table({"file": pa.array(names, pa.string()), "stamp": pa.array(stamps, pa.string())})).repartition(max(1, min(len(names), 4 * cores)), "file")
    ranges = files.mapInArrow(walk, RANGE_DDL)
    return ranges.repartition(max(1, min(4096, size // range_bytes + 1, 64 * cores)), "file", "start").mapInArrow(read, RECORDS)


def records_of_bytes(captures: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Records of captures held in a binary column, as ``binaryFile`` reads them from any store; null bytes are an empty file."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(path).to_pylist(), batch.column(content), strict=True):
                view = memoryview(data.as_buffer()) if data.is_valid else memoryview(b"")
                info = parse_header(bytes(view[:HEADER]), name)
                if info.status == "OK":
                    yield from _batches(view, 0, Range(name, 0, HEADER, -1, info))

    return captures.select(path, content).mapInArrow(run, RECORDS)


def files_of_bytes(captures: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [list(asdict(survey(memoryview(d.as_buffer()) if d.is_valid else b"", n, 1 << 62)[0]).values()) for n, d in zip(batch.column(path).to_pylist(), batch.column(content), strict=True)]
            kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FILES.split(", ")])

    return captures.select(path, content).mapInArrow(run, FILES)


def read_stream(spark: SparkSession, stream, name: str = "stream") -> tuple[DataFrame, DataFrame]:
    """(records, files) of a capture from an open binary stream, say a pipe; it is read to its end and closed, and is one binary value."""
    with stream:
        content = stream.read()
    captures = spark.createDataFrame(pa.table({"path": pa.array([name]), "content": pa.array([content], pa.binary())}))
    return records_of_bytes(captures), files_of_bytes(captures)


def read_anywhere(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, files) of captures in any store Spark can read; each file is one binary value, so of 2 GB at most, read by one task."""
    captures = spark.read.format("binaryFile").load(path).select("path", "content")
    return records_of_bytes(captures), files_of_bytes(captures)


def write_pcap(path: str, records, nsec: bool = False, big_endian: bool = False, snaplen: int = 65_535) -> int:
    """Write (ts_ns, wirelen, data) rows as a capture on the driver; returns how many."""
    order = ">" if big_endian else "<"
    n = 0
    with open(path, "wb") as f:
        f.write(struct.pack(order + "IHHIIII", 0xA1B23C4D if nsec else 0xA1B2C3D4, 2, 4, 0, 0, snaplen, ETHERNET))
        for ts_ns, wirelen, data in records:
            fraction = ts_ns % 1_000_000_000
            f.write(struct.pack(order + "IIII", ts_ns // 1_000_000_000, fraction if nsec else fraction // 1000, len(data), wirelen) + bytes(data))
            n += 1
    return n
