"""Media columns as TIFF: a writer, and a reader that walks image directories and emits one row per page."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ddl, others, slices, table

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, ROWS_PER_PAGE, TILE = 192, 256, (64, 16)
#: Samples of the largest page that is read; beyond, a few stored bytes could ask for any amount of memory.
MOST_PIXELS = 1 << 28
#: Field types of an image directory: size in bytes and struct letter.
TYPES = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 16: (8, "Q"), 17: (8, "q")}


class TiffError(ValueError):
    """The bytes are not a TIFF this reader can take apart."""


def packbits(data: bytes) -> bytes:
    """PackBits; runs of three and more are worth a run packet."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    cuts = np.flatnonzero(np.diff(a)) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(a)]
    out, literal = [], 0

    def flush(upto: int) -> None:
        for i in range(literal, upto, 128):
            part = data[i : min(i + 128, upto)]
            out.append(bytes([len(part) - 1]) + part)

    for i in np.flatnonzero(ends - starts >= 3):
        s, e = int(starts[i]), int(ends[i])
        flush(s)
        literal = e
        for j in range(s, e, 128):
            n = min(128, e - j)
            out.append(bytes([257 - n if n > 1 else 0, data[s]]))
    flush(len(data))
    return b"".join(out)


def unpackbits(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out.append(data[i + 1 : i + 2 + c])
            i += 2 + c
        else:
            if c > 128:
                out.append(data[i + 1 : i + 2] * (257 - c))
            i += 1 if c == 128 else 2
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from 9 bits, most significant bit first, one code early."""
    bits = held = 0
    out = bytearray()
    codes: dict[int, int] = {}  # code of a string << 8 | next byte -> code of both
    width = 9

    def put(code: int) -> None:
        nonlocal bits, held
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
        held &= (1 << bits) - 1

    def fresh() -> None:
        nonlocal codes, width
        put(256)
        codes, width = {}, 9

    fresh()
    size, prefix = 258, -1
    for c in data:
        if prefix < 0:
            prefix = c
        elif (longer := codes.get(key := prefix << 8 | c)) is not None:
            prefix = longer
        else:
            put(prefix)
            codes[key] = size
            size += 1
            if size + 1 > 1 << width:
                width += 1
            if size >= 4094:
                width = 12
                fresh()
                size = 258
            prefix = c
    if prefix >= 0:
        put(prefix)
        if size + 2 > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    out: list[bytes] = []
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    words: list[bytes] = []
    held = bits = 0
    width, mask, full, last = 9, 511, 511, b""
    add, emit = words.append, out.append
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & mask
        if code < 256 or code > 257:
            if last:
                known = len(words)
                if code < known:
                    word = words[code]
                    add(last + word[:1])
                elif code == known:
                    word = last + last[:1]
                    add(word)
                else:
                    raise TiffError("LZW code out of range")
            elif not words:
                raise TiffError("LZW data doesn't start with a clear code")
            elif code > 255:
                raise TiffError("LZW code out of range")
            else:
                word = words[code]
            emit(word)
            last = word
            if len(words) >= full and width < 12:
                width += 1
                mask = (1 << width) - 1
                full = mask
        elif code == 257:
            break
        else:
            words = base.copy()
            add = words.append
            width, mask, full, last = 9, 511, 511, b""
    return b"".join(out)


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


def difference(block: np.ndarray) -> np.ndarray:
    """Horizontal differencing of (rows, columns, samples)."""
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def undifference(block: np.ndarray) -> np.ndarray:
    return np.cumsum(block, axis=1, dtype=block.dtype)


def _packed(block: np.ndarray, compression: int, predictor: int) -> bytes:
    raw = (difference(block) if predictor == 2 else block).tobytes()
    return {NONE: bytes, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: packbits}[compression](raw)


def write(pages: list[dict]) -> bytes:
    """A little-endian TIFF. A page: pixels (rows, columns, samples) uint8, compression, predictor, rows (of a strip) or tile (width, length)."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for number, page in enumerate(pages):
        px = page["pixels"]
        height, width, samples = px.shape
        parts, tile = [], page.get("tile")
        if tile:
            tw, tl = tile
            for y in range(0, height, tl):
                for x in range(0, width, tw):
                    block = px[y : y + tl, x : x + tw]
                    full = np.zeros((tl, tw, samples), np.uint8)
                    full[: block.shape[0], : block.shape[1]] = block
                    parts.append(_packed(full, page["compression"], page["predictor"]))
        else:
            parts = [_packed(px[y : y + page["rows"]], page["compression"], page["predictor"]) for y in range(0, height, page["rows"])]
        offsets = []
        for part in parts:
            offsets.append(len(out))
            out += part
            out += b"\0" * (len(out) & 1)
        tags = [(254, 4, [2]), (256, 4, [width]), (257, 4, [height]), (258, 3, [8] * samples), (259, 3, [page["compression"]]), (262, 3, [2 if samples == 3 else 1]), (277, 3, [samples]), (284, 3, [1]), (297, 3, [number, len(pages)]), (317, 3, [page["predictor"]])]
        sizes = [len(x) for x in parts]
        tags += [(322, 4, [tile[0]]), (323, 4, [tile[1]]), (324, 4, offsets), (325, 4, sizes)] if tile else [(273, 4, offsets), (278, 4, [page["rows"]]), (279, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(tags):
            packed = struct.pack(f"<{len(values)}{TYPES[kind][1]}", *values)
            if len(packed) > 4:
                at = len(out)
                out += packed
                out += b"\0" * (len(out) & 1)
                packed = struct.pack("<I", at)
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _fields(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    if at + 2 > len(data):
        raise TiffError("a directory lies outside the file")
    (n,) = struct.unpack_from(order + "H", data, at)
    if at + 2 + 12 * n + 4 > len(data):
        raise TiffError("a directory is cut off")
    found = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in TYPES:
            continue
        size, letter = TYPES[kind]
        where = at + 10 + 12 * i if size * count <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        if where + size * count > len(data):
            raise TiffError(f"tag {tag} lies outside the file")
        found[tag] = struct.unpack_from(f"{order}{count}{letter}", data, where)
    return found, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples = one(256), one(257), one(277, 1)
    if not width or not height or width * height * samples > MOST_PIXELS:
        raise TiffError("the size of an image is missing, zero or too large")
    if any(b != 8 for b in tags.get(258, (1,))) or one(284, 1) != 1 and samples > 1:
        raise TiffError("only 8-bit samples in one plane are read")
    compression, predictor = one(259, NONE), one(317, 1)
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor} is not known")
    tiled = 322 in tags
    bw, bl = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    offsets, sizes = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
    across, down = -(-width // bw), -(-height // bl)
    if not offsets or not sizes or len(offsets) < across * down or len(sizes) < across * down:
        raise TiffError("strips or tiles are missing")
    out = np.zeros((height, width, samples), np.uint8)
    for i in range(across * down):
        y, x = i // across * bl, i % across * bw
        rows = bl if tiled else min(bl, height - y)
        want = rows * bw * samples
        if offsets[i] + sizes[i] > len(data):
            raise TiffError("a strip or tile lies outside the file")
        part = data[offsets[i] : offsets[i] + sizes[i]]
        if compression == PACKBITS:
            part = unpackbits(part)
        elif compression == LZW:
            part = unlzw(part)
        elif compression in (DEFLATE, OLD_DEFLATE):
            part = inflate(part, want)
        elif compression != NONE:
            raise TiffError(f"compression {compression} is not known")
        if len(part) < want:
            raise TiffError("a strip or tile is too short")
        block = np.frombuffer(part, np.uint8, want).reshape(rows, bw, samples)
        if predictor == 2:
            block = undifference(block)
        out[y : y + rows, x : x + bw] = block[: height - y, : width - x]
    return out


def directories(data: bytes) -> tuple[list[dict[int, tuple]], str | None]:
    """Walk the image directories of a TIFF: the tags of each, and what ended the walk early (a loop, a cut), if anything did."""
    found: list[dict[int, tuple]] = []
    try:
        if len(data) < 8 or data[:2] not in (b"II", b"MM"):
            raise TiffError("no TIFF header")
        order = "<" if data[:2] == b"II" else ">"
        magic, at = struct.unpack_from(order + "HI", data, 2)
        if magic != 42:
            raise TiffError("no TIFF header")
        seen: set[int] = set()
        while at:
            if at in seen:
                raise TiffError("directories form a loop")
            seen.add(at)
            tags, at = _fields(data, at, order)
            found.append(tags)
    except TiffError as error:
        return found, str(error)
    return found, None


def pixels(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """(rows, columns, samples) of the image that a directory describes; raises TiffError where that can't be read."""
    try:
        return _page(data, tags)
    except (zlib.error, struct.error, TypeError, ValueError) as error:
        raise error if isinstance(error, TiffError) else TiffError(str(error)) from error


#: How a page can be stored: coding, predictor, rows of a strip or a tile, samples.
FORMS = (
    {"compression": PACKBITS, "predictor": 1, "rows": 64, "samples": 3},
    {"compression": LZW, "predictor": 2, "rows": 64, "samples": 3},
    {"compression": DEFLATE, "predictor": 2, "tile": TILE, "samples": 1},
    {"compression": PACKBITS, "predictor": 1, "tile": TILE, "samples": 1},
    {"compression": LZW, "predictor": 1, "tile": TILE, "samples": 1},
    {"compression": DEFLATE, "predictor": 2, "rows": 128, "samples": 3},
)


def from_payload(payload: bytes) -> bytes:
    """A payload (a positive multiple of 192 bytes) as pages of up to 256 rows.

    A checksum of the payload and the number of the page choose one of FORMS, whatever the size: each form takes its share of
    the bytes, pages of one payload take turns, and equal payloads give equal files.
    """
    gray = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 1)
    first, out = zlib.crc32(payload), []
    for k, y in enumerate(range(0, len(gray), ROWS_PER_PAGE)):
        form = FORMS[(first + k) % len(FORMS)]
        px = gray[y : y + ROWS_PER_PAGE]
        out.append(form | {"pixels": px.reshape(len(px), WIDTH // form["samples"], form["samples"])})
    return write(out)


PAGE = pa.schema([("page", pa.int32()), ("pages", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())])
PAGE_DDL = "page int, pages int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"
#: Bytes of pixels, and of texts, in one batch at most, but for a single page or text.
BATCH_BYTES = 4 << 20


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page: the other columns of ``df``, then page (from 0), pages, sizes, coding, pixels and error.

    Pages of one file stay together and in order, in the partition of their row, and are sent on as they are read. Null
    media give no rows, an empty table gives none; a page that can't be read is a row with error set (pixels null) and the
    pages after it are read; so is what cuts the chain of directories short, as the last row. Repeated rows are read again.
    Pages of more than MOST_PIXELS samples are an error. Columns of ``df`` named as ours, in whatever case, give way.
    """
    keep = others(df, media, *PAGE.names)

    def run(batches):
        for batch in batches:
            kept = batch.select(keep)
            origin, rows, held = [], [], 0
            for i, data in enumerate(batch.column(media)):
                if (data := data.as_py()) is None:
                    continue
                found, ended = directories(data)
                total = len(found) + (ended is not None)
                for k, tags in enumerate(found):
                    one = lambda tag: tags.get(tag, (1,))[0]
                    try:
                        px = pixels(data, tags)
                        rows.append([k, total, px.shape[1], px.shape[0], px.shape[2], one(259), one(317), 322 in tags, px.tobytes(), None])
                        held += px.size
                    except TiffError as error:
                        rows.append([k, total, *[None] * 7, str(error)])
                    origin.append(i)
                    if held >= BATCH_BYTES:
                        yield _joined(kept, origin, rows)
                        origin, rows, held = [], [], 0
                if ended is not None:
                    rows.append([total - 1, total, *[None] * 7, ended])
                    origin.append(i)
            if rows:
                yield _joined(kept, origin, rows)

    return df.select(*keep, media).mapInArrow(run, ", ".join(filter(None, [ddl(df, keep), PAGE_DDL])))


def _joined(kept: pa.RecordBatch, origin: list[int], rows: list[list]) -> pa.RecordBatch:
    left = kept.take(pa.array(origin, pa.int64()))
    right = [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), PAGE, strict=True)]
    return pa.RecordBatch.from_arrays([*left.columns, *right], names=[*left.schema.names, *PAGE.names])


def text_to_tiff(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the text, with n_bytes (of its UTF-8) and media (a TIFF of it, padded with spaces to a positive multiple of 192).

    Whole texts, however long; null texts are empty; equal texts give equal bytes; an empty table stays empty. Columns named
    n_bytes or media, in whatever case, give way.
    """
    keep = others(df, text, "n_bytes", "media")

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, text, BATCH_BYTES):
                raws = [(value or "").encode("utf-8", "surrogatepass") for value in texts]
                media = [from_payload(raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")) for raw in raws]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(list(map(len, raws)), pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return df.select(*keep, text).mapInArrow(run, ", ".join(filter(None, [ddl(df, keep), "n_bytes bigint, media binary"])))


DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _digest(batches):
    """One row per file from its pages, which follow each other."""
    state = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["error"] is not None:
                raise TiffError(f"document {row['doc_id']}: {row['error']}")
            px = row["pixels"]
            if row["page"] == 0:
                state = {"sha": hashlib.sha256(), "n": 0, "hist": np.zeros(256, np.int64)}
            state["sha"].update(px)
            state["n"] += len(px)
            state["hist"] += np.bincount(np.frombuffer(px, np.uint8), minlength=256)
            if row["page"] == row["pages"] - 1:
                p = state["hist"][state["hist"] > 0] / state["n"]
                mean = int((state["hist"] * np.arange(256)).sum() * 1000 // state["n"])
                feature = f"pages={row['pages']};mean={mean};distinct={len(p)};entropy={-(p * np.log2(p)).sum():.4f}"
                out.append([row["doc_id"], row["n_bytes"], state["n"], state["sha"].hexdigest(), zlib.crc32(px[-16:]), row["media_bytes"], row["media_sha256"], feature])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 8, [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])


def op4_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a TIFF, read back page by page; no shuffle, since a file's pages stay where its row is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = text_to_tiff(docs).select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return tiff_pages(stored).select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "pages", "pixels", "error").mapInArrow(_digest, DIGEST)
