"""SentencePiece BPE encoding by a prefix table, and decoding.

For each prefix of a text the last token of its encoding is unique: a vocabulary piece that ends there (an automaton
finds them all in one pass) and that stays apart from the last token of what precedes it. The table of last tokens is
filled from left to right and the ids are read from it backwards. A single character is the last token when no longer
piece is, so the automaton holds the longer ones only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ddl, map_arrow, others, slices, table

SPACE = "▁"
#: Segments of one age that a worker remembers (it holds two ages), pairs that it remembers before it starts afresh, and
#: characters of a segment that is worth it; they bound its memory.
MOST_SEGMENTS, MOST_PAIRS, MOST_CHARS = 80_000, 200_000, 64
#: Bytes of text encoded, decoded in one call and sent on in one batch.
BATCH_BYTES = 2 << 20


class Pairs(dict):
    """(a << bits | b) -> whether the encoding of both pieces' text is a, b."""

    def __init__(self, pieces: list[str], scores: dict[str, float]):
        super().__init__()
        self.pieces, self.scores, self.bits = pieces, scores, len(pieces).bit_length()

    def __missing__(self, key: int) -> bool:
        left, right = self.pieces[key >> self.bits], self.pieces[key & (1 << self.bits) - 1]
        apart = left + right not in self.scores and merged(left + right, self.scores) == [left, right]
        if len(self) >= MOST_PAIRS:
            self.clear()
        self[key] = apart
        return apart


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """Plain BPE of a short text: join the best neighbours, the leftmost of equals, while any are a piece."""
    parts = list(text)
    joined = [scores.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        best = max((x for x in joined if x is not None), default=None)
        if best is None:
            return parts
        i = joined.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del joined[i]
        if i < len(joined):
            joined[i] = scores.get(parts[i] + parts[i + 1])
        if i:
            joined[i - 1] = scores.get(parts[i - 1] + parts[i])


def marks(pieces: Iterable[str]) -> str:
    """Characters that no piece joins with a letter, also not through others; so no piece reaches from a run of them into a word.

    Line breaks and characters beyond 16 bits count as letters: a class with these is three times as slow to search.
    """
    near: dict[str, set[str]] = {}
    for piece in pieces:
        for c in (own := set(piece) - {SPACE}):
            near.setdefault(c, set()).update(own)
    todo = [c for c in near if c.isalpha() or c == "\n" or c > "\uffff"]
    bound = set(todo)
    while todo:
        new = near[todo.pop()] - bound
        bound |= new
        todo += new
    return "".join(sorted(near.keys() - bound))


class Encoder(dict):
    """Segment -> ids as little-endian 32-bit integers. A segment is a part of the text that no piece reaches out of.

    Spaces are plain in it. When as many as a worker remembers are there, they become the old ones, and those asked for again
    are taken from there: what is frequent stays.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        super().__init__()
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        own = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.old: dict[str, bytes] = {}
        scores = {self.pieces[i]: sp.get_score(i) for i in own}
        if any(SPACE in p.lstrip(SPACE) for p in scores) or any(sp.is_unused(i) for i in own) or any(c not in scores for p in scores for c in p):
            raise ValueError("the model has pieces that this encoder doesn't handle")
        self.bytes = [pack("<I", sp.piece_to_id(f"<0x{i:02X}>")) for i in range(256)]
        self.packed = [pack("<I", i) for i in range(size)]
        self.lengths = [len(p) for p in self.pieces]
        self.pairs = Pairs(self.pieces, scores)
        self.single = {self.pieces[i]: i << self.pairs.bits for i in own if self.lengths[i] == 1}.get
        self.automaton = ahocorasick.Automaton()
        for i in own:
            if self.lengths[i] > 1:
                self.automaton.add_word(self.pieces[i], (self.lengths[i], i, i << self.pairs.bits))
        self.automaton.make_automaton()
        #: A piece starts at a space at the latest, holds marks or none, and no line break unless the vocabulary has it.
        apart = re.escape(marks(scores))
        line = "" if "\n" in scores else "\n"
        self.cut = re.compile("|".join([f" *[^ {line}{apart}]+", *([f" *[{apart}]+"] if apart else []), " +", "\n"])).findall

    def __missing__(self, segment: str) -> bytes:
        out = self.old.get(segment) or self.fill(segment.replace(" ", SPACE))
        if len(segment) <= MOST_CHARS:
            if len(self) >= MOST_SEGMENTS:
                self.old = self.copy()
                self.clear()
            self[segment] = out
        return out

    def fill(self, segment: str) -> bytes:
        """Ids of a segment by its table of last tokens, which are shifted as a pair's left one is."""
        pairs, bits, done = self.pairs, self.pairs.bits, -1
        last: list[int | None] = [*map(self.single, segment), None]  # None: a character outside the vocabulary; at -1, the start
        for end, (length, piece, shifted) in self.automaton.iter(segment):  # of those that end there the longest comes first
            if end != done:
                before = last[end - length]
                if before is None or pairs[before | piece]:
                    last[end] = shifted
                    done = end
        ids, end = [], len(segment) - 1
        while end >= 0:
            shifted = last[end]
            if shifted is None:
                ids += [self.bytes[b] for b in reversed(segment[end].encode("utf-8", "surrogatepass"))]
                end -= 1
            else:
                ids.append(self.packed[shifted >> bits])
                end -= self.lengths[shifted >> bits]
        ids.reverse()
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text with begin and end ids."""
        body = b"".join(map(self.__getitem__, self.cut(" " + text.replace(SPACE, " ")))) if text else b""
        return self.packed[self.library.bos_id()] + body + self.packed[self.library.eos_id()]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.library.decode([np.frombuffer(x, "<u4").tolist() for x in ids])


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process and model."""
    return Encoder(path)


def tokenize(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``df`` without the text, with ids (binary, little-endian 32-bit integers, begin and end ids included) and decoded.

    ``model`` is the file of a BPE model with the identity normalizer, at the same path on all machines. Null texts are
    empty and give begin and end; repeated rows are encoded again; an empty table stays empty; columns named ids or decoded, in
    whatever case, give way. Whole texts only, however long; a worker keeps bounded tables and no text beyond its batch.
    """
    keep = others(df, text, "ids", "decoded")

    def run(batches):
        coder = encoder(model)
        for batch in batches:
            for part, texts in slices(batch, text, BATCH_BYTES):
                ids = [coder.encode(x or "") for x in texts]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(ids, pa.binary()), pa.array(coder.decode(ids), pa.string())], names=[*keep, "ids", "decoded"])

    return map_arrow(df.select(*keep, text), run, ", ".join(filter(None, [ddl(df, keep), "ids binary, decoded string"])))


def token_ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def digests(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return digests(tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path()))
