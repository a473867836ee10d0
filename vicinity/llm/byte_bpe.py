"""Byte-level BPE through sentencepiece: the model is serialised straight from a file of ranks.

Each byte becomes one printable character (a fixed one-to-one map), so that a piece of the vocabulary is a string, its
score is minus its rank, and nothing is normalised. Merging the best-scored pair first is then the merging of the
lowest rank first. Text is cut by the vocabulary's pattern before the merges; ids are decoded by the inverse map.

Defined cases: a null or empty text has no ids; rows are independent, so ties, repeats and order don't matter; other
columns are ignored. A text is cut into chunks at single spaces (see encode_batch) and each distinct chunk is encoded once
per worker; the memory of that is bounded by CACHE chunks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident

CACHE = 400_000
#: Longer chunks aren't kept.
CACHED_CHARS = 64
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """A character for each byte: itself if it is a visible one of Latin-1, else from U+0100 on in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return [chr(b) if b in set(visible) else chr(0x100 + rest.index(b)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes(tag: int, value: bytes) -> bytes:
    return _varint(tag << 3 | 2) + _varint(len(value)) + value


def _number(tag: int, value: int) -> bytes:
    return _varint(tag << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces by rank with score -rank, then the unknown piece that it requires."""


    chars = byte_characters()
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token).encode()
        out += _bytes(1, _bytes(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)))
    out += _bytes(1, _bytes(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))
    # trainer_spec: model_type BPE, vocab_size, ids of <unk>, <s>, </s>, <pad> (-1 is none)
    none = (1 << 64) - 1
    out += _bytes(2, _number(3, 2) + _number(4, len(ranks) + 1) + _number(40, len(ranks)) + _number(41, none) + _number(42, none) + _number(43, none))
    # normalizer_spec: identity, no dummy prefix, white space as it is
    out += _bytes(3, _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


#: White space as Unicode's property has it; the s class of a pattern engine may add U+001C-U+001F.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Next to a second white-space character, a space may not begin a chunk.
_DOUBLE = re.compile(r"\s \s|  |^ | $")


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        self.ranks = read_ranks(path)
        if sorted(self.ranks.values()) != list(range(len(self.ranks))):
            raise ValueError("ranks must be 0, 1, ... without gaps")
        self.table = [b""] * len(self.ranks)
        for token, rank in self.ranks.items():
            self.table[rank] = token
        self.chars = {b: c for b, c in enumerate(byte_characters())}
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        pattern = pattern or public_tokenizers.PATTERN
        self.cut = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"(?!\S)", f"(?![^{_SPACE}])"))
        self.by_piece = {x.decode("latin-1").translate(self.chars): i for x, i in self.ranks.items()}
        self.inner: dict[str, bytes] = {}
        self.lengths = np.array([len(x) for x in self.table], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(self.table), np.uint8)
        width = len(str(len(self.table))) + 1
        self.decimals = np.array([f"{i} ".encode().ljust(width, b"\0") for i in range(len(self.table))], f"V{width}")

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as int32 bytes; the pieces that aren't tokens by themselves go to sentencepiece at once."""
        cut, ranks, chars, space = self.cut.findall, self.by_piece, self.chars, self.chars[32]
        # letters after at most one space are one match
        pieces = [[c] if c[1:].isalpha() and (c[0] == " " or c[0].isalpha()) else cut(c) for c in chunks]
        distinct = list({x for p in pieces for x in p})
        byte_mapped = [
            space + x[1:] if x[0] == " " and x.isascii() and x[1:].isalpha() else x.encode().decode("latin-1").translate(chars)
            for x in distinct
        ]
        # a piece that is a token by itself is that token
        ids = {x: array("i", (ranks[y],)).tobytes() for x, y in zip(distinct, byte_mapped, strict=True) if y in ranks}
        rest = [(x, y) for x, y in zip(distinct, byte_mapped, strict=True) if y not in ranks]
        found = self.sp.encode([y for _, y in rest], num_threads=1)
        ids |= {x: array("i", y).tobytes() for (x, _), y in zip(rest, found, strict=True)}
        return [ids[p[0]] if len(p) == 1 else b"".join([ids[x] for x in p]) for p in pieces]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as int32 bytes, each match of the pattern by itself.

        A space with a visible neighbour on each side always begins a match of the pattern, and what stands before
        it is matched as if the text ended there; so a text may be cut before such spaces. Texts with other spaces
        than those are matched whole.
        """
        inner = self.inner
        if len(inner) >= CACHE:
            inner.clear()
        split = [[x] if _DOUBLE.search(x) else x.split(" ") for x in texts]
        rest = [x[1:] for x in split]
        missing = list(set(chain.from_iterable(rest)).difference(inner))
        inner.update(zip(missing, self._encode([" " + x for x in missing]), strict=True))
        firsts = self._encode([x[0] for x in split])
        out = [first + b"".join(map(inner.__getitem__, x)) for first, x in zip(firsts, rest, strict=True)]
        for x in missing:
            if len(x) > CACHED_CHARS:
                del inner[x]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], np.int32).tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + n, n)].tobytes()

    def written(self, ids: np.ndarray) -> bytes:
        """The ids as decimals joined by one space."""
        out = self.decimals[ids].view(np.uint8)
        return out[out != 0].tobytes()[:-1]


def codec(path: str) -> Codec:
    """One per worker and vocabulary."""
    return resident(("codec", path), lambda: Codec(path))


def _slices(it: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Per row: the key, number of ids, SHA-256 of the ids as decimals joined by spaces and of the bytes that they
    decode to; with ids=True also token_ids. The vocabulary's path must exist on every executor."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in _slices(it):
            found = c.encode_batch([x or "" for x in batch.column(1).to_pylist()])
            arrays = [np.frombuffer(x, np.int32) for x in found]
            a = [hashlib.sha256(c.written(x)).hexdigest() for x in arrays]
            b = [hashlib.sha256(c.decode(x)).hexdigest() for x in arrays]
            cols = [batch.column(0), pa.array(map(len, arrays), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                ends = pa.array([0, *accumulate(map(len, arrays))], pa.int32())
                cols.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(arrays))))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, SCHEMA + ", token_ids array<int>" * ids)
