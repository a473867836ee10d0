"""Token ids as files of interleaved range-ANS blocks with one shared table of frequencies.

Texts are encoded by a `tokenizers` file (each distinct stretch between spaces once per batch), an end id closes each
document, and the documents are dealt by ranges of their ids, so that blocks stand in ascending order of doc_id. The
frequency table is counted over all tokens, scaled to 2^PROB_BITS and shared by all blocks.

A block holds whole documents: at least BLOCK tokens, or fewer at a partition's end. Its tokens are split into segments
of SEGMENT tokens. In a segment, token i belongs to lane i mod LANES; all lanes share one stream of 32-bit words, which
a step over the lanes writes in order. The states in which a segment starts, its place in the stream and a CRC-32 of its
words are its checkpoint, so each segment can be decoded by itself, in any order. Layout, little endian:

    magic "VRA2", segments u32, documents u32, tokens u64, CRC-32 of what follows u32
    for each segment: tokens u32, words u32, CRC-32 of the words u32
    for each document: doc_id i64, tokens u32; a bit for each document, set where it has no doc_id; for each segment: LANES states u64; the words of all segments

Defined cases: a null or empty text is the end id alone; rows with the same doc_id stay, in the order of their ids as
bytes; a null doc_id comes first and is kept as null; an empty table gives no block; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_characters
from .common import resident, shared_path, strings

PROB_BITS = 22
LANES = 1024
SEGMENT = 1 << 17
BLOCK = 1 << 18
MAGIC = b"VRA2"
_HEAD = "<4sIIQI"
CACHE, PIECES = 200_000, 800_000
CACHED_CHARS = 64
#: The normaliser and the cut for which Encoder._encode may go piece by piece.
_NORMALISER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_CUT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The same cut for characters below U+0100.
_PIECES = re.compile("'(?:s|t|re|ve|m|ll|d)|[^\\W\\d_\xb2\xb3\xb9\xbc-\xbe]+|[\\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\\w\t-\r \x85\xa0]|_)+")
_LOW = 1 << 31
#: Signs after a word of letters that are a piece by themselves.
_ENDS = frozenset(",.;:!?)")


class Table:
    """Frequencies scaled to sum to 2^PROB_BITS; every token that occurs has at least 1."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)])[:-1].astype(np.uint64)
        self.token = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.limit = self.freq << np.uint64(63 - PROB_BITS)

    @classmethod
    def scaled(cls, counts: dict[int, int], size: int) -> Table:
        freq = np.zeros(size, np.int64)
        if counts:
            ids = np.array(sorted(counts), np.int64)
            n = np.array([counts[i] for i in ids], np.float64)
            f = np.maximum(1, np.floor(n / n.sum() * (1 << PROB_BITS))).astype(np.int64)
            order = np.argsort(-f, kind="stable")
            over = int(f.sum()) - (1 << PROB_BITS)  # what rounding has left over goes to or comes from the frequent
            while over:
                step = np.zeros(len(f), np.int64)
                if over < 0:
                    step[order[0]] = -over
                else:
                    room = (f[order] - 1) // 2 + (f[order] > 1) * ((f[order] - 1) // 2 == 0)
                    taken = np.minimum(room, np.maximum(0, over - (np.cumsum(room) - room)))
                    step[order] = -taken
                f, over = f + step, over + int(step.sum())
            freq[ids] = f
        return cls(freq)

    def to_bytes(self) -> bytes:
        return self.freq.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        return cls(np.frombuffer(raw, "<u4").astype(np.int64))


def _encode_segment(t: Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States from which decoding starts, and the words that it reads."""
    x = np.full(LANES, _LOW, np.uint64)
    shift, bits = np.uint64(32), np.uint64(PROB_BITS)
    out: list[np.ndarray] = []
    for at in range((len(ids) - 1) // LANES * LANES, -1, -LANES):
        s = ids[at : at + LANES]
        y = x[: len(s)]
        full = y >= t.limit[s]
        out.append(y[full].astype(np.uint32))
        y = np.where(full, y >> shift, y)
        f = t.freq[s]
        q = y // f
        x[: len(s)] = (q << bits) + (y - q * f) + t.start[s]
    return x, np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)


def _decode_segment(t: Table, x: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    x, out, pos = x.copy(), np.empty(n, np.uint32), 0
    shift, bits, mask, low = np.uint64(32), np.uint64(PROB_BITS), np.uint64((1 << PROB_BITS) - 1), np.uint64(_LOW)
    for at in range(0, n, LANES):
        y = x[: min(LANES, n - at)]
        slot = y & mask
        s = t.token[slot]
        out[at : at + len(s)] = s
        y = t.freq[s] * (y >> bits) + slot - t.start[s]
        need = y < low
        k = int(np.count_nonzero(need))
        y[need] = (y[need] << shift) | words[pos : pos + k]
        pos += k
        x[: len(s)] = y
    if pos != len(words):
        raise ValueError("a segment has words left over")
    return out


def encode_block(t: Table, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    segments, states, words = [], [], []
    for at in range(0, len(ids), SEGMENT):
        part = ids[at : at + SEGMENT]
        x, w = _encode_segment(t, part)
        w = w.astype("<u4")
        segments.append(struct.pack("<III", len(part), len(w), zlib.crc32(w.tobytes())))
        states.append(x.astype("<u8").tobytes())
        words.append(w.tobytes())
    docs = np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes() + np.packbits([i is None for i in doc_ids]).tobytes()
    rest = b"".join([*segments, docs, *states, *words])
    return struct.pack(_HEAD, MAGIC, len(segments), len(lengths), len(ids), zlib.crc32(rest)) + rest


class Block:
    """A block that is read; its segments decode one by one."""

    def __init__(self, raw: bytes, table: Table) -> None:
        magic, n_segments, n_docs, self.n_tokens, crc = struct.unpack_from(_HEAD, raw)
        at = struct.calcsize(_HEAD)
        if magic != MAGIC or zlib.crc32(memoryview(raw)[at:]) != crc:
            raise ValueError("not a block, or a damaged one")
        self.table, self.raw = table, raw
        self.segments = np.frombuffer(raw, "<u4", 3 * n_segments, at).reshape(-1, 3).astype(np.int64)
        at += 12 * n_segments
        ids, n_flags = np.frombuffer(raw, "<i8", n_docs, at).tolist(), -(-n_docs // 8)
        self.lengths = np.frombuffer(raw, "<u4", n_docs, at + 8 * n_docs).astype(np.int64)
        at += 12 * n_docs
        none = np.unpackbits(np.frombuffer(raw, np.uint8, n_flags, at), count=n_docs).tolist()
        self.doc_ids = [None if x else i for i, x in zip(ids, none, strict=True)]
        at += n_flags
        self.states = np.frombuffer(raw, "<u8", LANES * n_segments, at).reshape(-1, LANES)
        self.words = np.frombuffer(raw, "<u4", int(self.segments[:, 1].sum()), at + 8 * LANES * n_segments)
        self.places = np.concatenate([[0], np.cumsum(self.segments[:, 1])])

    def segment(self, k: int) -> np.ndarray:
        words = self.words[self.places[k] : self.places[k + 1]]
        if zlib.crc32(words.tobytes()) != self.segments[k, 2]:
            raise ValueError(f"segment {k} is damaged")
        return _decode_segment(self.table, self.states[k], words, int(self.segments[k, 0]))

    def tokens(self) -> np.ndarray:
        return np.concatenate([self.segment(k) for k in range(len(self.segments))]) if len(self.segments) else np.zeros(0, np.uint32)


class Encoder:
    """A tokenizers file whose ids don't depend on what stands beyond a space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        spec = json.loads(self.tokenizer.to_str())
        special = [x["content"] for x in spec["added_tokens"]]
        self.marked = re.compile("|".join(map(re.escape, special)) or "(?!)").search
        self.plain = (spec["normalizer"], spec["pre_tokenizer"]) == (_NORMALISER, _CUT)
        self.code = "H" if self.kind is np.uint16 else "I"
        self.chars = byte_characters()
        self.pieces: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.kind).tobytes()

    def _plain(self, chunks: list[str]) -> list[bytes]:
        """The chunks' ids, from the library's merges piece by piece where its normaliser can't change more than case.

        That holds for characters below U+0100 outside special tokens: the canonical form leaves them and lower case
        maps them one by one. Anything else takes the library's whole path.
        """
        out, known, piece = [], self.pieces.get, self._piece
        for x in chunks:
            if x.isascii():
                low = x.lower()
                ids = known(low)
                if ids is None:
                    if low.isalpha():
                        ids = piece(low)
                    elif low[-1:] in _ENDS and low[:-1].isalpha():
                        ids = piece(low[:-1]) + piece(low[-1])
                    else:
                        ids = self._whole(x) if self.marked(x) else b"".join(map(piece, _PIECES.findall(low)))
            elif self.marked(x) or max(x) >= "\u0100":
                ids = self._whole(x)
            else:
                ids = b"".join(map(piece, _PIECES.findall(x.lower())))
            out.append(ids)
        return out

    def _other(self, chunks: list[str]) -> list[bytes]:
        """The chunks' ids by the library's whole path."""
        cache = self.cache
        found = list(map(cache.get, chunks))
        for k, x in enumerate(chunks):
            if found[k] is None:
                found[k] = ids = self._whole(x)
                if len(x) <= CACHED_CHARS:
                    cache[x] = ids
        return found

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            mapped = piece if piece.isascii() and piece.isprintable() else "".join(map(self.chars.__getitem__, piece.encode()))
            ids = self.pieces[piece] = array(self.code, [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
        return ids

    def encode_column(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end ids included, one after the other, and how many each text has.

        Arrow cuts the texts at spaces, or white space, and finds the distinct chunks; only these cross into Python.
        """
        if len(self.cache) >= CACHE:
            self.cache.clear()
        if len(self.pieces) >= PIECES:
            self.pieces.clear()
        filled = strings(texts)
        # no piece of the plain cut holds white space
        split = pc.ascii_split_whitespace(filled) if self.plain else pc.split_pattern(filled, " ")
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self._plain(chunks) if self.plain else self._other(chunks)
        found.append(self.kind(end).tobytes())
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind().itemsize
        flat = np.frombuffer(b"".join(found), self.kind)
        # the chunks of each text, then the end
        n = np.diff(split.offsets.to_numpy())
        place = np.insert(coded.indices.to_numpy(), np.cumsum(n), len(chunks))
        each = size[place]
        stop = np.cumsum(each)
        ids = flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat((np.cumsum(size) - size)[place] - stop + each, each)]
        per = np.add.reduceat(each, np.cumsum(n + 1) - n - 1) if len(n) else np.zeros(0, np.int64)
        return ids, per

    def encode_batch(self, texts: list[str], end: int) -> list[bytes]:
        ids, per = self.encode_column(pa.array(texts, pa.string()), end)
        return [x.tobytes() for x in np.split(ids, np.cumsum(per)[:-1])] if texts else []


def encoder(path: str) -> Encoder:
    return resident(("encoder", path), lambda: Encoder(path))


def _slices(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


_TOKENS = "doc_id bigint, width int, ids binary, counts binary"


def tokenise(docs: DataFrame, tokenizer: str, end: int, vocabulary: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and the document's ids with the end id, 2 bytes each where the vocabulary allows it, else 4; and for each
    task a row of width 0 whose counts say how often it saw each id of the vocabulary."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        names, seen = ["doc_id", "width", "ids", "counts"], np.zeros(vocabulary, np.int64)
        for batch in _slices(it, 5000):
            ids, n = e.encode_column(batch.column(1), end)
            seen += np.bincount(ids, minlength=vocabulary)
            at = np.concatenate([[0], np.cumsum(n)]) * ids.itemsize
            raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            wide = pa.array(np.full(len(n), ids.itemsize, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), wide, raw, pa.nulls(len(n), pa.binary())], names=names)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, 0, None, zlib.compress(seen.tobytes(), 1)), kinds, strict=True)], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _TOKENS)


def write(docs: DataFrame, path: str, tokenizer: str, end: int, vocabulary: int, *, partitions: int | None = None) -> None:
    """Writes path/blocks (part, first: tokens of the part before the block, n_tokens, block) and path/table.

    The tokens are kept in the shared folder between counting and coding. The driver gets one count per id of the
    vocabulary and nothing that grows with the input.
    """
    spark = docs.sparkSession
    kept = shared_path(spark, "tokens")
    tokenise(docs, tokenizer, end, vocabulary).write.parquet(kept)
    read_kept = spark.read.schema(_TOKENS).parquet(kept)
    tokens = read_kept.where("width > 0").select("doc_id", "width", "ids")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocabulary, np.int64)
        for batch in it:
            for raw in batch.column(0):
                n += np.frombuffer(zlib.decompress(raw.as_buffer()), np.int64)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n[found], pa.int64())], names=["id", "n"])

    counts = read_kept.where("counts IS NOT NULL").select("counts").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    raw = Table.scaled({r["id"]: r["n"] for r in counts}, vocabulary).to_bytes()
    spark.createDataFrame([(bytearray(raw),)], "freq binary").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(raw)  # 4 bytes for each id of the vocabulary

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t, part = Table.from_bytes(shared.value), TaskContext.get().partitionId()
        doc_ids: list[int | None] = []
        arrays: list[np.ndarray] = []
        first = held = 0
        names = ["part", "first", "n_tokens", "block"]

        def block() -> pa.RecordBatch:
            ids = np.concatenate(arrays)
            raw = encode_block(t, doc_ids, [len(a) for a in arrays], ids)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, first, len(ids))] + [pa.array([raw], pa.binary())], names=names)

        for batch in it:
            for i, w, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                doc_ids.append(i)
                arrays.append(np.frombuffer(raw.as_buffer(), f"<u{w}").astype(np.int64))
                held += len(arrays[-1])
                if held >= BLOCK:
                    yield block()
                    first, held, doc_ids, arrays = first + held, 0, [], []
        if arrays:
            yield block()

    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # doc_id alone may be null or repeat; the CRC spreads rows of one doc_id
    dealt = tokens.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.crc32("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("ids"), "ids")
    dealt.mapInArrow(code, "part bigint, first bigint, n_tokens bigint, block binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids_crc32, from the files alone."""
    raw = spark.read.parquet(f"{path}/table").first()["freq"]
    blocks = spark.read.schema("part bigint, first bigint, n_tokens bigint, block binary").parquet(f"{path}/blocks")
    # one row for each part, of which there are as many as tasks that wrote
    sizes = sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["part"])
    before, total = {}, 0
    for r in sizes:
        before[r["part"]] = total
        total += r["n"]
    shared = spark.sparkContext.broadcast((bytes(raw), before))

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, base = shared.value
        t = Table.from_bytes(freq)
        for batch in it:
            for part, first, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                b = Block(raw.as_buffer().to_pybytes(), t)
                ids = memoryview(b.tokens().astype("<u4").tobytes())
                ends = np.cumsum(b.lengths)
                crc = [zlib.crc32(ids[4 * int(e - n) : 4 * int(e)]) for e, n in zip(ends, b.lengths, strict=True)]
                start = base[part] + first + ends - b.lengths
                cols = [pa.array(b.doc_ids, pa.int64()), pa.array(start, pa.int64()), pa.array(b.lengths, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "first", "block").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
