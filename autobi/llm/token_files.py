"""Token files: patched frame-of-reference blocks.

A file image holds the ids of whole documents. Ids are cut into blocks of 256; a block stores its minimum,
the differences packed at the width that holds a given share of them, and the few larger ones as a list of
places and values. An index gives the byte at which each block starts, so any block is read by itself.

Layout, little-endian: magic ``PFB1``, documents u32, ids u64, ids before this file in its partition u64,
blocks u32; document ids i64 each; lengths u32 each; block starts u32 each, and the end; then the blocks:
minimum u32, width u8, exceptions u16, packed differences, places u8 each, differences u32 each. The last
block is filled up with its minimum.
"""

from __future__ import annotations

import functools
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autobi.llm import common

BLOCK, HEAD = 256, struct.Struct("<4sIQQI")
#: Share of a block's differences that the packed width must hold.
SHARE = 0.9
#: Ids in a file image, documents apart; images in one Parquet file.
IMAGE, IMAGES = 1 << 18, 64
KEPT, LONGEST = 800_000, 48


def pack(values: np.ndarray, share: float = SHARE) -> tuple[list[bytes], np.ndarray]:
    """The blocks of an array of unsigned 32-bit values, and the block starts with the end."""
    n = -(-len(values) // BLOCK)
    if not n:
        return [], np.zeros(1, np.uint32)
    padded = np.full(n * BLOCK, values[-1], np.uint32)
    padded[: len(values)] = values
    rows = padded.reshape(n, BLOCK)
    rows[-1, len(values) - (n - 1) * BLOCK :] = rows[-1, : len(values) - (n - 1) * BLOCK].min()
    low = rows.min(axis=1)
    rel = rows - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(share * BLOCK)) - 1)
    at = np.partition(rel, rank, axis=1)[:, rank]
    width = np.where(at == 0, 0, np.floor(np.log2(np.maximum(at, 1).astype(np.float64))).astype(np.int64) + 1)
    limit = np.left_shift(np.uint64(1), width.astype(np.uint64))
    over = rel >= limit[:, None]
    packed: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        where = np.flatnonzero(width == w)
        if w:
            kept = np.where(over[where], 0, rel[where]).astype(np.uint64).reshape(-1, 8)
            words = np.zeros((len(kept), (8 * w + 63) // 64 + 1), "<u8")  # eight values fill w bytes
            for k in range(8):
                slot, shift = k * w >> 6, np.uint64(k * w & 63)
                words[:, slot] |= kept[:, k] << shift
                if shift:
                    words[:, slot + 1] |= kept[:, k] >> (np.uint64(64) - shift)
            data = words.view(np.uint8)[:, :w].reshape(len(where), -1)
            for i, row in zip(where.tolist(), data):
                packed[i] = row.tobytes()
    blocks, counts = [], over.sum(axis=1)
    for i, (m, w, c) in enumerate(zip(low.tolist(), width.tolist(), counts.tolist())):
        block = struct.pack("<IBH", m, w, c) + packed[i]
        if c:
            places = np.flatnonzero(over[i])
            block += places.astype(np.uint8).tobytes() + rel[i, places].astype("<u4").tobytes()
        blocks.append(block)
    return blocks, np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype(np.uint32)


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    m, w, c = struct.unpack_from("<IBH", data, at)
    at += 7
    size = w * BLOCK // 8
    if w:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little").reshape(BLOCK, w)
        whole = np.zeros((BLOCK, 32), np.uint8)
        whole[:, :w] = bits
        rel = np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
    else:
        rel = np.zeros(BLOCK, np.uint32)
    if c:
        places = np.frombuffer(data, np.uint8, c, at + size)
        rel[places] = np.frombuffer(data, "<u4", c, at + size + c)
    return rel + np.uint32(m)


def image(doc_ids: list[int], lengths: list[int], values: np.ndarray, before: int) -> bytes:
    blocks, starts = pack(values)
    head = HEAD.pack(b"PFB1", len(doc_ids), len(values), before, len(blocks))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), np.array(lengths, "<u4").tobytes(), starts.astype("<u4").tobytes(), *blocks])


def open_image(data: bytes) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, int]:
    """Document ids, lengths, ids before, block starts, and the byte where blocks begin."""
    magic, docs, _, before, blocks = HEAD.unpack_from(data)
    if magic != b"PFB1":
        raise ValueError("not a token file")
    at = HEAD.size
    ids = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<u4", docs, at + 8 * docs)
    starts = np.frombuffer(data, "<u4", blocks + 1, at + 12 * docs)
    return ids, lengths, before, starts, at + 12 * docs + 4 * (blocks + 1)


def values_of(data: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
    """The ids from ``begin`` to ``end`` of a file image; only the blocks that hold them are read."""
    total = HEAD.unpack_from(data)[2]
    end = total if end is None else min(end, total)
    _, _, _, starts, base = open_image(data)
    if begin >= end:
        return np.zeros(0, np.uint32)
    first, last = begin // BLOCK, -(-end // BLOCK)
    found = _blocks(data, base, starts[first:last].astype(np.int64))
    return found[begin - first * BLOCK : end - first * BLOCK]


def _blocks(data: bytes, base: int, starts: np.ndarray) -> np.ndarray:
    """Many blocks at once, by width."""
    raw = np.frombuffer(data, np.uint8)
    at = base + starts
    head = raw[at[:, None] + np.arange(7)]
    low, width = np.ascontiguousarray(head[:, :4]).view("<u4").ravel(), head[:, 4].astype(np.int64)
    count = np.ascontiguousarray(head[:, 5:7]).view("<u2").ravel()
    out = np.zeros((len(at), BLOCK), np.uint32)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    window = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # eight bytes from each byte on hold any value
    for w in np.unique(width).tolist():
        if w:
            where, bit = np.flatnonzero(width == w), np.arange(BLOCK) * w
            read = window[(at[where] + 7)[:, None] + (bit >> 3)]
            out[where] = (read >> (bit & 7).astype(np.uint64)) & np.uint64((1 << w) - 1)
    for i in np.flatnonzero(count).tolist():
        c, p = int(count[i]), int(at[i] + 7 + width[i] * BLOCK // 8)
        out[i, raw[p : p + c]] = np.frombuffer(data, "<u4", c, p + c)
    return (out + low[:, None]).ravel()


def byte_letters() -> list[str]:
    """The characters by which byte-level vocabularies name the 256 bytes: printable ones themselves, others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _letter(word: bytes) -> bool:
    """Whether the last character is a letter or digit, and still one character in lower case."""
    if word[-1] < 0x80:
        return word[-1:].isalnum()
    last = word.decode("utf-8", "replace")[-1]
    return last.isalpha() and len(last.lower()) == 1


class Words(dict):
    """Ids of words cut at white space, as little-endian 32-bit bytes; the tokenizer never joins across it.

    The strings of special tokens (which hold no white space) get those tokens' ids, as by the library; with
    ``plain_specials`` they are ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = [] if plain_specials else [t.content.encode() for t in added]
        self.cut = self.tokenizer.model.tokenize
        self.plain = byte_letters()
        cuts = self.tokenizer.to_str()
        self.letters = r"[\\p{L}]+" in cuts and '"ByteLevel"' in cuts

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > 1 and word[-1] in b",." and _letter(word[:-1]):
            ids = self[word[:-1]] + self[word[-1:]]  # a mark after a letter or digit is a token of its own
        else:
            ids = self.encode(word)
        if len(word) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.letters and text.isalpha() and text.islower() and unicodedata.is_normalized("NFC", text):
            # one token run as it stands: no need to normalise and cut it
            found = [t.id for t in self.cut(text if text.isascii() else "".join(map(self.plain.__getitem__, word)))]
        else:
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", found).tobytes()

    def ids(self, text: bytes | None) -> bytes:
        text = text or b""
        if b"\xcc" not in text and b"\xcd" not in text:  # no mark that composes with a basic letter: A-Z can be lowered first
            low = text.lower()
            if low == text or not any(s in low for s in self.specials):  # nor may that make a special token's string
                text = low
        return b"".join(map(self.__getitem__, text.split()))


@functools.lru_cache(maxsize=2)
def words(path: str, plain_specials: bool = False) -> Words:
    return Words(path, plain_specials)


def write(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", image_ids: int = IMAGE, plain_specials: bool = False) -> DataFrame:
    """Write the ids of ``docs`` in ascending id order; ``(part, seq, n_docs, n_ids, data)`` of the files.

    The tokenizer must drop white space and never join across it (ids are found word by word). Each document
    ends with ``end_id``; null and empty texts are that id alone. Null ids come first; rows that repeat an id
    follow each other in the order of their texts (null first, then by bytes). An empty table writes no image.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, end = TaskContext.get().partitionId(), words(tokenizer, plain_specials), np.array([end_id], "<u4").tobytes()
        names, lengths, parts, size, before, seq = [], [], [], 0, 0, 0

        def out():
            data = image(names, lengths, np.frombuffer(b"".join(parts), "<u4"), before)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_docs", "n_ids", "data"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), common.binary(batch.column(1))):
                ids = own.ids(text) + end
                names.append(-(1 << 63) if name is None else name)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                size += len(ids) // 4
                if size >= image_ids:
                    yield out()
                    before, seq, size = before + size, seq + 1, 0
                    names.clear(), lengths.clear(), parts.clear()
        if names:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = rows.repartitionByRange(common.partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    files = ranged.mapInArrow(run, "part int, seq int, n_docs long, n_ids long, data binary")
    return common.materialize(files, maxRecordsPerFile=IMAGES)


def documents(files: DataFrame) -> DataFrame:
    """Read file images back: ``(doc_id, start, ids)`` of each document, start counted over all files."""
    starts = _part_starts(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, lengths, before, _, _ = open_image(data)
                cuts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
                ids = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values_of(data).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([_names(names), pa.array(cuts[:-1] + before + starts[part]), ids], ["doc_id", "start", "ids"])

    return files.select("part", "data").mapInArrow(run, "doc_id long, start long, ids array<long>")


def summaries(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, read from the file images."""
    starts = _part_starts(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, lengths, before, _, _ = open_image(data)
                cuts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
                raw = values_of(data).astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([_names(names), pa.array(cuts[:-1] + before + starts[part]), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _names(names: np.ndarray) -> pa.Array:
    return pa.array(names.astype(np.int64), mask=names == -(1 << 63))


def _part_starts(files: DataFrame) -> dict[int, int]:
    """Ids before each partition: one number for each partition, not for each file or document."""
    sums = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    ahead = np.concatenate(([0], np.cumsum([n for _, n in sums]))).tolist()
    return {part: at for (part, _), at in zip(sums, ahead)}


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return summaries(write(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))
