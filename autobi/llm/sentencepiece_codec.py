"""SentencePiece encoding that keeps, for every piece, the bytes of the source text it came from.

Normalisation replaces, at each place, the longest prefix found in the model's compiled character map (a
double-array trie with a pool of replacement strings) and records for every normalised byte the source byte
it came from. Pieces tile the normalised text, so their cumulated lengths index that record and give source
spans. The segmentation itself is the library's. No piece of such a vocabulary holds a space mark after
another character, so text is cut before each run of space marks and each cut is encoded once and kept.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autobi.llm import common

MARK = "▁".encode()
CUT = re.compile(rb" +[^ ]*")
#: Entries kept by each worker before it starts anew, and the longest cut that is kept.
KEPT, LONGEST = 200_000, 64


class CharMap:
    """Longest-prefix replacement through a compiled character map (empty: nothing is replaced)."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.pool = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement and the length of the longest prefix of text[at:] in the map."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                value = units[node] & 0x7FFFFFFF
                found = self.pool[value : self.pool.index(b"\0", value)], k + 1 - at
        return found


class Normalizer:
    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each of them and the end, the source offset."""
        if self.map.units or self.squeeze or not self.escape:
            return self._general(text)
        if not text:
            return b"", np.zeros(1, np.int32)
        source = np.frombuffer(text, np.uint8)
        width = np.where(source == 32, np.int8(3), np.int8(1))
        align = np.repeat(np.arange(len(source), dtype=np.int32), width)
        head = 3 * bool(self.prefix)
        return MARK * bool(self.prefix) + text.replace(b" ", MARK), np.concatenate((np.zeros(head, np.int32), align, [len(source)])).astype(np.int32)

    def _general(self, text: bytes) -> tuple[bytes, np.ndarray]:
        units: list[tuple[bytes, int]] = []
        at = 0
        while at < len(text):
            hit = self.map.longest(text, at) if self.map.units else None
            if hit is None:
                lead = text[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = text[at : at + n], n
            units += [(hit[0][k : k + 1], at) for k in range(len(hit[0]))]
            at += hit[1]
        if self.squeeze:
            kept: list[tuple[bytes, int]] = []
            for byte, where in units:
                if byte != b" " or kept and kept[-1][0] != b" ":
                    kept.append((byte, where))
            while kept and kept[-1][0] == b" ":
                kept.pop()
            at = len(text.rstrip(b" "))
            units = kept
        if not units:
            return b"", np.array([len(text)], np.int32)
        space = MARK if self.escape else b" "
        out, align = (space, [units[0][1]] * len(space)) if self.prefix else (b"", [])
        parts = [out]
        for byte, where in units:
            byte = space if byte == b" " else byte
            parts.append(byte)
            align += [where] * len(byte)
        return b"".join(parts), np.array([*align, at], np.int32)


class Codec(dict):
    """Encoder and decoder of one model; as a dict it keeps the ids of cuts (int32 bytes)."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.normalize = Normalizer(model.normalizer_spec)
        pieces = [p.piece for p in model.pieces]
        self.width = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], np.int32)
        self.plain = self.normalize.prefix and not self.normalize.squeeze and not self.normalize.map.units and not any(re.search("[^▁]▁", p) for p in pieces)
        self.unknown = self.processor.unk_id()
        self.mark = np.array([self.processor.piece_to_id("▁")], np.int32).tobytes()

    def __missing__(self, cut: bytes) -> bytes:
        if not cut:  # a single space mark at the end
            return self.mark
        ids = np.array(self.processor.encode(cut.decode("utf-8", "replace")), np.int32).tobytes()
        if len(cut) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[cut] = ids
        return ids

    def ids(self, text: bytes) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if not self.plain or MARK in text:
            return np.array(self.processor.encode(text.decode("utf-8", "replace")), np.int32)
        cuts = text.split(b" ") if b"  " not in text and text[0] != 32 and text[-1] != 32 else [m[1:] for m in CUT.findall(b" " + text)]
        return np.frombuffer(b"".join(map(self.__getitem__, cuts)), np.int32)

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last source byte of every piece."""
        normal, align = self.normalize(text)
        width = self.width[ids]
        if (ids == self.unknown).any():  # one unknown piece stands for a run of characters: the library knows its surface
            width = np.array([len(p.surface.replace(" ", "▁").encode()) for p in self.processor.encode(text.decode("utf-8", "replace"), return_type="proto").pieces], np.int32)
        end = np.cumsum(width)
        if len(end) and end[-1] != len(normal):
            raise ValueError("pieces do not tile the normalised text")
        return align[end - width], align[end]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, digest: bool = False) -> DataFrame:
    """``(doc_id, ids, begins, ends)``, with ``decode`` also ``decoded``: the library's decoding of the ids, with
    ``digest`` also ``spans_sha256``: lowercase hex of begin, end, begin, ... as little-endian unsigned 32-bit integers.

    ids are those of the sentencepiece library without begin or end ids; begins and ends are byte offsets in
    the UTF-8 source. Null and empty texts give empty arrays and an empty decoding. Bytes that are no UTF-8
    count as U+FFFD. Repeated rows each give a row; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for text in common.binary(batch.column(1)):
                    text = text or b""
                    ids = own.ids(text)
                    rows.append((ids, *own.spans(text, ids)))
                counts = np.array([0, *(len(r[0]) for r in rows)], np.int64)
                offsets = pa.array(np.cumsum(counts).astype(np.int32))
                arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[k] for r in rows]).astype(np.int32))) for k in range(3)]
                names = ["doc_id", "ids", "begins", "ends"]
                if decode:
                    arrays.append(pa.array([own.processor.decode(r[0].tolist()) if len(r[0]) else "" for r in rows], pa.string()))
                    names.append("decoded")
                if digest:
                    arrays.append(pa.array([hashlib.sha256(np.stack(r[1:], axis=1).astype("<u4").tobytes()).hexdigest() for r in rows], pa.string()))
                    names.append("spans_sha256")
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>" + ", decoded string" * decode + ", spans_sha256 string" * digest)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, decoded)`` from arrays of ids; a null array counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model).processor
        for batch in batches:
            texts = [own.decode(ids) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digest_columns() -> dict:
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return {"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(listed, 256), "decoded_sha256": F.sha2("decoded", 256)}


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    encoded = encode(common.read(spark, sf_dir, "documents"), default_model(), decode=True, digest=True)
    return encoded.select("doc_id", *[c.alias(name) for name, c in digest_columns().items()], "spans_sha256")
