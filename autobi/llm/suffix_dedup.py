"""Removal of repeated passages, exact over the whole corpus, by a prefix-free parse of the texts.

A passage is ``length`` bytes. Rolling-hash triggers cut every text into phrases: the trigger of a passage is
the place in it with the lowest rolling hash of ``gram`` bytes, and passages that start one after another with
the same trigger form a phrase, which with its trailing bytes holds all of them. (A trigger by a fixed residue
would leave passages without any, so the lowest hash is taken.) Equal passages have equal triggers at equal
places, so phrases with different triggers share none. The dictionary is the set of distinct phrases, the parse
the places where they occur.

1. Each task parses its texts and sends (trigger, phrase, place) rows, one for each phrase that it holds; the
   receiving task sorts them into corpus order. Later places of a phrase are repeats as a whole.
2. A dictionary phrase whose trigger no other phrase has holds no other repeats. The bytes of the others come
   together by trigger, and a suffix array of this part of the dictionary, by doubling up to ``length`` bytes, puts
   their suffixes in order; the parse gives the corpus order of equal ones. All but the first are repeats. As phrases
   overlap by all but one byte of a passage, no suffix goes on in the next phrase, so the parse needs no suffix
   array of its own.
3. Each text drops the bytes that its repeats cover.

A trigger of more than ``Limits.hot`` distinct phrases is hot (its phrases lie around a common passage, with ever
different neighbours). Its phrases are parsed once more with whole passages as triggers: each passage goes by its own
hash, once from each run of a task, so no task gets all of a common trigger or passage. In steps 1 and here phrases are
compared by two 64-bit hashes with independent bases; in the suffix arrays bytes are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autobi.llm import common

U = np.uint64


@dataclass(frozen=True)
class Limits:
    """Bytes parsed at once, rows a task holds before it sends them, distinct phrases that make a trigger hot.

    They bound memory; the result does not depend on them.
    """

    chunk: int = 1 << 20
    rows: int = 1 << 19
    hot: int = 64


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the 256 bytes, and the powers of an odd base and of its inverse modulo 2**64."""

    def run(x: int) -> np.ndarray:
        out = np.ones(size, U)
        done, step = 1, U(x)
        while done < size:
            more = min(done, size - done)
            out[done : done + more] = out[:more] * step
            step, done = step * step, done + more
        return out

    with np.errstate(over="ignore"):
        values = common.mix64(np.arange(1, 257, dtype=U) * U(base))
        return values, run(base), run(pow(base, -1, 1 << 64))


class Sums:
    """Prefix sums of a byte buffer from which the hash of any slice follows."""

    BASES = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)

    def __init__(self, raw: np.ndarray, which: int):
        size = 1 << max(12, len(raw).bit_length())
        values, powers, self.inverse = _powers(self.BASES[which], size)
        self.sums = np.zeros(len(raw) + 1, U)
        np.cumsum(values[raw] * powers[: len(raw)], out=self.sums[1:])

    def slices(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return common.mix64((self.sums[end] - self.sums[begin]) * self.inverse[begin])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return common.mix64((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def _windows(bounds: np.ndarray, length: int) -> np.ndarray:
    """Places where a passage starts that ends within its text; texts lie between neighbouring bounds."""
    begin, end = bounds[:-1], np.maximum(bounds[1:] - length + 1, bounds[:-1])
    change = np.zeros(bounds[-1] + 1, np.int8)
    has = end > begin
    np.add.at(change, begin[has], 1)
    np.add.at(change, end[has], -1)
    return np.flatnonzero(np.cumsum(change[:-1], dtype=np.int8))


def phrases(raw: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Start, number of passages, trigger hash and content hash of each phrase."""
    at = _windows(bounds, length)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    hashes = Sums(raw, 0).grams(gram)
    low = (hashes & ~U(0xFFFFFF)) | np.arange(len(hashes), dtype=U)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    trigger = (low[at] & U(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1))))
    start, count = at[new], np.diff(np.append(new, len(at)))
    content = Sums(raw, 1).slices(start, start + count + length - 1) + count.astype(U)
    return start, count, hashes[trigger[new]], content


def _pieces(batches: Iterator[pa.RecordBatch], length: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about ``chunk`` bytes: bytes, bounds of the texts, their ids, and the offset of each within its
    document (longer documents come in overlapping pieces)."""
    texts, ids, offsets, size = [], [], [], 0

    def out():
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        return np.frombuffer(b"".join(texts), np.uint8), bounds, np.array(ids, np.int64), np.array(offsets, np.int64)

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), common.binary(batch.column(1))):
            for offset in range(0, max(1, len(text or b"") - length + 1), chunk):
                part = (text or b"")[offset : offset + chunk + length - 1]
                texts.append(part), ids.append(name), offsets.append(offset)
                size += len(part)
                if size >= chunk:
                    yield out()
                    texts, ids, offsets, size = [], [], [], 0
    if texts:
        yield out()


def _split(columns: list[np.ndarray], to: np.ndarray, ranges: int) -> tuple[list[int], list[bytes]]:
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(ranges + 1))
    columns = [c[order] for c in columns]
    found = [r for r in range(ranges) if cut[r] < cut[r + 1]]
    return found, [b"".join([np.int64(cut[r + 1] - cut[r]).tobytes(), *(c[cut[r] : cut[r + 1]].tobytes() for c in columns)]) for r in found]


def _join(blobs: list[bytes], kinds: tuple) -> list[np.ndarray]:
    found = []
    for blob in blobs:
        n, at, row = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
        for kind in kinds:
            row.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
        found.append(row)
    return [np.concatenate([r[k] for r in found]) if found else np.zeros(0, kind) for k, kind in enumerate(kinds)]


def _batch(kind: str, to: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(to), pa.string()), pa.array(to, pa.int32()), pa.array(data, pa.binary())], ["kind", "range", "rows"])


#: Rows of a phrase: trigger, content, document, start, passages (0: only a mark that the trigger is hot).
PHRASE = (U, U, np.int64, np.uint32, np.uint8)
#: Spans: document, start, passages; ``HOT`` is added to the passages of a phrase with a hot trigger.
SPAN = (np.int64, np.uint32, np.uint32)
HOT = 1 << 16
PASSAGE = (U, U, np.int64, np.uint32)
BLOBS = "kind string, range int, rows binary"
PARTS = BLOBS + ", trigger long, doc long, start long, count int, bytes binary"


def _parsed(docs: DataFrame, length: int, gram: int, ranges: int, limits: Limits) -> DataFrame:
    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        trigger, content, doc, start, count = (np.concatenate([h[k] for h in held]) for k in range(5))
        order = np.lexsort((start, doc, content, trigger))
        trigger, content, doc, start, count = trigger[order], content[order], doc[order], start[order].astype(np.uint32), count[order]
        new_trigger = np.concatenate(([True], trigger[1:] != trigger[:-1]))
        first = new_trigger | np.concatenate(([True], content[1:] != content[:-1]))
        again = ~first
        if again.any():
            yield _batch("repeat", *_split([doc[again], start[again], count[again].astype(np.uint32)], _range(doc[again], ranges), ranges))
        group = np.cumsum(new_trigger) - 1
        hot = (np.bincount(group[first]) > limits.hot)[group] & first
        if hot.any():
            yield _batch("open", *_split([doc[hot], start[hot], count[hot].astype(np.uint32) + np.uint32(HOT)], _range(doc[hot], ranges), ranges))
        mark = hot & new_trigger
        count = np.where(mark, 0, count).astype(np.uint8)
        send = (first & ~hot) | mark
        rows = [x[send].astype(kind) for x, kind in zip((trigger, content, doc, start, count), PHRASE)]
        yield _batch("phrase", *_split(rows, (rows[0] % U(ranges)).astype(np.int64), ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        with np.errstate(over="ignore"):
            for raw, bounds, ids, offsets in _pieces(batches, length, limits.chunk):
                start, count, trigger, content = phrases(raw, bounds, length, gram)
                text = np.searchsorted(bounds, start, side="right") - 1
                held.append([trigger, content, ids[text], start - bounds[text] + offsets[text], count])
                size += len(start)
                if size >= limits.rows:
                    yield from flush(held)
                    held, size = [], 0
            if size:
                yield from flush(held)

    return docs.mapInArrow(common.tidy(run), BLOBS)


def _range(doc: np.ndarray, ranges: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (common.mix64(doc.astype(np.int64).view(U)) % U(ranges)).astype(np.int64)


def _sorted_phrases(rows: DataFrame, ranges: int, limits: Limits) -> DataFrame:
    """Corpus order of the phrases: later places of a phrase as repeats, first places with a shared trigger as open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for batch in batches:
            kinds, data = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            blobs += [d for k, d in zip(kinds, data) if k == "phrase"]
            for kind in ("repeat", "open"):
                own = [d for k, d in zip(kinds, data) if k == kind]
                if own:
                    yield _batch(kind, [0] * len(own), own)
        trigger, content, doc, start, count = _join(blobs, PHRASE)
        if not len(trigger):
            return
        order = np.lexsort((start, doc, content, trigger))
        trigger, content, doc, start, count = (x[order] for x in (trigger, content, doc, start, count))
        real = count > 0
        new_trigger = np.concatenate(([True], trigger[1:] != trigger[:-1]))
        group = np.cumsum(new_trigger) - 1
        same = ~new_trigger & np.concatenate(([False], (content[1:] == content[:-1]) & real[1:] & real[:-1]))
        again = real & same
        first = real & ~same
        distinct = np.bincount(group[first], minlength=group[-1] + 1)
        hot = (np.bincount(group[~real], minlength=group[-1] + 1) > 0) | (distinct > limits.hot)
        shared = first & (hot | (distinct > 1))[group]
        passages = count.astype(np.uint32) + np.where(hot[group], np.uint32(HOT), np.uint32(0))
        for kind, which, number in (("repeat", again, count.astype(np.uint32)), ("open", shared, passages)):
            if which.any():
                yield _batch(kind, [0], _split([doc[which], start[which], number[which]], np.zeros(int(which.sum()), np.int64), 1)[1])

    return rows.repartition(ranges, "range").mapInArrow(common.tidy(run), BLOBS)


def _by_document(rows: DataFrame, ranges: int) -> DataFrame:
    """``(doc_id, spans)`` from blobs of spans: spans are (start, passages) pairs in order, as bytes."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, count = _join(batch.column(0).to_pylist(), SPAN)
            if len(doc):
                yield _batch("", *_split([doc, start, count], _range(doc, ranges), ranges))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, start, count = _join([x for batch in batches for x in batch.column(0).to_pylist()], SPAN)
        if not len(doc):
            return
        order = np.lexsort((start, doc))
        doc, pair = doc[order], np.stack([start[order], count[order]], axis=1)
        cut = np.append(np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))), len(doc))
        for at in range(0, len(cut) - 1, 4096):
            part = cut[at : at + 4097]
            yield pa.RecordBatch.from_arrays([pa.array(doc[part[:-1]]), pa.array([pair[a:b].tobytes() for a, b in zip(part[:-1], part[1:])], pa.binary())], ["key", "spans"])

    sent = rows.select("rows").mapInArrow(common.tidy(send), BLOBS).repartition(ranges, "range").select("rows")
    return sent.mapInArrow(common.tidy(gather), "key long, spans binary")


def _opened(docs: DataFrame, spans: DataFrame, length: int, gram: int, ranges: int, limits: Limits) -> DataFrame:
    """Of the open phrases: ``phrase`` rows with their bytes and triggers; of those with a hot trigger ``passage``
    blobs by hash, and ``repeat`` blobs of passages that the task has met before."""

    def plain(kind: str, to: list[int], data: list[bytes]) -> pa.RecordBatch:
        n = len(to)
        rest = [pa.nulls(n, pa.int64())] * 3 + [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays([*_batch(kind, to, data).columns, *rest], ["kind", "range", "rows", "trigger", "doc", "start", "count", "bytes"])

    def passages(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        one, two, doc, start = (np.concatenate([h[k] for h in held]) for k in range(4))
        by = np.lexsort((start, doc, two, one))
        one, two, doc, start = one[by], two[by], doc[by], start[by].astype(np.uint32)
        again = np.concatenate(([False], (one[1:] == one[:-1]) & (two[1:] == two[:-1])))
        if again.any():
            yield plain("repeat", *_split([doc[again], start[again], np.ones(int(again.sum()), np.uint32)], _range(doc[again], ranges), ranges))
        rows = [x[~again] for x in (one, two, doc, start)]
        yield plain("passage", *_split(rows, (rows[0] % U(ranges)).astype(np.int64), ranges))

    def phrase_rows(raw: np.ndarray, doc: int, pair: np.ndarray) -> pa.RecordBatch:
        ends = pair.sum(axis=1) + length - 1
        parts = [raw[a:b].tobytes() for a, b in zip(pair[:, 0].tolist(), ends.tolist())]
        bounds = np.concatenate(([0], np.cumsum(ends - pair[:, 0]))).astype(np.int64)
        trigger = phrases(np.frombuffer(b"".join(parts), np.uint8), bounds, length, gram)[2]
        n = len(parts)
        first = [pa.array(["phrase"] * n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
        rest = [pa.array(trigger.view(np.int64)), pa.array(np.full(n, doc, np.int64)), pa.array(pair[:, 0]), pa.array(pair[:, 1].astype(np.int32)), pa.array(parts, pa.binary())]
        return pa.RecordBatch.from_arrays([*first, *rest], ["kind", "range", "rows", "trigger", "doc", "start", "count", "bytes"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                for name, text, spans in zip(batch.column(0).to_pylist(), common.binary(batch.column(1)), batch.column(2).to_pylist()):
                    pair = np.frombuffer(spans, np.uint32).reshape(-1, 2).astype(np.int64)
                    raw, hot = np.frombuffer(text, np.uint8), pair[:, 1] >= HOT
                    cold, pair = pair[~hot], pair[hot] - np.array([0, HOT])
                    for at in range(0, len(cold), 4096):
                        yield phrase_rows(raw, name, cold[at : at + 4096])
                    last = 0
                    while last < len(pair):  # a bounded part of the text at a time
                        base = int(pair[last, 0])
                        stop = int(np.searchsorted(pair[:, 0], base + limits.chunk, side="left"))
                        part = pair[last:stop]
                        own = np.unique(np.repeat(part[:, 0] - np.concatenate(([0], np.cumsum(part[:-1, 1]))), part[:, 1]) + np.arange(part[:, 1].sum()))
                        here = raw[base : int(own[-1]) + length]
                        one, two = (Sums(here, k).slices(own - base, own - base + length) for k in (0, 1))
                        held.append([one, two, np.full(len(own), name, np.int64), own])
                        size += len(own)
                        last = stop
                        if size >= limits.rows:
                            yield from passages(held)
                            held, size = [], 0
            if size:
                yield from passages(held)

    found = docs.join(spans, F.col("doc_id") == F.col("key")).select("doc_id", "text", "spans")
    return found.mapInArrow(common.tidy(send), PARTS)


def ranks(raw: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``raw``, the rank of its suffix by the first ``length`` bytes (equal ones have equal ranks).

    A suffix array by doubling: places are ordered by their first 8 bytes, then, from the ranks of two places, by
    twice as many, up to ``length``. Bytes after the end count as zero.
    """
    size = len(raw)
    step = min(8, length)
    padded = np.concatenate([raw, np.zeros(step, np.uint8)])
    key = np.zeros(size, U)
    for k in range(step):
        key = key << U(8) | padded[k : k + size].astype(U)
    rank = np.unique(key, return_inverse=True)[1].astype(U)
    while step < length:
        shift = min(step, length - step)
        behind = np.concatenate([rank[shift:] + U(1), np.zeros(min(shift, size), U)])[:size]
        rank = np.unique(rank * U(size + 1) + behind, return_inverse=True)[1].astype(U)
        step += shift
    return rank


def _runs(doc: np.ndarray, start: np.ndarray) -> list[bytes]:
    """Passages as one blob of spans."""
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))))
    count = np.diff(np.append(new, len(doc)))
    return _split([doc[new], start[new].astype(np.uint32), count.astype(np.uint32)], np.zeros(len(new), np.int64), 1)[1]


def _suffix_sorted(opened: DataFrame, length: int, ranges: int, limits: Limits) -> DataFrame:
    """Repeats among phrases with a common trigger, from suffix arrays of some 100 triggers and more at a time."""

    def repeated(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, start, count = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        sizes = np.array([len(r[4]) for r in rows], np.int64)
        begin = np.cumsum(sizes) - sizes
        with np.errstate(over="ignore"):
            rank = ranks(np.frombuffer(b"".join([r[4] for r in rows]), np.uint8), length)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        rank, doc, start = rank[np.repeat(begin, count) + inner], np.repeat(doc, count), np.repeat(start, count) + inner
        by = np.lexsort((start, doc, rank))
        which = by[1:][rank[by][1:] == rank[by][:-1]]
        if len(which):
            yield _batch("repeat", [0], _runs(doc[which], start[which]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= limits.chunk and row[0] != held[-1][0]:
                    yield from repeated(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from repeated(held)

    rows = opened.where("kind = 'phrase'").select("trigger", "doc", "start", "count", "bytes")
    return rows.repartition(ranges, "trigger").sortWithinPartitions("trigger").mapInArrow(common.tidy(run), BLOBS)


def _hashed(opened: DataFrame, ranges: int) -> DataFrame:
    """Repeats among the passages of hot triggers, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, doc, start = _join([x for batch in batches for x in batch.column(0).to_pylist()], PASSAGE)
        by = np.lexsort((start, doc, two, one))
        which = by[1:][(one[by][1:] == one[by][:-1]) & (two[by][1:] == two[by][:-1])]
        if len(which):
            yield _batch("repeat", [0], _runs(doc[which], start[which]))

    return opened.where("kind = 'passage'").select("range", "rows").repartition(ranges, "range").select("rows").mapInArrow(common.tidy(run), BLOBS)


def repeats(rows: DataFrame, length: int = 100, gram: int = 32, limits: Limits = Limits()) -> DataFrame:
    """``(key, spans)`` for rows ``(doc_id, text)`` with unique ids and no nulls: for each document with repeats,
    (start, passages) pairs of the passages to remove."""
    if not gram <= length < gram + 255:
        raise ValueError("a passage must be as long as a trigger, and less than 255 bytes longer")
    ranges = common.ranges(rows)
    sorted_ = common.materialize(_sorted_phrases(_parsed(rows, length, gram, ranges, limits), ranges, limits))
    spans = common.materialize(_by_document(sorted_.where("kind = 'open'"), ranges))
    opened = common.materialize(_opened(rows, spans, length, gram, ranges, limits))
    more = common.materialize(_suffix_sorted(opened, length, ranges, limits).unionByName(_hashed(opened, ranges)))
    found = [x.where("kind = 'repeat'").select("rows") for x in (sorted_, opened, more)]
    out = common.materialize(_by_document(found[0].unionByName(found[1]).unionByName(found[2]), ranges))
    common.drop(sorted_, spans, opened, more)
    return out


def _plain(numbered: DataFrame, text_col: str) -> DataFrame:
    return numbered.select(F.col("__place").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def cover(text: bytes, spans: bytes | None, length: int = 100) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the passages cover."""
    if not spans:
        return []
    pair = np.frombuffer(spans, np.uint32).reshape(-1, 2).astype(np.int64)
    begin, end = pair[:, 0], np.maximum.accumulate(pair[:, 0] + pair[:, 1] + length - 1)
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
    return list(zip(begin[new].tolist(), end[np.append(new[1:], len(pair)) - 1].tolist()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 32, limits: Limits = Limits()) -> DataFrame:
    """``(doc_id, n_bytes, runs, kept)``: removed byte runs ``array<struct<begin,end>>`` and the bytes that stay.

    A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a smaller id, or earlier
    in the same document; matches never cross documents, and all are judged on the input. Null texts count as
    empty. Rows that repeat an id, and those without one (before all others), count as documents of their own, in
    the order of a hash of their text. Cutting bytes may split a character; ``kept`` is therefore binary. Texts may
    have up to 2**32 bytes. Other columns are not read; an empty table gives an empty result.
    """
    docs = common.numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id", "text")
    spans = repeats(_plain(docs, "text"), length, gram, limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, runs, kept = [], [], []
            for text, spans in zip(common.binary(batch.column(1)), batch.column(2).to_pylist()):
                own = cover(text, spans, length)
                edges = [0, *(x for pair in own for x in pair), len(text)]
                sizes.append(len(text))
                runs.append([{"begin": a, "end": b} for a, b in own])
                kept.append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])]) if own else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "runs", "kept"])

    rows = docs.join(spans, F.col("__place") == F.col("key"), "left").select("id", F.coalesce("text", F.lit("")).alias("text"), "spans")
    return rows.mapInArrow(common.tidy(run), "doc_id long, n_bytes long, runs array<struct<begin:long,end:long>>, kept binary")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", length: int = 100, gram: int = 32) -> DataFrame:
    """``docs``, all rows and columns, with what :func:`remove_repeats` removes cut from the text.

    Bytes of a character that a cut splits go, too. ``chars_col``, where there is one, gets the new number of
    characters. Null texts stay null.
    """
    numbered = common.numbered(docs, id_col, text_col)
    spans = repeats(_plain(numbered, text_col), length, gram).withColumnsRenamed({"key": "__key", "spans": "__spans"})
    at, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, own in zip(common.binary(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist()):
                if text is not None and own:
                    edges = [0, *(x for pair in cover(text, own, length) for x in pair), len(text)]
                    text = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])
                texts.append(None if text is None else text.decode("utf-8", "ignore"))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.column(at).type)
            if chars >= 0:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], batch.column(chars).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    rows = numbered.join(spans, F.col("__place") == F.col("__key"), "left").select(*docs.columns, "__spans")
    return rows.mapInArrow(common.tidy(run), T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]))


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.read(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.length("kept")).cast("long")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
