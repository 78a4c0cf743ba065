"""Benchmark decontamination: documents that hold a near copy of a benchmark item.

Every window of as many words as an item has is compared with it. Windows and items get a SimHash of 256 bits from
their five-word shingles. The fingerprints are cut into 16 blocks; items are indexed by the value of each block. Of two
fingerprints that differ in at most ``radius`` bits some block differs in at most ``radius // 16``, so looking up all values
that near to a window's blocks finds all items within the radius. Most of those values are posted with the item, so that a
window takes one lookup a block, and all windows of a size are looked up together. The full Hamming distance and at last
the weighted similarity of the shingles decide.

At a similarity of 0.8 about 39 bits differ, with a standard deviation of 6; the radius is 63. Of two unrelated
fingerprints, about one pair in six is left by the blocks, and none by the distance. Windows that hold too few shingles
of all items of their size together to reach the similarity with one of them get no fingerprint; this loses
nothing, as a similarity s to an item of m shingles needs s * m of them.
"""

from __future__ import annotations

import functools
import itertools
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autobi.llm import common

#: Items and bytes of their texts that are sent to every task at once (one item at least); a larger benchmark is
#: worked off in as many passes as needed.
ITEMS, BYTES = 20_000, 32 << 20
WORDS, SIMILARITY, RADIUS = 5, 0.8, 63
WORDS_OF_PRINT = 4  # of 64 bits each
BLOCKS, VALUES = 16, 1 << 16
POSTS = 1 << 25  # postings of a slice's items, of 2 to 4 bytes


def _mix(values: np.ndarray, words: int) -> np.ndarray:
    """Hash of each run of ``words`` word hashes; of all of them if there are fewer."""
    k = min(words, len(values))
    if not k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(values) - k + 1, np.uint64)
        for i in range(k):
            out = out * np.uint64(0xB492B66FBE98F273) + values[i : len(values) - k + 1 + i]
        return common.mix64(out)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 500_000:
            self.clear()
        if len(word) <= 48:
            self[word] = found
        return found


def word_hashes(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words in order. A-Z count as a-z; words are cut at ASCII white space."""
    parts = (text or b"").lower().split()
    return np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))


def spread(rows: np.ndarray) -> np.ndarray:
    """The 256 bits of each shingle, as bytes of 0 and 1."""
    with np.errstate(over="ignore"):
        wide = np.stack([common.mix64(rows + np.uint64(k) * np.uint64(0xC2B2AE3D27D4EB4F)) for k in range(WORDS_OF_PRINT)], axis=1)
    return np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1, bitorder="little")


def simhash(rows: np.ndarray, at: np.ndarray, span: int, most: int = 1 << 12) -> np.ndarray:
    """Majority of the bits of the shingles, repeats included, of each window of ``span`` shingles that starts ``at``."""
    found = np.zeros((len(at), WORDS_OF_PRINT), np.uint64)
    done = 0
    while done < len(at):  # windows that start near each other share one running sum
        stop = int(np.searchsorted(at, at[done] + most))
        base = int(at[done])
        bits = spread(rows[base : int(at[stop - 1]) + span])
        sums = np.zeros((len(bits) + 1, bits.shape[1]), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        here = at[done:stop] - base
        found[done:stop] = np.packbits(2 * (sums[here + span] - sums[here]) > span, axis=1, bitorder="little").view(np.uint64)
        done = stop
    return found


@functools.lru_cache(maxsize=16)
def near_values(most: int, first: int = 0, last: int = 16) -> np.ndarray:
    """All block values with at most ``most`` bits set, all of them from ``first`` to before ``last``."""
    return np.array([sum(1 << b for b in bits) for k in range(most + 1) for bits in itertools.combinations(range(first, last), k)], np.uint16)


class Index:
    """Items of one size by the values of their fingerprints' blocks.

    An item is posted under all values that differ from its block in the low ``spread`` bits only, the others are
    varied in the lookup; a value keeps its items in order of the bits that are spent. So each pair of blocks that is
    near enough is met once. Of ``of`` items in all as many bits are spread as ``POSTS`` allows. Postings are found
    by the value itself or, if few, by binary search. Where even eight bits are too many (a wide radius), or where a
    size has so few of very many items that their lists would be shorter than the table of their limits, all items
    of the size are candidates.
    """

    def __init__(self, prints: np.ndarray, radius: int, of: int = 0):
        self.prints, self.radius, self.most = prints, radius, min(16, radius // BLOCKS)
        n = len(prints)
        costs = {bits: sum(math.comb(bits, k) for k in range(self.most + 1)) for bits in (16, 12, 8)}
        self.spread = next((bits for bits, cost in costs.items() if max(n, of) * BLOCKS * cost <= POSTS), 0)
        self.levels = 1 if self.spread == 16 else self.most + 1
        direct = n * costs.get(self.spread, 0) >= VALUES * self.levels // 2
        if not direct and self.spread != 16:
            self.spread = 0
        if not self.spread:
            return
        varied = near_values(self.most, 0, self.spread)
        spent = np.bitwise_count(varied).astype(np.int64) if self.levels > 1 else 0
        self.varied = near_values(self.most, self.spread, 16)
        self.left = self.most - np.bitwise_count(self.varied).astype(np.int64) if self.levels > 1 else 0
        self.keys: list[np.ndarray] = []
        self.items: list[np.ndarray] = []
        self.direct = direct
        for block in prints.view(np.uint16).reshape(-1, BLOCKS).T:
            keys = (block[:, None] ^ varied[None]).astype(np.int64) * self.levels + spent
            keys = keys.ravel().astype(np.uint16 if self.levels == 1 else np.uint32)
            order = np.argsort(keys, kind="stable")
            self.items.append((order // len(varied)).astype(np.uint16 if n <= VALUES else np.uint32))
            counts = np.bincount(keys, minlength=VALUES * self.levels) if direct else None
            self.keys.append(np.append(0, np.cumsum(counts)).astype(np.int32) if direct else keys[order])

    def candidates(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each block (place in ``values``, item) of the pairs that are near enough in it."""
        if not self.spread:
            place, item = np.divmod(np.arange(len(values) * len(self.prints)), max(1, len(self.prints)))
            yield place, item
            return
        for keys, items, block in zip(self.keys, self.items, values.view(np.uint16).reshape(-1, BLOCKS).T):
            wanted = (block[:, None] ^ self.varied[None]).astype(np.int64) * self.levels
            if self.direct:
                first, last = keys[wanted].ravel(), keys[wanted + self.left + 1].ravel()
            else:
                wanted = wanted.astype(keys.dtype).ravel()
                first, last = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
            size = (last - first).astype(np.int64)
            place = np.repeat(np.arange(len(size)), size)
            yield place // len(self.varied), items[(first - np.cumsum(size) + size)[place] + np.arange(len(place))]

    def within(self, values: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place in ``values``, item) within the radius, in order; a bounded number of ``values`` at a time."""
        n = len(self.prints)
        step = max(1, (1 << 20) // max(1, n))
        for at in range(0, len(values), step):
            here, found = values[at : at + step], []
            for place, item in self.candidates(here):
                near = np.bitwise_count(self.prints[item] ^ here[place]).sum(axis=1) <= self.radius
                found.append(place[near] * n + item[near])
            place, item = np.divmod(np.unique(np.concatenate(found)), max(1, n))
            yield from zip((at + place).tolist(), item.tolist())


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity; a shingle weighs as often as it occurs."""
    one, two = Counter(a.tolist()), Counter(b.tolist())
    both = (one & two).total()
    whole = len(a) + len(b) - both
    return both / whole if whole else 0.0


class Items:
    """All items; those of fewer words than a shingle are one shingle each and stand apart by their length."""

    def __init__(self, items: list[tuple[int, bytes]], words: int, radius: int, threshold: float):
        hashed: dict[int, list[tuple[int, np.ndarray]]] = {}
        hashes = WordHashes()
        for name, text in items:
            own = word_hashes(text, hashes)
            if len(own):
                hashed.setdefault(min(words, len(own)), []).append((name, own))
        self.groups = [Group(found, width, radius, threshold) for width, found in sorted(hashed.items())]

    def match(self, own: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, best similarity, first word of that window, its words) for each item that some window matches."""
        return [m for g in self.groups if len(own) >= g.words for m in g.match(_mix(own, g.words), len(own))]


class Group:
    """Items whose shingles have the same number of words."""

    def __init__(self, items: list[tuple[int, np.ndarray]], words: int, radius: int, threshold: float):
        self.words, self.threshold = words, threshold
        found = [(name, _mix(own, words), len(own)) for name, own in items]
        self.names, self.rows = [x[0] for x in found], [x[1] for x in found]
        sizes = np.array([x[2] for x in found], np.int64)
        self.sizes, kind = np.unique(sizes, return_inverse=True)
        self.known, place = np.unique(np.concatenate(self.rows), return_inverse=True)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        #: of each known shingle the sizes of the items that have it
        pair = np.unique(place * len(self.sizes) + np.repeat(kind, [len(r) for r in self.rows]))
        self.kinds = pair % len(self.sizes)
        self.cut = np.searchsorted(pair // len(self.sizes), np.arange(len(self.known) + 1))
        #: for each size: the items, how many of their shingles a window must hold, and their index
        self.of_size = []
        for k, size in enumerate(self.sizes.tolist()):
            which = np.flatnonzero(kind == k)
            prints = np.concatenate([simhash(self.rows[i], np.zeros(1, np.int64), len(self.rows[i])) for i in which])
            self.of_size.append((which, int(np.ceil(threshold * (size - words + 1) - 1e-9)), Index(prints, radius, len(items))))

    def hits(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known shingles, and which."""
        maybe = np.flatnonzero(self.bits[(rows & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, rows[maybe]), len(self.known) - 1)
        same = self.known[at] == rows[maybe]
        return maybe[same], at[same]

    def windows(self, rows: np.ndarray, n_words: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(which size, shingles in a window, starts of the windows that hold enough shingles of that size's items)."""
        place, which = self.hits(rows)
        if not len(place):
            return
        count = self.cut[which + 1] - self.cut[which]
        kinds = self.kinds[np.repeat(self.cut[which] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        order = np.argsort(kinds, kind="stable")
        kinds, place = kinds[order], np.repeat(place, count)[order]
        ends = np.append(np.flatnonzero(np.diff(kinds)) + 1, len(kinds))
        for first, last in zip([0, *ends[:-1].tolist()], ends.tolist()):
            kind, own = int(kinds[first]), place[first:last]
            span, need = max(1, min(int(self.sizes[kind]), n_words) - self.words + 1), self.of_size[kind][1]
            if span >= need and len(own) >= need:
                start = np.unique(np.clip(own[:, None] - np.arange(span)[None, :], 0, len(rows) - span)) if len(own) * span < 1 << 22 else np.arange(len(rows) - span + 1)
                held = np.searchsorted(own, start + span) - np.searchsorted(own, start)
                if (held >= need).any():
                    yield kind, span, start[held >= need]

    def match(self, rows: np.ndarray, n_words: int) -> list[tuple[int, float, int, int]]:
        best: dict[int, tuple[float, int, int]] = {}
        for kind, span, starts in self.windows(rows, n_words):
            which, _, index = self.of_size[kind]
            for place, item in index.within(simhash(rows, starts, span)):
                at, item = int(starts[place]), int(which[item])
                s = similarity(rows[at : at + span], self.rows[item])
                if s >= self.threshold and (item not in best or (-s, at) < (-best[item][0], best[item][1])):
                    best[item] = s, at, min(int(self.sizes[kind]), n_words)
        return [(self.names[i], *best[i]) for i in sorted(best)]


_ITEMS: dict[str, Items] = {}


def _items(name: str, sent, words: int, radius: int, threshold: float) -> Items:
    """The slice's items, built once in each Python worker."""
    if name not in _ITEMS:
        _ITEMS.clear()
        _ITEMS[name] = Items(sent.value, words, radius, threshold)
    return _ITEMS[name]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = WORDS, threshold: float = SIMILARITY, radius: int = RADIUS, at_once: int = ITEMS) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_words)``: each document with each item it holds.

    similarity is the best of the document's windows, first_word where the first such window starts. A document with
    fewer words than the item is one window; an item of fewer words than a shingle is one shingle. Null and empty
    texts and items match nothing, nor do items without an id. Rows that repeat an id each give rows; an item id
    that repeats is compared in each of its texts. A document without an id keeps its null. Other columns are not
    read; empty tables give an empty result. The benchmark is read in slices of at most ``at_once`` items and
    ``BYTES`` bytes in id order, each sent to all tasks, with one pass over the documents for each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = [_matched(rows, sent, words, radius, threshold) for sent in _slices(benchmark, item_col, item_text_col, at_once)]
    return functools.reduce(DataFrame.unionByName, parts)


def _slices(benchmark: DataFrame, item_col: str, item_text_col: str, at_once: int) -> Iterator:
    """Broadcasts of the items, bounded in items and bytes; at least one, which may be empty."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    own, size, count = [], 0, 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        text = row.text.encode()
        if own and (len(own) >= at_once or size + len(text) > BYTES):
            yield context.broadcast(own)
            own, size, count = [], 0, count + 1
        own.append((row.item_id, text))
        size += len(text)
    if own or not count:
        yield context.broadcast(own)


def _matched(rows: DataFrame, sent, words: int, radius: int, threshold: float) -> DataFrame:
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, hashes = _items(name, sent, words, radius, threshold), WordHashes()
        for batch in batches:
            found = []
            for doc, text in zip(batch.column(0).to_pylist(), common.binary(batch.column(1))):
                found += [(doc, *m) for m in items.match(word_hashes(text, hashes))]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return rows.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = WORDS, threshold: float = SIMILARITY, radius: int = RADIUS, at_once: int = ITEMS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item; nothing is shuffled for it.

    Null and empty texts hold none and stay, each row is judged by itself whatever its id, and empty tables are
    allowed; items are read as by :func:`leaks`.
    """
    at, schema = docs.columns.index(text_col), docs.schema
    for sent in _slices(benchmark, item_col, item_text_col, at_once):

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            items, hashes = _items(name, sent, words, radius, threshold), WordHashes()
            for batch in batches:
                yield batch.filter(pa.array([not items.match(word_hashes(t, hashes)) for t in common.binary(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
