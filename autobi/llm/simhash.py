"""Near-duplicate groups by SimHash, candidates pruned by the pigeonring principle.

A fingerprint is cut into ``segments`` parts that lie on a ring. If two fingerprints differ in at most ``t``
bits, some chain of consecutive parts has, for each of its prefixes of length l, at most ``floor(l * t / m)``
differing bits. While that budget is zero the parts are equal, so those parts together form the join key; the
rest of the chain is tested on each candidate before the full Hamming distance.

Only distinct fingerprints are compared, so copies cost nothing. A key shared by many distinct fingerprints is
split by the parts of the chain that follow, as long as the budget is one bit: the longer key of one fingerprint
equals that of the other, or equals it once one of its set bits is cleared. For ``t`` = 2 the short key has 26 bits
and the long one 51, so that at most 2**13 fingerprints ever share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autobi.llm import common

SEED = 42


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """SimHash of one text: majority of the XXH64 bits of its word shingles, repeats included."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined, size = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.concatenate(([0], np.cumsum(size[:-1] + 1)))
    end = begin + size
    k = min(words, len(parts))
    digest, total = xxhash.xxh64_digest, len(parts) - k + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 15):
        stop = min(total, at + (1 << 15))
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(begin[at:stop].tolist(), end[at + k - 1 : stop + k - 1].tolist())])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        for low in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            counts += np.add.reduce(bits[low : low + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)``, fp a signed long with the fingerprint's bits. Null and wordless texts: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in common.binary(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def ring(segments: int, distance: int) -> tuple[list[tuple[int, int]], list[int], int]:
    """Bit ranges (shift, width) of the segments, the budget of each chain length, and how many parts are equal."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    budget = [length * distance // segments for length in range(1, segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])], budget, sum(b == 0 for b in budget)


def chains(boxes: np.ndarray, total: np.ndarray, most: int) -> np.ndarray:
    """Which rows may differ in at most ``total`` bits, judged by chains of up to ``most`` segments on a ring.

    ``boxes`` holds the differing bits of each segment. Some chain must keep, at each of its lengths, within its share of
    the total.
    """
    open_, run = np.ones(boxes.shape, bool), np.zeros(boxes.shape, np.int64)
    for length in range(1, most + 1):
        run += np.roll(boxes, 1 - length, axis=1)
        open_ &= run <= (length / boxes.shape[1] * total)[:, None] + 1e-9
    return open_.any(axis=1)


def _mask(parts: list[tuple[int, int]]) -> int:
    value = sum(((1 << w) - 1) << s for s, w in parts)
    return value - (1 << 64) if value >> 63 else value


def links(fps: DataFrame, distance: int = 2, segments: int | None = None, hot: int = 16) -> DataFrame:
    """``(a, b)`` between distinct fingerprints ``fps(fp)``: links of at most ``distance`` bits with exact components.

    Keys of more than ``hot`` fingerprints are split by longer chains; the result does not depend on it. The
    larger the distance, the shorter the keys and the more candidates they leave: a key has about 128 / (2 *
    distance + 1) bits, and twice as many when split.
    """
    segments = segments or min(64, 2 * distance + 1)
    parts, budget, equal = ring(segments, distance)
    if distance < 1:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    if equal == 0:
        raise ValueError("needs more segments than differing bits")
    once = max(length for length in range(equal, segments + 1) if budget[length - 1] <= 1)
    turns = [[parts[(i + k) % segments] for k in range(segments)] for i in range(segments)]
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(t[:equal]))) for t in turns])
    keyed = fps.select("fp", F.posexplode(keys).alias("turn", "key"))
    sizes = keyed.groupBy("turn", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = common.materialize(keyed.join(sizes, ["turn", "key"]))
    few = shared.where(F.col("n") <= hot).select("turn", "key", "fp")
    many = shared.where(F.col("n") > hot)
    by_turn = lambda values: F.array(*values)[F.col("turn")]
    long_key = F.col("fp").bitwiseAND(by_turn([F.lit(_mask(t[:once])) for t in turns]))
    plain = many.select("turn", long_key.alias("key"), "fp")
    flips = by_turn([F.array(*[F.lit(_mask([(b, 1)])) for s, w in t[equal:once] for b in range(s, s + w)]) for t in turns])
    bit = F.explode(F.filter(flips, lambda x: F.col("fp").bitwiseAND(x) != 0)).alias("bit")
    cleared = many.select("turn", long_key.alias("key"), "fp", bit).select("turn", F.col("key").bitwiseXOR(F.col("bit")).alias("key"), "fp")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    within = F.bit_count(differ) <= distance
    for length in range(segments - 1, equal, -1):  # the shortest chain is tested first
        test = F.lit(False)
        for i, t in enumerate(turns):
            test = F.when(F.col("turn") == i, F.bit_count(differ.bitwiseAND(F.lit(_mask(t[:length])))) <= budget[length - 1]).otherwise(test)
        within = test & within

    def met(left: DataFrame, right: DataFrame, ordered: bool) -> DataFrame:
        a, b = (x.select("turn", "key", F.col("fp").alias(name)) for x, name in ((left, "a"), (right, "b")))
        pairs = a.join(b, ["turn", "key"])
        return (pairs.where(F.col("a") < F.col("b")) if ordered else pairs).where(within).select("a", "b")

    return _thinned(met(few, few, True).unionByName(met(plain, plain, True)).unionByName(met(plain, cleared, False)))


def _thinned(pairs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Of the links in each partition, about ``most`` at a time, those that are needed for the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pair: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, k]).view(np.int64)) for k in (0, 1)], ["a", "b"])

        held, size = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy().view(np.uint64) for k in (0, 1)], axis=1))
            size += batch.num_rows
            if size >= most:
                held = [_forest(np.concatenate(held))]
                size = len(held[0])
                if 2 * size >= most:
                    yield out(held[0])
                    held, size = [], 0
        if size:
            yield out(_forest(np.concatenate(held)))

    return pairs.mapInArrow(run, "a long, b long")


def _forest(pair: np.ndarray) -> np.ndarray:
    """Links that join the same fingerprints as ``pair`` does, at most one for each of them."""
    names, ends = np.unique(pair, return_inverse=True)
    ends = ends.reshape(pair.shape)
    root = np.arange(len(names))
    while len(ends):
        low = np.minimum(root[ends[:, 0]], root[ends[:, 1]])
        new = root.copy()
        np.minimum.at(new, root[ends[:, 0]], low)
        np.minimum.at(new, root[ends[:, 1]], low)
        new = new[new[new]]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(names))
    return np.stack([names[moved], names[root[moved]]], axis=1).astype(np.uint64).reshape(-1, 2)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2, segments: int | None = None, hot: int = 16) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, fp, component_id)``.

    component_id is the smallest id among the documents reachable by links of at most ``distance`` bits, the
    document itself included; any distance is allowed (:func:`links` says what it costs). Null and empty texts
    share fingerprint zero and are linked like any other. Rows that repeat an id each give a row. A null id gets
    its group's smallest id (null if all are). Other columns of ``docs`` are not read. An empty table gives an
    empty result.
    """
    fps = common.materialize(fingerprints(docs, id_col, text_col, words))
    each = common.materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    root = common.components(links(each.select("fp"), distance, segments, hot))
    rooted = each.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = common.materialize(rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group, all columns: the one with the smallest id.

    Rows are told apart by their place, not by their id. Among rows of one id the one whose text has the smaller
    hash comes first; rows without an id come last, so one of them stays only if no row of its group has an id.
    """
    rows = common.numbered(docs, id_col, text_col, nulls_first=False)
    return keep_first(rows, near_duplicates(rows, PLACE, text_col, **options))


#: The column that :func:`common.numbered` adds.
PLACE = "__place"


def keep_first(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows whose place is the ``component_id`` of their group in ``groups(doc_id, component_id)``, without it."""
    stay = common.materialize(groups.where("doc_id = component_id").select(F.col("doc_id").alias(PLACE)))
    return rows.join(stay, PLACE, "left_semi").drop(PLACE)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
