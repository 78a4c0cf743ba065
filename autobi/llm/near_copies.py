"""Near copies by SimHash of word shingles, candidates by pigeonring, each link tested by the shingles themselves.

Two documents are linked if the sets of their five-word shingles have a Jaccard similarity of at least 0.8. At that
similarity 15 % of SimHash bits differ. In 64 bits that is 10 and often more than 15, so that equal segments would be of
3 bits and prune nothing; a fingerprint here has ``BITS`` bits, in ``SEGMENT`` bits long segments on a ring. Two that differ
in fewer bits than there are segments have one of them equal, and of two that differ in 15 % of all bits 99 % have.
That segment is the key; the chain that starts with it must keep within its share of ``RADIUS`` bits at each length, which
is tested where keys meet, then chains of the whole ring and the Hamming distance, last the sets. Keys of many texts
are split by the segments that follow.

What these links leave is exact, too: pairs that no such link joins are found by the shingles. The pigeonhole is laid over
them in an order common to all
documents: of two sets of which neither is smaller than ``s``, and one has just ``s`` shingles, the first
``s - ceil(2 * 0.8 / 1.8 * s) + 1`` of the smaller one (its lead) and the first ``s' - ceil(0.8 * s') + 1`` of the larger one
(its keys) share one. Shingles that are common in a sample come last in that order; this changes the work and not the
result. A passage that many texts share thus leads a text only if it makes up most of it. Keys whose texts are all of one
group are done. Other pairs that meet by a lead are
compared by their whole sets, unless their places in the sets or parities show that too much differs: in bitmaps of
the parity of shingles at each of some places (four for each shingle or more) no more bits can differ than shingles do,
so this bound on the Hamming distance loses nothing. It is tested by pigeonring chains of segments first, as in ``simhash``.

A key with many leads is not paired off. All its documents are compared with one of them, the centre. As Jaccard
distance is a metric, only those not much farther from the centre than others can be similar to them; those
not similar to the centre go on to the next round with a centre of their own. With each round, in the first of which
groups of near copies are found, ``LATER`` times as many pairs may be tested: what is left of a key are mostly texts that share a
passage and else differ, which places and fingerprints tell apart in the join itself.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autobi.llm import common
from autobi.llm.simhash import PLACE, SEED, chains, keep_first

SLACK = 1e-9
#: Places of a fingerprint at least; a power of two, so that a longer one can be folded to the length of a shorter one.
PLACES = 1024
#: Segments in the longest chain that is tested before the full distance; a segment is 64 bits.
CHAIN = 4
#: Bits of a SimHash fingerprint, of its segments, and in how many two of similar texts may differ (a quarter; 15 % do at 0.8).
BITS, SEGMENT, RADIUS = 1024, 16, 256
LATER = 3
#: Leads that are always paired off with all that have their key: that is in proportion to the input.
FEW = 8
#: The fingerprint folded to 256 bits, in four numbers that pairs are tested by as they are made.
FOLDS = ("f0", "f1", "f2", "f3")


def grams(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text of fewer words is one shingle."""
    parts = (text or b"").lower().split()
    joined, size = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    begin = np.concatenate(([0], np.cumsum(size[:-1] + 1)))
    end = begin + size
    begin, end, digest = begin[: len(parts) - words + 1], end[words - 1 :], xxhash.xxh64_digest
    found = []
    for at in range(0, len(begin), 1 << 15):  # a long text's shingles are never all there as objects
        found.append(b"".join([digest(joined[a:b], SEED) for a, b in zip(begin[at : at + (1 << 15)].tolist(), end[at : at + (1 << 15)].tolist())]))
    return np.unique(np.frombuffer(b"".join(found), np.uint64))


def fingerprint(own: np.ndarray) -> bytes:
    """SimHash of a set of shingles: the majority of each of ``BITS`` bits derived from their hashes."""
    more, counts = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.zeros(BITS, np.int64)
    for at in range(0, len(own), 255):  # sums of 255 bits fit a byte
        bits = np.unpackbits(common.mix64(own[at : at + 255, None] + more).view(np.uint8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(own)).tobytes()


def _usual(texts: DataFrame, words: int, sample: int, least: int = 3, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample of the texts, sorted, and how often they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(t, words) for t in common.binary(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))], ["gram"])

    every = max(1, texts.count() // sample)
    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select(F.coalesce("text", F.lit("")).alias("text")).dropDuplicates()
    rows = some.mapInArrow(common.tidy(run), "gram long").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "gram").limit(most).collect()
    rows.sort(key=lambda r: r.gram % (1 << 64))
    return np.array([r.gram for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)


def _keys(texts: DataFrame, words: int, similarity: float, usual: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(node, size, keys, sketch, fp, *FOLDS)``: how many shingles a text has, as bytes those that come first, the sketch, the SimHash."""

    def first(own: np.ndarray) -> np.ndarray:
        count = len(own) - math.ceil(similarity * len(own) - SLACK) + 1
        if not len(usual[0]):
            return own[:count]
        at = np.minimum(np.searchsorted(usual[0], own), len(usual[0]) - 1)
        often = np.where(usual[0][at] == own, usual[1][at], 0)
        return own[np.argsort(often, kind="stable")[:count]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [grams(t, words) for t in common.binary(batch.column(1))]
            sketches = [sketch(x) for x in sets]
            folded = np.array([np.bitwise_xor.reduce(np.frombuffer(x, np.int64).reshape(-1, len(FOLDS)), axis=0) for x in sketches], np.int64).reshape(-1, len(FOLDS))
            found = [pa.array(map(len, sets), pa.int32()), pa.array([first(x).tobytes() for x in sets], pa.binary()), pa.array(sketches, pa.binary()), pa.array(map(fingerprint, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found, *(pa.array(np.ascontiguousarray(x)) for x in folded.T)], ["node", "size", "keys", "sketch", "fp", *FOLDS])

    return texts.select("node", "text").mapInArrow(common.tidy(run), "node long, size int, keys binary, sketch binary, fp binary, " + ", ".join(f"{f} long" for f in FOLDS))


def lead(size: np.ndarray, similarity: float) -> np.ndarray:
    """How many of the first shingles of a set meet those of any similar set that is not smaller."""
    return size - np.ceil(2 * similarity / (1 + similarity) * size - SLACK).astype(np.int64) + 1


def _dealt(rows: np.ndarray, ranges: int) -> pa.RecordBatch:
    """``(range, rows)``: rows of numbers as bytes, by the range of the first one."""
    to = (common.mix64(rows[:, 0]) % np.uint64(ranges)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    rows, cut = rows[order], np.searchsorted(to[order], np.arange(ranges + 1))
    found = [r for r in range(ranges) if cut[r] < cut[r + 1]]
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([rows[cut[r] : cut[r + 1]].tobytes() for r in found], pa.binary())], ["range", "rows"])


def ringed(key: np.ndarray, node: np.ndarray, after: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, differ)``: for nodes ``b`` the smallest and the nearest of the smaller nodes ``a`` with a key in common whose next
    four segments (``after``) keep within their chain's budgets; ``differ`` is in how many bits these differ.

    Keys of more than ``hot`` nodes are split by the bits that follow, eight at a time; of those that stay so large each
    node meets the ``hot`` next in order.
    """
    order = np.lexsort((node, after, key))
    key, node, after = key[order], node[order], after[order]
    starts = np.concatenate(([True], key[1:] != key[:-1]))
    for shift in range(56, -8, -8):
        n = np.diff(np.append(np.flatnonzero(starts), len(key)))
        if n.max() <= hot:
            break
        part = after >> np.uint64(shift)
        starts[1:] |= np.repeat(n > hot, n)[1:] & (part[1:] != part[:-1])
    group, n = np.cumsum(starts) - 1, np.diff(np.append(np.flatnonzero(starts), len(key)))
    each, budget = SEGMENT * RADIUS // BITS, 64 // SEGMENT
    found = [np.zeros((0, 3), np.int64)]
    for k in range(1, min(hot, int(n.max()))):
        at = np.flatnonzero(group[k:] == group[:-k])
        differ = after[at] ^ after[at + k]
        for length in range(budget, 0, -1):  # the longest chain leaves fewest
            stay = np.bitwise_count(differ >> np.uint64(64 - SEGMENT * length)) <= each * (length + 1)
            at, differ = at[stay], differ[stay]
        ends = node[at], node[at + k]
        found.append(np.stack([np.minimum(*ends), np.maximum(*ends), np.bitwise_count(differ)], axis=1))
    a, b, differ = np.concatenate(found).T
    kept = []
    for order in (np.lexsort((differ, a, b)), np.lexsort((a, differ, b))):
        order = order[(a != b)[order]]
        kept.append(order[np.concatenate(([True], b[order][1:] != b[order][:-1]))[: len(order)]])
    kept = np.unique(np.concatenate(kept))
    return a[kept], b[kept], differ[kept]


def _met(each: DataFrame, ranges: int, hot: int) -> DataFrame:
    """``(a, b)``: each node of ``each(node, fp)`` with the smallest and the nearest smaller one that it meets by a segment of
    their fingerprints and the chain from it, see :func:`ringed`: at most twice as many pairs as nodes."""
    count = BITS // SEGMENT

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.frombuffer(b"".join(batch.column(1).to_pylist()), f">u{SEGMENT // 8}").reshape(-1, count).astype(np.uint64)
            if not len(parts):
                continue
            after = np.zeros_like(parts)
            for k in range(1, 64 // SEGMENT + 1):
                after = after << np.uint64(SEGMENT) | np.roll(parts, -k, axis=1)
            key = np.arange(count, dtype=np.uint64) << np.uint64(SEGMENT) | parts
            node = np.repeat(batch.column(0).to_numpy().view(np.uint64), count)
            yield _dealt(np.stack([key.ravel(), node, after.ravel()], axis=1), ranges)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.frombuffer(x, np.uint64).reshape(-1, 3) for batch in batches for x in batch.column(1).to_pylist()]
        if not rows:
            return
        rows = np.concatenate(rows)
        pairs = ringed(rows[:, 0], np.ascontiguousarray(rows[:, 1]).view(np.int64), rows[:, 2], hot)
        for at in range(0, len(pairs[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in pairs], ["a", "b", "differ"])

    sent = each.select("node", "fp").mapInArrow(common.tidy(send), "range int, rows binary")
    pairs = sent.repartitionById(ranges, F.col("range")).mapInArrow(common.tidy(meet), "a long, b long, differ long")
    best = pairs.groupBy("b").agg(F.min("a").alias("least"), F.min(F.struct("differ", "a")).alias("near"))
    return best.select(F.explode(F.array_distinct(F.array("least", "near.a"))).alias("a"), "b")


def _shared(each: DataFrame, ranges: int, similarity: float) -> DataFrame:
    """``(key, node, size, at, before, leads)`` for each key that several nodes of ``each(node, size, keys)`` have and one leads with.

    ``at`` is the key's place in the node's set, ``before`` the key ahead of it there.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).to_pylist()
            if not keys:
                continue
            count = np.array([len(k) // 8 for k in keys])
            key = np.frombuffer(b"".join(keys), np.uint64)
            at = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
            node, size = (np.repeat(batch.column(k).to_numpy().astype(np.int64), count) for k in (0, 1))
            yield _dealt(np.stack([key, node.view(np.uint64), (size << 32 | at).view(np.uint64), np.roll(key, 1)], axis=1), ranges)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.frombuffer(x, np.uint64).reshape(-1, 4) for batch in batches for x in batch.column(1).to_pylist()]
        if not rows:
            return
        rows = np.concatenate(rows)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        size, at = (rows[:, 2] >> np.uint64(32)).astype(np.int64), (rows[:, 2] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        leads = at < lead(size, similarity)
        first = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
        n = np.diff(np.append(first, len(rows)))
        met = np.repeat((n > 1) & (np.add.reduceat(leads.astype(np.int64), first) > 0), n)
        key, node, before = (np.ascontiguousarray(rows[met, k]).view(np.int64) for k in (0, 1, 3))
        columns = [key, node, size[met].astype(np.int32), at[met].astype(np.int32), before, leads[met]]
        for a in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in columns], ["key", "node", "size", "at", "before", "leads"])

    return each.select("node", "size", "keys").mapInArrow(common.tidy(send), "range int, rows binary").repartitionById(ranges, F.col("range")).mapInArrow(common.tidy(meet), "key long, node long, size int, at int, before long, leads boolean")


def sketch(own: np.ndarray) -> bytes:
    """The parity of the number of shingles at each place."""
    places = max(PLACES, 1 << (4 * len(own) - 1).bit_length())
    return np.packbits(np.bincount((own % np.uint64(places)).astype(np.int64), minlength=places) & 1).tobytes()


def differing(pairs: list[tuple[bytes, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which of the pairs of fingerprints, and the bits in which they differ by segments of 64; equal lengths at once."""
    lengths = np.array([min(len(x), len(y)) for x, y in pairs])
    for size in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == size)
        folded = [[np.bitwise_xor.reduce(np.frombuffer(pairs[k][side], np.uint64).reshape(-1, size // 8), axis=0) for k in at] for side in (0, 1)]
        yield at, np.bitwise_count(np.stack(folded[0]) ^ np.stack(folded[1])).astype(np.int64)


def _sets(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``(node, grams)`` of some nodes, grams as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(t, words).tobytes() for t in common.binary(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "grams"])

    return texts.join(nodes, "node", "left_semi").select("node", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(common.tidy(run), "node long, grams binary")


def _compared(pairs: DataFrame, texts: DataFrame, each: DataFrame, words: int, mark: str = "sketch") -> DataFrame:
    """``(a, b, hub, j)``, written: ``pairs(a, b, hub, least)`` that may reach the similarity ``least``, j their exact one.

    ``mark``: what is compared before the sets, the ``sketch``, whose bits differ no more than the sets, or the SimHash ``fp``.
    """

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, size = batch.column(3).to_numpy(), batch.column(4).to_numpy() + batch.column(5).to_numpy()
            if not len(least):
                continue
            total = size * (1 - least) / (1 + least) if mark == "sketch" else np.full(len(least), float(RADIUS))
            stay = np.zeros(len(least), bool)
            for at, boxes in differing(list(zip(batch.column(6).to_pylist(), batch.column(7).to_pylist()))):
                may_be = chains(boxes, total[at], CHAIN)
                stay[at[may_be]] = boxes[may_be].sum(axis=1) <= total[at[may_be]] + SLACK
            yield batch.select(["a", "b", "hub", "a_size"]).filter(pa.array(stay))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(3), batch.column(4)):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                found.append(same / (len(both) - same))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.float64())], ["a", "b", "hub", "j"])

    a, b = (each.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col(mark).alias(f"{x}_mark")) for x in "ab")
    both = pairs.distinct().join(a, "a").join(b, "b").select("a", "b", "hub", "least", "a_size", "b_size", "a_mark", "b_mark")
    some = common.materialize(both.mapInArrow(common.tidy(may), "a long, b long, hub boolean, a_size int"))
    nodes = some.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = common.materialize(_sets(texts, nodes, words))
    # Each pair carries the set of one side to the other. So that this never takes much more room than all sets
    # together do, pairs are worked off in as many parts as they carry that much.
    carried, whole = some.agg(F.coalesce(F.sum("a_size"), F.lit(0)) * 8).first()[0], sets.agg(F.coalesce(F.sum(F.length("grams")), F.lit(0))).first()[0]
    parts = max(1, -(-carried // max(whole, 1)))
    found = []
    for k in range(parts):
        mine = lambda name: F.pmod(F.xxhash64(name), F.lit(parts)) == k  # noqa: B023, E731
        a, b = sets.select(F.col("node").alias("a"), F.col("grams").alias("a_grams")), sets.where(mine("node")).select(F.col("node").alias("b"), F.col("grams").alias("b_grams"))
        pairs = some.where(mine("b")).join(a, "a").join(b, "b").select("a", "b", "hub", "a_grams", "b_grams")
        found.append(common.materialize(pairs.mapInArrow(common.tidy(run), "a long, b long, hub boolean, j double")))
    common.drop(some, sets)
    return functools.reduce(DataFrame.unionByName, found)


def _paired(left: DataFrame, right: DataFrame, similarity: float, apart: bool = False, known: bool = False) -> DataFrame:
    """All pairs ``(a, b)`` of ``left`` and ``right(key, node, size, at, before, leads, *FOLDS)`` with a common key, a lead of the
    smaller one, which comes from the left, whose sizes, places of the key and folded fingerprints allow the similarity; tested
    in the join itself, so that the others are never sent on. ``known``: only those that no link joins (``root``); ``apart``: of
    these those that their similarities ``j`` to a third set allow."""
    more = ("root", "j") if apart else ("root",) if known else ()
    a, b = (rows.select("key", "leads", F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("at").alias(f"{x}_at"), F.col("before").alias(f"{x}_before"), *[F.col(f).alias(f"{x}_{f}") for f in (*FOLDS, *more)]) for rows, x in ((left, "a"), (right, "b")))
    both = F.col("a_size") + F.col("b_size")
    ordered = (F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a") < F.col("b")))
    fits = F.col("a_size") >= F.col("b_size") * similarity - SLACK
    # A pair need only meet by the first key that both have: all that they share is this one or comes after it, and the keys
    # ahead of it differ.
    first = (F.col("a_at") == 0) | (F.col("b_at") == 0) | (F.col("a_before") != F.col("b_before"))
    rest = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    enough = rest >= both * (similarity / (1 + similarity)) - SLACK
    differ = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_{f}").bitwiseXOR(F.col(f"b_{f}"))) for f in FOLDS])
    near = differ <= both * ((1 - similarity) / (1 + similarity)) + SLACK
    if apart:
        near = (F.abs(F.col("a_j") - F.col("b_j")) <= 1 - similarity + SLACK) & near
    if more:
        near = (F.col("a_root") != F.col("b_root")) & near
    return a.where("leads").drop("leads").join(b.drop("leads"), "key").where(ordered & fits & first & enough & near).select("a", "b").distinct()


def printed(each: DataFrame, texts: DataFrame, ranges: int, words: int = 5, similarity: float = 0.8, hot: int = 64) -> DataFrame:
    """``(a, b)``, written: links between nodes of ``each(node, size, fp)`` that their fingerprints show and their sets confirm."""
    pairs = _met(each, ranges, hot).select("a", "b", F.lit(False).alias("hub"), F.lit(similarity).alias("least"))
    return _compared(pairs, texts, each, words, "fp").where(F.col("j") >= similarity - SLACK).select("a", "b")


def links(shared: DataFrame, texts: DataFrame, each: DataFrame, found: DataFrame, words: int = 5, similarity: float = 0.8, hot: int = 64, rounds: int = 6) -> DataFrame:
    """``(a, b)``: ``found`` and the links it lacks between nodes of ``shared(key, node, size, at, before, leads, *FOLDS, root)``, so that
    components are exact; ``root`` is the group by ``found``.

    A key whose nodes are all of one group is done. Another is paired off if that makes at most ``hot`` times ``hot`` tests, see ``LATER`` and ``FEW``, or after ``rounds`` rounds.
    """
    near, ringed = F.col("j") >= similarity - SLACK, 2 * similarity - 1
    rings, rest = [], shared
    for k in range(rounds + 1):
        centre = rest.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n"), F.count_if("leads").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"))
        now = common.materialize(rest.join(centre.where("n > 1 and m > 0 and low < high").drop("low", "high"), "key"))
        large = (F.col("m") > FEW) & (F.col("n") * F.col("m") > hot * hot * LATER**k) if k < rounds else F.lit(False)
        many = now.where(large)
        few = now.where(~large)
        pairs = _paired(few, few, similarity, known=True).select("a", "b", F.lit(False).alias("hub"), F.lit(similarity).alias("least"))
        hubs = many.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b"), F.lit(True).alias("hub"), F.lit(ringed).alias("least"))
        done = _compared(pairs.unionByName(hubs), texts, each, words)
        linked = done.where(near)
        found = found.unionByName(linked.select("a", "b"))
        rings.append((many, done.where("hub").select(F.col("a").alias("centre"), F.col("b").alias("node"), "j")))
        close = linked.where("hub").select(F.col("a").alias("centre"), F.col("b").alias("node"))
        if not many.limit(1).count():
            break
        rest = common.materialize(many.where("node != centre").join(close, ["centre", "node"], "left_anti").select("key", "node", "size", "at", "before", "leads", *FOLDS, "root"))
    if len(rings) == 1:
        return found
    # Those near a centre against those farther off that have the same key: only where the metric allows it and no other
    # links join them.
    root, crossing = common.materialize(common.components(found)), None
    for many, hubs in rings:
        ring = many.drop("root").join(hubs.where(F.col("j") >= ringed - SLACK), ["centre", "node"]).join(root, "node", "left")
        ring = common.materialize(ring.select("key", "node", "size", "at", "before", "leads", *FOLDS, "j", F.coalesce("root", "node").alias("root")))
        inner, outer = ring.where(near), ring.where(~near)
        pairs = _paired(inner, outer, similarity, apart=True).unionByName(_paired(outer, inner, similarity, apart=True))
        crossing = pairs if crossing is None else crossing.unionByName(pairs)
    more = crossing.select("a", "b", F.lit(False).alias("hub"), F.lit(similarity).alias("least"))
    return found.unionByName(_compared(more, texts, each, words).where(near).select("a", "b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, hot: int = 64, sample: int = 5000) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, component_id)``.

    component_id is the smallest id among the documents reachable by links of at least ``similarity``. Null and
    wordless texts are alike. Rows that repeat an id each give a row; a null id gets its group's smallest id (null if
    all are). Texts are one node if their MD5 digests are equal. Other columns are not read. An empty table gives an
    empty result.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = common.numbered(kept, "doc_id", "text", nulls_first=False)
    found = _places(rows.select(F.col(PLACE).alias("node"), "text"), words, similarity, hot, sample)
    named = rows.select("doc_id", PLACE).join(found, PLACE).select("doc_id", "root")
    lowest = common.materialize(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return named.join(lowest, "root").select("doc_id", "component_id")


def _places(texts: DataFrame, words: int, similarity: float, hot: int, sample: int) -> DataFrame:
    """``(__place, root)``: for each of ``texts(node, text)``, node unique, the smallest node of its group."""
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    named = common.materialize(texts.select(F.col("node").alias(PLACE), digest.alias("digest")))
    firsts = common.materialize(named.groupBy("digest").agg(F.min(PLACE).alias("node")))
    keyed = common.materialize(_keys(texts, words, similarity, _usual(texts, words, sample)))
    each = common.materialize(keyed.join(firsts.select("node"), "node", "left_semi"))
    common.drop(keyed)
    ranges = common.ranges(texts)
    found = printed(each, texts, ranges, words, similarity, hot)
    grouped = common.materialize(common.components(found))
    shared = common.materialize(_shared(each, ranges, similarity))
    met = each.select("node", "size", "sketch", *FOLDS).join(shared.select("node").distinct(), "node", "left_semi")
    marked = common.materialize(met.join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node")))
    rows = common.materialize(shared.join(marked.select("node", *FOLDS, "root"), "node"))
    common.drop(each, shared)
    root = common.components(links(rows, texts, marked.drop(*FOLDS, "root"), found, words, similarity, hot))
    rooted = common.materialize(firsts.join(root, "node", "left").select("digest", F.coalesce("root", "node").alias("root")))
    return named.join(rooted, "digest").select(PLACE, "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, hot: int = 64, sample: int = 5000) -> DataFrame:
    """``docs`` with one document of each group of near copies, as ``simhash.keep_one`` chooses it."""
    rows = common.numbered(docs, id_col, text_col, nulls_first=False)
    found = _places(rows.select(F.col(PLACE).alias("node"), F.col(text_col).cast("string").alias("text")), words, similarity, hot, sample)
    return keep_first(rows, found.select(F.col(PLACE).alias("doc_id"), F.col("root").alias("component_id")))
