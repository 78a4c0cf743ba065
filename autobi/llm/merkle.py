"""Merkle trees over the rows of a table: one for each source, and one over the sources.

A tree is cut into aligned blocks of ``FAN ** LEVELS`` nodes at their base. The nodes of a block lie in van Emde Boas
order: a subtree is split at half its height, the upper half comes first and then each lower subtree, each in the
same order. The address of a node follows from its level, its index and the number of nodes at the base alone, so
neither building nor looking up siblings stores any pointer. The roots of a source's blocks are the base of the next
blocks, until one is left; the roots of the sources are the base of one more tree.

Rows of a source are numbered over all range partitions, so a source of any size is spread over many tasks and no task
holds more than a block of each tree.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from autobi.llm import common

FAN_BITS = 4
FAN = 1 << FAN_BITS
#: How often the nodes of a full block are combined.
LEVELS = 3
BASE = FAN**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sizes(n: int, levels: int) -> list[int]:
    """Nodes at each level of a tree with ``n`` at its base."""
    return [-(-n >> FAN_BITS * k) if k else n for k in range(levels + 1)]


def address(level: int, index: np.ndarray, size: list[int]) -> np.ndarray:
    """Where the nodes ``index`` of a level lie in van Emde Boas order, in a tree with ``size`` nodes at each level.

    Trees need not be full: nodes that are not there take no room, so those ahead of a node are counted by clipping.
    """
    top, low, at = len(size) - 1, 0, np.zeros(len(index), np.int64)
    while top > low:
        middle = low + (top - low + 1) // 2 - 1  # the highest level of the lower half
        root = index >> FAN_BITS * (top - level)
        if level > middle:
            low = middle + 1
            continue
        own = index >> FAN_BITS * (middle - level)
        for k in range(middle + 1, top + 1):  # the upper half of this subtree
            first = root << FAN_BITS * (top - k)
            at += np.minimum(first + (1 << FAN_BITS * (top - k)), size[k]) - np.minimum(first, size[k])
        for k in range(low, middle + 1):  # the lower subtrees before its own
            shift = FAN_BITS * (middle - k)
            at += np.minimum(own << shift, size[k]) - np.minimum(root << FAN_BITS * (top - middle) + shift, size[k])
        top = middle
    return at


def depth(n: int) -> int:
    """How often ``n`` nodes are combined until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n >> FAN_BITS), levels + 1
    return levels


@functools.lru_cache(maxsize=256)
def layout(n: int, levels: int) -> tuple[np.ndarray, ...]:
    """Addresses of the nodes of each level."""
    size = sizes(n, levels)
    return tuple(address(k, np.arange(size[k]), size) for k in range(levels + 1))


def build(base: np.ndarray, levels: int) -> np.ndarray:
    """The nodes of a block, 32 bytes each, in van Emde Boas order."""
    at = layout(len(base), levels)
    nodes = np.empty((sum(map(len, at)), 32), np.uint8)
    nodes[at[0]] = base
    for k in range(levels):
        text = nodes[at[k]].tobytes().hex().encode()
        above = [hashlib.sha256(text[a : a + 64 * FAN]).digest() for a in range(0, len(text), 64 * FAN)]
        nodes[at[k + 1]] = np.frombuffer(b"".join(above), np.uint8).reshape(-1, 32)
    return nodes


def siblings(nodes: np.ndarray, n: int, levels: int) -> list[list[bytes]]:
    """For each level but the last, the runs of nodes that are combined, as hex text."""
    found = []
    for at in layout(n, levels)[:levels]:
        text = nodes[at].tobytes().hex().encode()
        found.append([text[a : a + 64 * FAN] for a in range(0, len(text), 64 * FAN)])
    return found


def steps(runs: list[list[bytes]], index: int) -> list[tuple[bytes, bytes]]:
    """What stands before and after a node and those above it, level by level."""
    found = []
    for level in runs:
        cut = 64 * (index & FAN - 1)
        text = level[index >> FAN_BITS]
        found.append((text[:cut], text[cut + 64 :]))
        index >>= FAN_BITS
    return found


def pack(path: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join(bytes([len(a) // 64, len(b) // 64]) + bytes.fromhex((a + b).decode()) for a, b in path)


def unpack(data: bytes) -> list[tuple[bytes, bytes]]:
    found, at = [], 0
    while at < len(data):
        a, b = data[at], data[at + 1]
        text = data[at + 2 : at + 2 + 32 * (a + b)].hex().encode()
        found.append((text[: 64 * a], text[64 * a :]))
        at += 2 + 32 * (a + b)
    return found


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node (hex) and its siblings give."""
    for before, after in path:
        node = hashlib.sha256(before + node + after).hexdigest().encode()
    return node


def ranked(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank``, their place from 0 within a key, written.

    Rows are dealt to ranges by key and order and counted there; a range adds what earlier ranges hold of its first
    key. Those numbers, at most one for each range, are broadcast. Rows alike in key and order are spread by a hash.
    """
    names = rows.columns
    spread = F.xxhash64(F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column(batch.schema.get_field_index(key)).to_pylist(), object)
            new = np.flatnonzero(np.concatenate(([keys[0] != last], keys[1:] != keys[:-1])))
            start = np.full(len(keys), -seen)
            start[new] = new
            local = np.arange(len(keys)) - np.maximum.accumulate(start)
            last, seen = keys[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], [*names, "local"])

    count = common.partitions(rows.sparkSession)
    sorted_ = rows.withColumn("spread", spread).repartitionByRange(count, key, *order, "spread").sortWithinPartitions(key, *order, "spread").drop("spread")
    schema = StructType([*rows.schema.fields, StructField("local", LongType())])
    placed = common.materialize(sorted_.mapInArrow(run, schema).withColumn("range", F.spark_partition_id()))
    held = placed.groupBy(key, "range").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(key, "range", F.sum("n").over(ahead).alias("before")).where("before > 0")
    return placed.join(F.broadcast(before), [key, "range"], "left").withColumn("rank", F.col("local") + F.coalesce("before", F.lit(0))).drop("local", "range", "before")


BLOCK = "key string, block long, n int, big boolean, nodes binary, tags array<string>, others array<binary>"


def blocks(rows: DataFrame) -> DataFrame:
    """The blocks of ``rows(key, rank, node, tag, other)``, written; big: whether their key may have more of them."""

    def made(key, number, group: list[tuple]) -> tuple:
        base = np.frombuffer(b"".join(g[0] for g in group), np.uint8).reshape(-1, 32)
        big = number > 0 or len(base) == BASE
        nodes = build(base, LEVELS if big else depth(len(base)))
        return key, number, len(base), big, nodes.tobytes(), [g[1] for g in group], [g[2] for g in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []

        def flush():
            found = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)
            out.clear()
            return found

        names = ["key", "block", "n", "big", "nodes", "tags", "others"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.binary())]
        held = 0
        for batch in batches:
            for key, number, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, number) != now:
                    if group:
                        out.append(made(*now, group))
                        held += len(group)
                    now, group = (key, number), []
                    if held > 4 * BASE:
                        yield flush()
                        held = 0
                group.append(row)
        if group:
            out.append(made(*now, group))
        if out:
            yield flush()

    numbered = rows.select("key", F.shiftright("rank", FAN_BITS * LEVELS).alias("block"), "node", "tag", "other", "rank")
    dealt = numbered.repartition("key", "block").sortWithinPartitions("key", "block", "rank").drop("rank")
    return common.materialize(dealt.mapInArrow(run, BLOCK))


def forest(rows: DataFrame) -> list[DataFrame]:
    """All blocks of the trees over ``rows(key, rank, node, tag, other)``, from the base up."""
    found = [blocks(rows)]
    while True:
        over = found[-1].where("big")
        if not over.limit(1).count():
            return found
        root = F.expr("substring(nodes, 1, 32)")
        found.append(blocks(over.select("key", F.col("block").alias("rank"), root.alias("node"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("binary").alias("other"))))


def roots(trees: list[DataFrame]) -> DataFrame:
    """``(key, root)`` of each tree."""
    each = [b.where("not big").select("key", F.expr("substring(nodes, 1, 32)").alias("root")) for b in trees]
    return functools.reduce(DataFrame.unionByName, each)


def _inside(n: int, big: bool) -> int:
    return LEVELS if big else depth(n)


def paths(trees: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest blocks with ``path`` and ``subroot``: what stands beside them up to the last root.

    ``above(key, path, subroot)`` has those of each tree's root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, n, big, nodes, path, subroot in zip(*(c.to_pylist() for c in batch.columns)):
                levels = _inside(n, big)
                runs = siblings(np.frombuffer(nodes, np.uint8).reshape(-1, 32), n, levels)
                found = [pack(steps(runs, k)) + path for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(found, pa.binary()), pa.array([subroot] * n, pa.binary())], ["key", "k", "path", "subroot"])

    whole = above.select("key", F.lit(0).cast("long").alias("block"), F.lit(False).alias("big"), "path", "subroot")
    up = whole
    for level in reversed(range(len(trees))):
        met = trees[level].join(up, ["key", "block", "big"])
        if level == 0:
            return met
        # the base of an upper block are lower blocks; their number is the block's own base and the place in it
        each = common.materialize(_with_block(met, run))
        up = whole.unionByName(each.select("key", "block", F.lit(True).alias("big"), "path", "subroot"))
    raise ValueError("no trees")


def _with_block(met: DataFrame, run) -> DataFrame:
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                number = one.column(1)[0].as_py()
                for found in run(iter([one.select([0, 2, 3, 4, 5, 6])])):
                    at = np.asarray(found.column(1)) + number * BASE
                    yield pa.RecordBatch.from_arrays([found.column(0), pa.array(at), found.column(2), found.column(3)], ["key", "block", "path", "subroot"])

    return met.select("key", "block", "n", "big", "nodes", "path", "subroot").mapInArrow(numbered, "key string, block long, path binary, subroot binary")


@dataclass(frozen=True)
class Manifest:
    """The written trees of a table: those of the sources, the one over the sources, and its root (None if empty)."""

    sources: list[DataFrame]
    top: list[DataFrame]
    root: bytes | None


def digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of fields, each ``-`` if null, else its length in bytes, a colon and itself."""
    text = {k: c.cast("string") for k, c in fields.items()}
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text.values()]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(key, id, node, other)``: the leaf of each row and, where ``tampered`` holds, that of the row in lower case."""
    own = {f: F.col(f) for f in fields}
    low = own | {text_col: F.translate(F.col(text_col).cast("string"), UPPER, LOWER)}
    other = F.when(tampered, digest(low)) if tampered is not None else F.lit(None).cast("binary")
    key = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), F.col(source_col).cast("string")))
    return docs.select(key.alias("key"), F.col(id_col).cast("long").alias("id"), digest(own).alias("node"), other.alias("other"))


def manifest(rows: DataFrame) -> Manifest:
    """The trees over ``rows(key, id, node, other)``; ids ascend, null first, equal ones by their leaf."""
    placed = ranked(common.materialize(rows), "key", [F.col("id"), F.col("node")])
    sources = forest(placed.select("key", "rank", "node", F.col("id").cast("string").alias("tag"), "other"))
    tops = roots(sources).select(F.lit("").alias("all"), F.col("key").alias("tag"), F.col("root").alias("node"))
    order = ranked(tops, "all", [F.col("tag")])
    top = forest(order.select(F.col("all").alias("key"), "rank", "node", "tag", F.lit(None).cast("binary").alias("other")))
    found = roots(top).first()
    return Manifest(sources, top, bytes(found.root) if found else None)


def proofs(found: Manifest) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of each row of a manifest.

    ``folded_root`` comes from the tampered leaf where there is one, else from the row's own, and the stored siblings.
    """
    root = (found.root or b"").hex().encode()

    def sourced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, big, nodes, tags, path in zip(*(c.to_pylist() for c in batch.columns)):
                raw, levels = np.frombuffer(nodes, np.uint8).reshape(-1, 32), _inside(n, big)
                runs, base = siblings(raw, n, levels), raw[layout(n, levels)[0]]
                yield pa.RecordBatch.from_arrays([pa.array(tags, pa.string()), pa.array([pack(steps(runs, k)) + path for k in range(n)], pa.binary()), pa.array([x.tobytes() for x in base], pa.binary())], ["key", "path", "subroot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for batch in batches:
            for n, big, nodes, tags, others, path, subroot in zip(*(c.to_pylist() for c in batch.columns)):
                raw, levels = np.frombuffer(nodes, np.uint8).reshape(-1, 32), _inside(n, big)
                runs, base = siblings(raw, n, levels), raw[layout(n, levels)[0]]
                above = unpack(path)
                rest = b"".join(a + b for a, b in above)
                leaf = [x.tobytes().hex() for x in base]
                proof, folded = [], []
                for k, (own, other) in enumerate(zip(leaf, others)):
                    inner = steps(runs, k)
                    proof.append(hashlib.sha256(b"".join([a + b for a, b in inner]) + rest).hexdigest())
                    folded.append(fold(fold(other.hex().encode() if other is not None else own.encode(), inner), above))
                ids = pa.array([None if t is None else int(t) for t in tags], pa.int64())
                text = [pa.array(x, pa.string()) for x in (leaf, [subroot.hex()] * n, [root.decode()] * n, proof, [f.decode() for f in folded])]
                yield pa.RecordBatch.from_arrays([ids, *text, pa.array([f == root for f in folded])], names)

    spark = found.sources[0].sparkSession
    start = spark.createDataFrame([("", b"", b"")], "key string, path binary, subroot binary")
    over = paths(found.top, start).select("n", "big", "nodes", "tags", "path").mapInArrow(sourced, "key string, path binary, subroot binary")
    met = paths(found.sources, common.materialize(over)).select("n", "big", "nodes", "tags", "others", "path", "subroot")
    return met.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def merkle(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``, see :func:`proofs`; ``tampered`` says which texts to take in lower case.

    Nulls in any column have a mark of their own in the leaf, a null source a tree of its own that comes first. Null
    ids come first in a source and are never tampered with by ``op13``; rows of one id follow by their leaves, and
    repeated rows are leaves each. Other columns are not read. An empty table gives no rows.
    """
    return proofs(manifest(leaves(docs, tampered)))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return merkle(common.read(spark, sf_dir, "documents"), F.coalesce(number % 5 == 0, F.lit(False)))
