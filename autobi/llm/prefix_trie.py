"""A prefix trie of conversations from sorted sequences, without building it node by node.

A conversation is the sequence of its turns' digests. Distinct sequences are sorted into ranges; within a range the
longest common prefix (LCP) of each sequence and the one before it is all that is needed: a prefix of d turns is a node,
and its members are the neighbours to the left and right between which no LCP falls below d. Each candidate prefix finds
its two ends by itself, by binary search over a sparse table of range minima. In preorder the nodes of a subtree lie
together, so sums over it are differences of running sums.

A prefix that sequences on both sides of a range's edge share is open: the range gives its part, parts are added up by
the prefix's digest, and the trie of the open prefixes alone (a few for each range) is finished in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autobi.llm import common

#: Bytes of a turn's digest: half a SHA-256.
TURN = 16
#: Bytes of digests in a range, about.
RANGE = 16 << 20
NOBODY = hashlib.sha256(b"").hexdigest()
#: Every conversation starts with this many turns of its base at most.
MOST_SHARED = 5


def turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turns)``, turns an array of structs in order: digest (hex) and code points of the text.

    Null turns come first; turns of one number follow by role and digest. Null roles and texts count as empty. Rows
    without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    each = rows.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.char_length(text).alias("chars")).alias("t"))
    return each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(own: DataFrame, base: Column, shared: Column) -> DataFrame:
    """``(conv_id, turns)``: the first ``shared`` turns of conversation ``base``, then its own after its first ``shared``."""
    named = common.materialize(own.withColumn("base", base).withColumn("shared", shared))
    heads = named.join(named.select(F.col("base").alias("conv_id")).distinct(), "conv_id", "left_semi").select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED).alias("head"))
    met = named.join(heads, "base", "left")
    nothing = F.slice("turns", 1, 0)
    head = F.slice(F.coalesce("head", nothing), F.lit(1), F.col("shared"))
    rest = F.slice("turns", F.col("shared") + 1, F.greatest(F.size("turns") - F.col("shared"), F.lit(0)))
    return met.select("conv_id", F.concat(head, rest).alias("turns"))


def _sequences(convs: DataFrame) -> DataFrame:
    """``(seq, chars, n, first, ends)`` of each distinct sequence: how many conversations, the smallest, digest of all."""
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = common.materialize(convs.select("conv_id", seq.alias("seq"), F.transform("turns", lambda t: t["chars"]).alias("chars")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, least, digest = None, 0, 0, None
        out: list[tuple] = []

        def flush():
            found = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], ["first", "n", "ends"])
            out.clear()
            return found

        for batch in batches:
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    if now is not None:
                        out.append((least, count, digest.hexdigest()))
                    now, count, least, digest = key, 0, name, hashlib.sha256()
                digest.update(b",%d" % name if count else b"%d" % name)
                count += 1
            if len(out) > 10_000:
                yield flush()
        if now is not None:
            out.append((least, count, digest.hexdigest()))
        if out:
            yield flush()

    keyed = rows.select(F.unhex(F.substring(F.sha2("seq", 256), 1, 2 * TURN)).alias("key"), "conv_id")
    groups = keyed.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "first long, n long, ends string")
    return rows.withColumnRenamed("conv_id", "first").join(groups, "first")


def shared_turns(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix in turns."""
    n = min(len(a), len(b))
    if a[:TURN] != b[:TURN] or not n:
        return 0
    if a[:n] == b[:n]:
        return n // TURN
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // TURN


def minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level j holds the least of each ``2 ** j`` values in a row."""
    table = [values]
    while len(table[-1]) > 1 << len(table) - 1:
        half = 1 << len(table) - 1
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


class Trie:
    """Nodes of the trie over sorted distinct sequences in preorder, the root first.

    ``pos`` is the first sequence that starts with a node's prefix, ``last`` the last one, ``depth`` its turns,
    ``parent`` and ``stop`` places in this order; the subtree of node k is ``k`` to ``stop[k]``.
    """

    def __init__(self, size: np.ndarray, lcp: np.ndarray):
        self.size, self.lcp, self.table = size, lcp, minima(lcp)
        new = size - lcp
        self.start = np.concatenate(([1], 1 + np.cumsum(new)))
        at = np.repeat(np.arange(len(size)), new)
        self.pos = np.concatenate(([0], at))
        self.depth = np.concatenate(([0], np.arange(1, len(at) + 1) - self.start[at] + lcp[at] + 1))
        self.last = self.right(self.pos, self.depth)
        self.stop = self.start[self.last + 1]
        self.parent = np.arange(-1, len(at))
        fresh = np.flatnonzero(new > 0)
        self.parent[self.start[fresh]] = self.find(fresh, lcp[fresh])

    def right(self, pos: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last sequence up to which all share ``depth`` turns with the one at ``pos``."""
        found, n = pos.copy(), len(self.size)
        for j in reversed(range(len(self.table))):
            to = found + (1 << j)
            fits = to < n
            fits[fits] = self.table[j][found[fits] + 1] >= depth[fits]
            found[fits] = to[fits]
        return found

    def left(self, pos: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first sequence from which on all share ``depth`` turns with the one at ``pos``."""
        found = pos.copy()
        for j in reversed(range(len(self.table))):
            to = found - (1 << j)
            fits = to >= 0
            fits[fits] = self.table[j][to[fits] + 1] >= depth[fits]
            found[fits] = to[fits]
        return found

    def find(self, pos: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The nodes of the first ``depth`` turns of the sequences at ``pos``."""
        first = self.left(pos, depth)
        return np.where(depth == 0, 0, self.start[first] + depth - self.lcp[first] - 1)

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least of ``values`` (one for each sequence) among each node's members."""
        table = minima(values)
        level = np.floor(np.log2(self.last - self.pos + 1)).astype(np.int64)
        out = np.empty(len(self.pos), values.dtype)
        for j in np.unique(level).tolist():
            at = np.flatnonzero(level == j)
            out[at] = np.minimum(table[j][self.pos[at]], table[j][self.last[at] - (1 << j) + 1])
        return out

    def members(self, counts: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(counts)))
        return sums[self.last + 1] - sums[self.pos]

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[self.stop] - sums[np.arange(len(values))]


def prefixes(seq: bytes, depth: int) -> list[bytes]:
    """Digests of the first 0, 1, ... ``depth`` turns."""
    digest, found = hashlib.sha256(), [b""]
    for k in range(depth):
        digest.update(seq[TURN * k : TURN * (k + 1)])
        found.append(digest.digest()[:TURN])
    return found


def _over(seqs: list[bytes]) -> Trie:
    size = np.array([len(s) // TURN for s in seqs], np.int64)
    return Trie(size, np.array([0, *(shared_turns(a, b) for a, b in zip(seqs, seqs[1:]))], np.int64))


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PART = f"{NODE}, node binary, parent binary, chars long, open boolean"


def _local(seqs: list[bytes], chars: list[list[int]], n: list[int], first: list[int], ends: list[str], left: int, right: int) -> pa.RecordBatch:
    """The nodes of a range; of open ones this range's part, closed children and closed nodes below only."""
    trie, size = _over(seqs), np.array([len(c) for c in chars], np.int64)
    flat = np.concatenate([np.zeros(1, np.int64), *(np.asarray(c, np.int64) for c in chars)])
    last = np.where(trie.depth > 0, flat[np.concatenate(([0], np.cumsum(size)))[trie.pos] + trie.depth], 0)
    convs, least = trie.members(np.array(n, np.int64)), trie.least(np.array(first, np.int64))
    is_open, keys = np.zeros(len(trie.pos), bool), {0: b""}
    edges = ((0, left), (len(seqs) - 1, right))
    for pos, most in edges:
        nodes = trie.find(np.full(most + 1, pos), np.arange(most + 1))
        keys |= zip(nodes.tolist(), prefixes(seqs[pos], most))
        is_open[nodes] = True
    is_open[0] = True
    closed = ~is_open
    leaf = closed & (np.bincount(trie.parent[1:], minlength=len(closed)) == 0)
    kids = np.bincount(trie.parent[1:][closed[1:]], minlength=len(closed))
    leaves, saved = trie.below(leaf.astype(np.int64)), trie.below(np.where(closed, (convs - 1) * last, 0))
    parent = np.where(trie.parent >= 0, least[trie.parent], 0)
    hidden = np.concatenate(([True], is_open[trie.parent[1:]]))
    whole = trie.depth == trie.size[trie.pos]
    told = [ends[p] if w else (None if o else NOBODY) for p, w, o in zip(trie.pos.tolist(), whole.tolist(), is_open.tolist())]
    up = [keys[p] if h and k else None for k, (p, h) in enumerate(zip(trie.parent.tolist(), hidden.tolist()))]
    own = [keys.get(k) if o else None for k, o in enumerate(is_open.tolist())]
    columns = [pa.array(least), pa.array(trie.depth), pa.array(parent, mask=hidden), pa.array(convs), pa.array(kids), pa.array(leaves), pa.array(saved), pa.array(told, pa.string()), pa.array(own, pa.binary()), pa.array(up, pa.binary()), pa.array(last), pa.array(is_open)]
    return pa.RecordBatch.from_arrays(columns, NAMES)


NAMES = [c.split()[0] for c in PART.split(", ")]


def _ranges(sequences: DataFrame) -> DataFrame:
    """``(range, low, high, seqs, chars, n, first, ends)``, written: sorted sequences, a row for each range that has any."""
    kinds = {"seqs": pa.list_(pa.binary()), "chars": pa.list_(pa.list_(pa.int32())), "n": pa.list_(pa.int64()), "first": pa.list_(pa.int64()), "ends": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        for batch in batches:
            for have, column in zip(held, batch.columns):
                have += column.to_pylist()
        if held[0]:
            ends = [pa.array([x], pa.binary()) for x in (held[0][0], held[0][-1])]
            yield pa.RecordBatch.from_arrays([*ends, *(pa.array([x], t) for x, t in zip(held, kinds.values()))], ["low", "high", *kinds])

    rows = common.materialize(sequences.select("seq", "chars", "n", "first", "ends"))
    size = rows.agg(F.sum(F.length("seq"))).first()[0] or 0
    count = max(common.partitions(rows.sparkSession), -(-size // RANGE))
    dealt = rows.repartitionByRange(count, "seq").sortWithinPartitions("seq")
    packed = dealt.mapInArrow(run, "low binary, high binary, seqs array<binary>, chars array<array<int>>, n array<long>, first array<long>, ends array<string>")
    return common.materialize(packed.withColumn("range", F.spark_partition_id()))


def _edges(ranges: DataFrame) -> DataFrame:
    """``(range, left, right)``: the turns that each range's first and last sequence share with its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, left = None, 0
        for batch in batches:
            for number, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                if before is not None:
                    shared = shared_turns(before[1], low)
                    yield pa.RecordBatch.from_pydict({"range": pa.array([before[0]], pa.int32()), "left": pa.array([left], pa.int32()), "right": pa.array([shared], pa.int32())})
                    left = shared
                before = number, high
        if before is not None:
            yield pa.RecordBatch.from_pydict({"range": pa.array([before[0]], pa.int32()), "left": pa.array([left], pa.int32()), "right": pa.array([0], pa.int32())})

    return common.materialize(ranges.select("range", "low", "high").repartition(1).sortWithinPartitions("range").mapInArrow(run, "range int, left int, right int"))


def _finished(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """The open nodes with what lies below them; ``parts`` has one row for each, ``edges(seq)`` the shared prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seqs = {}, {b""}
        for batch in batches:
            for row in batch.to_pylist():
                if row["seq"] is not None:
                    seqs.add(row["seq"])
                else:
                    known[row["node"]] = row
        if not known:
            return
        ordered = sorted(seqs)
        trie, keys = _over(ordered), [b""]
        for k, seq in enumerate(ordered):
            keys += prefixes(seq, len(seq) // TURN)[int(trie.lcp[k]) + 1 :]
        rows = [known[k] for k in keys]
        of = lambda name: np.array([r[name] for r in rows], np.int64)
        convs, least, inner = of("n_convs"), of("conv_id"), np.bincount(trie.parent[1:], minlength=len(rows))
        kids = of("n_children") + inner
        # closed sums of a node hold all of its range parts already; only open nodes are added up here
        leaves = of("n_leaves") + trie.below((kids == 0).astype(np.int64))
        saved = of("saved_tokens") + trie.below((convs - 1) * of("chars"))
        parent = np.where(trie.parent >= 0, least[trie.parent], 0)
        columns = [pa.array(least), pa.array(trie.depth), pa.array(parent, mask=trie.parent < 0), pa.array(convs), pa.array(kids), pa.array(leaves), pa.array(saved), pa.array([r["ends_sha256"] or NOBODY for r in rows]), pa.array(keys, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, NAMES[:9])

    both = parts.unionByName(edges, allowMissingColumns=True)
    return common.materialize(both.repartition(1).mapInArrow(run, f"{NODE}, node binary"))


def trie(convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``convs(conv_id, turns)``, see :func:`prefix_trie`."""
    ranges = _ranges(_sequences(convs))
    edges = _edges(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = _local(*(c[k].as_py() for c in batch.columns))
                for at in range(0, found.num_rows, 1 << 16):
                    yield found.slice(at, 1 << 16)

    met = ranges.join(F.broadcast(edges), "range")  # a row of three numbers for each range
    nodes = common.materialize(met.select("seqs", "chars", "n", "first", "ends", "left", "right").mapInArrow(run, PART))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = nodes.where("open").groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.min("ends_sha256").alias("ends_sha256"), *sums)
    shared = ranges.select("range", "low").join(F.broadcast(edges.where("left > 0")), "range").select(F.expr(f"substring(low, 1, {TURN} * left)").alias("seq"))
    finished = _finished(parts, shared)
    names = [c.split()[0] for c in NODE.split(", ")]
    above = finished.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    closed = nodes.where("not open").join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return closed.select(names).unionByName(finished.select(names))


def prefix_trie(rows: DataFrame, base: Column, shared: Column, **columns) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations of ``rows(conv_id, turn, role, text)``.

    ``base`` and ``shared``, columns of ``conv_id``, say which conversation each one starts with and how many of its turns
    (five at most). A node is a distinct sequence of first turns; the root has none. Columns: ``conv_id`` (smallest
    member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    and ``ends_sha256``, the digest of the members that end there.

    Repeated rows are turns each; see :func:`turns` for nulls and ties. The digests of one conversation, 24 bytes a turn,
    and those of one range are held in one task; texts never are together. Other columns are not read. An empty table has
    no root and gives no rows.
    """
    return trie(rebuilt(turns(rows, **columns), base, shared))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    shared = (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")
    return prefix_trie(common.read(spark, sf_dir, "conversations"), conv - F.pmod(conv, F.lit(100)), shared)
