"""Operator 11 against a trie of dictionaries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from autobi.llm import prefix_trie
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    nodes = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    kids = {}
    for v in nodes:
        if v:
            kids.setdefault(v[:-1], []).append(v)
    leaves, saved = {}, {}
    for v in sorted(nodes, key=len, reverse=True):
        below = kids.get(v, [])
        leaves[v] = sum(leaves[k] for k in below) or 1
        saved[v] = sum(saved[k] for k in below) + ((len(nodes[v]) - 1) * len(v[-1][1]) if v else 0)
    out = []
    for v, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(full[c]) == len(v)))
        out.append((min(members), len(v), min(nodes[v[:-1]]) if v else None, len(members), len(kids.get(v, [])), leaves[v], saved[v], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def op(df):
    conv = F.col("conv_id")
    shared = (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")
    return prefix_trie.prefix_trie(df, conv - F.pmod(conv, F.lit(100)), shared)


def got(df):
    return sorted((tuple(r) for r in op(df).collect()), key=str)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_given_conversations(spark, size):
    path = f"/root/testdata/{size}"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{path}/conversations.parquet").collect()]
    assert sorted((tuple(r) for r in prefix_trie.op11_prefix_trie(spark, path).collect()), key=str) == brute(rows)


def few_words(rng, convs, most, words):
    return [(c, t, rng.choice(["user", "assistant"]) if words > 3 else "user", rng.choice("abcdefghij"[:words])) for c in range(convs) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_shared_prefixes_over_any_ranges(spark, parts):
    rng = random.Random(parts)
    rows = few_words(rng, 500, 9, 2) + [(1000 + k, t, "user", "a") for k in range(50) for t in range(60 if k % 3 else 57)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert got(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_intervals_equal_direct_search():
    rng = random.Random(9)
    digest = lambda k: hashlib.sha256(bytes([k])).digest()[: prefix_trie.TURN]
    seqs = sorted({b"".join(digest(rng.randrange(3)) for _ in range(rng.randint(0, 6))) for _ in range(200)})
    trie = prefix_trie._over(seqs)
    for pos, depth, last, parent in zip(trie.pos, trie.depth, trie.last, trie.parent):
        own = seqs[pos][: 16 * depth]
        members = [k for k, s in enumerate(seqs) if s[: 16 * depth] == own and len(s) >= 16 * depth]
        assert members == list(range(pos, last + 1))
        if depth:
            assert seqs[trie.pos[parent]][: 16 * (depth - 1)] == own[:-16] and trie.depth[parent] == depth - 1
    values = np.array([rng.randrange(99) for _ in seqs])
    assert trie.least(values).tolist() == [values[a : b + 1].min() for a, b in zip(trie.pos, trie.last)]


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(0, None, "user", "x"), (0, 1, None, "é🙂"), (0, 1, None, "é🙂"), (0, 1, "b", None), (7, 0, "user", "x"), (100, 5, "user", ""), (123, 1, "u", "y" * 1_000_000), (3, None, None, None), (-5, 2, "a", "n"), (None, 1, "a", "lost"), (250, 0, "user", "x"), (250, 0, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.withColumns({c: F.lit(c) for c in ("turns", "base", "shared", "seq", "node", "range", "depth")})
    assert got(extra) == brute(rows)
    assert op(df.limit(0)).count() == 0
    assert op(df.where("conv_id is null")).count() == 0
    turnless = spark.createDataFrame([(c, 0, "u", "t") for c in range(301, 340)], SCHEMA)
    assert got(turnless) == brute([(c, 0, "u", "t") for c in range(301, 340)])
