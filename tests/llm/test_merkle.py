"""Operator 13 against trees built by hand."""

import hashlib
import zlib

import numpy as np
import pytest
from autobi.llm import merkle
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, low=False):
    doc_id, source, lang, n_chars, text = row
    if low and text is not None:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    return H("".join(map(field, (doc_id, source, lang, n_chars, text))))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][a : a + 16])) for a in range(0, len(levels[-1]), 16)])
    return levels


def walk(levels, i):
    path = []
    for level in levels[:-1]:
        a = i // 16 * 16
        path.append(("".join(level[a:i]), "".join(level[i + 1 : a + 16])))
        i //= 16
    return path


def tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in keys:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    top = tree([trees[s][-1][0] for s in keys])
    root, out = top[-1][0], []
    for j, s in enumerate(keys):
        for i, r in enumerate(by[s]):
            path = walk(trees[s], i) + walk(top, j)
            node = leaf(r, tampered(r[0]))
            for a, b in path:
                node = H(a + node + b)
            out.append((r[0], leaf(r), trees[s][-1][0], root, H("".join(a + b for a, b in path)), node, node == root))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))


def got(df):
    is_tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return order(tuple(r) for r in merkle.merkle(df, is_tampered).collect())


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4096])
def test_addresses_fill_the_block_and_keep_halves_together(n):
    at = merkle.layout(n, merkle.LEVELS)
    assert sorted(np.concatenate(at).tolist()) == list(range(sum(map(len, at))))
    assert at[-1][0] == 0  # the root comes first, then the rest of the upper half
    assert at[2].tolist() == list(range(1, 1 + len(at[2])))
    for k, parent in enumerate(at[1]):  # each subtree of the lower half lies in one piece
        assert at[0][16 * k : 16 * k + 16].tolist() == list(range(parent + 1, parent + 1 + len(at[0][16 * k : 16 * k + 16])))


def test_paths_pack_and_fold():
    base = np.frombuffer(b"".join(hashlib.sha256(bytes([k])).digest() for k in range(37)), np.uint8).reshape(-1, 32)
    levels = merkle.depth(37)
    nodes = merkle.build(base, levels)
    runs = merkle.siblings(nodes, 37, levels)
    for k in range(37):
        path = merkle.steps(runs, k)
        assert merkle.unpack(merkle.pack(path)) == path
        assert merkle.fold(base[k].tobytes().hex().encode(), path) == nodes[0].tobytes().hex().encode()


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert got(df) == order(brute(rows))


def test_one_source_of_several_blocks_beside_small_ones(spark):
    rows = [(k, "hot" if k % 10 else f"s{k}", "en", k, f"Text {k}") for k in range(9300)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == order(brute(rows))


def test_ranks_go_on_over_batches_and_ranges(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(500).select(F.when(F.col("id") < 400, "a").otherwise(F.concat(F.lit("b"), F.col("id") % 9)).alias("key"), F.col("id").alias("x"))
        got = merkle.ranked(df.repartition(3), "key", [F.col("x")]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for r in sorted(got, key=lambda r: r.x):
        by.setdefault(r.key, []).append(r["rank"])
    assert len(got) == 500 and all(v == list(range(len(v))) for v in by.values())


def test_more_sources_than_a_block_holds(spark):
    rows = [(k, f"é{k}", None, None, "A") for k in range(4200)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == order(brute(rows))


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, None, None, None), (1, "", "en", 3, "ABC"), (1, "", "en", 3, "ABC"), (None, "b", "en", 0, ""), (None, "b", "de", 0, "X" * 1_000_000), (2, "b", "en", 1, "é1:A"), (5, None, "fr", 7, "t")]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.withColumns({c: F.lit(c) for c in ("rank", "key", "block", "node", "spread", "root", "path")})
    assert got(extra) == order(brute(rows))
    assert merkle.merkle(df.limit(0)).count() == 0
    assert merkle.merkle(df).where("verified").count() == len(rows)  # nothing tampered with
