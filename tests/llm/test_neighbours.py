"""Operator 12 against all inner products."""

import numpy as np
import pytest
from autobi.llm import neighbours
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, items):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in items], SCHEMA)


def brute(items, keep, every):
    """Each query's nearest, ties to the smaller id; of items that repeat an id the smallest vector counts."""
    one = {}
    for i, v in items:
        v = np.asarray(v, np.float32).astype(float).tolist()
        one[i] = min(one.get(i, v), v)
    score = lambda i, j: float(np.dot(one[i], one[j]))
    return {i: sorted(((j, score(i, j)) for j in one if j != i), key=lambda x: (-round(x[1], 9), x[0]))[:keep] for i in one if i % every == 0}


def table(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def same(got, want):
    assert got.keys() == want.keys()
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]], i
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], rtol=1e-12, atol=1e-12)


def recall(got, want):
    return sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_recall_on_the_given_vectors(spark, size):
    path = f"/root/testdata/{size}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    q = np.flatnonzero(ids % 20 == 0)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    want = {int(ids[i]): [(int(ids[j]), s[a, j]) for j in np.argsort(-s[a], kind="stable")[:20]] for a, i in enumerate(q)}
    got = table(neighbours.op12_neighbours(spark, path))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.95


def test_recall_over_several_blocks_with_unequal_norms(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24)) * rng.choice([0.5, 1, 3], 3000)[:, None]
    items = list(enumerate(x))
    df, asked = frame(spark, items), F.col("vec_id") % 50 == 0
    some = neighbours.vectors(df)
    index = neighbours.index(some, 10, pivots=64, block=700)
    assert index.blocks.count() == 5
    x = x.astype(np.float32).astype(float)
    s = x[::50] @ x.T
    s[np.arange(60), np.arange(0, 3000, 50)] = -np.inf
    want = {50 * a: [(int(j), s[a, j]) for j in np.argsort(-s[a], kind="stable")[:10]] for a in range(60)}
    got = table(neighbours.search(index, some.where(asked), rerank=200))
    assert recall(got, want) >= 0.9
    same(table(neighbours.search(index, some.where(asked), rerank=700)), want)


def test_gains_are_footrule_distances():
    rng = np.random.default_rng(2)
    orders = np.array([rng.permutation(12)[:5] for _ in range(80)])
    files = neighbours.inverted(orders, 12)
    for own in orders[:10]:
        got = neighbours.gains(own, *files, 80)
        for other, gain in zip(orders, got):
            place = lambda o, p: list(o).index(p) if p in o else 5
            assert sum(abs(place(own, p) - place(other, p)) for p in range(12)) == 5 * 6 - 2 * gain


def test_copies_ties_and_few_vectors(spark):
    rng = np.random.default_rng(4)
    items = [(k, [1.0, 2.0, -0.5]) for k in range(60)] + [(k, rng.normal(size=3)) for k in range(60, 90)] + [(61, [1.0, 2.0, -0.5]), (60, [0.0, -0.0, 4.0]), (5, [1.0, 2.0, -0.5])]
    df = frame(spark, items)
    same(table(neighbours.nearest(df, F.col("vec_id") % 20 == 0)), brute(items, 20, 20))
    few = items[58:64]
    same(table(neighbours.nearest(frame(spark, few), F.col("vec_id") % 2 == 0)), brute(few, 20, 2))


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0]), (-20, [3.0, 1.0])]
    bad = [(40, None), (60, [0.0, 0.0]), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = frame(spark, good + bad).withColumns({c: F.lit(c) for c in ("vector", "entry", "block", "ids", "rank", "found")})
    asked = F.col("vec_id") % 20 == 0
    same(table(neighbours.nearest(df, asked)), brute(good, 20, 20))
    assert neighbours.nearest(df.limit(0), asked).count() == 0
    assert neighbours.nearest(frame(spark, good[:1]), asked).count() == 0
