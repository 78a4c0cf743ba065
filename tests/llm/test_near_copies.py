"""Near copies in the pipeline's stage against brute force over all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from autobi.llm import near_copies, simhash
from pyspark.sql import functions as F
from tests.llm.test_dedup import TEXTS, frame, words


def shingles(text):
    w = words(text)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def brute(rows, least=0.8):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and similarity(sets[a], sets[b]) >= least:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def text_of(rng, n):
    return [rng.choice("abcdefghijklmnopqrst") + str(rng.randrange(300)) for _ in range(n)]


def changed(rng, text, places):
    out = list(text)
    for k in rng.sample(range(len(out)), places):
        out[k] = f"new{rng.randrange(10**6)}"
    return out


def test_stage_drops_planted_copies(spark):
    rng = random.Random(5)
    rows, planted = [], []
    for k in range(40):
        text = text_of(rng, rng.randint(100, 300))
        copy = changed(rng, text, rng.randint(1, max(1, len(text) // 50)))
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
        if 0.8 <= similarity(*(shingles(t) for _, t in rows[-2:])) <= 0.97:
            planted.append(2 * k + 1)
    assert len(planted) > 20
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()}
    assert not kept & set(planted)
    assert kept == set(brute(rows).values())


@pytest.mark.parametrize("hot", [2, 16, 10_000])
def test_groups_equal_brute_force_with_common_passages_and_chains(spark, hot):
    """Large groups, drifting chains and texts that share half of their words, at every bound for common keys."""
    rng = random.Random(6)
    line, texts = text_of(rng, 40), list(TEXTS)
    for _ in range(3):
        now = text_of(rng, 90)
        for _ in range(25):
            texts.append(" ".join(now))
            if rng.random() < 0.6:
                now = changed(rng, now, rng.randint(1, 3))
    texts += [" ".join(line + text_of(rng, rng.choice([2, 5, 10, 40]))) for _ in range(60)]
    rows = list(enumerate(texts))
    got = near_copies.near_copies(frame(spark, rows, extra=True), hot=hot).collect()
    groups = brute(rows)
    assert len(set(groups.values())) < len(rows) - 60
    assert {r.doc_id: r.component_id for r in got} == groups


def test_fingerprints_of_any_length_bound_the_difference():
    rng = np.random.default_rng(5)
    pairs, differ = [], []
    for size in (3, 200, 500, 2000, 9000):
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        b = np.unique(np.concatenate([a[: size * 4 // 5], rng.integers(0, 2**63, size // 3).astype(np.uint64)]))
        pairs.append((near_copies.sketch(np.unique(a)), near_copies.sketch(b)))
        differ.append(len(np.setxor1d(a, b)))
    found = {int(k): int(boxes.sum()) for at, rows in near_copies.differing(pairs) for k, boxes in zip(at, rows)}
    assert all(0.75 * n <= found[k] <= n for k, n in enumerate(differ))


def test_texts_that_share_a_passage_meet_in_few_pairs(spark):
    """84 common and 20 own words each, similarity 0.67: none is linked, and they are not paired off either."""
    rng = random.Random(11)
    line = text_of(rng, 84)
    rows = [(k, " ".join(line + [f"own{k}x{j}" for j in range(20)])) for k in range(1500)]
    rows += [(5000 + k, " ".join(changed(rng, line + [f"own{k}x{j}" for j in range(20)], 1))) for k in range(40)]
    df = frame(spark, rows).select(F.col("doc_id").alias("node"), "text")
    keyed = near_copies._keys(df, 5, 0.8, near_copies._usual(df, 5, 5000))
    shared = near_copies._shared(keyed, 4, 0.8).join(keyed.select("node", *near_copies.FOLDS), "node")
    assert near_copies._paired(shared, shared, 0.8).count() < 200
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, rows)).collect()}
    assert got == {k: k if k < 5000 else k - 5000 for k, _ in rows}


def test_chains_never_lose_a_pair_within_the_distance():
    rng = np.random.default_rng(3)
    boxes = rng.integers(0, 9, (4000, 16)) * (rng.random((4000, 16)) < 0.5)
    total = rng.integers(0, 60, 4000).astype(float)
    whole = boxes.sum(axis=1) <= total
    stay = [simhash.chains(boxes, total, k) for k in (1, 4, 16)]
    assert all((s | ~whole).all() for s in stay) and (stay[2] == whole).all()
    assert stay[0].sum() > stay[1].sum() > whole.sum() > 500


def test_repeats_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (3, "other text here now"), (None, "a b c d"), (None, "nobody else has this text")]
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in near_copies.keep_one(frame(spark, rows)).collect())
    assert kept == [(False, 1, "a b c d"), (False, 3, "other text here now"), (True, 0, "nobody else has this text")]
    assert near_copies.keep_one(frame(spark, rows).limit(0)).count() == 0


def met(prints, hot=64):
    """Pairs of fingerprints that ``ringed`` gives, by place in the list."""
    parts = np.frombuffer(b"".join(prints), ">u2").reshape(-1, 64).astype(np.uint64)
    after = sum(np.roll(parts, -k, axis=1) << np.uint64(64 - 16 * k) for k in range(1, 5))
    key, node = np.arange(64, dtype=np.uint64) << np.uint64(16) | parts, np.repeat(np.arange(len(prints)), 64)
    return set(zip(*(x.tolist() for x in near_copies.ringed(key.ravel(), node, after.ravel(), hot)[:2])))


def test_pigeonring_keys_meet_by_fingerprints():
    """No pair of fewer differing bits than segments is lost, nearly none of similarity 0.8, and others do not meet."""
    rng = np.random.default_rng(4)
    prints = []
    for k in range(600):
        a = rng.integers(0, 256, 128).astype(np.uint8)
        flip = np.zeros(1024, np.uint8)
        flip[rng.choice(1024, 63, replace=False) if k % 2 else np.arange(63) + rng.integers(0, 900)] = 1
        prints += [a.tobytes(), (a ^ np.packbits(flip)).tobytes()]
    assert {(2 * k, 2 * k + 1) for k in range(600)} <= (got := met(prints)) and len(got) < 650
    sets = []
    for _ in range(400):
        own = rng.integers(0, 2**63, 360).astype(np.uint64)
        sets += [own, np.concatenate([own[40:], rng.integers(0, 2**63, 40).astype(np.uint64)])]
    prints = [near_copies.fingerprint(x) for x in sets]
    bits = np.stack([np.unpackbits(np.frombuffer(x, np.uint8)) for x in prints])
    differ = (bits[::2] != bits[1::2]).sum(axis=1)
    assert 140 < differ.mean() < 170 and differ.max() < near_copies.RADIUS < (bits[:400] != bits[400:]).sum(axis=1).min()
    got = met(prints)
    assert len({(2 * k, 2 * k + 1) for k in range(400)} & got) >= 392 and len(got) < 440
    same = [prints[0]] * 3000 + prints[1:40]  # one key for all: each meets at most two smaller ones, and all stay together
    got = met(same, 16)
    assert len(got) < 2 * len(same) and len({b for _, b in got if b < 3000}) == 2999


def test_copies_are_linked_by_fingerprints_before_shingles(spark):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        text = text_of(rng, rng.randint(100, 300))
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(changed(rng, text, rng.randint(1, 2))))]
    df = frame(spark, rows).select(F.col("doc_id").alias("node"), "text")
    keyed = near_copies._keys(df, 5, 0.8, near_copies._usual(df, 5, 5000))
    links = {(r.a, r.b) for r in near_copies.printed(keyed, df, 4).collect()}
    want = {(a, b) for (a, x), (b, y) in zip(rows[::2], rows[1::2]) if similarity(shingles(x), shingles(y)) >= 0.8}
    assert len(want) > 50 and links == want
    grouped = keyed.join(spark.createDataFrame(sorted((x, min(p)) for p in links for x in p), "node long, root long"), "node")
    shared = near_copies._shared(grouped, 4, 0.8).join(grouped.select("node", *near_copies.FOLDS, "root"), "node")
    assert near_copies._paired(shared, shared, 0.8).count() >= len(want) and near_copies._paired(shared, shared, 0.8, known=True).count() == 0
