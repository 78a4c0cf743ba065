"""SimHash groups, repeated passages and benchmark leaks against brute force."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from autobi.llm import common, decontaminate, near_copies, simhash, suffix_dedup


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:  # columns whose names the operators use themselves
        df = df.withColumns({c: F.lit("x") for c in ("key", "spans", "fp", "n", "component_id", "begin", "path")})
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---- SimHash


def brute_print(text):
    w = words(text)
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, distance=2):
    names = sorted(prints)
    root = {i: i for i in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in names:
        for j in names:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in names}


TEXTS = ["", None, " \t\n", "one", "One", "one two", "a b c", "A b\x0bc", "a b c d e f g", "a b c d e f h", "É é ß 中文 words", "x " * 4000, "a b c"]


def test_fingerprints_and_groups(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)) for _ in range(6)]
    more = []
    for t in base:
        for _ in range(8):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            more.append(" ".join(w))
    rows = list(enumerate(TEXTS + base + more))
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, rows, extra=True)).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == brute_groups(prints)


def test_common_keys_keep_every_link(spark):
    rng = random.Random(2)
    base, found = rng.getrandbits(64), {0, 2**64 - 1}
    for _ in range(600):
        x = base
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        found.add(x)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in found}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    for hot, distance in ((4, 2), (10_000, 2), (1, 1), (4, 3), (4, 5)):
        got = {r.node: r.root for r in common.components(simhash.links(df, distance, hot=hot)).collect()}
        groups = brute_groups(found and {x: x for x in found}, distance)
        ours = {x: got.get(signed[x], signed[x]) for x in found}
        assert len(set(ours.values())) == len(set(groups.values()))
        assert len({(ours[x], groups[x]) for x in found}) == len(set(groups.values()))


def test_keep_one_with_repeats_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "other text here now"), (None, "a b c d"), (None, "nobody else has this text")]
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in simhash.keep_one(frame(spark, rows)).collect())
    assert kept == [(False, 1, "a b c d"), (False, 3, "other text here now"), (True, 0, "nobody else has this text")]
    empty = simhash.near_duplicates(frame(spark, [(1, "x")]).limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fp", "component_id"]


def test_keep_one_tells_rows_of_one_id_apart(spark):
    """Ids that repeat over different texts: no unique text goes, no copy stays."""
    for module in (simhash, near_copies):
        for seed in range(3):
            rng = random.Random(seed)
            texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvw") * rng.randint(1, 4) for _ in range(80)) for _ in range(14)]
            rows = [(rng.choice([1, 2, 3, 3, 5, None, None]), rng.choice(texts)) for _ in range(40)] + [(9, None), (9, ""), (None, None)]
            rng.shuffle(rows)
            kept = module.keep_one(frame(spark, rows, extra=True)).collect()
            assert sorted(r.text or "" for r in kept) == sorted({t or "" for _, t in rows})
            first = {}
            for name, text in rows:
                first.setdefault(text or "", []).append(float("inf") if name is None else name)
            assert {r.text or "": float("inf") if r.doc_id is None else r.doc_id for r in kept} == {t: min(v) for t, v in first.items()}


def test_scratch_tables_can_be_dropped(spark):
    table = common.materialize(spark.range(5))
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    common.drop(table)
    assert not os.path.exists(path)
    common.materialize(spark.range(5))
    assert common.drop_all(spark) >= 1 and common.drop_all(spark) == 0


def test_a_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (7, 200)], "a long, b long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 0, 100: 100}


# ---- repeated passages


def brute_removed(rows, length=100):
    seen, out = set(), {}
    for name, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[name] = (len(raw), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def repeated_rows():
    rng = random.Random(4)
    pool = ["alpha", "beta", "gamma", "é", "ü中", "\n", "x" * 30]
    base = [" ".join(rng.choice(pool) for _ in range(60)) for _ in range(4)]
    line = "this one very common line is found again and again in document after document, with more than a hundred bytes"
    rows = [(0, None), (1, ""), (2, "a" * 99), (3, "a" * 100), (4, "a" * 101), (5, "a" * 350), (6, "ab" * 200), (7, "b" * 100 + "a" * 120)]
    for i in range(8, 150):
        x = rng.choice(base)
        a = rng.randrange(len(x))
        noise = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 150)))
        rows.append((i * 3 - 640, x[a : rng.randrange(a, len(x))] + noise + rng.choice(["", line]) + str(i) + rng.choice(base)[: rng.randint(0, 250)]))
    return rows


def digest(df):
    found = df.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")), F.size("runs"), F.sha2("kept", 256)).collect()
    return {r[0]: tuple(r)[1:] for r in found}


def test_removed_bytes(spark):
    rows = repeated_rows()
    assert digest(suffix_dedup.remove_repeats(frame(spark, rows, extra=True))) == brute_removed(rows)


def test_removed_bytes_in_small_pieces(spark):
    rows = repeated_rows()
    small = {"chunk": 257, "rows": 300, "hot": 3}
    assert digest(suffix_dedup.remove_repeats(frame(spark, rows), limits=suffix_dedup.Limits(**small))) == brute_removed(rows)


def test_repeated_and_missing_ids_are_documents(spark):
    text = "a passage that is longer than one hundred bytes, so that it is found again wherever it is, be it here or there"
    got = suffix_dedup.remove_repeats(frame(spark, [(5, text), (5, text), (5, "x"), (None, text), (None, None)])).collect()
    assert sorted((r.doc_id is not None, len(r.kept)) for r in got) == [(False, 0), (False, len(text)), (True, 0), (True, 0), (True, 1)]


def test_cut_repeats_keeps_columns(spark):
    rows = [(1, "é" * 80), (2, "x" + "é" * 80 + "end"), (3, None)]
    df = frame(spark, rows).withColumns({"n_chars": F.lit(7), "spans": F.lit("mine")})
    got = {r.doc_id: (r.text, r.n_chars, r.spans) for r in suffix_dedup.cut_repeats(df).collect()}
    assert got[1][0].startswith("é") and got[2] == ("xend", 4, "mine") and got[3] == (None, None, "mine")
    assert suffix_dedup.cut_repeats(df.limit(0)).count() == 0
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_ranks_order_suffixes():
    rng = random.Random(3)
    for length in (1, 5, 8, 9, 16, 33, 100):
        raw = bytes(rng.choice(b"ab") for _ in range(400)) + b"a" * 300
        rank = suffix_dedup.ranks(np.frombuffer(raw, np.uint8), length).tolist()
        keys = [raw[i : i + length] for i in range(len(raw) - length + 1)]
        order = {k: n for n, k in enumerate(sorted(set(keys)))}
        known = sorted({rank[i] for i in range(len(keys))})
        assert [known.index(rank[i]) for i in range(len(keys))] == [order[k] for k in keys]


def test_a_common_line_between_different_neighbours(spark):
    """Hot triggers: the passages at the line's edges differ in each document, those in it are the same."""
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefghijklmnop ") for _ in range(230))
    rows = [(i, "".join(rng.choice("qrstuvwxyz ") for _ in range(120)) + line + "".join(rng.choice("qrstuvwxyz ") for _ in range(120))) for i in range(300)]
    for hot, size in ((3, 400), (64, 1 << 19)):
        got = digest(suffix_dedup.remove_repeats(frame(spark, rows), limits=suffix_dedup.Limits(chunk=5000, rows=size, hot=hot)))
        assert got == brute_removed(rows)


def test_phrases_hold_each_passage_once():
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 100, 5000).astype(np.uint8)
    bounds = np.array([0, 0, 1200, 1250, 5000])
    with np.errstate(over="ignore"):
        start, count, trigger, content = suffix_dedup.phrases(raw, bounds, 100, 32)
    at = np.concatenate([np.arange(s, s + c) for s, c in zip(start, count)])
    assert at.tolist() == [*range(0, 1101), *range(1250, 4901)]
    assert len(trigger) == len(content) == len(start)


# ---- benchmark


def test_leaks_against_every_window(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 40, 41])))) for k in range(25)] + [(90, ""), (91, None), (7, "a second text of item seven with words enough")]
    rows = [(0, None), (1, ""), (2, "short"), (3, " ".join(rng.choice(vocabulary) for _ in range(3000)))]
    for k in range(60):
        w = words(rng.choice(items)[1] or "")
        if rng.random() < 0.5 and w:
            w[rng.randrange(len(w))] = "Changed"
        pad = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        rows.append((10 + k, " ".join(pad + w + pad[:9]).upper()))
    rows.append(rows[-1])

    def grams(w):
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])

    want = {}
    for name, text in rows:
        w = words(text)
        for item, passage in items:
            i = Counter(grams(words(passage)))
            n = len(words(passage))
            best = 0.0
            for p in range(max(1, len(w) - n + 1)) if i else ():
                c = Counter(grams(w[p : p + n]))
                both = (c & i).total()
                best = max(best, both / max(1, c.total() + i.total() - both))
            if best >= 0.8:
                want[name, item] = max(best, want.get((name, item), 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for at_once in (20_000, 10):
        got = {}
        for r in decontaminate.leaks(frame(spark, rows, extra=True), bench, at_once=at_once).collect():
            got[r.doc_id, r.item_id] = max(r.similarity, got.get((r.doc_id, r.item_id), 0))
        assert got == pytest.approx(want)
    kept = {r.doc_id for r in decontaminate.without_leaks(frame(spark, rows), bench, at_once=10).collect()}
    assert kept == {n for n, _ in rows} - {n for n, _ in want}
    assert decontaminate.leaks(frame(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.leaks(frame(spark, rows).limit(0), bench).count() == 0


def test_blocks_find_every_item_within_the_radius_and_prune():
    rng = np.random.default_rng(9)
    cases = [(1, 0, 16), (3, 0, 16), (300, 0, 16), (2000, 0, 16), (1000, 5000, 12), (1500, 20_000, 8), (40, 20_000, 0)]
    for n, of, spread in cases:  # by binary search, by the value, with fewer bits spread, and all of them
        prints = rng.integers(0, 2**63, (n, 4)).astype(np.uint64)
        index = decontaminate.Index(prints, decontaminate.RADIUS, of)
        assert index.spread == spread
        values = []
        for _ in range(60):
            bits = np.unpackbits(prints[rng.integers(n)].copy().view(np.uint8))
            bits[rng.choice(256, rng.integers(0, 64), replace=False)] ^= 1
            values.append(np.packbits(bits).view(np.uint64))
        values = np.array(values)
        near = np.bitwise_count(prints[None] ^ values[:, None]).sum(axis=2) <= decontaminate.RADIUS
        assert near.any(axis=1).all() and sorted(index.within(values)) == list(zip(*(x.tolist() for x in np.nonzero(near))))
        if spread:
            met = [list(zip(p.tolist(), i.tolist())) for p, i in index.candidates(values)]
            assert all(len(m) == len(set(m)) for m in met)  # no pair of blocks twice
            blocks, own = values.view(np.uint16).reshape(60, 1, 16), prints.view(np.uint16).reshape(1, n, 16)
            assert set().union(*met) == set(zip(*(x.tolist() for x in np.nonzero((np.bitwise_count(blocks ^ own) <= 3).any(axis=2)))))
            assert len(set().union(*met)) < 0.2 * 60 * n + 60
    for radius in (0, 15, 40, 200):
        index = decontaminate.Index(prints, radius)
        near = np.bitwise_count(prints[None] ^ values[:, None]).sum(axis=2) <= radius
        assert list(index.within(values)) == list(zip(*(x.tolist() for x in np.nonzero(near))))


def test_leaks_of_many_items_of_one_size(spark):
    """1500 items of 40 words: all begin alike, so that many windows are looked up among all, and families differ at the end only."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(2000)]
    start, families = [f"start{k}" for k in range(20)], [rng.choices(vocabulary, k=17) for _ in range(300)]
    items = [start + families[k % 300] + rng.choices(vocabulary, k=3) for k in range(1500)]
    rows = []
    for k in range(24):
        w = list(rng.choice(items))
        if k % 3:
            w[rng.randrange(40)] = "changed"
        rows.append((k, " ".join(rng.choices(vocabulary, k=30) + (start + families[k] if k % 4 == 0 else []) + w + rng.choices(vocabulary, k=30))))

    def grams(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    holders, want = {}, {}
    for k, item in enumerate(items):
        assert len(grams(item)) == 36  # none repeats within an item, so a count of different ones is the weighted count
        for g in grams(item):
            holders.setdefault(g, []).append(k)
    for name, text in rows:
        w = words(text)
        for p in range(len(w) - 39):
            for k, both in Counter(itertools.chain.from_iterable(holders.get(g, ()) for g in grams(w[p : p + 40]))).items():
                if both >= 0.8 * (72 - both):
                    want[name, k] = max(both / (72 - both), want.get((name, k), 0))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(frame(spark, rows), bench).collect()}
    assert len(want) > 60 and got == pytest.approx(want)


def test_window_fingerprints_by_brute_force():
    rng = np.random.default_rng(10)
    rows = rng.integers(0, 2**63, 500).astype(np.uint64)
    at = np.array([0, 3, 77, 400])
    bits = decontaminate.spread(rows)
    want = [np.packbits(2 * bits[a : a + 30].sum(axis=0, dtype=np.int64) > 30, bitorder="little").view(np.uint64).tolist() for a in at]
    assert decontaminate.simhash(rows, at, 30, most=50).tolist() == want
