"""Word pieces, SentencePiece codec and token files against the libraries or brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from autobi.llm import sentencepiece_codec, token_counts, token_files

tokenizers = pytest.importorskip("public_tokenizers")
MODEL, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"
TEXTS = [None, "", " ", "  a  b ", "Hello, World.\nNew\tline", "▁ a▁ b", "🙂 naïve café", "x" * 3000, "The cat sat. " * 400, "J̌ İ ß ﬁ", "<s> <|endoftext|> <0x41>", "中文 字", "a" * 70 + " b"]


def frame(spark, texts=TEXTS):
    rows = [(k * 7 % 101, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return rows, df.withColumns({c: F.lit("x") for c in ("ids", "part", "start", "n_tokens")})


def greedy(word, first, rest):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (rest if at else first)), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_counts_of_random_vocabularies():
    rng = random.Random(1)

    def some():
        return {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 4))) for _ in range(4)}

    for _ in range(200):
        first, rest = some(), some()
        machine = token_counts.Automaton(first, rest)
        for _ in range(30):
            word = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9)))
            assert machine.count(word) == greedy(word, first, rest)


def test_token_counts(spark):
    rows, df = frame(spark)
    first, rest = map(set, token_counts.vocabulary(tokenizers.path(MODEL)))
    want = {}
    for name, text in rows:
        counts = [greedy(w, first, rest) for w in (text or "").encode().split()]
        want[name] = (len(counts), sum(c if c >= 0 else 1 for c in counts), counts.count(-1))
    assert {r[0]: tuple(r)[1:] for r in token_counts.token_counts(df, tokenizers.path(MODEL)).collect()} == want
    assert token_counts.token_counts(df.limit(0), tokenizers.path(MODEL)).count() == 0


def test_codec_equals_the_library(spark):
    rows, df = frame(spark)
    library = sentencepiece_codec.codec(tokenizers.path(MODEL)).processor
    encoded = sentencepiece_codec.encode(df, tokenizers.path(MODEL), decode=True)
    texts = dict(rows)
    for r in encoded.collect():
        text = texts[r.doc_id] or ""
        ids = library.encode(text)
        assert r.ids == ids and r.decoded == (library.decode(ids) if ids else "")
        if ids:
            assert r.begins[0] == 0 and r.ends[-1] == len(text.encode()) and r.begins[1:] == r.ends[:-1]
            pieces = b"".join(text.encode()[a:b] for a, b in zip(r.begins, r.ends))
            assert pieces == text.encode()
    again = sentencepiece_codec.decode(encoded.select("doc_id", "ids"), tokenizers.path(MODEL))
    assert {r.doc_id: r.decoded for r in again.collect()} == {r.doc_id: r.decoded for r in encoded.collect()}
    assert sentencepiece_codec.encode(df.limit(0), tokenizers.path(MODEL)).count() == 0


def test_digests(spark):
    library = sentencepiece_codec.codec(tokenizers.path(MODEL)).processor
    encoded = sentencepiece_codec.encode(frame(spark, ["Some text", None])[1], tokenizers.path(MODEL), decode=True)
    found = {r.doc_id: r for r in encoded.select("doc_id", *[c.alias(n) for n, c in sentencepiece_codec.digest_columns().items()]).collect()}
    assert found[0].ids_sha256 == hashlib.sha256(",".join(map(str, library.encode("Some text"))).encode()).hexdigest()
    assert (found[7].n_tokens, found[7].decoded_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_span_digests_against_the_library(spark):
    rows, df = frame(spark)
    library = sentencepiece_codec.codec(tokenizers.path(MODEL)).processor
    want = {}
    for name, text in rows:
        text = text or ""
        spans = [k for p in library.encode(text, return_type="proto").pieces for k in (p.begin, p.end)]
        want[name] = hashlib.sha256(np.array(spans, "<u4").tobytes()).hexdigest()
    got = sentencepiece_codec.encode(df.unionByName(df), tokenizers.path(MODEL), digest=True).select("doc_id", "spans_sha256").collect()
    assert len(got) == 2 * len(rows) and {tuple(r) for r in got} == set(want.items())


def test_files_of_repeated_ids_are_in_the_order_of_texts(spark):
    rows = [(5, "b c"), (5, "a"), (5, None), (5, "é"), (2, "z"), (None, "x"), (None, "w"), (5, "a")]
    names = [(None, "w"), (None, "x"), (2, "z"), (5, ""), (5, "a"), (5, "a"), (5, "b c"), (5, "é")]
    library = token_files.words(tokenizers.path(WORDS))
    want, start = [], 0
    for name, text in names:
        ids = np.frombuffer(library.ids(text.encode()), "<u4").tolist() + [2]
        want.append((name, start, ids))
        start += len(ids)
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        files = token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizers.path(WORDS), 2)
        got = sorted((r.start, r.doc_id, list(r.ids)) for r in token_files.documents(files).collect())
        assert [(d, s, i) for s, d, i in got] == want


def compiled(mapping: dict[bytes, bytes]) -> bytes:
    """A compiled character map: a double-array trie laid out one free block at a time, and its pool."""
    tree, pool = {}, b""
    for key, value in mapping.items():
        node = tree
        for byte in key:
            node = node.setdefault(byte, {})
        node["end"] = len(pool)
        pool += value + b"\0"
    units, used = [0] * 65536, 1

    def place(node, at, label):
        nonlocal used
        base = 256 * used  # children of a node fill a block of their own
        used += 1
        offset = base ^ at
        units[at] = label | (256 if "end" in node else 0) | (offset << 10 if offset < 1 << 21 else 0)
        if "end" in node:
            units[base] = node["end"] | 1 << 31
        for byte, child in node.items():
            if byte != "end":
                place(child, base ^ byte, byte)

    place(tree, 0, 0)
    raw = np.array(units, "<u4").tobytes()
    return len(raw).to_bytes(4, "little") + raw + pool


class Spec:
    def __init__(self, blob=b"", prefix=True, squeeze=False):
        self.precompiled_charsmap, self.add_dummy_prefix, self.remove_extra_whitespaces, self.escape_whitespaces = blob, prefix, squeeze, True


def test_normalisation_takes_the_longest_prefix_and_keeps_offsets():
    mapping = {b"a": b"1", b"ab": b"22", b"abc": b"", "é".encode(): b"e", b"x": "ß".encode()}
    normal = sentencepiece_codec.Normalizer(Spec(compiled(mapping), prefix=False))
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "c", "é", "x", "z", " ", "中"]) for _ in range(rng.randint(0, 9))).encode()
        want, places, at = b"", [], 0
        while at < len(text):
            n = next((n for n in (3, 2, 1) if text[at : at + n] in mapping), 0)
            lead = text[at]
            size = n or (1 if lead < 128 else 2 if lead < 224 else 3)
            part = mapping[text[at : at + n]] if n else text[at : at + size]
            part = part.replace(b" ", "▁".encode())
            want, places, at = want + part, places + [at] * len(part), at + size
        got, align = normal(text)
        assert got == want and align.tolist()[:-1] == places and (not want or align[-1] == len(text))


def test_normalisation_without_a_map():
    plain, general = sentencepiece_codec.Normalizer(Spec()), sentencepiece_codec.Normalizer(Spec())
    for text in ("a b", " é  ", "x", "▁ a"):
        one, two = plain(text.encode()), general._general(text.encode())
        begins = [k for k, b in enumerate(one[0]) if b & 0xC0 != 0x80] + [len(one[0])]  # pieces begin with a character
        assert one[0] == two[0] and one[1][begins].tolist() == two[1][begins].tolist()
    squeezed = sentencepiece_codec.Normalizer(Spec(squeeze=True))
    assert squeezed(b"  a   b ")[0].decode() == "▁a▁b"


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(0, 1500))
        v = rng.integers(0, int(rng.choice([1, 2, 50, 49_000, 2**32 - 1])), n).astype(np.uint32)
        if n and rng.random() < 0.5:
            v[rng.integers(0, n, 5)] = 2**32 - 1
        data = token_files.image([1], [n], v, 0)
        a = int(rng.integers(0, n + 1))
        b = int(rng.integers(a, n + 1))
        assert (token_files.values_of(data) == v).all() and (token_files.values_of(data, a, b) == v[a:b]).all()
        _, _, _, starts, base = token_files.open_image(data)
        for k in range(len(starts) - 1):
            own = v[k * 256 : (k + 1) * 256]
            assert (token_files.unpack_block(data, base + int(starts[k]))[: len(own)] == own).all()


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    own, library = token_files.Words(tokenizers.path(WORDS)), Tokenizer.from_file(tokenizers.path(WORDS))
    plain, as_text = token_files.Words(tokenizers.path(WORDS), plain_specials=True), Tokenizer.from_file(tokenizers.path(WORDS))
    as_text.encode_special_tokens = True
    assert np.frombuffer(own.ids(b"x <|endoftext|> y"), "<u4").tolist() == [343, 49407, 344]
    rng = random.Random(4)
    parts = ["J̌", "À", "a", "B", ".", ",", "\x1c", "\x85", " ", "\n", "é", "'s", "don't", "1", "²", "…", "ΣΑΣ", "İ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "🙂", "　", "ﬁ", "中"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        for ours, theirs in ((own, library), (plain, as_text)):
            assert np.frombuffer(ours.ids(text.encode()), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark):
    from tokenizers import Tokenizer

    rows, df = frame(spark, TEXTS + ["an <|endoftext|> and <|STARTOFTEXT|>.", "again"])
    rows = rows + [rows[-1]]
    df = df.unionByName(df.where(F.col("text") == "again"))
    library = Tokenizer.from_file(tokenizers.path(WORDS))
    files = token_files.write(df, tokenizers.path(WORDS), 2, image_ids=500)
    want, at = [], 0
    for name, text in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((name, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = sorted(tuple(r) for r in token_files.summaries(files).collect())
    assert got == sorted(w[:4] for w in want)
    assert sorted((r.doc_id, r.start, r.ids) for r in token_files.documents(files).collect()) == sorted((w[0], w[1], w[4]) for w in want)
    assert token_files.summaries(token_files.write(df.limit(0), tokenizers.path(WORDS), 2)).count() == 0
    nulls = token_files.write(spark.createDataFrame([(None, "a"), (1, "b")], "doc_id long, text string"), tokenizers.path(WORDS), 2)
    assert [r.doc_id for r in token_files.summaries(nulls).orderBy("start").collect()] == [None, 1]
