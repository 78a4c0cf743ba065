"""Null ids, repeated rows, a text of over a megabyte, clashing columns and empty tables, in every operator."""

import random

import pytest
from pyspark.sql import functions as F

from autobi.llm import decontaminate, near_copies, quality_bayes, quality_gbt, sentencepiece_codec, simhash, site_tree, suffix_dedup, token_counts, token_files, url_filter

tokenizers = pytest.importorskip("public_tokenizers")
rng = random.Random(12)
LONG = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(200_000))
ROWS = [(1, LONG), (1, LONG), (2, None), (2, ""), (None, "some words stand here"), (None, None), (3, "some words stand here")]
CLASH = ("key", "spans", "fp", "n", "component_id", "path", "host", "low", "low_id", "trigger", "ids", "score", "kept", "good", "quality_", "__labelled", "evidence", "rows", "range", "place", "low_place", "url")
LABELS = "doc_id long, quality int, toxic int"


def operators(spark):
    piece, word = tokenizers.path("piece_bpe_32k.model"), tokenizers.path("word_bpe_49k.json")
    bench = spark.createDataFrame([(1, LONG[5000:5300]), (None, "x y z"), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1), (3, 1, None)], LABELS)
    return {
        "simhash": (simhash.near_duplicates, 7), "keep_one": (simhash.keep_one, 3), "near_copies": (near_copies.near_copies, 7),
        "token_counts": (lambda d: token_counts.token_counts(d, piece), 7), "codec": (lambda d: sentencepiece_codec.encode(d, piece, decode=True, digest=True), 7),
        "classifier": (lambda d: quality_bayes.classify(d.withColumns({"source": F.lit(None).cast("string"), "lang": F.lit("x")}), labels), 7),
        "token_files": (lambda d: token_files.summaries(token_files.write(d, word, 2)), 7), "quality_rules": (lambda d: quality_gbt.quality_rules(d, labels), 7),
        "keep_good": (lambda d: quality_gbt.keep_good(d, labels), 2), "suffix_dedup": (suffix_dedup.remove_repeats, 7), "cut_repeats": (suffix_dedup.cut_repeats, 7),
        "leaks": (lambda d: decontaminate.leaks(d, bench), 2), "without_leaks": (lambda d: decontaminate.without_leaks(d, bench), 5),
        "pages": (lambda d: site_tree.extract(d.withColumn("url", F.lit("http://h.com/")), id_col="doc_id", html_col="text"), 7), "urls": (lambda d: url_filter.url_filter(d, id_col="doc_id", url_col="text"), 7),
    }


def test_edges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({c: F.lit("x") for c in CLASH})
    for name, (run, count) in operators(spark).items():
        found = run(docs)
        assert found.count() == count, name
        assert run(docs.limit(0)).count() == 0, name
        if name.startswith(("keep", "cut", "without")):
            assert found.columns == docs.columns, name


def test_edge_values(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in CLASH})
    run = operators(spark)
    values = lambda name, *cols: sorted((tuple(r) for r in run[name][0](docs).select(*cols).collect()), key=str)
    by_id = lambda long, empty, words: sorted([(1, long), (1, long), (2, empty), (2, empty), (None, empty), (None, words), (3, words)], key=str)
    assert values("pages", "page_id", "text") == by_id(LONG, "", "some words stand here")
    found = values("simhash", "doc_id", "fp")
    one, words = (next(p for d, p in found if d == k) for k in (1, 3))
    assert found == by_id(one, 0, words) and len({one, words, 0}) == 3
    counted = values("token_counts", "doc_id", "n_tokens")
    one, words = (next(n for d, n in counted if d == k) for k in (1, 3))
    assert counted == by_id(one, 0, words) and one > 200_000 > words > 3
