"""The pipeline's stages against brute force, each on its own input."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
from autobi.llm import common, quality_gbt, sentencepiece_codec
from tests.llm.test_dedup import brute_removed, words
from tests.llm.test_near_copies import brute
from tests.llm.test_quality import brute_statistics

SMALL = "/root/testdata/sf0.001"


def holds_item(text, items):
    """Whether some window of an item's size has a weighted five-word similarity of 0.8 or more to it."""
    w = words(text)
    for item in items:
        own = words(item)
        mine = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
        places = [i for i in range(len(w) - 4) if tuple(w[i : i + 5]) in mine]
        if len(places) < 0.8 * mine.total():
            continue
        for p in range(max(0, places[0] - len(own)), min(len(w) - len(own), places[-1]) + 1):
            part = Counter(tuple(w[i : i + 5]) for i in range(p, p + len(own) - 4))
            both = (part & mine).total()
            if both >= 0.8 * (part.total() + mine.total() - both):
                return True
    return False


def test_stages(spark):
    """The second stage was once held against groups of two differing bits; what is asked of it are five words and 0.8."""
    docs = common.read(spark, SMALL, "documents")
    labels = common.read(spark, SMALL, "labels")
    columns = docs.columns
    texts, frames = [{r.doc_id: r.text for r in docs.collect()}], []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = common.materialize(stage(spark, docs, SMALL))
        assert docs.columns == columns
        frames.append(docs)
        texts.append({r.doc_id: r.text for r in docs.collect()})
    trees = quality_gbt.fit(common.read(spark, SMALL, "documents"), labels)
    good = set()
    for i, text in texts[0].items():
        n, *_, repeats = brute_statistics(text)
        x = np.array([quality_gbt.statistics((text or "").encode())[1]])
        if n >= 50 and 100 * repeats <= 50 * n and trees.score(x)[0] >= 0:
            good.add(i)
    assert set(texts[1]) == good and 0 < len(good) < len(texts[0])
    assert set(texts[2]) == set(brute(list(texts[1].items())).values())
    sizes = {i: n - gone for i, (n, gone, _, _) in brute_removed(list(texts[2].items())).items()}
    assert set(texts[3]) == set(texts[2])
    assert all(sizes[i] - 6 <= len(t.encode()) <= sizes[i] for i, t in texts[3].items())  # a cut may split a character
    items = [r.text for r in common.read(spark, SMALL, "benchmark").collect()]
    assert set(texts[4]) == {i for i, t in texts[3].items() if not holds_item(t, items)}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "SentencePiece encoding"]
    out = {r.doc_id: r for r in corpus_pipeline.STAGES[4][1](spark, frames[3], SMALL).collect()}
    library = sentencepiece_codec.codec(sentencepiece_codec.default_model()).processor
    assert out.keys() == texts[4].keys()
    for i, text in texts[4].items():
        ids = library.encode(text or "")
        assert list(out[i].ids) == ids and out[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_stages_with_nulls_repeats_and_empty_tables(spark):
    docs = common.read(spark, SMALL, "documents").limit(12)
    odd = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).selectExpr("doc_id", "cast(null as string) as text", "lang", "source", "n_chars")).unionByName(docs.limit(2).selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SMALL).count() <= odd.count()
        assert stage(spark, docs.limit(0), SMALL).count() == 0
