"""Quality classifier: document evidence combined with what is known of its site, by hierarchical empirical Bayes.

A logistic model on hashed words and a few shares of characters gives each document's log odds of being good
(of good quality and not toxic). The mean of these chances over a host, and over a path of it, are beta
posteriors: a path is shrunk toward its host and a host toward all documents, the more so the fewer documents
it has; how strongly is estimated from the spread between hosts. A document's own chance is taken out of its
site before the site's log odds, less those of all documents, are added to its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autobi.llm import common
from autobi.llm.quality_gbt import SAMPLE, labelled_sample, statistics

BUCKETS = 1 << 20
#: Standard errors by which a feature's share of good documents must differ from the whole, documents that must have
#: it, and how many features are used at most (the most telling ones). The same at every size.
CLEAR, LEAST, FEATURES = 5.0, 5, 4096
EDGE, KEPT, LONGEST = b".,;:!?\"'()[]{}", 400_000, 48
PREFIXES = (4, 5, 6)
#: Features beside words: limits of the shares that switch one on.
LIMITS = ((2, 0.02), (2, 0.2), (3, 0.2), (4, 0.3), (4, 0.6), (6, 0.2), (8, 0.5), (8, 1.0), (10, 0.3))
LOW = ((5, 0.4), (5, 0.2))


def buckets(word: bytes) -> list[int]:
    """Hash buckets of a word and of its beginnings (words that share a stem share evidence)."""
    word = word.lower().strip(EDGE)
    parts = [b"=" + word, *(word[:k] for k in PREFIXES if len(word) >= k)]
    return [zlib.crc32(p) % BUCKETS for p in parts]


def switches(text: bytes | None) -> list[int]:
    """Switched-on features of a text's shares, as places after the word buckets."""
    x = statistics(text)[1]
    on = [x[f] > limit for f, limit in LIMITS] + [x[f] < limit for f, limit in LOW]
    return [BUCKETS + k for k, yes in enumerate(on) if yes]


SIZE = BUCKETS + len(LIMITS) + len(LOW)


def features(text: bytes | None) -> np.ndarray:
    """Places of all features of a text: buckets of each distinct word, and switches."""
    text = text or b""
    return np.array([b for word in set(text.split()) for b in buckets(word)] + switches(text), np.int64)


def fit_weights(lists: list[np.ndarray], good: np.ndarray, used: np.ndarray, rounds: int = 150, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic model on the used features, by full-batch steps with a rate for each weight."""
    weights, n = np.zeros(SIZE), len(good)
    place = np.full(SIZE, -1, np.int64)
    place[used] = np.arange(len(used))
    rows, flat = np.repeat(np.arange(n), [len(x) for x in lists]), place[np.concatenate(lists)]
    rows, flat = rows[flat >= 0], flat[flat >= 0]
    w, seen, offset, seen_offset = np.zeros(len(used)), np.full(len(used), 1e-8), 0.0, 1e-8
    for _ in range(rounds):
        margin = np.bincount(rows, w[flat], n) + offset
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - good) / n
        step = np.bincount(flat, error[rows], len(used)) + 1e-7 * w
        seen += step**2
        w -= rate * step / np.sqrt(seen)
        seen_offset += error.sum() ** 2
        offset -= rate * error.sum() / np.sqrt(seen_offset)
    weights[used] = w
    return weights, float(offset)


def train(labelled: DataFrame, clear: float = CLEAR, least: int = LEAST, most: int = FEATURES) -> tuple[np.ndarray, float]:
    """Weights and offset from rows ``(text, good)``. Tasks count and pick the features; to the driver come the places
    of at most ``most`` features, and one bit for each of them from each row, however long its text."""
    n, n_good = (float(v or 0) for v in labelled.agg(F.count("*"), F.sum("good")).first())
    if not 0 < n_good < n:
        return np.zeros(SIZE), float(np.log((n_good + 0.5) / (n - n_good + 0.5)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros((2, SIZE), np.int64), [pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            for text, good in zip(common.binary(batch.column(0)), batch.column(1).to_pylist()):
                own = np.unique(features(text))
                total[0, own] += 1
                total[1, own] += good
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((at, total[0, at], total[1, at]), kind)], ["place", "n", "n_good"])

    counted = labelled.mapInArrow(count, "place int, n long, n_good long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("n_good").alias("n_good"))
    mean = n_good / n
    differ = F.abs(F.col("n_good") - mean * F.col("n")) / F.sqrt(F.col("n") * mean * (1 - mean))
    words = counted.withColumn("differ", differ).where((F.col("differ") >= clear) & (F.col("n") >= least) & (F.col("place") < BUCKETS))
    picked = words.orderBy(F.desc("differ"), "place").limit(most).select("place").toArrow().column("place").to_numpy()
    used = np.concatenate([np.sort(picked), np.arange(BUCKETS, SIZE)]).astype(np.int64)
    sent = labelled.sparkSession.sparkContext.broadcast(used)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(SIZE, -1, np.int64)
        place[sent.value] = np.arange(len(sent.value))
        for batch in batches:
            bits = np.zeros((batch.num_rows, len(sent.value)), bool)
            for row, text in enumerate(common.binary(batch.column(0))):
                own = place[features(text)]
                bits[row, own[own >= 0]] = True
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary()), batch.column(1)], ["bits", "good"])

    found = labelled.mapInArrow(pick, "bits binary, good int").toArrow()
    lists = [used[np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))[: len(used)])] for x in found.column("bits").to_pylist()]
    return fit_weights(lists, found.column("good").to_numpy().astype(np.float64), used)


class Scores(dict):
    """Evidence of each distinct word."""

    def __init__(self, weights: dict[int, float]):
        self.weight = weights.get

    def __missing__(self, word: bytes) -> float:
        found = sum([self.weight(b, 0.0) for b in buckets(word)])
        if len(word) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[word] = found
        return found


def evidence(docs: DataFrame, weights: np.ndarray, offset: float, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    used = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((dict(zip(used.tolist(), weights[used].tolist())), offset))  # at most FEATURES and the switches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, offset = sent.value
        scores, weight = Scores(weights), weights.get
        for batch in batches:
            found = [sum(map(scores.__getitem__, set((t or b"").split()))) + sum([weight(k, 0.0) for k in switches(t)]) + offset for t in common.binary(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.float64())], ["doc_id", "host", "path", "evidence"])

    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((host_col, "host"), (path_col, "path"))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *names, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, evidence double")


def posteriors(scored: DataFrame) -> DataFrame:
    """Adds ``host_posterior``, ``path_posterior`` and ``score`` to rows with host, path and evidence."""
    chance = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("evidence")))))
    scored = scored.withColumn("chance", chance)
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum("chance").alias("s_path"))
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    rate = F.col("s_host") / F.col("n_host")
    total = hosts.agg(F.sum("n_host").alias("n"), F.sum("s_host").alias("s"), F.sum(F.col("n_host") * rate * rate).alias("q"), F.count("*").alias("hosts"), F.sum(F.col("n_host") * F.col("n_host")).alias("nn")).first()
    n, s = float(total.n or 0), float(total.s or 0)
    mean = min(max(s / n if n else 0.5, 1e-4), 1 - 1e-4)
    inner = mean * (1 - mean)
    spread = ((float(total.q or 0) - n * mean * mean) - (total.hosts - 1) * inner) / max(n - float(total.nn or 0) / max(n, 1), 1e-9) if n else 0.0
    weight = float(np.clip(inner / spread - 1, 2.0, 1e4)) if spread > 0 else 1e4
    paths, scored = common.materialize(paths), common.materialize(scored)
    many = hosts.join(paths.groupBy("host").agg(F.count("*").alias("paths")), "host")
    sites = common.join_groups(paths, many, ["host"], "paths", paths.count())
    joined = common.join_groups(scored, sites, ["host", "path"], "n_path", int(n))
    others = lambda kind: (F.col(f"s_{kind}") - F.col("chance"), F.col(f"n_{kind}") - 1)
    (hs, hn), (ps, pn) = others("host"), others("path")
    joined = joined.withColumn("host_posterior", (hs + weight * mean) / (hn + weight))
    joined = joined.withColumn("path_posterior", (ps + weight * F.col("host_posterior")) / (pn + weight))
    bound = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("path_posterior")))
    shift = F.log(bound / (1 - bound)) - float(np.log(mean / (1 - mean)))
    return joined.withColumn("score", F.col("evidence") + shift)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, evidence, host_posterior, path_posterior, score, kept)`` of each document.

    A document is good if its label says quality 1 and toxic 0 (a null counts as 0); of labels that contradict each
    other the bad one holds. The document model is fitted on at most ``sample`` labelled documents, of an id that
    repeats on the smallest of its texts; host and path figures come from all documents. kept: a score of at least 0.
    Null and empty texts have no words, so only the offset speaks; a null host or path is a site of its own. Without
    labels of both kinds evidence is constant. Labels without an id are left out; documents without one are judged like
    others. Repeated rows each give a row and count twice in their site; an empty table gives an empty result; other
    columns are not read.
    """
    flags = labels.withColumn("good", ((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int"))
    chosen = labelled_sample(docs, flags, "good", sample, id_col, text_col).orderBy("doc_id")
    weights, offset = train(common.materialize(chosen.select("text", "good")))
    scored = common.materialize(evidence(docs, weights, offset, id_col, text_col, host_col, path_col))
    found = posteriors(scored)
    return found.select("doc_id", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= 0).alias("kept"))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
