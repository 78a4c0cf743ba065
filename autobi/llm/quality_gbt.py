"""Quality rules: gradient-boosted trees over document statistics.

Statistics are counted from the whole text. The trees are grown here from a bounded sample of labelled
documents, on quantile bins with logistic loss; chosen statistics may only push the score one way. The model is
flattened into arrays of nodes, so a batch of documents walks all trees by array indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autobi.llm import common

#: Labelled documents that the trees are grown from at most.
SAMPLE = 20_000
WHITE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
_kind = np.arange(256, dtype=np.uint8)
STARTS = (_kind & 0xC0) != 0x80  # bytes that begin a code point
UPPER, DIGITS = (_kind >= 65) & (_kind <= 90), (_kind >= 48) & (_kind <= 57)
PUNCTUATION = np.isin(_kind, np.frombuffer(b"!?.,;:", np.uint8))

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and the way each may push the score that a document is good: 1 up, -1 down, 0 either.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1,
    "distinct_word_share": 1, "upper_share": 0, "digit_share": 0, "punctuation_per_word": 0, "words_per_line": 0,
    "commonest_word_share": -1,
}


def statistics(text: bytes | None) -> tuple[tuple[int, ...], list[float]]:
    """The base counts and the features of one text."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
        return (0, 0, symbols, 0, 0), [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(counts[STARTS].sum()) - sum(int(counts[c]) for c in WHITE)
    symbols = sum(int(counts[c]) for c in SYMBOLS)
    lines = text.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        full = [x for x in lines if x.strip(WHITE)]
        dup = len(full) - len(set(full))
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    repeat = repeated(ids, len(names))
    common_share = int(np.bincount(ids).max()) / n
    features = [np.log1p(n), chars / n, symbols / n, dup / len(lines), repeat / n, len(names) / n, counts[UPPER].sum() / chars, counts[DIGITS].sum() / chars, counts[PUNCTUATION].sum() / n, n / len(lines), common_share]
    return (n, chars, symbols, dup, repeat), [float(x) for x in features]


def repeated(ids: np.ndarray, names: int, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which is found twice or more."""
    if len(ids) < width + 1:
        return 0
    code = ids[: len(ids) - width + 1].copy()
    for k in range(1, width):
        code = code * names + ids[k : len(ids) - width + 1 + k]
        if names > 1 << 20:  # keeps the products within 64 bits
            code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    many = np.zeros(len(code), bool)
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    change = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(many)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    return int((np.cumsum(change) > 0).sum())


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])


@dataclass
class Trees:
    """Nodes of all trees: inner nodes compare a feature with a limit, leaves (feature -1) hold a value."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                low = x[rows, np.maximum(self.feature[at], 0)] <= self.limit[at]
                at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
            total += self.value[at]
        return total


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 5, shrink: float = 1.0) -> Trees:
    """Boosted trees for labels 0 and 1. A feature of sign 1 (-1) can only raise (lower) the score: splits keep
    the two sides' values in order, and their middle bounds what lies below. Without both labels: a constant."""
    nodes: list[list[float]] = []
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), start)

        def value(g: float, h: float, low: float, high: float) -> float:
            return float(np.clip(-g / (h + shrink), low, high))

        def split(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = grad[rows], hess[rows]
            own, at = value(g.sum(), h.sum(), low, high), len(nodes)
            nodes.append([-1, 0.0, -1, -1, rate * own])
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                for f, c in enumerate(cuts):
                    b = binned[rows, f]
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g, h, None))
                    gl, hl, gr, hr = gs, hs, g.sum() - gs, h.sum() - hs
                    vl, vr = np.clip(-gl / (hl + shrink), low, high), np.clip(-gr / (hr + shrink), low, high)
                    gain = -(gl * vl + (hl + shrink) * vl**2 / 2) - (gr * vr + (hr + shrink) * vr**2 / 2) + (g.sum() * own + (h.sum() + shrink) * own**2 / 2)
                    gain[(ns < least) | (len(rows) - ns < least) | (signs[f] * (vr - vl) < 0)] = -1
                    if len(gain) and gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = float(gain[k]), (f, k, float(vl[k]), float(vr[k]))
            if best[1]:
                f, k, vl, vr = best[1]
                middle, left = (vl + vr) / 2, binned[rows, f] <= k
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[f]]
                a = split(rows[left], level + 1, *bounds[0])
                b = split(rows[~left], level + 1, *bounds[1])
                nodes[at] = [f, float(cuts[f][k]), a, b, 0.0]
            return at

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            first = len(nodes)
            roots.append(split(np.arange(len(y)), 0, -8.0, 8.0))
            tree = Trees(*_columns(nodes), np.array([first]), 0.0)
            margin += tree.score(x)
    return Trees(*_columns(nodes), np.array(roots, np.int64), start)


def _columns(nodes: list[list[float]]) -> tuple[np.ndarray, ...]:
    table = np.array(nodes, np.float64).reshape(-1, 5)
    return table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4]


SCHEMA = ", ".join([f"{c} long" for c in ("doc_id", *BASE)])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: Trees | None = None) -> DataFrame:
    """``(doc_id, base counts, features)``; with trees also ``score`` (log odds) and ``base_failed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in common.binary(batch.column(1))]
            base = np.array([r[0] for r in rows], np.int64).reshape(-1, len(BASE))
            x = np.array([r[1] for r in rows], np.float64).reshape(-1, len(FEATURES))
            arrays = [batch.column(0), *(pa.array(base[:, k]) for k in range(len(BASE)))]
            names = ["doc_id", *BASE]
            if trees is None:
                arrays.append(pa.array(x.tolist(), pa.list_(pa.float64())))
                names.append("features")
            else:
                arrays += [pa.array(trees.score(x)), pa.array(base_failed(base))]
                names += ["score", "base_failed"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", features array<double>" if trees is None else ", score double, base_failed boolean"))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``sample`` labelled documents, chosen by a hash of the id: ``(doc_id, text, column)``.

    Labels without an id or a value are left out before the choice. Of labels of one id that contradict each other
    the lowest holds, of its texts the smallest.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__labelled")).agg(F.min(column).alias(column))
    order, count = F.xxhash64("__labelled"), known.count()
    if count > 2 * sample:  # what is far beyond the limit need not come together to be sorted
        known = known.where(order < int(-(2**63) + 2**64 * 1.5 * sample / count))
    chosen = known.orderBy(order, "__labelled").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("__labelled"))  # ``sample`` pairs of numbers
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first(column).alias(column))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees from the labelled documents; at most ``sample`` rows of figures come to the driver."""
    chosen = common.materialize(labelled_sample(docs, labels, "quality", sample, id_col, text_col))
    rows = measured(chosen).join(chosen.select("doc_id", "quality"), "doc_id").orderBy("doc_id").select("features", "quality").collect()
    x = np.array([r.features for r in rows], np.float64).reshape(-1, len(FEATURES))
    return grow(x, np.array([r.quality for r in rows], np.float64), list(FEATURES.values()))


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base counts, score, base_failed, kept)`` of each document.

    base_failed: fewer than 50 words, or over half of them in repeated three-word windows. kept: not base_failed
    and a score (log odds that the document is good) of at least 0. Null and empty texts have no words and fail.
    Without labels of both kinds the score is one constant, at least 0 unless all labels are bad. Of labels that
    contradict each other the lowest holds. A null id is kept. Repeated rows each give a row; an empty table gives an empty result; other columns are not read.
    """
    found = measured(docs, id_col, text_col, fit(docs, labels, sample, id_col, text_col))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= 0))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`quality_rules` keeps; nothing is shuffled for it.

    Each row is judged by its text, whatever its id; null and empty texts go; empty tables are allowed.
    """
    trees, at = fit(docs, labels, sample, id_col, text_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in common.binary(batch.column(at))]
            base = np.array([r[0] for r in rows], np.int64).reshape(-1, len(BASE))
            x = np.array([r[1] for r in rows], np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(~base_failed(base) & (trees.score(x) >= 0)))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
