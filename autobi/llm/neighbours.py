"""Nearest neighbours by inner product with a permutation index.

A vector is represented by the order of its nearest pivots. Blocks of vectors hold an inverted file for each pivot: the
vectors that have it among their nearest, with its place in their order. A query adds up, over the files of its own
nearest pivots, what each posting takes off the footrule distance of the two orders; the vectors of a block nearest by
footrule are then ranked by their exact inner products.

Inner products are made comparable by one more component, as usual: a vector is lengthened to the largest norm, a query
by zero, which changes no product and makes the largest product the smallest distance.

Equal vectors are one entry of the index with their smallest ids, so that many copies cost nothing. Queries are dealt to
every block in packs and meet it by its number; a block is in memory once and the packs pass by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autobi.llm import common

#: Pivots, picked by a hash of the id: the bounded sample that the index is fitted on.
PIVOTS = 128
#: How many of its nearest pivots represent a vector.
NEAR = 32
#: Vectors in a block, about.
BLOCK = 8192
#: How many vectors of each block are ranked by their inner products.
RERANK = 3072
PACK = 512


@dataclass(frozen=True)
class Index:
    """``blocks(block, vectors, ids, counts, starts, items, places)``, written, and what it was fitted on."""

    blocks: DataFrame
    entries: DataFrame
    pivots: np.ndarray
    largest: float
    count: int
    keep: int


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", length: int | None = None) -> DataFrame:
    """``(vec_id, vector)`` of the rows that take part.

    Not part of it: rows without an id, and vectors that are null, empty, zero, hold a null or non-finite component, or
    are not of ``length`` (if not given, the length of the valid vector with the smallest id). Of rows that repeat an id
    only the one with the smallest vector, component by component, takes part.
    """
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    if length is None:
        first = found.select("vec_id", F.size("vector").alias("n")).orderBy("vec_id", "n").first()
        length = first.n if first else 0
    found = found.where(F.size("vector") == length)
    repeated = found.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1")
    return found.groupBy("vec_id").agg(F.min("vector").alias("vector")) if repeated.limit(1).count() else found


def lengthened(x: np.ndarray, largest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(largest**2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def orders(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first, equal ones by number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :near]


def inverted(order: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pivot's file the start, and of all files the vectors and the places."""
    flat = order.ravel()
    by = np.argsort(flat, kind="stable")
    return np.searchsorted(flat[by], np.arange(pivots + 1)).astype(np.int32), (by // order.shape[1]).astype(np.int32), (by % order.shape[1]).astype(np.int16)


def gains(order: np.ndarray, starts: np.ndarray, items: np.ndarray, places: np.ndarray, count: int) -> np.ndarray:
    """What shared pivots take off the footrule distance between a query's order and that of each of ``count`` vectors.

    With missing pivots at place k, the distance is k (k + 1) less twice the sum of ``k - max(places)`` over the shared ones.
    """
    near, found = len(order), np.zeros(count, np.int32)
    for place, pivot in enumerate(order.tolist()):
        a, b = starts[pivot], starts[pivot + 1]
        found[items[a:b]] += near - np.maximum(places[a:b], place)
    return found


def index(rows: DataFrame, keep: int = 20, pivots: int = PIVOTS, near: int = NEAR, block: int = BLOCK) -> Index:
    """The index of ``rows(vec_id, vector)``. Of equal vectors the ``keep`` + 1 smallest ids are held, which is as many
    as any query for ``keep`` neighbours can need."""
    first = Window.partitionBy("vector").orderBy("vec_id")
    some = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep + 1)
    ids = F.sort_array(F.collect_list("vec_id"))
    entries = common.materialize(some.groupBy("vector").agg(ids.alias("ids")).select(F.col("ids")[0].alias("entry"), F.col("vector").cast("array<double>").alias("vector"), "ids"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    total, largest = entries.agg(F.count("*"), F.max(norm)).first()
    sample = entries.orderBy(F.xxhash64("entry"), "entry", "vector").limit(pivots).select("vector").collect()
    points = lengthened(np.array([r.vector for r in sample], np.float64), largest) if sample else np.zeros((0, 1))
    near, count = min(near, len(points)), max(1, -(-total // block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, names = None, [], []
        for batch in batches:
            if batch.num_rows:
                number = batch.column(0)[0].as_py()
                held.append(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1))
                names += batch.column(2).to_pylist()
        if number is None:
            return
        x = np.concatenate(held)
        starts, items, places = inverted(orders(lengthened(x, largest), points, near), len(points))
        counts = np.array([len(n) for n in names], np.int32)
        flat = np.array([i for n in names for i in n], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (x, flat, counts, starts, items, places))], FIELDS)

    dealt = entries.select(F.pmod(F.xxhash64("entry", "vector"), F.lit(count)).cast("int").alias("block"), "vector", "ids").repartitionById(count, F.col("block")).mapInArrow(run, SCHEMA)
    return Index(common.materialize(dealt), entries, points, largest or 0.0, count, keep)


FIELDS = ["block", "vectors", "ids", "counts", "starts", "items", "places"]
SCHEMA = "block int, " + ", ".join(f"{f} binary" for f in FIELDS[1:])


def search(found: Index, queries: DataFrame, near: int = NEAR, rerank: int = RERANK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest ``keep`` of the index to each of ``queries(vec_id, vector)``, the
    query's own id apart. At least ``rerank`` vectors of each block, or all, are ranked by their inner products."""
    keep, points, count = found.keep, found.pivots, found.count
    near = min(near, len(points))
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    each = asked.groupBy("vector").agg(F.min("query_id").alias("entry"))
    named = common.materialize(asked.join(each, "vector"))
    packs = named.where("query_id = entry").select("entry", "vector")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(part.column(0)).tobytes()], pa.binary()), pa.array([np.asarray(part.column(1).flatten()).tobytes()], pa.binary())], ["asked", "points"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["vectors"] is not None:
                    ids, counts, starts, items = (np.frombuffer(row[f], t) for f, t in (("ids", np.int64), ("counts", np.int32), ("starts", np.int32), ("items", np.int32)))
                    held = np.frombuffer(row["vectors"], np.float64).reshape(len(counts), -1), ids, np.concatenate(([0], np.cumsum(counts))), starts, items, np.frombuffer(row["places"], np.int16)
                elif held is not None:
                    names = np.frombuffer(row["asked"], np.int64)
                    x = np.frombuffer(row["points"], np.float64).reshape(len(names), -1)
                    yield from answers(names, x, held)

    def answers(names: np.ndarray, x: np.ndarray, held: tuple) -> Iterator[pa.RecordBatch]:
        vectors, ids, cuts, *files = held
        order = orders(np.concatenate([x, np.zeros((len(x), 1))], axis=1), points, near)
        found = []
        for q, own in zip(x, order):
            gain = gains(own, *files, len(vectors))
            picked = np.argpartition(-gain, rerank)[:rerank] if len(gain) > rerank else np.arange(len(gain))
            product = vectors[picked] @ q
            if len(picked) > keep + 1:
                bound = np.partition(product, -keep - 1)[-keep - 1]
                picked = picked[product >= bound - 1e-9 * max(1.0, abs(bound))]
            score = (vectors[picked] * q).sum(axis=1)
            size = cuts[picked + 1] - cuts[picked]
            score, vec = np.repeat(score, size), np.concatenate([ids[cuts[k] : cuts[k + 1]] for k in picked])
            best = np.lexsort((vec, -score))[: keep + 1]
            found.append([{"less": -float(s), "vec_id": int(v)} for s, v in zip(score[best], vec[best])])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found, pa.list_(pa.struct([("less", pa.float64()), ("vec_id", pa.int64())])))], ["entry", "found"])

    number = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    small = common.materialize(packs.mapInArrow(packed, "asked binary, points binary")).select(number.alias("block"), "asked", "points")
    both = found.blocks.unionByName(small, allowMissingColumns=True)
    met = both.repartitionById(count, F.col("block")).sortWithinPartitions(F.col("vectors").isNull()).select("vectors", "ids", "counts", "starts", "items", "places", "asked", "points")
    near_each = met.mapInArrow(run, "entry long, found array<struct<less double, vec_id long>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, keep + 1)
    merged = common.materialize(near_each.groupBy("entry").agg(best.alias("found")))
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, keep)
    told = named.select("query_id", "entry").join(merged, "entry").select("query_id", F.posexplode(others).alias("rank", "f"))
    return told.select("query_id", (F.col("rank") + 1).alias("rank"), "f.vec_id", (-F.col("f.less")).alias("score"))


def nearest(rows: DataFrame, asked: Column, keep: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """For the rows for which ``asked`` (a condition on ``vec_id``) holds, their ``keep`` nearest among all rows.

    Ties go to the smaller id. See :func:`vectors` for what takes no part; a query that takes no part has no rows,
    and neither has an empty table. Other columns are not read.
    """
    some = vectors(rows, id_col, vector_col)
    return search(index(some, keep, **options), some.where(asked))


def op12_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
