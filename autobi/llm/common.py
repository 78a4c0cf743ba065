"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splits on space and the bytes 9 to 13 only, as ``[^\x20\x09-\x0D]+`` does; ``bytes.lower`` changes A-Z only.
WORD = r"[^\x20\x09-\x0D]+"


#: Where this package lies; Python workers on the same machine look there, on a cluster it is sent with --py-files.
HOME = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started, and keep what they get at once small."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", HOME)
    if spark.conf.get(BATCH) == "67108864b":  # Spark's default; a session that sets another size keeps it
        spark.conf.set(BATCH, "16m")


#: Bytes that a Python worker gets at once. At Spark's 64 MB two workers and their copies outgrow a small executor.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one of the machine's own serves a local master
    only (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Where each frame returned by :func:`materialize` lies.
_TABLES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_WRITTEN: list[str] = []
#: Settings of Spark while a table is written: its shuffle files are deleted when it is done.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def materialize(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    Spark deletes the shuffle files of this write when it is done, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.schema(df.schema).parquet(path)
    _TABLES[found] = path
    _WRITTEN.append(path)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete the files of frames made by :func:`materialize` that nothing will read again."""
    for table in tables:
        path = _TABLES.pop(table)
        _WRITTEN.remove(path)
        _delete(table.sparkSession, path)


def drop_all(spark: SparkSession) -> int:
    """Delete every table that this process has written by :func:`materialize`; results not yet saved are lost.

    For callers that have saved what they want. Gives the number of tables.
    """
    count = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    _TABLES.clear()
    return count


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(rows: DataFrame, text_col: str = "text", each: int = 64 << 20) -> int:
    """How many ranges hashes and ids are dealt to: one for each 64 MB of text, at least as many as Spark's setting."""
    size = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(partitions(rows.sparkSession), -(-size // each))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function for ``mapInArrow``, that gives memory it has freed back to the system when a task ends.

    Workers serve many tasks; what one has freed would else stay with it while the next stage needs memory elsewhere.
    """

    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return inner


def give_back() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim:
        trim(0)


def binary(column) -> list:
    """An Arrow string column as a list of UTF-8 bytes (null: None)."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit of an unsigned 64-bit array over the output."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def numbered(docs: DataFrame, id_col: str, text_col: str, nulls_first: bool = True) -> DataFrame:
    """``docs`` with a unique ``__place`` in id order: the id itself, or where ids repeat or lack, a number by id
    (nulls first or last), a hash of the text, and the text."""
    key = F.col(id_col).cast("long")
    same = docs.groupBy(key.alias("i")).agg(F.count("*").alias("n")).where("n > 1 or i is null")
    if not same.limit(1).count():
        return docs.withColumn("__place", key)
    by_id, text = key.asc_nulls_first() if nulls_first else key.asc_nulls_last(), F.col(text_col).cast("string")
    ranged = docs.repartitionByRange(partitions(docs.sparkSession), by_id, F.xxhash64(text)).sortWithinPartitions(by_id, F.xxhash64(text), text)
    return materialize(ranged.withColumn("__place", F.monotonically_increasing_id()))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` inner-joined with ``groups(*keys, count, ...)``, one row a group, ``count`` of the ``total`` rows in it.

    Groups of more than one in ``share`` of all rows, of which there are fewer than ``share``, are broadcast, so no
    task gets a large group; the others are joined by a shuffle.
    """
    limit = max(1, total // share)
    large = groups.where(F.col(count) > limit)
    here = rows.join(F.broadcast(large), keys)
    rest = rows.join(F.broadcast(large.select(keys)), keys, "left_anti").join(groups.where(F.col(count) <= limit), keys)
    return here.unionByName(rest.select(here.columns))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, root)``, root the smallest node reachable.

    Alternates two star contractions until nothing changes. Every step is a partial ``min`` per node and a
    join that AQE can split, so a node with very many links never sits in one task. Each round is written to
    the shared folder. Empty input gives no rows; self links give a row of their own.
    """
    spark = edges.sparkSession
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(now.where("u = v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u != v")
        now = materialize(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).groupBy("node").agg(F.min("root").alias("root"))
