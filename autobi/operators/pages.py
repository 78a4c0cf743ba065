"""Deep pages: rows in order, written in ranges with their running counts, so that a page reads only its range."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from autobi.operators.browse import order_columns
from autobi.sources import tables

RANGE, START, COUNT, FILES = "__range", "__start", "__count", "__files"


@dataclass(frozen=True)
class PageIndex:
    """An ordered table at ``path``: its rows by range, the ranges' counts, and the order."""

    path: str
    rules: tuple[tuple[str, str], ...]
    key: str
    columns: tuple[str, ...]


def build(df: DataFrame, path: str, key: str, rules: Sequence[tuple[str, str]] = (), rows: int = 200_000, mode: str = "errorifexists", file_rows: int = 1_000_000) -> PageIndex:
    """Write ``df`` to ``path`` in ranges of ``rows`` rows by the sort rules and the key, which must be unique.

    The table lies below ``path/rows``, in files of some ``file_rows`` rows (fewer if there are too few for
    ``spark.sql.shuffle.partitions`` files, but whole ranges) that hold their ranges one after the other;
    the limits of files alone come from a sample of the order, so that it grows with the files and not with the ranges.
    ``path/ranges`` holds the file, the first place and the count of each range; a file's last range may be shorter.
    """
    spark, total = df.sparkSession, df.count()
    least = min(-(-total // rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    count = max(1, least, -(-total // max(rows, file_rows)))
    order = order_columns(df, rules, key)
    dealt = df.repartitionByRange(count, *order).sortWithinPartitions(*order)
    # the number of a row is its partition's, from bit 33 on, and its place there; so is that of a range
    place, low = F.monotonically_increasing_id(), F.lit((1 << 33) - 1)
    number = F.shiftleft(F.shiftright(place, 33), 33) + F.floor(place.bitwiseAND(low) / rows)
    numbered = dealt.select("*", number.cast("long").alias(RANGE))
    numbered.write.mode(mode).parquet(f"{path}/rows")
    counts = spark.read.schema(numbered.schema).parquet(f"{path}/rows").groupBy(RANGE).agg(F.count("*").alias(COUNT), F.collect_set(F.col("_metadata.file_name")).alias(FILES))
    ahead = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts.select(RANGE, COUNT, FILES, F.coalesce(F.sum(COUNT).over(ahead), F.lit(0)).alias(START)).write.mode(mode).parquet(f"{path}/ranges")
    return PageIndex(path, tuple(rules), key, tuple(df.columns))


def page(spark: SparkSession, index: PageIndex, number: int = 1, size: int = 50) -> DataFrame:
    """The rows of one page, in order. Only the files of the ranges that hold it are opened, of these only the pages of the ranges are
    read, and no more than one range is skipped over."""
    first = (number - 1) * size
    ranges = spark.read.parquet(f"{index.path}/ranges")
    held = ranges.where((F.col(START) < first + size) & (F.col(START) + F.col(COUNT) > first) & (F.col(COUNT) > 0)).orderBy(START).collect()  # as many ranges as a page touches
    if not held:
        return spark.read.parquet(f"{index.path}/rows").select(*index.columns).limit(0)
    table = tables.read_files(spark, f"{index.path}/rows", sorted({f"{index.path}/rows/{name}" for r in held for name in r[FILES]}))
    rows = table.where(F.col(RANGE).isin([r[RANGE] for r in held])).select(*index.columns)
    return rows.orderBy(*order_columns(rows, index.rules, index.key)).offset(first - held[0][START]).limit(size)


def info(spark: SparkSession, index: PageIndex, size: int = 50) -> DataFrame:
    """One row: ``rows`` and ``pages``, from the counts alone."""
    return spark.read.parquet(f"{index.path}/ranges").agg(F.coalesce(F.sum(COUNT), F.lit(0)).alias("rows")).select("rows", F.ceil(F.col("rows") / size).alias("pages"))
