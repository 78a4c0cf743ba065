"""CSV scans, typed ingest and retention."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autobi.functions import coerce
from autobi.sources.dialect import Dialect, detect

#: Truth words that mean yes.
TRUE_WORDS = ["true", "yes", "1", "t", "y", "sim"]
#: Files whose splits' starts are broadcast; about 200 bytes for each split.
FILES = 20_000


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, tolerant: bool = False, header: bool = True, dialect: Dialect | None = None, broken: str | None = None) -> DataFrame:
    """A CSV file, by default with a header row; rows of the wrong width are skipped, or padded and cut if tolerant.

    Without a schema all columns are text named by the header, to be typed by :func:`typed`. A ``dialect`` (see
    :func:`autobi.sources.dialect.detect`) says how the file is written and what its columns are. ``broken`` names a
    column for the text of rows of the wrong width, null in others (tolerant scans without a schema only).
    """
    options = {"header": header, "mode": "PERMISSIVE" if tolerant else "DROPMALFORMED", "columnPruning": False}
    if dialect:
        options |= {"sep": dialect.delimiter, "quote": dialect.quote, "escape": dialect.quote, "header": dialect.header, "enforceSchema": True}
    if schema is None:
        names = dialect.columns if dialect else spark.read.option("header", True).csv(path).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, *([broken] if broken else [])]])
        options |= {"columnNameOfCorruptRecord": broken} if broken else {}
    return spark.read.options(**options).schema(schema).csv(path)


def typed(df: DataFrame, profile_rows: list) -> DataFrame:
    """Text columns cast to their inferred types (rows of a profile: column, inferred_type)."""
    kinds = {r["column"]: r["inferred_type"] for r in profile_rows}
    cast = {"Number": lambda n: coerce.num(df, n), "Date": lambda n: coerce.ts(df, n), "Boolean": lambda n: F.lower(F.trim(df[n])).isin(TRUE_WORDS)}
    columns = []
    for f in df.schema.fields:
        make = cast.get(kinds.get(f.name, "")) if isinstance(f.dataType, T.StringType) else None
        columns.append((F.when(~coerce.is_blank(df[f.name]), make(f.name)) if make else df[f.name]).alias(f.name))
    return df.select(columns)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A number for each row, rising in scan order, to break ties in later sorts."""
    return df.withColumn(name, F.monotonically_increasing_id())


def with_row_number(scan: DataFrame, name: str = "row_id") -> DataFrame:
    """``scan``, a file source as read, with dense numbers from 1 in the order of files (by path) and of rows in them.

    Rows are counted by split in a first pass; the sums of those counts, one row for each split, are joined to the
    rows by their split. The numbers are the same for any size of splits.
    """
    placed = scan.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")).withColumn("__place", F.monotonically_increasing_id())
    splits = placed.groupBy("__file", "__block").agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
    ahead = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("__file", "__block", "__first", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    out = placed.join(F.broadcast(starts) if len(scan.inputFiles()) <= FILES else starts, ["__file", "__block"])
    number = F.col("__place") - F.col("__first") + F.col("__start") + 1
    return out.select(number.alias(name), *scan.columns)


def ingest_csv(spark: SparkSession, path: str, out: str, mode: str = "errorifexists") -> DataFrame:
    """Write a CSV file as a typed Parquet table and return ``(path, rows)``; values that do not fit become null.

    :func:`autobi.sources.ledger.ingest` keeps account of them instead.
    """
    from autobi.operators.profile import profile

    raw = scan_csv(spark, path, dialect=detect(spark, path))
    kinds = profile(raw).select("column", "inferred_type").collect()  # one row for each column
    typed(raw, kinds).write.mode(mode).parquet(out)
    return spark.read.parquet(out).agg(F.count("*").alias("rows")).select(F.lit(out).alias("path"), "rows")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (a temporary one of this machine under a local master)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{found or f'file://{tempfile.mkdtemp()}'}/scratch-{uuid.uuid4().hex}"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``(file, changed)``: the files below a folder and when each was written; none of them is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"))


def read_files(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """The Parquet files of a folder with these names (as :func:`listing` gives them), with the columns of its sub-folders."""
    return spark.read.option("basePath", path).parquet(*map(unquote, files))


def kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select([F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])


def expired(df: DataFrame, access: str, as_of: str, days: int) -> DataFrame:
    """Rows last used at least ``days`` days before ``as_of``."""
    return df.where(coerce.ts(df, access) <= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days)))
