"""Profiles kept by file: a file is read once, and the profile of a folder is merged from what is kept of its files.

A store holds, below ``figures``, a row for each file and column (counts, ends, a sketch of the distinct values) and,
below ``values``, the distinct values of each by the 96 bits of two hashes, with their counts and first characters. A
file is known by its path and the time it was written: one written anew is read again, one that is gone no longer counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autobi.operators.profile import figures_of, filled, inferred, marks_of, simple_columns
from autobi.sources import tables

FIGURES = "file string, changed timestamp, batch string, place int, column string, type string, rows long, full long, bools long, dates long, numbers long, min double, max double, sketch binary"
VALUES = "file string, batch string, column string, h long, g int, head string, n long"
SUMS = ["full", "bools", "dates", "numbers"]
#: Characters kept of a value; values are told apart by their hashes.
HEAD = 200


def _kind(kind: T.DataType) -> str:
    for name, types in {"text": T.StringType, "number": T.NumericType, "boolean": T.BooleanType}.items():
        if isinstance(kind, types):
            return name
    return "time"


TYPES = {"text": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "time": T.TimestampType()}


def _text(c, kind: T.DataType):
    whole = F.when(c == 0, F.abs(c)).otherwise(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c  # one zero only
    return F.when(filled(c, kind), whole.cast("string"))


def _file(name: str) -> list[Column]:
    """A file as the two hashes by which values are told apart, so that no row carries its name."""
    return [F.xxhash64(name).alias("fh"), F.hash(name).alias("fg")]


def _counted(df: DataFrame, values: list[Column]) -> DataFrame:
    """``(fh, fg, place, h, g, head, n)``: the distinct values of each file and column.

    ``head`` is a key, as it follows from the value: the smallest one of a group would need all rows sorted by their keys.
    """
    long = df.select(*_file("_metadata.file_path"), F.explode(F.array(*values)).alias("v")).where("v is not null").select("fh", "fg", "v.*")
    return long.groupBy("fh", "fg", "place", "h", "g", "head").agg(F.count("*").alias("n"))


def update(spark: SparkSession, path: str, store: str) -> int:
    """Read the files of a folder of Parquet files that the store does not hold yet; returns how many.

    A column must have the same kind of type (text, number, truth value, time) in all files; it may be missing in
    some, whose rows count as null. An update that fails leaves nothing that a later one would count; run one at a time.
    """
    known = tables.kept(spark, f"{store}/figures/*", FIGURES)
    new = tables.listing(spark, path).join(known.select("file", "changed").distinct(), ["file", "changed"], "left_anti")
    files = [r.file for r in new.select("file").collect()]  # names of files to read, which their scan lists as well
    if not files:
        return 0
    df, batch = tables.read_files(spark, path, files), uuid.uuid4().hex
    columns = simple_columns(df)
    if not columns:
        return 0
    for r in known.select("column", "type").distinct().collect():  # as many as columns
        if any(f.name == r.column and _kind(f.dataType) != r.type for f in columns):
            raise ValueError(f"{r.column} was {r.type} before")
    file, changed = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed")
    figures, marked, shown, values = [F.count("*").alias("__rows")], [], [], []
    for k, f in enumerate(columns):
        marks = marks_of(df[f.name], f.dataType)
        own = figures_of({n: F.col(f"__{n}_{k}") for n in marks})
        value = _text(df[f.name], f.dataType)
        figures += [v.alias(f"{n}_{k}") for n, v in own.items()] + [F.hll_sketch_agg(f"__hash_{k}").alias(f"sketch_{k}")]
        marked += [v.alias(f"__{n}_{k}") for n, v in marks.items()] + [F.when(value.isNotNull(), F.xxhash64(value)).alias(f"__hash_{k}")]
        made = [(F.col(f"{n}_{k}") if n in own else F.lit(0)).cast("double" if n in ("min", "max") else "long").alias(n) for n in [*SUMS, "min", "max"]]
        shown.append(F.struct(F.lit(k).alias("place"), F.lit(f.name).alias("column"), F.lit(_kind(f.dataType)).alias("type"), F.col("__rows").alias("rows"), *made, F.col(f"sketch_{k}").alias("sketch")))
        values.append(F.when(value.isNotNull(), F.struct(F.lit(k).alias("place"), F.xxhash64(value).alias("h"), F.hash(value).alias("g"), F.left(value, F.lit(HEAD)).alias("head"))))
    names = new.select("file", *_file("file"))
    column = F.array(*[F.lit(f.name) for f in columns])[F.col("place")].alias("column")
    counted = _counted(df, values).join(F.broadcast(names) if len(files) <= tables.FILES else names, ["fh", "fg"])
    counted.select("file", F.lit(batch).alias("batch"), column, "h", "g", "head", "n").write.parquet(f"{store}/values/{batch}")
    whole = df.select(file, changed, *marked).groupBy("file", "changed").agg(*figures)
    found = whole.select("file", "changed", F.explode(F.array(*shown)).alias("p")).select("file", "changed", "p.*")
    empty = [F.lit(k if n == "place" else f.name if n == "column" else _kind(f.dataType) if n == "type" else 0 if n not in ("min", "max", "sketch") else None).alias(n) for k, f in enumerate(columns[:1]) for n in ["place", "column", "type", "rows", *SUMS, "min", "max", "sketch"]]
    found = found.unionByName(new.join(whole.select("file"), "file", "left_anti").select("file", "changed", *empty))  # files without rows are known as well
    found.withColumn("batch", F.lit(batch)).write.parquet(f"{store}/figures/{batch}")
    return len(files)


def _current(spark: SparkSession, path: str, store: str) -> DataFrame:
    known = tables.kept(spark, f"{store}/figures/*", FIGURES)
    return known.join(tables.listing(spark, path), ["file", "changed"], "left_semi")


def _values(spark: SparkSession, figures: DataFrame, store: str) -> DataFrame:
    """``(column, h, g, head, n)``: the distinct values of all files of the figures."""
    values = tables.kept(spark, f"{store}/values/*", VALUES).join(figures.select("file", "batch").distinct(), ["file", "batch"], "left_semi")
    return values.groupBy("column", "h", "g", "head").agg(F.sum("n").alias("n"))


def profile(spark: SparkSession, path: str, store: str, exact: bool = True, table: str | None = None) -> DataFrame:
    """The profile of the folder's files, as ``profile.profile`` gives it, from what the store holds of them after :func:`update`.

    Distinct values are counted by the kept hashes, or, not exact, by merged sketches, which reads no value. Files that
    the store does not hold do not count.
    """
    figures = _current(spark, path, store)
    rows = figures.groupBy("file").agg(F.max("rows").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"))
    merged = figures.groupBy("column").agg(
        F.min("place").alias("place"), F.first("type").alias("type"), *[F.sum(n).alias(n) for n in SUMS], F.min("min").alias("min"), F.max("max").alias("max"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("distinct"),
    )
    if exact:
        counts = _values(spark, figures, store).groupBy("column").agg(F.count("*").alias("distinct"))
        merged = merged.drop("distinct").join(counts, "column", "left").fillna(0, ["distinct"])
    whole = merged.join(F.broadcast(rows))  # one row
    made = {n: F.col(n) for n in [*SUMS, "distinct"]}
    kind = F.coalesce(*[F.when(F.col("type") == n, inferred(t, made, F.col("row_count"))) for n, t in TYPES.items()])
    null_rate = F.when(F.col("row_count") > 0, 1 - F.col("full") / F.col("row_count")).otherwise(0.0)
    out = whole.withColumn("inferred_type", kind).select(
        "column", "inferred_type", "row_count", null_rate.alias("null_rate"), F.col("distinct").cast("long").alias("distinct_count"),
        *[F.when(F.col("inferred_type") == "Number", F.col(n)).alias(n) for n in ("min", "max")],
    )
    return out.select(F.lit(table).alias("table"), "*") if table else out


def top_values(spark: SparkSession, path: str, store: str, n: int = 3) -> DataFrame:
    """``(column, value, count)``: each column's most frequent values in the folder's files, ties by value; of values the
    first 200 characters."""
    counted = _values(spark, _current(spark, path, store), store).select("column", F.col("head").alias("value"), F.col("n").alias("count"), "h")
    part = Window.partitionBy("column", F.pmod("h", F.lit(64))).orderBy(F.desc("count"), "value")
    best = counted.withColumn("r", F.row_number().over(part)).where(F.col("r") <= n)
    whole = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return best.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= n).drop("r", "h")
