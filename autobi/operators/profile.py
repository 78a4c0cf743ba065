"""Column profiles and type inference."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autobi.functions import coerce

#: Share of values that must fit a type.
FIT = 0.9
SIMPLE = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
SCHEMA_COLUMNS = ("column", "inferred_type", "row_count", "null_rate", "distinct_count", "min", "max")


def simple_columns(df: DataFrame) -> list[T.StructField]:
    """Columns of single values; nested ones are not profiled."""
    return [f for f in df.schema.fields if isinstance(f.dataType, SIMPLE)]


def filled(c: Column, kind: T.DataType) -> Column:
    """Neither null nor blank text; values of other types are not written as text to see it."""
    return ~coerce.is_blank(c) if isinstance(kind, T.StringType) else c.isNotNull()


def inferred(kind: T.DataType, figures: dict[str, Column], rows: Column) -> Column:
    few = figures["distinct"] <= F.greatest(F.lit(20), F.floor(rows * 0.05))
    word = F.when(few, "Category").otherwise("String")
    full = figures["full"]
    if isinstance(kind, T.BooleanType):
        return F.when(full == 0, "String").otherwise("Boolean")
    if isinstance(kind, T.NumericType):
        return F.when(full == 0, "String").otherwise("Number")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.when(full == 0, "String").otherwise("Date")
    return (
        F.when(full == 0, "String")
        .when(figures["bools"] >= FIT * full, "Boolean")
        .when(figures["dates"] >= FIT * full, "Date")
        .when(figures["numbers"] >= FIT * full, "Number")
        .otherwise(word)
    )


def marks_of(c: Column, kind: T.DataType) -> dict[str, Column]:
    """What a value counts for in its column's profile; made for each row, as an aggregation would test a text anew for each figure."""
    full, text = filled(c, kind), isinstance(kind, T.StringType)
    own = {"full": full}
    if text:
        clean = F.trim(c)
        own |= {"bools": full & coerce.is_bool_word(clean), "dates": full & coerce.is_date_word(clean), "numbers": full & coerce.is_number_word(clean)}
    value = F.when(coerce.may_be_number(c), coerce.text_num(F.replace(c, F.lit(" "), F.lit("")))) if text else c.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
    return own | {"value": value}


def figures_of(marks: dict[str, Column]) -> dict[str, Column]:
    """Sums and ends, of columns of marks, that a column's profile is made of, besides its distinct values; they merge over parts."""
    return {n: F.count_if(c) for n, c in marks.items() if n != "value"} | {"min": F.min(marks["value"]), "max": F.max(marks["value"])}


def profile(df: DataFrame, sample_rows: int | None = None, exact: bool = True, table: str | None = None) -> DataFrame:
    """One row for each column: ``column, inferred_type, row_count, null_rate, distinct_count, min, max``.

    One aggregation over all columns, then one row for each. Distinct values are counted in a second scan by the
    96 bits of two hashes, all columns at once and equal values combined before they are shuffled, or, not exact, by a
    sketch in the one aggregation. Blank text counts as null. ``table`` adds its name as a first column.
    """
    rows = df.limit(sample_rows) if sample_rows else df
    apart = exact and not sample_rows
    distinct = F.count_distinct if exact else F.approx_count_distinct
    figures, marked, shown, hashes = [F.count("*").alias("__rows")], [], [], []
    for k, f in enumerate(simple_columns(df)):
        c = rows[f.name]
        full = filled(c, f.dataType)
        marks = marks_of(c, f.dataType)
        marked += [v.alias(f"__{n}_{k}") for n, v in marks.items()] + ([] if apart else [F.when(full, c).alias(f"__distinct_{k}")])
        own = figures_of({n: F.col(f"__{n}_{k}") for n in marks}) | {"distinct": F.lit(0) if apart else distinct(f"__distinct_{k}")}
        figures += [v.alias(f"{n}_{k}") for n, v in own.items()]
        made = {n: F.col(f"{n}_{k}") for n in own}
        if apart:
            hashes.append(F.when(full, F.struct(F.lit(k).alias("k"), F.xxhash64(c).alias("h"), F.hash(c).alias("g"))))
            made["distinct"] = F.coalesce(F.col("__distinct")[k], F.lit(0)).cast("long")
        total = F.col("__rows")
        kind = inferred(f.dataType, made, total)
        limits = [F.when(kind == "Number", made[n]).alias(n) for n in ("min", "max")]
        null_rate = F.when(total > 0, 1 - made["full"] / total).otherwise(0.0)
        shown.append(F.struct(F.lit(f.name).alias("column"), kind.alias("inferred_type"), total.alias("row_count"), null_rate.alias("null_rate"), made["distinct"].alias("distinct_count"), *limits))
    whole = rows.select(*marked).agg(*figures)
    if hashes:
        values = rows.select(F.explode(F.array(*hashes)).alias("v")).where("v is not null").select("v.*").distinct()
        each = values.groupBy("k").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("__distinct"))
        whole = whole.join(F.broadcast(each))  # one row each
    out = whole.select(F.explode(F.array(*shown)).alias("p")).select("p.*")
    return out.select(F.lit(table).alias("table"), "*") if table else out


def profile_tables(tables: dict[str, DataFrame], **options) -> DataFrame:
    """Profiles of many tables, with a ``table`` column."""
    return functools.reduce(DataFrame.unionByName, [profile(df, table=name, **options) for name, df in tables.items()])


def profile_top_values(df: DataFrame, n: int = 3) -> DataFrame:
    """``(column, value, count)``: the most frequent values of each column, ties by value.

    Values are counted within each column's name after one unpivot, combined before they are shuffled.
    """
    texts = [F.struct(F.lit(f.name).alias("column"), df[f.name].cast("string").alias("value")) for f in simple_columns(df)]
    long = df.select(F.explode(F.array(*texts)).alias("p")).select("p.*").where(~coerce.is_blank(F.col("value")))
    counted = long.groupBy("column", "value").agg(F.count("*").alias("count"))
    # the best of each part of a column first, so that no task sorts all values of a column
    part = Window.partitionBy("column", F.pmod(F.xxhash64("value"), F.lit(64))).orderBy(F.desc("count"), "value")
    best = counted.withColumn("r", F.row_number().over(part)).where(F.col("r") <= n)
    whole = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return best.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= n).drop("r")
