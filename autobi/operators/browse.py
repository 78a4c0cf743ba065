"""Row browser, field statistics and facets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autobi.functions import coerce
from autobi.operators import filters as fl
from autobi.plans.spec import Filter


def order_columns(df: DataFrame, rules: Sequence[tuple[str, str]], key: str | None = None) -> list[Column]:
    """At most three (column, asc or desc) rules, nulls last, then the key."""
    if len(rules) > 3:
        raise ValueError("at most three sort rules")
    columns = [(F.desc_nulls_last if way == "desc" else F.asc_nulls_last)(df[coerce.field(df, c).name]) for c, way in rules or [(df.columns[0], "asc")]]
    return columns + ([F.asc_nulls_last(df[coerce.field(df, key).name])] if key else [])


def sort_rows(df: DataFrame, rules: Sequence[tuple[str, str]] = (), key: str | None = None) -> DataFrame:
    return df.orderBy(*order_columns(df, rules, key))


def page(df: DataFrame, number: int = 1, size: int = 50, rules: Sequence[tuple[str, str]] = (), key: str | None = None) -> DataFrame:
    """The rows of one page, in order."""
    return sort_rows(df, rules, key).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, size: int = 50, most: int = 100_000) -> DataFrame:
    """One row: total rows, pages, and whether there are more rows than are shown."""
    counted = df.agg(F.count("*").alias("rows"))
    return counted.select("rows", F.ceil(F.col("rows") / size).alias("pages"), (F.col("rows") > most).alias("truncated"))


def browse(df: DataFrame, filters: Iterable[Filter] = (), search: str | None = None, rules: Sequence[tuple[str, str]] = (), number: int = 1, size: int = 50, key: str | None = None) -> DataFrame:
    """A page of the filtered rows, every column as text."""
    rows = fl.apply(df, filters)
    rows = fl.search(rows, search) if search else rows
    shown = page(rows, number, size, rules, key)
    return shown.select([shown[c].cast("string").alias(c) for c in shown.columns])


def field_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, blanks, distinct values, values that read as numbers or dates, and the kind of field."""
    f = coerce.field(df, column)
    c, blank = df[f.name], coerce.is_blank(df[f.name])
    text = isinstance(f.dataType, T.StringType)
    number = ~blank & (coerce.num(df, column).isNotNull() if text or coerce.is_numeric(df, column) else F.lit(False))
    date = ~blank & (coerce.ts(df, column).isNotNull() if text or coerce.is_temporal(df, column) else F.lit(False))
    found = df.agg(F.count("*").alias("rows"), F.count_if(blank).alias("blanks"), F.count_distinct(F.when(~blank, c)).alias("distinct"), F.count_if(number).alias("numbers"), F.count_if(date).alias("dates"))
    full = F.col("rows") - F.col("blanks")
    kind = F.when((full > 0) & (F.col("numbers") >= 0.9 * full), "Number").when((full > 0) & (F.col("dates") >= 0.9 * full), "Date").when(F.col("distinct") <= 50, "Category").otherwise("String")
    return found.withColumn("kind", kind)


def top_values(df: DataFrame, column: str, n: int = 12) -> DataFrame:
    """``(value, count)``: the most frequent values that are not blank."""
    name = coerce.field(df, column).name
    counted = df.select(df[name].cast("string").alias("value")).where(~coerce.is_blank(F.col("value"))).groupBy("value").agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), "value").limit(n)


def heavy_values(df: DataFrame, column: str, n: int = 12, buckets: int = 1 << 16) -> DataFrame:
    """What :func:`top_values` gives, exactly, without a shuffle of all distinct values.

    Values are counted by bucket of their hash first: a summary of fixed size that adds up over tasks, and a bound on
    every value in a bucket. The values of the fullest buckets are then counted each. If a bucket left out could still
    hold one of the top values, those of all buckets that could are counted. Two or three scans.
    """
    name = coerce.field(df, column).name
    value = df[name].cast("string")
    rows = df.select(value.alias("value")).where(~coerce.is_blank(F.col("value"))).withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)))
    held = rows.groupBy("bucket").agg(F.count("*").alias("held"))
    fullest = held.orderBy(F.desc("held"), "bucket").limit(4 * n + 1).collect()  # bounded by n
    taken, rest = [r.bucket for r in fullest[: 4 * n]], fullest[4 * n :]

    def best(some: DataFrame) -> DataFrame:
        return some.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(n)

    found = best(rows.where(F.col("bucket").isin(taken)))
    if not rest:
        return found
    known = found.collect()  # n rows
    least = known[-1]["count"] if len(known) == n else 1
    if rest[0].held < least:
        return df.sparkSession.createDataFrame(known, "value string, count long")
    could = held.where(F.col("held") >= least).select("bucket")
    return best(rows.join(F.broadcast(could), "bucket", "left_semi"))  # at most so many buckets as there are


def with_others(top: DataFrame, total: DataFrame) -> DataFrame:
    """Top values and a row ``Others`` with the rest of the total (one row, ``rows``)."""
    rest = top.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("listed")).join(F.broadcast(total.select("rows")))
    others = rest.select(F.lit("Others").alias("value"), (F.col("rows") - F.col("listed")).cast("long").alias("count")).where("count > 0")
    return top.unionByName(others)


def _ranges(values: DataFrame, bins: int, n: int) -> DataFrame:
    """``(bin, lo, hi, count)`` of a column v: observed ends of equal buckets, the most frequent first."""
    many = values.select("v").distinct().limit(21).agg((F.count("*") > 20).alias("many"))  # as many as it takes to tell
    stats = values.agg(F.min("v").alias("low"), F.max("v").alias("high")).join(F.broadcast(many)).where("many").drop("many")  # one row each
    place = F.least(F.floor((F.col("v") - F.col("low")) / ((F.col("high") - F.col("low")) / bins)), F.lit(bins - 1)).cast("int")
    cut = values.join(F.broadcast(stats)).groupBy(place.alias("bin")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("count"))  # one row of limits
    return cut.orderBy(F.desc("count"), "bin").limit(n)


def numeric_ranges(df: DataFrame, column: str, bins: int = 8, n: int = 8) -> DataFrame:
    """Equal-width ranges of a column of more than 20 distinct numbers."""
    return _ranges(df.select(coerce.num(df, column).alias("v")).where("v is not null"), bins, n)


def date_ranges(df: DataFrame, column: str, bins: int = 8, n: int = 8) -> DataFrame:
    """Equal-length ranges of a column of more than 20 distinct times."""
    values = df.select(coerce.epoch_s(coerce.ts(df, column)).alias("v")).where("v is not null")
    stamp = lambda c: F.timestamp_micros(F.round(F.col(c) * 1e6).cast("long")).cast("timestamp_ntz")
    return _ranges(values, bins, n).withColumns({"lo": stamp("lo"), "hi": stamp("hi")})


def _others(df: DataFrame, filters: Sequence[Filter], column: str) -> Column:
    found = fl.combine(df, [f for f in filters if f.column.lower() != column.lower()])
    return F.lit(True) if found is None else found


def facet_distinct(df: DataFrame, filters: Sequence[Filter], columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, distinct)``: for each column, its values under all filters but its own, in one scan."""
    names = [coerce.field(df, c).name for c in columns or df.columns]
    # of each row only hashes (96 bits) of the values that count go on, equal ones combined before they are shuffled
    hashes = [F.when(_others(df, filters, c) & ~coerce.is_blank(df[c]), F.struct(F.lit(k).alias("k"), F.xxhash64(df[c]).alias("h"), F.hash(df[c]).alias("g"))) for k, c in enumerate(names)]
    values = df.select(F.explode(F.filter(F.array(*hashes), lambda v: v.isNotNull())).alias("v")).select("v.*").distinct()
    counted = values.groupBy("k").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))  # a row for each column
    number = lambda k: F.coalesce(F.col("m")[F.lit(k)], F.lit(0)).cast("long")
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), number(k).alias("distinct")) for k, c in enumerate(names)])).alias("f")).select("f.*")


def facet_values(df: DataFrame, filters: Sequence[Filter], column: str, n: int = 12) -> DataFrame:
    """The most frequent values of a column under all filters but its own."""
    return top_values(df.where(_others(df, filters, column)), column, n)


def page_stats(df: DataFrame) -> DataFrame:
    """``(column, null_rate, distinct)`` of the rows given."""
    counted = df.agg(F.count("*").alias("__n"), *[x for c in df.columns for x in (F.count_if(coerce.is_blank(df[c])).alias(f"{c}__b"), F.count_distinct(df[c]).alias(f"{c}__d"))])
    parts = [F.struct(F.lit(c).alias("column"), (F.col(f"{c}__b") / F.col("__n")).alias("null_rate"), F.col(f"{c}__d").alias("distinct")) for c in df.columns]
    return counted.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


