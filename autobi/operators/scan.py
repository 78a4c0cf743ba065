"""Running figures over all rows in order without a single task for them: a prefix scan over ranges.

Rows are dealt to ranges by limits taken from a bounded sample of the order column. Within a range windows give the
figures; what earlier ranges hold (count, sum, last value), one row for each range, is added to them.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample from which limits are taken.
SAMPLE = 2000
RANGE = "__range"


def limits(df: DataFrame, order: str, ranges: int) -> list:
    """At most ``ranges`` - 1 values that cut the order column into ranges of about equal size."""
    some = df.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order, F.monotonically_increasing_id())).limit(SAMPLE).collect()
    values = sorted(r[0] for r in some)
    return sorted({values[len(values) * k // ranges] for k in range(1, ranges)}) if values else []


def ranged(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the number of each row's range; rows alike in order, and all nulls, are in one range."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = limits(df, order, ranges)
    kind = df.schema[order].dataType
    number = functools.reduce(lambda a, b: a + b, [F.coalesce((F.col(order) >= F.lit(c).cast(kind)).cast("int"), F.lit(0)) for c in cuts], F.lit(0))
    return df.withColumn(RANGE, number)


def _carried(rows: DataFrame, figures: list[Column], joined: list[Column]) -> DataFrame:
    """``rows`` with figures of all earlier ranges: ``figures`` made of each range, ``joined`` over those before."""
    each = rows.groupBy(RANGE).agg(*figures)
    last = rows.agg(F.max(RANGE).alias("__last"))
    later = F.explode(F.sequence(F.col(RANGE) + 1, F.col("__last")))
    ahead = each.join(F.broadcast(last)).where(F.col(RANGE) < F.col("__last")).withColumn("__to", later).groupBy("__to").agg(*joined)
    return rows.join(F.broadcast(ahead.withColumnRenamed("__to", RANGE)), RANGE, "left")  # one row for each range


def _window(order: str) -> Window:
    return Window.partitionBy(RANGE).orderBy(order)


def index(df: DataFrame, order: str, name: str) -> DataFrame:
    """The place of each row from 0."""
    rows = _carried(ranged(df, order), [F.count("*").alias("__c")], [F.sum("__c").alias("__before")])
    place = F.row_number().over(_window(order)) - 1 + F.coalesce("__before", F.lit(0))
    return rows.withColumn(name, place).drop(RANGE, "__before")


def running_sum(df: DataFrame, col: str, order: str, name: str, at: str | None = None) -> DataFrame:
    """The sum of a column up to each row, and with ``at`` the row's place from 0 as well, in one scan."""
    rows = _carried(ranged(df, order), [F.sum(col).alias("__s"), F.count("*").alias("__c")], [F.sum("__s").alias("__carried"), F.sum("__c").alias("__before")])
    w = _window(order)
    rows = rows.withColumn("__k", F.row_number().over(w))
    own = F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.when(own.isNull() & F.col("__carried").isNull(), F.lit(None)).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce("__carried", F.lit(0)))
    rows = rows.withColumn(name, whole)
    if at:
        rows = rows.withColumn(at, F.col("__k") - 1 + F.coalesce("__before", F.lit(0)))
    return rows.drop(RANGE, "__carried", "__before", "__k")


def last_known(df: DataFrame, col: str, order: str) -> DataFrame:
    """The last value that is not null up to each row, in place of the column."""
    known = F.struct(F.col(order).isNotNull(), order)
    rows = _carried(ranged(df, order), [F.max_by(F.col(col), F.when(F.col(col).isNotNull(), known)).alias("__v")], [F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(RANGE))).alias("__held")])
    own = F.last(col, ignorenulls=True).over(_window(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(col, F.coalesce(own, "__held")).drop(RANGE, "__held")


def lagged(df: DataFrame, col: str, order: str, name: str) -> DataFrame:
    """The value of the row before, null for the first row."""
    end = F.max_by(F.struct(F.col(col).alias("v")), F.struct(F.col(order).isNotNull(), order))
    rows = _carried(ranged(df, order), [end.alias("__v")], [F.max_by("__v", RANGE).alias("__end")])
    w = _window(order)
    rows = rows.withColumn("__k", F.row_number().over(w)).withColumn(name, F.lag(col).over(w))
    return rows.withColumn(name, F.when(F.col("__k") == 1, F.col("__end.v")).otherwise(F.col(name))).drop(RANGE, "__k", "__end")
