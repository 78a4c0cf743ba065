"""Percentiles of measures, overall and for each bucket of a chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autobi.functions import coerce
from autobi.operators import charts
from autobi.operators import filters as fl
from autobi.operators.selection import selected
from autobi.plans.spec import QuerySpec

#: The reference levels.
LEVELS = {"p5": 0.05, "p10": 0.1, "p90": 0.9, "p95": 0.95}


def quantile(col: Column, q: float, exact: bool = True) -> Column:
    """Interpolated quantile; not exact: a sketch of fixed size, for groups of very many distinct values."""
    return F.percentile(col, F.lit(q)) if exact else F.percentile_approx(col, F.lit(q), F.lit(10_000)).cast("double")


def quantiles(col: Column, levels: Sequence[float], exact: bool = True) -> Column:
    """Several quantiles as an array, from one buffer of values."""
    many = F.array(*[F.lit(q) for q in levels])
    return F.percentile(col, many) if exact else F.percentile_approx(col, many, F.lit(10_000)).cast("array<double>")


def percentiles(df: DataFrame, col: str, by: Sequence[str] = (), levels: dict[str, float] = LEVELS, exact: bool = True, bounded: bool = False) -> DataFrame:
    """Quantiles of a measure, of each group ``by``; bounded: exact too, with no buffer of a group's values."""
    if bounded:
        return selected(df, col, levels, by)
    rows = df.select(*by, coerce.num(df, col).alias("v")).where("v is not null")
    found = rows.groupBy(*by).agg(quantiles(F.col("v"), list(levels.values()), exact).alias("q"))
    return found.select(*by, *[F.col("q")[k].alias(n) for k, n in enumerate(levels)])


def bucket(df: DataFrame, spec: QuerySpec) -> Column:
    return coerce.time_bin(coerce.ts(df, spec.x), spec.bin) if spec.chart == "line" else coerce.label(df, spec.x)


def percentile_by(df: DataFrame, spec: QuerySpec, q: float, exact: bool = True) -> DataFrame:
    """``(bucket, [series,] percentile)`` of the measure in each time bin or category."""
    rows = fl.apply(df, spec.filters)
    columns = [bucket(rows, spec).alias("bucket"), coerce.num(rows, spec.y).alias("v")]
    if spec.series:
        columns.append(charts.series_label(rows, spec.series).alias("series"))
    flat = rows.select(columns).where("bucket is not null and v is not null")
    return flat.groupBy("bucket", *(["series"] if spec.series else [])).agg(quantile(F.col("v"), q, exact).alias("percentile"))


def has_multi(df: DataFrame, key: str) -> DataFrame:
    """One row: does any value of the key have more than one row."""
    name = coerce.field(df, key).name
    return df.groupBy(name).agg(F.count("*").alias("n")).agg((F.coalesce(F.max("n"), F.lit(0)) > 1).alias("multi"))


def resolve_mode(df: DataFrame, spec: QuerySpec, asked: str | None = None) -> str:
    """``bucket`` or ``overall``: lines by bucket unless asked otherwise, bars if a category has several rows."""
    if asked == "overall" or spec.chart in ("scatter", "histogram"):
        return "overall"
    if spec.chart == "line":
        return "bucket"
    return "bucket" if has_multi(fl.apply(df, spec.filters), spec.x).first().multi else "overall"


def percentile_refs(df: DataFrame, spec: QuerySpec, exact: bool = True) -> DataFrame:
    """One row of reference levels of the measure (of x for a histogram)."""
    return percentiles(fl.apply(df, spec.filters), spec.x if spec.chart == "histogram" else spec.y, exact=exact)


def align(base: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return base.join(other, list(on), "left")


def percentile_view(df: DataFrame, spec: QuerySpec, q: float, mode: str | None = None, exact: bool = True) -> DataFrame:
    """The chart's points with a ``percentile``: of each bucket, or one for all of them."""
    mode = mode or resolve_mode(df, spec)
    base = charts.chart(df, spec, gaps="none")
    if mode == "bucket":
        key = "x" if spec.chart == "line" else "category"
        own = percentile_by(df, spec, q, exact).withColumnRenamed("bucket", key)
        return align(base, own, [key, *(["series"] if spec.series else [])])
    rows = fl.apply(df, spec.filters)
    one = rows.agg(quantile(coerce.num(rows, spec.x if spec.chart == "histogram" else spec.y), q, exact).alias("percentile"))
    return base.join(F.broadcast(one))  # one row
