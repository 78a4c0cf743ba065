"""What-if comparisons of a measure by dimension."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autobi.functions import coerce
from autobi.operators import charts
from autobi.operators import filters as fl
from autobi.plans.spec import Filter, Step


def _change(metric: Column, step: Step) -> Column:
    if step.kind == "multiply":
        return metric * F.lit(float(step.value))
    if step.kind == "add":
        return metric + F.lit(float(step.value))
    return coerce.clamp(metric, step.low, step.high) if step.kind == "clamp" else metric


def what_if(df: DataFrame, metric: str, dim: str, agg: str = "sum", steps: Iterable[Step] = (), filters: Iterable[Filter] = (), limit: int | None = None) -> DataFrame:
    """``(dimension, baseline, simulated, delta, delta_percent)`` by dimension, in one aggregation.

    Steps change the measure of each row in order; removed values leave the simulated side. A side without rows
    counts as 0.
    """
    rows, steps = fl.apply(df, filters), list(steps)
    gone = [rows[coerce.field(rows, s.column or dim).name].isin(*s.values) for s in steps if s.kind == "remove"]
    keep = functools.reduce(lambda a, b: a & b, [F.coalesce(~g, F.lit(False)) for g in gone], F.lit(True))
    measure = coerce.num(rows, metric)
    flat = rows.select(coerce.label(rows, dim).alias("dimension"), measure.alias("m"), functools.reduce(_change, steps, measure).alias("s"), keep.alias("keep"))
    flat = flat.where("dimension is not null and m is not null")
    both = flat.groupBy("dimension").agg(charts.aggregate(agg, F.col("m")).cast("double").alias("baseline"), charts.aggregate(agg, F.when(F.col("keep"), F.col("s"))).cast("double").alias("simulated"))
    out = _deltas(both)
    return out.orderBy("dimension").limit(limit) if limit else out


def _deltas(both: DataFrame) -> DataFrame:
    both = both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("baseline", "simulated")})
    both = both.withColumn("delta", F.col("simulated") - F.col("baseline"))
    return both.withColumn("delta_percent", coerce.pct_change(F.col("baseline"), F.col("simulated")))


def compare(baseline: DataFrame, simulated: DataFrame, on: str = "dimension", value: str = "value") -> DataFrame:
    """Two tables of values side by side; a missing side counts as 0."""
    a = baseline.select(on, F.col(value).cast("double").alias("baseline"))
    b = simulated.select(on, F.col(value).cast("double").alias("simulated"))
    return _deltas(a.join(b, on, "full"))


def delta_summary(compared: DataFrame) -> DataFrame:
    """One row: mean, largest and smallest percent change, and how many points changed."""
    p = F.col("delta_percent")
    return compared.agg(coerce.rnd(F.avg(p), 4).alias("mean_percent"), coerce.rnd(F.max(p), 4).alias("max_percent"), coerce.rnd(F.min(p), 4).alias("min_percent"), F.count_if(F.abs("delta") > 1e-7).alias("changed"))


def top_deltas(compared: DataFrame, n: int = 5) -> DataFrame:
    return compared.orderBy(F.desc(F.abs(F.coalesce("delta_percent", "delta"))), "dimension").limit(n)


def cap_at_p95(df: DataFrame, metric: str) -> DataFrame:
    """One row: the smallest value that at least 95 % of the values do not exceed."""
    return df.select(coerce.num(df, metric).alias("v")).where("v is not null").agg(F.expr("percentile_disc(0.95) within group (order by v)").alias("cap"))


def preset(name: str, df: DataFrame | None = None, metric: str | None = None) -> list[Step]:
    """Steps of a named scenario: plus_10, minus_10, cap_p95 (which looks up one value)."""
    if name == "cap_p95":
        return [Step("clamp", high=cap_at_p95(df, metric).first().cap)]
    return [Step("multiply", {"plus_10": 1.1, "minus_10": 0.9}[name])]


def what_if_summary(compared: DataFrame, drivers: int = 3) -> DataFrame:
    """One row: mean, sum and largest change, change of spread and slope over the dimensions, and main drivers."""
    indexed = charts.with_index(compared, (), "dimension")
    slope = lambda c: F.coalesce(F.regr_slope(c, "i"), F.lit(0.0))
    figures = indexed.agg(
        F.avg("delta").alias("mean_delta"), F.sum("delta").alias("sum_delta"), F.max("delta").alias("max_delta"),
        (F.stddev_pop("simulated") - F.stddev_pop("baseline")).alias("stddev_change"),
        (slope("simulated") - slope("baseline")).alias("slope_change"),
    )
    size = F.abs(F.col("delta"))
    first = compared.orderBy(F.desc(size), "dimension").limit(drivers)
    text = F.struct((-size).alias("size"), "dimension", F.concat("dimension", F.lit(": "), coerce.fmt(F.col("delta"))).alias("text"))
    named = first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(text)), lambda t: t["text"]), "; ").alias("drivers"))
    return figures.join(F.broadcast(named))  # one row each
