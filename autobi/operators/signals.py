"""Statistical signals of series: one row for each series of ``(by…, x, y)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autobi.operators import charts
from autobi.operators.percentiles import quantiles

# Limits between the classes.
FLAT, STRONG, CALM, WILD = 0.06, 0.35, 0.15, 0.45


def points(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Points with a value, numbered from 0 within their series."""
    return charts.with_index(df.where("y is not null"), by, "x", "i")


def moments(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``n, mean, stddev`` (population), ``cv, min, max``."""
    cv = F.stddev_pop("y") / F.greatest(F.abs(F.avg("y")), F.lit(1e-9))
    return df.where("y is not null").groupBy(*by).agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("stddev"), cv.alias("cv"), F.min("y").alias("min"), F.max("y").alias("max"))


def slope(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on the place in the series."""
    return points(df, by).groupBy(*by).agg(F.coalesce(F.regr_slope("y", "i"), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept("y", "i"), F.first("y")).alias("intercept"))


def trend(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``trend`` Up, Flat or Down and its ``trend_strength``; fewer than 4 points: Flat."""
    made = points(df, by).groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.regr_slope("y", "i"), F.lit(0.0)).alias("s"), F.avg("y").alias("mean"))
    change = F.when(F.col("n") >= 4, F.col("s") * (F.col("n") - 1) / F.greatest(F.abs("mean"), F.lit(1e-9))).otherwise(0.0)
    made = made.withColumn("change", change)
    kind = F.when(F.abs("change") < FLAT, "Flat").when(F.col("change") > 0, "Up").otherwise("Down")
    return made.select(*by, kind.alias("trend"), F.least(F.lit(1.0), F.abs("change") / F.when(kind == "Flat", FLAT).otherwise(STRONG)).alias("trend_strength"))


def volatility(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``volatility`` Low, Medium or High by the coefficient of variation, and its ``volatility_strength``."""
    kind = F.when(F.col("cv") < CALM, "Low").when(F.col("cv") < WILD, "Medium").otherwise("High")
    return moments(df, by).select(*by, kind.alias("volatility"), F.when(kind == "High", 0.35).when(kind == "Medium", 0.2).otherwise(0.1).alias("volatility_strength"))


def fences(df: DataFrame, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """``n, mean, stddev, lo, hi``: what lies outside is an outlier. Fences are 1.5 interquartile ranges out, or
    3 standard deviations where that range is about zero."""
    made = df.where("y is not null").groupBy(*by).agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("stddev"), quantiles(F.col("y"), (0.25, 0.75), exact).alias("q"))
    made = made.withColumns({"q1": F.col("q")[0], "q3": F.col("q")[1]})
    iqr = F.col("q3") - F.col("q1")
    far = F.when(iqr > 1e-9, F.col("q1") - 1.5 * iqr).when(F.col("stddev") > 1e-9, F.col("mean") - 3 * F.col("stddev"))
    near = F.when(iqr > 1e-9, F.col("q3") + 1.5 * iqr).when(F.col("stddev") > 1e-9, F.col("mean") + 3 * F.col("stddev"))
    return made.select(*by, "n", "mean", "stddev", far.alias("lo"), near.alias("hi"), (iqr > 1e-9).alias("by_range"))


def _marked(df: DataFrame, by: Sequence[str]) -> DataFrame:
    limits = fences(df, by)
    rows = df.where("y is not null")
    both = rows.join(limits, list(by)) if by else rows.join(F.broadcast(limits))
    strict = (F.col("y") < F.col("lo")) | (F.col("y") > F.col("hi"))
    loose = (F.col("y") <= F.col("lo")) | (F.col("y") >= F.col("hi"))
    return both.withColumn("out", F.coalesce((F.col("n") >= 4) & F.when(F.col("by_range"), strict).otherwise(loose), F.lit(False)))


def outliers(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``outliers`` None, Few or Many, ``outlier_count`` and ``outlier_strength``."""
    made = _marked(df, by).groupBy(*by).agg(F.count("*").alias("n"), F.count_if("out").alias("outlier_count"))
    share = F.col("outlier_count") / F.col("n")
    kind = F.when(F.col("outlier_count") == 0, "None").when((share <= 0.02) | (F.col("outlier_count") <= 3), "Few").otherwise("Many")
    return made.select(*by, kind.alias("outliers"), "outlier_count", F.least(F.lit(1.0), share * 8).alias("outlier_strength"))


def outlier_rows(df: DataFrame, by: Sequence[str] = (), n: int = 5) -> DataFrame:
    """The n outliers of each series farthest beyond its fences (in standard deviations where those are the fence)."""
    far = F.row_number().over(charts.over(by, F.desc("distance"), F.asc("x")))
    rows = _marked(df, by).where("out").withColumn("distance", F.when(F.col("by_range"), F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi"))).otherwise(F.abs(F.col("y") - F.col("mean")) / F.col("stddev")))
    if not by:
        rows = rows.orderBy(F.desc("distance"), F.asc("x")).limit(n)
    return rows.withColumn("rank", far).where(F.col("rank") <= n).select(*by, "x", "y", "distance", "rank")


def bucket_strength(df: DataFrame, bucket: Column, by: Sequence[str] = ()) -> DataFrame:
    """``n, buckets, strength``: spread of the buckets' means over the spread of the values."""
    rows = df.where("y is not null")
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop("y").alias("s"), F.min("x").alias("first"), F.max("x").alias("last"))
    means = rows.groupBy(*by, bucket.alias("b")).agg(F.avg("y").alias("m")).groupBy(*by).agg(F.count("*").alias("buckets"), F.stddev_pop("m").alias("ms"))
    both = whole.join(means, list(by)) if by else whole.join(F.broadcast(means))
    return both.select(*by, "n", "buckets", "first", "last", F.when(F.col("s") > 1e-9, F.col("ms") / F.col("s")).otherwise(0.0).alias("strength"))


def seasonality(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``seasonality`` None, Weak or Strong over weekdays and its strength; needs 14 daily points over 60 days."""
    made = bucket_strength(df, F.dayofweek("x"), by)
    ready = (F.col("n") >= 14) & (F.timestamp_diff("DAY", F.col("first"), F.col("last")) >= 60) & (F.col("buckets") >= 4)
    s = F.when(ready, F.col("strength")).otherwise(0.0)
    kind = F.when(s >= 0.45, "Strong").when(s >= 0.25, "Weak").otherwise("None")
    return made.select(*by, kind.alias("seasonality"), F.least(F.lit(1.0), F.when(kind == "None", s / 2).otherwise(s)).alias("seasonality_strength"))


def confidence(n: Column, strengths: Sequence[Column]) -> Column:
    """From 0.1 to 0.95 by the number of points and the mean strength of the signals."""
    tier = F.when(n >= 500, 0.4).when(n >= 100, 0.3).when(n >= 30, 0.2).when(n >= 10, 0.12).otherwise(0.05)
    mean = sum(strengths[1:], strengths[0]) / len(strengths)
    return F.greatest(F.lit(0.1), F.least(F.lit(0.95), 0.2 + tier + 0.35 * mean))


def signals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All signals of each series; fewer than 4 points: Flat, Medium, None, None and confidence 0.2."""
    by = list(by)
    out = df.groupBy(*by).agg(F.count("y").alias("n")) if by else df.agg(F.count("y").alias("n"))
    for part in (trend(df, by), volatility(df, by), outliers(df, by), seasonality(df, by)):
        out = out.join(part, by, "left") if by else out.join(F.broadcast(part), how="left")
    enough = F.col("n") >= 4
    strengths = [F.coalesce(c, F.lit(0.0)) for c in ("trend_strength", "volatility_strength", "outlier_strength", "seasonality_strength")]
    words = {c: F.when(enough, F.coalesce(c, F.lit(d))).otherwise(d) for c, d in (("trend", "Flat"), ("volatility", "Medium"), ("outliers", "None"), ("seasonality", "None"))}
    sure = F.when(enough, confidence(F.col("n"), strengths)).otherwise(0.2)
    return out.select(*by, "n", *[v.alias(k) for k, v in words.items()], F.when(enough, F.coalesce("outlier_count", F.lit(0))).otherwise(0).alias("outlier_count"), sure.alias("confidence"))
