"""Evidence tables: quality, distribution, series statistics, change points, segments, facts, citations."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autobi.functions import coerce
from autobi.operators import charts, scan, signals
from autobi.operators.percentiles import quantile, quantiles
from autobi.operators.profile import profile


def quality(df: DataFrame, x: str | None = None, y: str | None = None, exact: bool = True) -> DataFrame:
    """One row: rows, columns, null rates, estimated duplicates, coverage of dates, negatives, strong skew."""
    columns = profile(df, exact=exact)
    of_all = columns.agg(F.max("row_count").alias("rows"), F.count("*").alias("columns"), F.avg("null_rate").alias("mean_null_rate"), F.max("null_rate").alias("max_null_rate"), F.min_by("column", F.struct(-F.col("null_rate"), "column")).alias("max_null_column"), F.max("distinct_count").alias("d"))
    of_all = of_all.withColumn("duplicate_rate_est", F.when(F.col("rows") > 0, F.greatest(F.lit(0.0), 1 - F.col("d") / F.col("rows"))).otherwise(0.0)).drop("d")
    stamp = coerce.ts(df, x) if x else F.lit(None).cast("timestamp_ntz")
    given = ~coerce.is_blank(coerce.label(df, x)) if x else F.lit(False)
    value = coerce.num(df, y) if y else F.lit(None).cast("double")
    rows = df.select(stamp.alias("x"), given.alias("given"), value.alias("y"))
    skew = F.when(F.stddev_pop("y") > 1e-9, (F.avg("y") - quantile(F.col("y"), 0.5, exact)) / F.stddev_pop("y")).otherwise(0.0)
    of_axes = rows.agg(F.min("x").alias("first"), F.max("x").alias("last"), F.count_if(F.col("given") & F.col("x").isNull()).alias("unparsable_dates"), F.count_if(F.col("y") < 0).alias("negative_values"), (F.abs(F.coalesce(skew, F.lit(0.0))) >= 1.5).alias("extreme_skew"))
    return of_all.join(F.broadcast(of_axes))  # one row each


def duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``rows, distinct_rows, duplicate_rows, duplicate_rate``, exact, by the given columns or all.

    Rows are counted by 128 bits of two hashes, combined before the shuffle. Only rows whose hash is not alone are
    compared by value, so that rows of equal hashes but different values count as different.
    """
    names = list(columns or df.columns)
    marks = [F.xxhash64(*[df[c] for c in names]).alias("__h"), F.xxhash64(F.lit(1), *[part for c in names for part in (df[c], df[c].isNull())]).alias("__g")]
    rows = df.select(*[df[c] for c in names], *marks)
    groups = rows.groupBy("__h", "__g").agg(F.count("*").alias("n"))
    alone = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") == 1).alias("alone"))
    shared = rows.join(groups.where("n > 1").select("__h", "__g"), ["__h", "__g"], "left_semi").groupBy(*names).agg(F.lit(1)).agg(F.count("*").alias("shared"))
    both = alone.join(F.broadcast(shared)).select("rows", (F.col("alone") + F.col("shared")).alias("distinct_rows"))  # one row each
    extra = F.col("rows") - F.col("distinct_rows")
    return both.select("rows", "distinct_rows", extra.alias("duplicate_rows"), F.when(F.col("rows") > 0, extra / F.col("rows")).otherwise(0.0).alias("duplicate_rate"))


def distribution(df: DataFrame, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Count, moments, percentiles, interquartile range, variation and skew of each series' y."""
    levels = {"median": 0.5, "p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}
    made = df.where("y is not null").groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("y").alias("mean"), quantiles(F.col("y"), list(levels.values()), exact).alias("q"), F.stddev_pop("y").alias("stddev"), F.min("y").alias("min"), F.max("y").alias("max")
    )
    own = [F.col("q")[k].alias(n) for k, n in enumerate(levels)]
    made = made.select(*by, "n", "mean", own[0], "stddev", "min", "max", *own[1:])
    s, m = F.col("stddev"), F.col("mean")
    return made.withColumns({"iqr": F.col("p75") - F.col("p25"), "cv": F.when(F.abs(m) > 1e-9, s / F.abs(m)).otherwise(0.0), "skew": F.when(s > 1e-9, (m - F.col("median")) / s).otherwise(0.0)})


def series_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Slope, its class (1 % of the mean), volatility and a band of one standard deviation; 6 points at least."""
    made = signals.points(df, by).groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("y", "i").alias("slope"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("stddev")).where("n >= 6")
    edge = 0.01 * F.abs("mean")
    kind = F.when(F.col("slope") > edge, "Rising").when(F.col("slope") < -edge, "Falling").otherwise("Flat")
    ratio = F.when(F.abs("mean") > 1e-9, F.col("stddev") / F.abs("mean")).otherwise(0.0)
    return made.select(*by, "n", "slope", kind.alias("trend"), ratio.alias("volatility_ratio"), (F.col("mean") - F.col("stddev")).alias("band_low"), (F.col("mean") + F.col("stddev")).alias("band_high"))


def pattern_strength(df: DataFrame, bucket: str = "weekday", by: Sequence[str] = ()) -> DataFrame:
    """How much weekdays or months differ; 8 points at least."""
    key = {"weekday": F.dayofweek("x"), "month": F.month("x")}[bucket]
    return signals.bucket_strength(df, key, by).where("n >= 8").select(*by, "n", "strength")


def change_points(df: DataFrame, by: Sequence[str] = (), k: int = 3) -> DataFrame:
    """The k places of each series where the mean before and the mean after differ most; 12 points at least.

    Both means span a number of points that grows with the series (an eighth, from 3 to 20). Running sums give
    them: the sum up to a place is looked up at three places by joins on the place.
    """
    by = list(by)
    if by:
        run = charts.over(by, "x").rowsBetween(-(2**63), 0)
        sized = signals.points(df, by).withColumn("total", F.sum("y").over(run)).withColumn("n", F.count("*").over(charts.over(by))).where("n >= 12")
    else:
        known = df.where("y is not null")
        whole = known.agg(F.count("*").alias("n")).where("n >= 12")
        sized = scan.running_sum(known, "y", "x", "total", at="i").join(F.broadcast(whole))  # one row
    sized = sized.withColumn("w", F.greatest(F.lit(3), F.least(F.lit(20), F.floor(F.col("n") / 8))).cast("int"))
    sums = sized.select(*by, F.col("i").alias("j"), F.col("total").alias("upto"))
    at = lambda place, name: sums.select(*by, F.col("j").alias(place), F.col("upto").alias(name))
    rows = sized.where("i >= w and i + w < n").withColumns({"a": F.col("i") - F.col("w") - 1, "b": F.col("i") - 1, "c": F.col("i") + F.col("w") - 1})
    rows = rows.join(at("a", "sa"), [*by, "a"], "left").join(at("b", "sb"), [*by, "b"]).join(at("c", "sc"), [*by, "c"])
    before = (F.col("sb") - F.coalesce("sa", F.lit(0.0))) / F.col("w")
    after = (F.col("sc") - F.col("sb")) / F.col("w")
    shifted = rows.select(*by, "x", before.alias("before"), after.alias("after"), F.abs(after - before).alias("shift"))
    best = [F.desc(F.round("shift", 6)), F.asc("x")]
    rank = F.row_number().over(charts.over(by, *best))
    return (shifted if by else shifted.orderBy(*best).limit(k)).withColumn("rank", rank).where(F.col("rank") <= k)


def share(df: DataFrame, col: str, by: Sequence[str] = ()) -> Column:
    """Part of the group's total of absolute values."""
    total = F.sum(F.abs(col)).over(charts.over(by))
    return F.when(total > 1e-9, F.abs(col) / total).otherwise(0.0)


def segment_breakdown(df: DataFrame, n: int = 10, series: str = "series", sensitive: bool = False) -> DataFrame:
    """The n (3 to 20) largest segments: total, share of those kept, stability, and whether the share is unusual."""
    n = min(20, max(3, n))
    made = df.where("y is not null").groupBy(series).agg(F.sum("y").alias("total"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))
    cv = F.when(F.abs("m") > 1e-9, F.col("s") / F.abs("m")).otherwise(0.0)
    kept = made.withColumn("stability", 1 / (1 + cv)).orderBy(F.desc(F.abs("total")), series).limit(n)
    kept = kept.withColumn("share_percent", share(kept, "total") * 100)
    every = charts.over(())
    kept = kept.withColumns({"sm": F.avg("share_percent").over(every), "ss": F.stddev_pop("share_percent").over(every)})
    odd = (F.col("ss") > 1e-9) & (F.abs(F.col("share_percent") - F.col("sm")) > 2 * F.col("ss"))
    rank = F.row_number().over(charts.over((), F.desc(F.abs("total")), F.asc(series)))
    out = kept.select(F.col(series).alias("segment"), "total", "share_percent", "stability", odd.alias("outlier"), rank.alias("rank"))
    return out.withColumn("segment", F.lit("segment")) if sensitive else out


def facts(df: DataFrame, prefix: str, values: Sequence[str], name: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``(evidence_id, claim, value)`` of a table's figures; a row's id holds its key columns."""
    def one(column: str) -> Column:
        parts = [F.lit(prefix), F.lit(column), *([F.lit(name)] if name else []), *[F.col(k).cast("string") for k in keys]]
        ident = F.concat_ws("_", *[coerce.evidence_id(p) for p in parts])
        return F.struct(ident.alias("evidence_id"), F.concat_ws(" ", F.lit(column), *([F.lit(f"of {name}")] if name else []), *[F.col(k).cast("string") for k in keys]).alias("claim"), F.col(column).cast("double").alias("value"))

    return df.select(F.explode(F.array(*[one(c) for c in values])).alias("f")).select("f.*").where("value is not null")


def all_facts(*tables: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def unknown_citations(cites: DataFrame, known: DataFrame) -> DataFrame:
    """Citations of evidence that does not exist."""
    return cites.join(known.select("evidence_id"), "evidence_id", "left_anti")


def citation_usage(cites: DataFrame, known: DataFrame, n: int = 10) -> DataFrame:
    """The n most cited facts: ``(evidence_id, used)``."""
    used = cites.join(known.select("evidence_id"), "evidence_id", "left_semi").groupBy("evidence_id").agg(F.count("*").alias("used"))
    return used.orderBy(F.desc("used"), "evidence_id").limit(n)


def aggregated_sample(df: DataFrame, by: Sequence[str] = (), most: int = 400, sensitive: bool = False) -> DataFrame:
    """Evenly spread points of each series; none if the data is sensitive."""
    return charts.even_sample(df, most, by).where(F.lit(not sensitive))
