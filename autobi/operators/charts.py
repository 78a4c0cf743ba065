"""Chart queries: time series, bars, scatter samples, histograms, gap filling and thinning."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autobi.functions import coerce
from autobi.operators import filters as fl
from autobi.operators import scan
from autobi.plans.spec import Filter, QuerySpec

#: Points of a line, pairs kept for each bar of a grouped chart, and series shown.
MAX_POINTS, PAIRS, SERIES = 2000, 5, 5


def aggregate(kind: str, col: Column) -> Column:
    return {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}[kind](col)


def series_label(df: DataFrame, name: str) -> Column:
    return F.when(coerce.is_blank(coerce.label(df, name)), "Unknown").otherwise(coerce.label(df, name))


def over(by: Sequence[str], *order):
    """A window over each series; all rows are one series if ``by`` is empty (for a few rows, see :mod:`autobi.operators.scan`)."""
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return window.orderBy(*order) if order else window


def time_series(df: DataFrame, x: str, y: str | Sequence[str], bin: str = "day", agg: str = "sum", series: str | None = None, filters: Iterable[Filter] = (), strict: bool = False) -> DataFrame:
    """``([series,] x, value)``: a measure by time bin. Several measures give series named after them."""
    rows = fl.apply(df, filters)
    many = [y] if isinstance(y, str) else list(y)
    keys = [coerce.time_bin(coerce.ts(rows, x), bin).alias("x")]
    if series:
        keys.append(series_label(rows, series).alias("series"))
    flat = rows.select(*keys, *[coerce.num(rows, m, strict).alias(f"m{k}") for k, m in enumerate(many)]).where("x is not null")
    if len(many) == 1:
        flat = flat.where("m0 is not null")
        return flat.groupBy(*(["series"] if series else []), "x").agg(aggregate(agg, F.col("m0")).alias("value"))
    found = flat.groupBy(*(["series"] if series else []), "x").agg(*[aggregate(agg, F.col(f"m{k}")).alias(f"v{k}") for k in range(len(many))], *[F.count(f"m{k}").alias(f"n{k}") for k in range(len(many))])
    parts = []
    for k, m in enumerate(many):
        name = F.concat(F.lit(f"{m} - "), F.col("series")) if series else F.lit(m)
        parts.append(F.struct(name.alias("series"), F.col(f"v{k}").cast("double").alias("value"), F.col(f"n{k}").alias("n")))
    return found.select("x", F.explode(F.array(*parts)).alias("p")).where("p.n > 0").select("p.series", "x", "p.value")


def fill_gaps(points: DataFrame, bin: str, mode: str = "nulls", by: Sequence[str] = (), x: str = "x", value: str = "value", most: int = 100_000) -> DataFrame:
    """Every bin from a series' first to its last: missing ones null, the last value (``ffill``) or zero.

    ``most`` bounds the bins of a series; a longer one is an error rather than a huge table.
    """
    if mode not in ("none", "nulls", "ffill", "zeros"):
        raise ValueError("mode must be none, nulls, ffill or zeros")
    if mode == "none":
        return points
    ends = points.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).where("lo is not null")
    shortest = {"day": 86_400, "week": 7 * 86_400, "month": 28 * 86_400, "quarter": 90 * 86_400, "year": 365 * 86_400}[bin]
    span = F.timestamp_diff("SECOND", F.col("lo"), F.col("hi")) / shortest
    ends_ok = ends.where(F.when(span <= most, True).otherwise(F.raise_error(F.lit("too many bins in a series"))))
    calendar = ends_ok.select(*by, F.explode(F.sequence("lo", "hi", coerce.interval(bin))).alias(x))
    out = calendar.join(points, [*by, x], "left")
    if mode == "zeros":
        out = out.withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    if mode == "ffill":
        out = ffill(out, value, by, x)
    return out.select(*by, x, value)


def with_index(points: DataFrame, by: Sequence[str] = (), order: str = "x", name: str = "i") -> DataFrame:
    """Place of each point in its series, from 0."""
    if not by:
        return scan.index(points, order, name)
    return points.withColumn(name, F.row_number().over(over(by, order)) - 1)


def ffill(points: DataFrame, col: str = "y", by: Sequence[str] = (), order: str = "x") -> DataFrame:
    """The last known value of a series where a point has none."""
    if not by:
        return scan.last_known(points, col, order)
    window = over(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn(col, F.last(col, ignorenulls=True).over(window))


def diff(points: DataFrame, col: str = "y", by: Sequence[str] = (), order: str = "x", name: str = "diff") -> DataFrame:
    """Change from the point before; the first point has none."""
    if not by:
        return scan.lagged(points, col, order, "__lag").withColumn(name, F.col(col) - F.col("__lag")).drop("__lag")
    return points.withColumn(name, F.col(col) - F.lag(col).over(over(by, order)))


def trailing_mean(points: DataFrame, width: int, col: str = "y", by: Sequence[str] = (), order: str = "x", name: str = "trailing_mean") -> DataFrame:
    """Mean of the ``width`` points before each point; null where there are fewer.

    Without series it is the difference of two running sums of what is known, the earlier one looked up by its place.
    """
    if not by:
        known = points.withColumn("__n", F.col(col).isNotNull().cast("int"))
        rows = scan.running_sum(scan.running_sum(known, "__n", order, "__count", at="__i"), col, order, "__sum")
        own = rows.withColumns({"__a": F.col("__i") - width - 1, "__b": F.col("__i") - 1})
        at = rows.select(F.col("__i").alias("__j"), F.struct("__sum", "__count").alias("__at"))
        for side in "ab":
            own = own.join(at.withColumnsRenamed({"__j": f"__{side}", "__at": f"__at_{side}"}), f"__{side}", "left")
        part = lambda f: F.coalesce(F.col(f"__at_b.{f}"), F.lit(0)) - F.coalesce(F.col(f"__at_a.{f}"), F.lit(0))
        mean = F.when((F.col("__i") >= width) & (part("__count") > 0), part("__sum") / part("__count"))
        return own.withColumn(name, mean).select(*points.columns, name)
    window = over(by, order)
    mean = F.avg(col).over(window.rowsBetween(-width, -1))
    return points.withColumn(name, F.when(F.row_number().over(window) > width, mean))


def stride(points: DataFrame, most: int = MAX_POINTS, by: Sequence[str] = (), order: str = "x") -> DataFrame:
    """Every k-th point of a series, the first included, with the smallest k that leaves at most ``most``."""
    counted = points.withColumn("__n", F.count("*").over(over(by))) if by else points.join(F.broadcast(points.agg(F.count("*").alias("__n"))))  # one row
    step = F.ceil(F.col("__n") / most)
    marked = with_index(counted, by, order, "__i").withColumn("__step", F.greatest(F.lit(1), step)).drop("__n")
    return marked.where(F.col("__i") % F.col("__step") == 0).drop("__i", "__step")


def even_sample(points: DataFrame, most: int, by: Sequence[str] = (), order: str = "x") -> DataFrame:
    """Exactly ``most`` evenly spread points of a longer series, its ends included; shorter series stay whole."""
    counted = points.withColumn("__n", F.count("*").over(over(by))) if by else points.join(F.broadcast(points.agg(F.count("*").alias("__n"))))  # one row
    marked = with_index(counted, by, order, "__i")
    if most < 2:
        return marked.where("__i = 0 or __n <= 1").where(F.lit(most > 0)).drop("__i", "__n")
    gap = (F.col("__n") - 1) / (most - 1)
    slot = F.round(F.col("__i") / gap).cast("long")  # the slot whose place is nearest
    near = [F.bround((slot + k) * gap) == F.col("__i") for k in (-1, 0, 1)]
    inside = [(slot + k >= 0) & (slot + k <= most - 1) for k in (-1, 0, 1)]
    taken = (near[0] & inside[0]) | (near[1] & inside[1]) | (near[2] & inside[2])
    return marked.where((F.col("__n") <= most) | taken).drop("__i", "__n")


def top_n(df: DataFrame, n: int, by: str = "value", tie: str = "category") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), F.asc(tie)).limit(n)


def top_series(points: DataFrame, n: int = SERIES, series: str = "series", value: str = "value") -> DataFrame:
    """The series with the largest totals: ``(series, total)``."""
    return top_n(points.groupBy(series).agg(F.sum(value).alias("total")), n, "total", series)


def bar(df: DataFrame, x: str, y: str | None = None, agg: str = "sum", n: int = 20, series: str | None = None, filters: Iterable[Filter] = ()) -> DataFrame:
    """``(category, [series,] value)``: the top categories by an aggregate.

    With series: of the largest ``5 n`` pairs, the five largest series, with zero where a pair is missing.
    """
    rows = fl.apply(df, filters)
    measure = coerce.num(rows, y) if y else F.lit(1.0)
    columns = [coerce.label(rows, x).alias("category"), measure.alias("m")]
    if series:
        columns.append(series_label(rows, series).alias("series"))
    flat = rows.select(columns).where("category is not null and m is not null")
    if not series:
        return top_n(flat.groupBy("category").agg(aggregate(agg, F.col("m")).alias("value")), n)
    pairs = flat.groupBy("category", "series").agg(aggregate(agg, F.col("m")).cast("double").alias("value"))
    pairs = pairs.orderBy(F.desc("value"), "category", "series").limit(PAIRS * n)
    shown = F.broadcast(top_series(pairs).select("series"))  # at most five rows
    names = shown.agg(F.collect_list("series").alias("all"))
    grid = pairs.select("category").distinct().join(F.broadcast(names)).select("category", F.explode("all").alias("series"))
    return grid.join(pairs, ["category", "series"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def sample_n(df: DataFrame, n: int, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """A repeatable random sample of n rows: those whose keys, with the seed before them, have the smallest SHA-256."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256), *keys).limit(n)


def scatter(df: DataFrame, x: str, y: str, n: int = 2000, filters: Iterable[Filter] = (), key: str | None = None, seed: int = 42) -> DataFrame:
    """``(x, y)`` of at most n rows, sampled by the hash of a key (default: of the pair)."""
    rows = fl.apply(df, filters)
    columns = [coerce.num(rows, x).alias("x"), coerce.num(rows, y).alias("y")]
    if key:
        columns.append(rows[coerce.field(rows, key).name].alias("__key"))
    flat = rows.select(columns).where("x is not null and y is not null")
    return sample_n(flat, n, "__key" if key else ["x", "y"], seed).select("x", "y")


def histogram(df: DataFrame, x: str, bins: int = 20, filters: Iterable[Filter] = ()) -> DataFrame:
    """``(bin, lo, hi, count, label)``: equal bins from minimum to maximum, the last one closed, empty ones zero.

    A constant column has one bin; a column without values none. The number of bins is kept within 5 and 50.
    """
    bins = min(50, max(5, bins))
    rows = fl.apply(df, filters)
    flat = rows.select(coerce.num(rows, x).alias("v")).where("v is not null")
    stats = flat.agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low is not null")
    stats = stats.withColumn("bins", F.when(F.col("high") - F.col("low") < 1e-4, 1).otherwise(bins)).withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    place = F.when(F.col("bins") == 1, 0).otherwise(F.least(F.floor((F.col("v") - F.col("low")) / F.col("width")), F.col("bins") - 1))
    counts = flat.join(F.broadcast(stats)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("count"))  # one row of limits
    frame = stats.select("low", "high", "width", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    lo = F.col("low") + F.col("bin") * F.col("width")
    hi = F.when(F.col("bin") == F.col("bins") - 1, F.col("high")).otherwise(F.col("low") + (F.col("bin") + 1) * F.col("width"))
    out = frame.join(counts, "bin", "left").select("bin", lo.alias("lo"), hi.alias("hi"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    return out.withColumn("label", F.concat(F.lit("["), coerce.fmt(F.col("lo")), F.lit(", "), coerce.fmt(F.col("hi")), F.lit(")")))


def chart(df: DataFrame, spec: QuerySpec, gaps: str = "nulls") -> DataFrame:
    """The points of a described chart."""
    if spec.chart == "line":
        points = time_series(df, spec.x, spec.y, spec.bin, spec.agg, spec.series, spec.filters)
        by = ["series"] if spec.series else []
        return stride(fill_gaps(points, spec.bin, gaps, by), MAX_POINTS, by)
    if spec.chart == "bar":
        return bar(df, spec.x, spec.y, spec.agg, spec.top_n, spec.series, spec.filters)
    if spec.chart == "scatter":
        return scatter(df, spec.x, spec.y, filters=spec.filters)
    return histogram(df, spec.x, spec.bins, spec.filters)


def drilldown(spec: QuerySpec, label: str) -> QuerySpec:
    """The chart's filters with the clicked bar added: a category, or a histogram bin ``[a, b)``."""
    if spec.chart == "histogram":
        low, high = sorted(float(v) for v in label.strip("[]() ").split(","))
        added = Filter(spec.x, "between", (low, high))
    else:
        added = Filter(spec.x, "eq", (label,))
    return spec.replace(filters=(*spec.filters, added))


def rows_behind(df: DataFrame, x: str, label: str, n: int = 200, key: str | None = None) -> DataFrame:
    """The first n rows whose label is this one, or if there are none, holds it."""
    name = coerce.field(df, x).name
    exact = df.where(df[name].cast("string") == label)
    like = df.where(fl.contains(df[name], label))
    none = exact.limit(1).agg((F.count("*") == 0).alias("none"))
    both = exact.unionByName(like.join(F.broadcast(none)).where("none").drop("none"))  # one row tells which
    return both.orderBy(key or name).limit(n)
