"""Column roles and chart recommendations over the profiles of many tables at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autobi.functions import coerce

# Base scores and impacts of the chart types, and how many are proposed.
BASE = {"line": (0.52, 0.45), "bar": (0.50, 0.38), "scatter": (0.46, 0.42), "histogram": (0.42, 0.34)}
KEPT, BARS, SCATTERS = 12, 6, 2


def is_id(name: Column, kind: Column, distinct: Column, rows: Column, compat: bool = False) -> Column:
    """A column that names rows: ``id`` or ``key`` as a word of its name, or text that hardly repeats.

    compat: any name that contains ``id``, as in ``width``.
    """
    low = F.lower(name)
    named = low.contains("id") if compat else low.rlike(r"(^|_)(id|key)($|_)|key$") | name.rlike(r"[a-z]I[dD]$")
    return named | (kind.isin("String", "Category") & (distinct >= 0.98 * rows) & (rows > 0))


def roles(profiles: DataFrame, compat: bool = False) -> DataFrame:
    """Adds ``role``: Time, Id, Measure or Category."""
    kind = F.col("inferred_type")
    named = is_id(F.col("column"), kind, F.col("distinct_count"), F.col("row_count"), compat)
    return profiles.withColumn("role", F.when(kind == "Date", "Time").when(named, "Id").when(kind == "Number", "Measure").otherwise("Category"))


def _ranked(profiles: DataFrame, role: str, n: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("table").orderBy(*order, F.asc("column")))
    return profiles.where(F.col("role") == role).withColumn("rank", rank).where(F.col("rank") <= n)


def measures(profiles: DataFrame, n: int) -> DataFrame:
    """The n preferred measures of each table: ``score`` in the name, ``balance`` in it, then most distinct values."""
    low = F.lower("column")
    return _ranked(profiles, "Measure", n, F.desc(low.contains("score")), F.desc(low.contains("balance")), F.desc("distinct_count"))


def candidates(profiles: DataFrame) -> DataFrame:
    """``(table, chart, x, y, agg, bin, generation)`` from profiles with roles; tables may be many."""
    three = measures(profiles, 3).select("table", F.col("column").alias("m"), F.col("rank").alias("mr"))
    two = three.where("mr <= 2")
    time = _ranked(profiles, "Time", 1, F.desc(F.lower("column").contains("created"))).select("table", F.col("column").alias("x"))
    groups = _ranked(profiles.where("distinct_count <= 20"), "Category", 3, F.asc("distinct_count")).select("table", F.col("column").alias("x"), F.col("rank").alias("xr"))
    line = time.join(two, "table").select("table", F.lit("line").alias("chart"), "x", F.col("m").alias("y"), F.lit("avg").alias("agg"), F.lit("day").alias("bin"), F.col("mr").alias("generation"))
    bar = groups.join(two, "table").select("table", F.lit("bar").alias("chart"), "x", F.col("m").alias("y"), F.lit("sum").alias("agg"), F.lit(None).cast("string").alias("bin"), (F.col("xr") * 10 + F.col("mr") + 100).alias("generation"))
    hist = two.select("table", F.lit("histogram").alias("chart"), F.col("m").alias("x"), F.lit(None).cast("string").alias("y"), F.lit(None).cast("string").alias("agg"), F.lit(None).cast("string").alias("bin"), (F.col("mr") + 200).alias("generation"))
    other = three.select("table", F.col("m").alias("y"), F.col("mr").alias("yr"))
    pairs = three.join(other, "table").where("mr < yr")
    order = F.row_number().over(Window.partitionBy("table").orderBy("mr", "yr"))
    scatter = pairs.withColumn("o", order).where(F.col("o") <= SCATTERS).select("table", F.lit("scatter").alias("chart"), F.col("m").alias("x"), "y", F.lit(None).cast("string").alias("agg"), F.lit(None).cast("string").alias("bin"), (F.col("o") + 300).alias("generation"))
    return line.unionByName(bar).unionByName(hist).unionByName(scatter)


def score(found: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``score`` and ``impact`` from the profiles of the two axes."""
    side = lambda name: profiles.select("table", F.col("column").alias(name), F.col("role").alias(f"{name}_role"), F.col("distinct_count").alias(f"{name}_distinct"), F.col("null_rate").alias(f"{name}_null"), F.col("row_count").alias(f"{name}_rows"))
    both = found.join(side("x"), ["table", "x"]).join(side("y"), ["table", "y"], "left")
    coverage = F.coalesce(1 - F.col("y_null"), F.lit(0.0))  # a histogram has no second axis
    share = F.least(F.lit(1.0), F.coalesce(F.col("y_distinct") / F.greatest(F.lit(1), F.col("y_rows")), F.lit(0.0)))  # least() passes over nulls
    low = F.col("x_distinct") <= F.greatest(F.lit(20), F.floor(F.col("x_rows") * 0.05))
    summed = F.coalesce(F.col("agg").isin("sum", "avg"), F.lit(False))
    base = lambda k: F.create_map(*[F.lit(v) for c, b in BASE.items() for v in (c, b[k])])[F.col("chart")]
    x_score = F.when(F.col("x_role") == "Time", 0.14).when(low, 0.08).otherwise(-0.04)
    x_impact = F.when(F.col("x_role") == "Time", 0.08).when(low, 0.04).otherwise(0.0)
    value = base(0) + 0.18 * coverage + 0.22 * share + x_score + F.when(summed, 0.05).otherwise(0.0)
    weight = base(1) + 0.3 * share + 0.15 * coverage + x_impact
    unit = lambda c: coerce.rnd(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 3)
    reasons = F.array(
        F.when(coverage >= 0.95, "the measure is almost complete"), F.when(share >= 0.5, "the measure takes many values"),
        F.when(F.col("x_role") == "Time", "the axis is time"), F.when(low, "the axis has few values"),
        F.when(summed, "rows are summarised"),
    )
    criteria = F.slice(F.filter(reasons, lambda r: r.isNotNull()), 1, 5)
    return both.withColumns({"score": unit(value), "impact": unit(weight), "criteria": criteria}).select(*found.columns, "score", "impact", "criteria")


def recommend(profiles: DataFrame, compat: bool = False) -> DataFrame:
    """At most twelve charts for each table, best first: ``table, rank, chart, x, y, agg, bin, score, impact``."""
    spark = profiles.sparkSession
    # A row for each column of each table, as many as the schemas hold: it is looked up several times, profiled once.
    known = spark.createDataFrame(roles(profiles, compat).toArrow())
    scored = score(candidates(known), known)
    rank = F.row_number().over(Window.partitionBy("table").orderBy(F.desc("score"), F.desc("impact"), F.asc("generation")))
    bars = F.row_number().over(Window.partitionBy("table", "chart").orderBy("generation"))
    kept = scored.withColumn("b", bars).where((F.col("chart") != "bar") | (F.col("b") <= BARS)).drop("b")
    return kept.withColumn("rank", rank).where(F.col("rank") <= KEPT).drop("generation")


def choose(recommended: DataFrame, chart: str | None = None, min_score: float = 0.0, text: str | None = None, order: str = "score") -> DataFrame:
    """Recommendations of a type, from a score, or with a text in an axis, ordered by score, impact or chart."""
    out = recommended.where(F.col("score") >= min_score)
    out = out.where(F.col("chart") == chart) if chart else out
    out = out.where(F.lower(F.concat_ws(" ", "x", "y")).contains(text.lower())) if text else out
    first = F.asc("chart") if order == "chart" else F.desc(order)
    return out.orderBy(first, "table", "rank")
