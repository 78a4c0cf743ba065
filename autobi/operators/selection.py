"""Exact quantiles in bounded memory.

A sketch of fixed size gives, for each level, two values between which the wanted ranks must lie. A second pass counts
what is below the lower one and, of the few values between the two, each distinct one; a running sum over those finds
the values at the ranks. No buffer holds the values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from autobi.functions import coerce

#: A sketch with this accuracy misplaces a value by at most one rank in so many.
ACCURACY = 2000
def selected(df: DataFrame, col: str, levels: dict[str, float], by: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """``(by..., levels...)``: interpolated quantiles of a measure, exactly as a sort would give them.

    Groups without values have no row. The input is read twice; about ``6 / accuracy`` of a group's values lie between
    its limits, and a group of at most ``4 * accuracy`` values has none. The sketch's bound on ranks guarantees that the
    limits hold the ranks; should they not, the query fails rather than give another value.
    """
    by = list(by)
    rows = df.select(*by, coerce.num(df, col).alias("v")).where("v is not null and not isnan(v)")
    near = 3.0 / accuracy
    cuts = [c for q in levels.values() for c in (max(0.0, q - near), min(1.0, q + near))]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(*map(F.lit, cuts)), F.lit(accuracy)).alias("c")).where("n > 0")
    few = F.col("n") <= 4 * accuracy
    lo, hi = (lambda k: F.when(few, float("-inf")).otherwise(F.col("c")[2 * k])), (lambda k: F.when(few, float("inf")).otherwise(F.col("c")[2 * k + 1]))
    limits = sketch.select(*[F.col(k).alias(f"__{k}") for k in by], "n", F.array(*[F.struct(F.lit(k).alias("level"), (F.lit(q) * (F.col("n") - 1)).alias("at"), lo(k).alias("lo"), hi(k).alias("hi")) for k, q in enumerate(levels.values())]).alias("limits"))
    same = [rows[k].eqNullSafe(limits[f"__{k}"]) for k in by]  # null keys are groups too
    met = (rows.join(limits, same) if by else rows.join(F.broadcast(limits))).drop(*[f"__{k}" for k in by])  # without groups one row
    place = F.transform("limits", lambda b: F.struct(b["level"].alias("level"), b["at"].alias("at"), F.when(F.col("v") >= b["lo"], F.col("v")).alias("v"), (F.col("v") <= b["hi"]).alias("in")))
    inside = met.select(*by, F.explode(F.filter(place, lambda p: p["in"])).alias("p")).select(*by, "p.level", "p.at", "p.v")
    counts = inside.groupBy(*by, "level", "at", "v").agg(F.count("*").alias("c"))  # null: all that lies below
    upto = F.sum("c").over(Window.partitionBy(*by, "level", "at").orderBy(F.asc_nulls_first("v")))
    summed = counts.withColumn("upto", upto).withColumn("first", F.col("upto") - F.col("c"))
    holds = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank < F.col("upto")), F.col("v")))
    found = summed.groupBy(*by, "level", "at").agg(holds(F.floor("at")).alias("a"), holds(F.ceil("at")).alias("b"))
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    value = F.when(known, F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).otherwise(F.raise_error(F.lit("limits that do not hold the rank")).cast("double"))
    made = [F.max(F.when(F.col("level") == k, value)).alias(name) for k, name in enumerate(levels)]
    return found.groupBy(*by).agg(*made) if by else found.agg(*made).where(F.col(next(iter(levels))).isNotNull())
