"""Baseline forecasts of series, with a band from the method's own past errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autobi.functions import coerce
from autobi.operators import charts, signals

METHODS = ("naive", "moving_average", "linear")
#: Standard deviations on each side of a forecast.
BAND = 1.64


def _errors(found: DataFrame, by: list[str]) -> DataFrame:
    return found.groupBy(*by).agg(F.stddev_pop("e").alias("residual_std"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))


def _model(df: DataFrame, method: str, by: list[str], window: int) -> DataFrame:
    """One row for each series: last x, number of points, error figures and what the forecast needs."""
    rows = signals.points(df, by)
    figures = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("x").alias("last_x"), F.max_by("y", "x").alias("last_y"), F.coalesce(F.regr_slope("y", "i"), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept("y", "i"), F.avg("y")).alias("intercept"))
    join = lambda a, b: a.join(b, by) if by else a.join(F.broadcast(b))  # noqa: E731  one row without series
    if method == "naive":
        errors = rows.withColumn("e", F.col("y") - F.lag("y").over(charts.over(by, "x")))
        return join(figures, _errors(errors, by))
    if method == "linear":
        errors = join(rows.drop("n"), figures).withColumn("e", F.col("y") - (F.col("intercept") + F.col("slope") * F.col("i")))
        return join(figures, _errors(errors, by))
    sized = join(rows, figures.select(*by, "n", F.greatest(F.lit(2), F.least(F.lit(max(2, window)), F.lit(15), F.col("n") - 1)).cast("int").alias("w")))
    behind = F.array(*[F.lag("y", k).over(charts.over(by, "x")) for k in range(1, 16)])
    trailing = sized.withColumn("before", F.slice(behind, 1, F.col("w")))
    mean = F.aggregate("before", F.lit(0.0), lambda a, v: a + v) / F.col("w")
    errors = trailing.withColumn("e", F.when(F.col("i") >= F.col("w"), F.col("y") - mean))
    last = sized.where(F.col("i") >= F.col("n") - F.col("w")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "y"))).alias("tail"), F.first("w").alias("w"))
    last = last.withColumn("tail", F.transform("tail", lambda t: t["y"]))  # at most 15 values
    return join(join(figures, _errors(errors, by)), last)


def forecast(df: DataFrame, method: str = "naive", horizon: int | None = None, bin: str = "day", by: Sequence[str] = (), window: int = 5) -> DataFrame:
    """``(by…, step, x, forecast, lower, upper, residual_std, rmse)`` for 7 to 90 steps (30 unless asked).

    naive repeats the last value; moving_average the mean of the last values, forecasts included; linear extends
    the least-squares line. Series of fewer than 2 points have no forecast.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    by, horizon = list(by), min(90, max(7, horizon or 30))
    model = _model(df, method, by, window).where("n >= 2")
    if method == "moving_average":
        start = F.struct(F.col("tail").alias("tail"), F.array().cast("array<double>").alias("out"))

        def step(state, _):
            tail = state["tail"]
            value = F.aggregate(tail, F.lit(0.0), lambda a, v: a + v) / F.size(tail)
            return F.struct(F.concat(F.slice(tail, F.lit(2), F.size(tail) - 1), F.array(value)).alias("tail"), F.concat(state["out"], F.array(value)).alias("out"))

        values = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda s: s["out"])
        rows = model.select("*", F.posexplode(values).alias("k", "forecast")).withColumn("step", F.col("k") + 1)
    else:
        rows = model.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
        line = F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))
        rows = rows.withColumn("forecast", F.col("last_y") if method == "naive" else line)
    half = BAND * F.coalesce("residual_std", F.lit(0.0))
    return rows.select(*by, "step", coerce.next_bin(F.col("last_x"), bin, F.col("step")).alias("x"), "forecast", (F.col("forecast") - half).alias("lower"), (F.col("forecast") + half).alias("upper"), F.coalesce("residual_std", F.lit(0.0)).alias("residual_std"), F.coalesce("rmse", F.lit(0.0)).alias("rmse"))
