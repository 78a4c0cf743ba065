"""Descriptions of charts, filters and what-if steps, checked when they are made."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

OPERATORS = ("eq", "not_eq", "gt", "gte", "lt", "lte", "in", "between", "contains")
AGGREGATIONS = ("sum", "avg", "count", "min", "max")
CHARTS = ("line", "bar", "scatter", "histogram")


@dataclass(frozen=True)
class Filter:
    """One condition; ``connector`` joins it to those before it."""

    column: str
    op: str
    values: tuple
    connector: str = "and"

    def __post_init__(self):
        values = self.values if isinstance(self.values, (tuple, list)) else (self.values,)
        object.__setattr__(self, "values", tuple(values))
        if self.op not in OPERATORS:
            raise ValueError(f"operator must be one of {OPERATORS}")
        if self.connector not in ("and", "or"):
            raise ValueError("connector must be and or or")
        if self.op == "between" and len(self.values) % 2:
            raise ValueError("between takes pairs of values")
        if self.op not in ("in", "between") and len(self.values) > 1:
            raise ValueError(f"{self.op} takes one value")


@dataclass(frozen=True)
class QuerySpec:
    """A chart: what is on its axes, how it is aggregated, and which rows it shows."""

    chart: str
    x: str
    y: str | None = None
    bin: str = "day"
    agg: str = "sum"
    series: str | None = None
    top_n: int = 20
    bins: int = 20
    filters: tuple[Filter, ...] = ()

    def __post_init__(self):
        if self.chart not in CHARTS or self.agg not in AGGREGATIONS:
            raise ValueError(f"chart must be one of {CHARTS}, agg one of {AGGREGATIONS}")
        if self.chart != "histogram" and self.y is None and self.agg != "count":
            raise ValueError("this chart needs a y column")

    def replace(self, **changes) -> QuerySpec:
        """The chart with some of its parts overridden; x only of scatter charts and histograms."""
        if "x" in changes and changes["x"] != self.x and self.chart not in ("scatter", "histogram"):
            raise ValueError("x can be overridden for scatter charts and histograms only")
        return dataclasses.replace(self, **changes)


@dataclass(frozen=True)
class Step:
    """A what-if step: multiply(value), add(value), clamp(low, high), remove(column, values)."""

    kind: str
    value: float | None = None
    low: float | None = None
    high: float | None = None
    column: str | None = None
    values: tuple = ()

    def __post_init__(self):
        if self.kind not in ("multiply", "add", "clamp", "remove"):
            raise ValueError("unknown step")
        if self.kind in ("multiply", "add") and self.value is None:
            raise ValueError(f"{self.kind} needs a value")
        if self.kind == "clamp" and self.low is None and self.high is None:
            raise ValueError("clamp needs a side")
        if self.kind == "remove" and not self.values:
            raise ValueError("remove needs values")
