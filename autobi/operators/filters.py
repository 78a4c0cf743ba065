"""Row filters as conditions that reach the scan where the column is typed."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from decimal import ROUND_FLOOR, Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autobi.functions import coerce
from autobi.plans.spec import Filter

DATE = re.compile(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T].*)?$|\d{1,2}/\d{1,2}/\d{4}$")


def _number(value) -> Decimal | None:
    """The exact value of a number or of text that reads as one."""
    if isinstance(value, bool) or value is None:
        return None
    text = str(value).replace(",", "").strip()
    return Decimal(text) if re.match(coerce.NUMBER, text) else None


def _compare(f: T.StructField, column: Column, op: str, n: Decimal) -> Column:
    """A comparison with a number in the column's own type, so that it is exact and reaches the scan.

    What lies between two values of a whole-number or decimal column, or beyond them all, is compared by its neighbour.
    """
    if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType):
        value = F.lit(float(n))
        return {"eq": column == value, "not_eq": column != value, "gt": column > value, "gte": column >= value, "lt": column < value, "lte": column <= value}[op]
    if isinstance(f.dataType, T.DecimalType):
        scale, most = f.dataType.scale, Decimal(10) ** f.dataType.precision - 1
        low = -most
    else:
        scale, most = 0, Decimal(2 ** {"tinyint": 7, "smallint": 15, "int": 31}.get(f.dataType.simpleString(), 63) - 1)
        low = -most - 1
    with localcontext(prec=400):
        whole = (n.scaleb(scale)).to_integral_value(ROUND_FLOOR)
        between = whole != n.scaleb(scale)
    known = F.when(column.isNotNull(), F.lit(True))
    if whole > most or whole < low:
        return known if (op == "not_eq") or (op in ("lt", "lte")) == (whole > 0) and op != "eq" else ~known
    if between and op in ("eq", "not_eq"):
        return known if op == "not_eq" else ~known
    value = F.lit(int(whole) if not isinstance(f.dataType, T.DecimalType) else whole.scaleb(-scale)).cast(f.dataType)
    op = {"gte": "gt", "lt": "lte"}.get(op, op) if between else op
    return {"eq": column == value, "not_eq": column != value, "gt": column > value, "gte": column >= value, "lt": column < value, "lte": column <= value}[op]


def _typed(df: DataFrame, name: str, values: tuple) -> tuple[Column, list[Column]]:
    """The column and the literals in a common type: numbers in text, else dates, else text."""
    f = coerce.field(df, name)
    column, numbers = df[f.name], [_number(v) for v in values]
    if coerce.is_temporal(df, name) and all(DATE.match(str(v).strip()) or not isinstance(v, str) for v in values):
        literals = [coerce.text_ts(F.lit(v)) if isinstance(v, str) else F.lit(v).cast("timestamp_ntz") for v in values]
        return column, literals
    if isinstance(f.dataType, T.StringType):
        if None not in numbers:
            return coerce.num(df, name), [F.lit(float(n)) for n in numbers]
        if all(DATE.match(str(v).strip()) for v in values):
            return coerce.ts(df, name), [coerce.text_ts(F.lit(str(v))) for v in values]
        return column, [F.lit(str(v)) for v in values]
    return column.cast("string"), [F.lit(str(v)) for v in values]


def contains(column: Column, text: str) -> Column:
    """Substring in any letter case; ``%`` and ``_`` are wild, a backslash is itself."""
    return F.lower(column.cast("string")).like("%" + text.lower().replace("\\", "\\\\") + "%")


def predicate(df: DataFrame, f: Filter) -> Column:
    if f.op == "contains":
        return contains(coerce.label(df, f.column), str(f.values[0]))
    field, numbers = coerce.field(df, f.column), [_number(v) for v in f.values]
    if isinstance(field.dataType, T.NumericType) and numbers and None not in numbers:
        test = functools.partial(_compare, field, df[field.name])
        if f.op == "in":
            return functools.reduce(lambda a, b: a | b, [test("eq", n) for n in numbers])
        if f.op == "between":
            return functools.reduce(lambda a, b: a | b, [test("gte", a) & test("lte", b) for a, b in zip(numbers[::2], numbers[1::2])])
        return test(f.op, numbers[0])
    column, values = _typed(df, f.column, f.values)
    if f.op == "in":
        return column.isin(*values) if values else F.lit(False)
    if f.op == "between":
        ranges = [column.between(a, b) for a, b in zip(values[::2], values[1::2])]
        return functools.reduce(lambda a, b: a | b, ranges) if ranges else F.lit(False)
    v = values[0]
    return {"eq": column == v, "not_eq": column != v, "gt": column > v, "gte": column >= v, "lt": column < v, "lte": column <= v}[f.op]


def combine(df: DataFrame, filters: Iterable[Filter]) -> Column | None:
    """All filters from left to right, each joined by its own connector; those without values are skipped."""
    out: Column | None = None
    for f in filters:
        if not f.values:
            continue
        p = predicate(df, f)
        out = p if out is None else (out | p if f.connector == "or" else out & p)
    return out


def apply(df: DataFrame, filters: Iterable[Filter]) -> DataFrame:
    condition = combine(df, filters)
    return df if condition is None else df.where(condition)


def drop_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose value is none of these; null values go, too."""
    return df.where(~df[coerce.field(df, column).name].isin(*values))


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows in which the text of any column of single values holds the text."""
    kinds = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    tests = [F.coalesce(contains(df[f.name], text), F.lit(False)) for f in df.schema.fields if isinstance(f.dataType, kinds)]
    return df.where(functools.reduce(lambda a, b: a | b, tests)) if tests else df.where(F.lit(False))


def guard_group_by(df: DataFrame, column: str, limit: int = 50, sample_share: float = 0.05) -> DataFrame:
    """``(rows, distinct, allowed)``: whether a column has few enough values to group by."""
    name = coerce.field(df, column).name
    counted = df.agg(F.count("*").alias("rows"), F.count_distinct(name).alias("distinct"))
    most = F.least(F.lit(limit), F.greatest(F.lit(20), F.floor(F.col("rows") * sample_share)))
    return counted.withColumn("allowed", F.col("distinct") <= most)
