"""Parsing and formatting of values as Column functions.

Typed columns are used as they are, so filters on them still reach the file scan; only text is parsed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What text must look like for a number to be left of it without marks, and for any of the date patterns: one cheap test before many.
NUMBER_LIKE = r"^[-+0-9., eE\n\r\x{85}\x{2028}\x{2029}]++$"
DATE_LIKE = r"^\s*[0-9]{4}[-/][0-9]{1,2}[-/][0-9]|^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}$|^[0-9]{8}$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Words that count as truth values, and date patterns in order of preference.
BOOL_WORDS = ["true", "false", "yes", "no", "1", "0", "t", "f", "y", "n", "sim", "não", "nao"]
DATE_PATTERNS = ["yyyyMMdd", "d/M/yyyy", "yyyy-M-d", "M/d/yyyy"]
DATE_WORD_PATTERNS = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "M-d-yyyy", "yyyyMMdd"]
BINS = ("day", "week", "month", "quarter", "year")


def field(df: DataFrame, name: str) -> T.StructField:
    """The field of that name, in any letter case."""
    found = [f for f in df.schema.fields if f.name == name] or [f for f in df.schema.fields if f.name.lower() == name.lower()]
    if not found:
        raise ValueError(f"no column {name!r}; there are {df.columns}")
    return found[0]


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(field(df, name).dataType, T.NumericType)


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(field(df, name).dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def text_num(text: Column, strict: bool = False) -> Column:
    """Text without thousands marks as double. Not a number: null, or an error if strict."""
    bare = F.trim(F.replace(text, F.lit(","), F.lit("")))
    good = bare.rlike(NUMBER)
    value = F.when(good, bare.cast("double"))
    return F.when(text.isNull() | good, value).otherwise(F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")) if strict else value


def num(df: DataFrame, name: str, strict: bool = False) -> Column:
    """A column as double."""
    f = field(df, name)
    return text_num(df[f.name], strict) if isinstance(f.dataType, T.StringType) else df[f.name].cast("double")


def text_ts(text: Column, patterns: list[str] = DATE_PATTERNS) -> Column:
    """Text as timestamp: year-first forms, then the patterns (day before month). Years and times alone are null."""
    year_first = F.when(text.rlike(r"^\s*[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"), F.replace(text, F.lit("/"), F.lit("-")).try_cast("timestamp_ntz"))
    return F.coalesce(year_first, *[F.when(text.rlike(_form(p)), F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz")) for p in patterns])


def _form(pattern: str) -> str:
    """What text of a date pattern looks like; a parser that fails is far slower than this test."""
    for part, digits in (("yyyy", "[0-9]{4}"), ("MM", "(0[1-9]|1[0-2])"), ("dd", "(0[1-9]|[12][0-9]|3[01])"), ("M", "[0-9]{1,2}")):
        pattern = pattern.replace(part, digits)
    return f"^{re.sub('d(?![0-9{])', '[0-9]{1,2}', pattern)}$"


def ts(df: DataFrame, name: str) -> Column:
    """A column as timestamp without time zone."""
    f = field(df, name)
    return text_ts(df[f.name]) if isinstance(f.dataType, T.StringType) else df[f.name].cast("timestamp_ntz")


def label(df: DataFrame, name: str) -> Column:
    return df[field(df, name).name].cast("string")


def is_blank(col: Column) -> Column:
    return F.coalesce(F.trim(col.cast("string")), F.lit("")) == ""


def time_bin(col: Column, bin: str) -> Column:
    """Start of the day, week (Monday), month, quarter or year."""
    if bin.lower() not in BINS:
        raise ValueError(f"bin must be one of {BINS}")
    return F.date_trunc(bin.lower(), col).cast("timestamp_ntz")


def interval(bin: str, count: int = 1) -> Column:
    unit = {"day": "days", "week": "weeks", "month": "months", "quarter": "months", "year": "years"}[bin.lower()]
    return F.expr(f"make_interval({', '.join(str(count * (3 if bin.lower() == 'quarter' else 1)) if u == unit else '0' for u in ('years', 'months', 'weeks', 'days'))})")


def next_bin(col: Column, bin: str, steps: Column) -> Column:
    """The start of a bin some steps on (month ends stay within their month)."""
    unit = {"day": "DAY", "week": "WEEK", "month": "MONTH", "quarter": "QUARTER", "year": "YEAR"}[bin.lower()]
    return F.timestamp_add(unit, steps.cast("int"), col).cast("timestamp_ntz")


def epoch_ms(col: Column) -> Column:
    return F.unix_millis(col.cast("timestamp"))


def epoch_s(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp")) / 1e6


def ts_from_number(col: Column) -> Column:
    """A number as timestamp by size: over 1e10 milliseconds, over 1e9 seconds, else null."""
    value = col.cast("double")
    made = F.when(value > 1e10, F.timestamp_millis(value.cast("long"))).when(value > 1e9, F.timestamp_seconds(value.cast("long")))
    return made.cast("timestamp_ntz")


def looks_like_date(col: Column) -> Column:
    return col.rlike("[-/]") | col.rlike("^[0-9]{8}$")


def is_bool_word(col: Column) -> Column:
    return (F.octet_length(F.trim(col)) <= 20) & F.lower(F.trim(col)).isin(BOOL_WORDS)  # no word has more than 5 characters


def is_number_word(col: Column) -> Column:
    return may_be_number(col) & F.regexp_replace(col, "[, ]", "").rlike(NUMBER)


def may_be_number(col: Column) -> Column:
    """False for text that is no number however its commas and blanks are taken; ends at the first other character."""
    return col.rlike(NUMBER_LIKE)


def is_date_word(col: Column) -> Column:
    return F.trim(col).rlike(DATE_LIKE) & text_ts(F.trim(col), DATE_WORD_PATTERNS).isNotNull()


def clamp(col: Column, low: float | None = None, high: float | None = None) -> Column:
    col = col if low is None else F.greatest(col, F.lit(float(low)))
    return col if high is None else F.least(col, F.lit(float(high)))


def pct_change(base: Column, new: Column) -> Column:
    """Percent change; null where the base is about zero."""
    return F.when(F.abs(base) >= 1e-7, (new - base) / F.abs(base) * 100)


def rnd(col: Column, digits: int) -> Column:
    """Rounding with ties to the even digit."""
    return F.bround(col, digits)


def fmt(col: Column, digits: int = 2, trim: bool = False, percent: bool = False) -> Column:
    """A number as text with so many digits after the point; optionally without trailing zeros, or as percent."""
    text = F.format_string(f"%.{digits}f", (col * 100 if percent else col).cast("double"))
    if trim and digits:
        text = F.regexp_replace(text, r"\.?0+$", "")
    return F.concat(text, F.lit("%")) if percent else text


def evidence_id(col: Column) -> Column:
    """Upper case with ``_`` for all but letters and digits; blank: UNKNOWN."""
    return F.when(is_blank(col), "UNKNOWN").otherwise(F.regexp_replace(F.upper(F.trim(col)), r"[^\p{L}\p{N}]", "_"))


def parse_range(col: Column) -> Column:
    """A label ``[a, b)`` or ``a - b`` as struct (lo, hi), the smaller first."""
    number = r"([+-]?[0-9]+(?:\.[0-9]+)?)"
    form = rf"^\s*[\[(]?\s*{number}\s*(?:,|\s-\s)\s*{number}\s*[\])]?\s*$"
    a, b = (text_num(F.regexp_extract(col, form, k)) for k in (1, 2))
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def row_hash(*cols: Column) -> Column:
    """SHA-256 of the columns' texts, each led by its length and a colon; a null is a minus sign."""
    parts = [F.coalesce(F.concat(F.char_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cols]
    return F.sha2(F.concat(*parts), 256)
