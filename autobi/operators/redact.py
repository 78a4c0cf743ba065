"""Removal of sensitive fields by their names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parts of names that mark personal data.
PATTERNS = ("email", "mail", "phone", "mobile", "cpf", "ssn", "document", "address")


def sensitive(name: str, patterns: Sequence[str] = PATTERNS) -> bool:
    return any(p.lower() in name.lower() for p in patterns)


def _clean(column: Column, kind: T.StructType, patterns: Sequence[str]) -> Column | None:
    gone = [f.name for f in kind.fields if sensitive(f.name, patterns)]
    if len(gone) == len(kind.fields):
        return None
    column = column.dropFields(*gone) if gone else column
    for f in kind.fields:
        if f.name not in gone and isinstance(f.dataType, T.StructType):
            inner = _clean(column[f.name], f.dataType, patterns)
            column = column.dropFields(f.name) if inner is None else column.withField(f.name, inner)
    return column


def redact(df: DataFrame, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """The table without columns and struct fields whose name holds a pattern."""
    kept = []
    for f in df.schema.fields:
        if sensitive(f.name, patterns):
            continue
        column = _clean(df[f.name], f.dataType, patterns) if isinstance(f.dataType, T.StructType) else df[f.name]
        if column is not None:
            kept.append(column.alias(f.name))
    return df.select(kept)


def redact_rows(df: DataFrame, name_col: str, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """A long table without the rows that describe a sensitive column; rows without a name stay."""
    found = F.lower(F.col(name_col)).rlike("|".join(re.escape(p.lower()) for p in patterns))
    return df.where(~F.coalesce(found, F.lit(False)))
