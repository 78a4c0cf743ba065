"""Detection of a CSV file's delimiter, quote and header from a bounded sample of its lines."""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from autobi.functions.coerce import BOOL_WORDS, NUMBER

DELIMITERS, QUOTES = (",", ";", "\t", "|"), ('"', "'")
#: Lines that a detection reads, and the characters of each of them.
LINES, LONGEST = 1000, 20_000
DATE = re.compile(r"^[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}([ T].*)?$|^(19|20)[0-9]{6}$")
NUMERIC = re.compile(NUMBER)
NAME = re.compile(r"^[^\W\d][\w .,()/%$#&+-]*$")


@dataclass(frozen=True)
class Dialect:
    """How a CSV file is written. Without a header the columns are ``c0``, ``c1``, and so on."""

    delimiter: str = ","
    quote: str = '"'
    header: bool = True
    columns: tuple[str, ...] = ()


def kind(cell: str) -> str:
    """What a cell looks like: blank, number, date, truth or text."""
    cell = cell.strip()
    if not cell:
        return "blank"
    if NUMERIC.match(cell.replace(",", "").replace(" ", "")) and not DATE.match(cell):
        return "number"
    if DATE.match(cell):
        return "date"
    return "truth" if cell.lower() in BOOL_WORDS else "text"


def cut(lines: Sequence[str], delimiter: str, quote: str) -> list[list[str]]:
    return [row for row in csv.reader(lines, delimiter=delimiter, quotechar=quote) if row]


def score(rows: list[list[str]]) -> float:
    """How well rows fit a table: equal widths, columns of one kind, no quotes left around or within cells."""
    if not rows:
        return 0.0
    width, fits = Counter(map(len, rows)).most_common(1)[0]
    even = fits / len(rows)
    if width == 1:
        return 0.1 * even
    body = [r for r in rows[1:] if len(r) == width] or [r for r in rows if len(r) == width]
    pure = []
    for column in zip(*body):
        kinds = Counter(k for k in map(kind, column) if k != "blank")
        usual, count = kinds.most_common(1)[0] if kinds else ("blank", 0)
        pure.append((0.9 if usual == "text" else 1.0) * count / sum(kinds.values()) if kinds else 0.9)  # anything is text
    cells = [c.strip() for r in body for c in r]
    left = sum(1 for c in cells if c[:1] in QUOTES or (c[-1:] in QUOTES and c)) / max(1, len(cells))
    return even**2 * (0.5 + 0.5 * sum(pure) / width) * (1 - left)


def has_header(rows: list[list[str]]) -> bool:
    """Whether the first row names the columns: distinct names unlike what stands below them."""
    first, body = [c.strip() for c in rows[0]], [r for r in rows[1:] if len(r) == len(rows[0])]
    if not all(first) or len(set(first)) < len(first) or any(kind(c) in ("number", "date") for c in first):
        return False
    if not body:
        return True
    for place, column in enumerate(zip(*body)):
        kinds = Counter(k for k in map(kind, column) if k != "blank")
        if kinds and kinds.most_common(1)[0][0] != "text" and kind(first[place]) == "text":
            return True
    again = any(first[place] in map(str.strip, column) for place, column in enumerate(zip(*body)))
    return not again and all(NAME.match(c) for c in first)


def names(row: list[str], header: bool) -> tuple[str, ...]:
    """Column names, blank ones by their place, repeated ones with a number."""
    found: list[str] = []
    for place, name in enumerate(row):
        name = (name.strip() if header else "") or f"c{place}"
        base, k = name, 2
        while name.lower() in {f.lower() for f in found}:
            name, k = f"{base}_{k}", k + 1
        found.append(name)
    return tuple(found)


def of_lines(lines: Sequence[str]) -> Dialect:
    """The dialect that fits a sample of lines best; of equal ones the first of ``DELIMITERS`` and ``QUOTES``."""
    lines = [line for line in lines if line.strip()]
    if not lines:
        return Dialect()
    found = []
    for delimiter in DELIMITERS:
        for quote in QUOTES:
            try:
                rows = cut(lines, delimiter, quote)
            except csv.Error:
                continue
            found.append((score(rows), delimiter, quote, rows))
    _, delimiter, quote, rows = max(found, key=lambda f: f[0])
    width = Counter(map(len, rows)).most_common(1)[0][0]
    rows = [r for k, r in enumerate(rows) if k == 0 or len(r) == width]
    if len(rows[0]) != width:  # the first row is broken or a title: the table starts below
        rows = rows[1:]
        return Dialect(delimiter, quote, False, names(rows[0], False))
    header = has_header(rows)
    return Dialect(delimiter, quote, header, names(rows[0], header))


def detect(spark: SparkSession, path: str, lines: int = LINES) -> Dialect:
    """The dialect of a CSV file or folder, from at most ``lines`` lines of its first file."""
    rows = spark.read.text(path).limit(lines).collect()  # bounded: so many lines, cut below
    return of_lines([r.value[:LONGEST].removeprefix("﻿") for r in rows])
