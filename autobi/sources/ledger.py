"""Typed ingest that keeps account of every row: typed rows, and rejects with column, text and reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autobi.functions import coerce
from autobi.operators.profile import profile
from autobi.sources import tables
from autobi.sources.dialect import Dialect, detect

BROKEN = "__broken"
REJECTS = "array<struct<column:string,text:string,reason:string>>"


@dataclass(frozen=True)
class Ingest:
    """What an ingest made: ``rows`` (typed, with ``row_id``), ``rejects(row_id, column, text, reason)``, a line for each
    value or row that does not fit, the columns lifted to text, and where it lies."""

    rows: DataFrame
    rejects: DataFrame
    lifted: tuple[str, ...]
    path: str

    def summary(self) -> DataFrame:
        """One row: ``rows_in``, ``rows``, ``rejected`` rows and ``reasons`` given for them."""
        kept = self.rows.agg(F.count("*").alias("rows"))
        out = self.rejects.agg(F.count_distinct("row_id").alias("rejected"), F.count("*").alias("reasons"))
        return kept.join(F.broadcast(out)).select((F.col("rows") + F.col("rejected")).alias("rows_in"), "rows", "rejected", "reasons")  # one row each


def conversions(df: DataFrame, kinds: dict[str, str]) -> dict[str, Column]:
    """For each text column with an inferred type, its typed value (null where the text does not fit)."""
    truth = lambda n: F.when(coerce.is_bool_word(df[n]), F.lower(F.trim(df[n])).isin(tables.TRUE_WORDS))
    make = {"Number": lambda n: coerce.num(df, n), "Date": lambda n: coerce.ts(df, n), "Boolean": truth}
    return {n: make[k](n) for n, k in kinds.items() if k in make}


def _fails(df: DataFrame, name: str, typed: Column) -> Column:
    return ~coerce.is_blank(df[name]) & typed.isNull()


def ingest(spark: SparkSession, path: str, out: str, dialect: Dialect | None = None, limit: float = 0.01, mode: str = "errorifexists") -> Ingest:
    """Write a CSV file as a typed Parquet table at ``out`` with an account of what did not fit.

    A row of the wrong width, or with a value that does not fit its column's type, is a reject and stays whole in the
    table's rejected part, so rows in are rows out and rejects. A column of which more than ``limit`` of the filled
    values do not fit is lifted to text instead. ``row_id`` counts all rows of the input from 1 in file order. The
    input is read for its profile, for misfits, for the numbers of rows by split, and for the one write.
    """
    dialect = dialect or detect(spark, path)
    raw = tables.scan_csv(spark, path, tolerant=True, dialect=dialect, broken=BROKEN)
    names = [c for c in raw.columns if c != BROKEN]
    whole = raw.where(F.col(BROKEN).isNull())
    kinds = {r.column: r.inferred_type for r in profile(whole.select(names), exact=False).collect()}  # one row for each column
    typed = conversions(raw, kinds)
    lifted: tuple[str, ...] = ()
    if typed:
        counts = whole.agg(*[F.count_if(_fails(raw, n, c)).alias(f"x{k}") for k, (n, c) in enumerate(typed.items())], *[F.count_if(~coerce.is_blank(raw[n])).alias(f"n{k}") for k, n in enumerate(typed)]).first()
        lifted = tuple(n for k, n in enumerate(typed) if counts[f"x{k}"] > limit * counts[f"n{k}"])
    numbered = tables.with_row_number(raw)
    typed = conversions(numbered, {n: k for n, k in kinds.items() if n not in lifted})
    broken = numbered[BROKEN].isNotNull()
    reasons = [F.when(broken, _reason(F.lit(None).cast("string"), numbered[BROKEN], F.lit("width")))]
    reasons += [F.when(~broken & _fails(numbered, n, c), _reason(F.lit(n), numbered[n], F.lit(f"not a {kinds[n].lower()}"))) for n, c in typed.items()]
    rejects = F.filter(F.array(*reasons), lambda r: r.isNotNull()).cast(REJECTS)
    columns = [(F.when(~coerce.is_blank(numbered[n]), typed[n]) if n in typed else numbered[n]).alias(n) for n in names]
    staged = numbered.select("row_id", *columns, rejects.alias("__rejects")).withColumn("__rejected", F.size("__rejects") > 0)
    staged.write.mode(mode).partitionBy("__rejected").parquet(out)
    table = spark.read.schema(T.StructType([*staged.schema.fields])).parquet(out)
    bad = table.where("__rejected").select("row_id", F.explode("__rejects").alias("r")).select("row_id", "r.column", "r.text", "r.reason")
    return Ingest(table.where("not __rejected").drop("__rejects", "__rejected"), bad, lifted, out)


def _reason(column: Column, text: Column, reason: Column) -> Column:
    return F.struct(column.alias("column"), text.alias("text"), reason.alias("reason"))
