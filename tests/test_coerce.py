import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from autobi.functions import coerce
from tests.helpers import rows


def one(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(make(df)).collect()]


def test_numbers_from_text(spark):
    values = ["1,234.50", " 12 ", "1e3", "12d", "NaN", "inf", "", None, "-.5", "x"]
    assert one(spark, values, lambda df: coerce.num(df, "v")) == [1234.5, 12.0, 1000.0, None, None, None, None, None, -0.5, None]
    assert one(spark, [3, None], lambda df: coerce.num(df, "V"), "int") == [3.0, None]


def test_strict_numbers_fail(spark):
    with pytest.raises(PySparkException):
        one(spark, ["1", "x"], lambda df: coerce.num(df, "v", strict=True))
    assert one(spark, ["1,5", None], lambda df: coerce.num(df, "v", strict=True)) == [15.0, None]


def test_dates_from_text(spark):
    values = ["20240101", "31/12/2024", "12/31/2024", "1/2/2024", "2024/01/05", "2024-01-05 06:07:08", "2024", "13:45", "31/12/24", None]
    d = dt.datetime
    want = [d(2024, 1, 1), d(2024, 12, 31), d(2024, 12, 31), d(2024, 2, 1), d(2024, 1, 5), d(2024, 1, 5, 6, 7, 8), None, None, None, None]
    assert one(spark, values, lambda df: coerce.ts(df, "v")) == want


def test_bins_and_next_bins(spark):
    jan31 = dt.datetime(2024, 1, 31, 5)
    assert one(spark, [jan31], lambda df: coerce.time_bin(df.v, "week"), "timestamp_ntz") == [dt.datetime(2024, 1, 29)]
    assert one(spark, [jan31], lambda df: coerce.time_bin(df.v, "quarter"), "timestamp_ntz") == [dt.datetime(2024, 1, 1)]
    assert one(spark, [jan31], lambda df: coerce.next_bin(df.v, "month", F.lit(1)), "timestamp_ntz") == [dt.datetime(2024, 2, 29, 5)]
    with pytest.raises(ValueError):
        coerce.time_bin(F.lit(None), "minute")


def test_epochs(spark):
    stamp = dt.datetime(1970, 1, 2)
    assert one(spark, [stamp], lambda df: coerce.epoch_ms(df.v), "timestamp_ntz") == [86_400_000]
    assert one(spark, [1.7e12, 1.7e9, 5.0], lambda df: coerce.ts_from_number(df.v), "double") == [dt.datetime(2023, 11, 14, 22, 13, 20)] * 2 + [None]


def test_words(spark):
    assert one(spark, ["Yes", "sim", "2", "não"], lambda df: coerce.is_bool_word(df.v)) == [True, True, False, True]
    assert one(spark, ["1 000,5", "12d", "-1e5"], lambda df: coerce.is_number_word(df.v)) == [True, False, True]
    assert one(spark, ["2024-1-5", "5/1/2024", "x", "20240105"], lambda df: coerce.is_date_word(df.v)) == [True, True, False, True]
    assert one(spark, ["a-b", "20240101", "abc"], lambda df: coerce.looks_like_date(df.v)) == [True, True, False]
    assert one(spark, [" ", None, "a"], lambda df: coerce.is_blank(df.v)) == [True, True, False]


def test_arithmetic_and_text(spark):
    assert one(spark, [5.0, -1.0], lambda df: coerce.clamp(df.v, 0, 3), "double") == [3.0, 0.0]
    assert one(spark, [0.0, 50.0], lambda df: coerce.pct_change(df.v, F.lit(75.0)), "double") == [None, 50.0]
    assert one(spark, [2.5, 3.5], lambda df: coerce.rnd(df.v, 0), "double") == [2.0, 4.0]
    assert one(spark, [1.5, 2.0], lambda df: coerce.fmt(df.v, 4, trim=True), "double") == ["1.5", "2"]
    assert one(spark, [0.125], lambda df: coerce.fmt(df.v, 1, percent=True), "double") == ["12.5%"]
    assert one(spark, ["São Paulo-1", " ", None], lambda df: coerce.evidence_id(df.v)) == ["SÃO_PAULO_1", "UNKNOWN", "UNKNOWN"]
    assert [tuple(r) for r in one(spark, ["[1.5, 3)", "9 - 2", "x"], lambda df: coerce.parse_range(df.v))] == [(1.5, 3.0), (2.0, 9.0), (None, None)]
    assert len(set(one(spark, ["a", None, "\\N"], lambda df: coerce.row_hash(df.v, F.lit("x"))))) >= 2


def test_unknown_column(spark):
    with pytest.raises(ValueError):
        coerce.field(spark.range(1), "nope")
    df = spark.range(1)
    assert rows(df.select(coerce.num(df, "ID"))) == [(0.0,)]
