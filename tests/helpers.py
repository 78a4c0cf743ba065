import datetime as dt


def rows(df):
    return [tuple(r) for r in df.collect()]


def day(k, start=dt.datetime(2024, 1, 1)):
    return start + dt.timedelta(days=k)


def series(spark, values, start=dt.datetime(2024, 1, 1)):
    """(series, x, y), one point a day."""
    return spark.createDataFrame([("s", day(k, start), float(v)) for k, v in enumerate(values)], "series string, x timestamp_ntz, y double")
