import datetime as dt
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from autobi.functions import coerce
from autobi.operators import browse, charts, evidence, filters, forecast, percentiles, profile, questions, recommend, redact, signals, whatif
from autobi.plans.spec import Filter, QuerySpec, Step
from tests.helpers import day, rows, series

SALES = [("20240101", "15234.50", "North"), ("20240102", "18000", "South"), ("20240103", "1,000.5", "North"), ("20240105", "x", "East"), ("20240108", "25432.10", "North")]


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(SALES, "date string, sales string, region string")


@pytest.fixture
def journey(spark):
    found = [(100, "North", "A"), (150, "North", "A"), (210, "South", "B"), (130, "South", "A"), (170, "North", "B"), (190, "West", "C"), (200, "West", "C")]
    return spark.createDataFrame([(day(k), float(s), r, c) for k, (s, r, c) in enumerate(found)], "date timestamp_ntz, sales double, region string, category string")


# filters


def test_filter_kinds(spark, journey):
    def n(*f):
        return filters.apply(journey, f).count()

    assert n(Filter("region", "eq", ("North",))) == 3
    assert n(Filter("REGION", "not_eq", ("North",))) == 4
    assert n(Filter("sales", "between", (100, 130, 200, 220))) == 4
    assert n(Filter("region", "in", ("West", "South"))) == 4
    assert n(Filter("region", "contains", ("OUT",))) == 2
    assert n(Filter("date", "gte", ("2024-01-06",))) == 2
    assert n(Filter("sales", "gt", (190,)), Filter("region", "eq", ("North",), "or")) == 5
    assert n(Filter("region", "in", ())) == 7


def test_filter_on_text_numbers_and_dates(sales):
    assert filters.apply(sales, [Filter("sales", "gt", (16000,))]).count() == 2
    assert filters.apply(sales, [Filter("date", "lt", ("2024-01-03",))]).count() == 2


def test_filter_special_characters(spark):
    df = spark.createDataFrame([("50% off",), ("a\\b",), ("it's",), ("plain",)], "v string")
    assert rows(filters.apply(df, [Filter("v", "contains", ("\\",))])) == [("a\\b",)]
    assert rows(filters.apply(df, [Filter("v", "eq", ("it's",))])) == [("it's",)]
    assert filters.apply(df, [Filter("v", "contains", ("5_%",))]).count() == 1


def test_bad_filters():
    for args in (("a", "near", (1,)), ("a", "between", (1,)), ("a", "eq", (1, 2)), ("a", "eq", (1,), "xor")):
        with pytest.raises(ValueError):
            Filter(*args)


def test_drop_values_drops_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert rows(filters.drop_values(df, "v", ["a"])) == [("b",)]


def test_search_and_guard(journey):
    assert filters.search(journey, "nort").count() == 3
    assert rows(filters.guard_group_by(journey, "region")) == [(7, 3, True)]


def test_typed_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    df = filters.apply(spark.read.parquet(str(tmp_path / "t")), [Filter("id", "gt", (10,))])
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThan(id,10)" in plan and "Python" not in plan


# charts


def test_line_and_gaps(sales):
    points = charts.time_series(sales, "date", "sales")
    assert points.count() == 4  # one value is no number
    filled = charts.fill_gaps(points, "day")
    got = rows(filled.orderBy("x"))
    assert len(got) == 8 and [v for _, v in got].count(None) == 4
    assert [v for _, v in rows(charts.fill_gaps(points, "day", "zeros").orderBy("x"))].count(0.0) == 4
    ffill = [v for _, v in rows(charts.fill_gaps(points, "day", "ffill").orderBy("x"))]
    assert ffill[3:7] == [1000.5] * 4 and ffill[7] == 25432.10


def test_gap_limit(spark):
    df = series(spark, [1, 2]).withColumn("x", F.when(F.col("y") == 1, F.lit(dt.datetime(1, 1, 1))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="too many bins"):
        charts.fill_gaps(df, "day", value="y", most=1000).collect()


def test_series_and_many_measures(spark):
    df = spark.createDataFrame([(day(0), 1.0, 10.0, None), (day(0), 2.0, None, " "), (day(1), 3.0, 30.0, "a")], "x timestamp_ntz, p double, q double, g string")
    got = rows(charts.time_series(df, "x", "p", series="g").orderBy("x"))
    assert got == [("Unknown", day(0), 3.0), ("a", day(1), 3.0)]
    many = rows(charts.time_series(df, "x", ["p", "q"], agg="sum").orderBy("series", "x"))
    assert many == [("p", day(0), 3.0), ("p", day(1), 3.0), ("q", day(0), 10.0), ("q", day(1), 30.0)]


def test_downsampling(spark):
    df = series(spark, range(10))
    assert [y for _, _, y in rows(charts.stride(df, 4, ["series"]).orderBy("x"))] == [0, 3, 6, 9]
    got = [y for _, _, y in rows(charts.even_sample(df, 4, ["series"]).orderBy("x"))]
    assert got == [round(i * 9 / 3) for i in range(4)]
    assert charts.even_sample(df, 20, ["series"]).count() == 10
    big = series(spark, range(57))
    assert [int(y) for _, _, y in rows(charts.even_sample(big, 11, ["series"]).orderBy("x"))] == [round(i * 56 / 10) for i in range(11)]


def test_bars(journey, spark):
    assert rows(charts.bar(journey, "region", "sales")) == [("North", 420.0), ("West", 390.0), ("South", 340.0)]
    assert rows(charts.bar(journey, "region", "sales", "count", 2)) == [("North", 3), ("South", 2)]
    grouped = {(c, s): v for c, s, v in rows(charts.bar(journey, "region", "sales", series="category").select("category", "series", "value"))}
    assert len(grouped) == 9 and grouped["North", "C"] == 0.0 and grouped["West", "C"] == 390.0
    assert charts.bar(journey.limit(0), "region", "sales").count() == 0


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 9, 10)], "v double")
    got = rows(charts.histogram(df, "v", 5).orderBy("bin"))
    assert [r[3] for r in got] == [2, 1, 0, 0, 2] and got[-1][2] == 10.0
    assert [r[:4] for r in rows(charts.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v"))] == [(0, 3.0, 3.0, 4)]
    assert charts.histogram(df.limit(0), "v").count() == 0


def test_scatter_is_repeatable(spark):
    df = spark.range(500).select("id", (F.col("id") * 2).alias("v"))
    a, b = (sorted(rows(charts.scatter(df, "id", "v", 20, key="id"))) for _ in range(2))
    assert a == b and len(a) == 20


def test_drilldown_and_rows_behind(journey):
    spec = charts.drilldown(QuerySpec("histogram", "sales"), "[100, 150)")
    assert filters.apply(journey, spec.filters).count() == 3
    assert charts.rows_behind(journey, "region", "North").count() == 3
    assert charts.rows_behind(journey, "region", "nor").count() == 3
    assert charts.rows_behind(journey, "region", "zzz").count() == 0


def test_spec_overrides():
    spec = QuerySpec("line", "date", "sales")
    assert spec.replace(agg="avg", bin="month").agg == "avg"
    with pytest.raises(ValueError):
        spec.replace(x="other")
    with pytest.raises(ValueError):
        QuerySpec("pie", "a", "b")


# percentiles


def test_percentiles(journey):
    assert rows(percentiles.percentiles(journey, "sales", levels={"p50": 0.5, "p90": 0.9})) == [(170.0, pytest.approx(204.0))]
    assert percentiles.resolve_mode(journey, QuerySpec("bar", "region", "sales")) == "bucket"
    assert percentiles.resolve_mode(journey, QuerySpec("bar", "date", "sales")) == "overall"
    view = {r.category: r.percentile for r in percentiles.percentile_view(journey, QuerySpec("bar", "region", "sales"), 0.5).collect()}
    assert view == {"North": 150.0, "South": 170.0, "West": 195.0}
    assert {r.percentile for r in percentiles.percentile_view(journey, QuerySpec("bar", "region", "sales"), 0.5, "overall").collect()} == {170.0}


# what-if


def test_what_if(spark):
    df = spark.createDataFrame([("A", 100.0), ("A", 150.0), ("B", 80.0), ("B", 120.0)], "region string, sales double")
    got = rows(whatif.what_if(df, "sales", "region", "sum", [Step("multiply", 2)], limit=10))
    assert got == [("A", 250.0, 500.0, 250.0, 100.0), ("B", 200.0, 400.0, 200.0, 100.0)]
    gone = rows(whatif.what_if(df, "sales", "region", "sum", [Step("add", 10), Step("clamp", high=100), Step("remove", values=("B",))], limit=10))
    assert gone == [("A", 250.0, 200.0, -50.0, -20.0), ("B", 200.0, 0.0, -200.0, -100.0)]


def test_what_if_summaries(spark):
    both = spark.createDataFrame([("A", 100.0, 110.0, 10.0, 10.0), ("B", 120.0, 130.0, 10.0, 8.3333)], "dimension string, baseline double, simulated double, delta double, delta_percent double")
    s = whatif.what_if_summary(both).first()
    assert (s.mean_delta, s.sum_delta, s.max_delta, s.drivers) == (10.0, 20.0, 10.0, "A: 10.00; B: 10.00")
    assert whatif.delta_summary(both).first().changed == 2
    assert whatif.preset("plus_10")[0].value == 1.1
    with pytest.raises(ValueError):
        Step("divide")


def test_compare_keeps_one_sided_rows(spark):
    a = spark.createDataFrame([("x", 1.0)], "dimension string, value double")
    b = spark.createDataFrame([("y", 2.0)], "dimension string, value double")
    assert sorted(rows(whatif.compare(a, b).select("dimension", "delta"))) == [("x", -1.0), ("y", 2.0)]


# browser


def test_pages_and_stats(journey, sales):
    page = browse.browse(journey, number=2, size=3, rules=[("sales", "desc")], key="date")
    assert [r.sales for r in page.collect()] == ["170.0", "150.0", "130.0"]
    assert rows(browse.page_info(journey, 3)) == [(7, 3, False)]
    assert rows(browse.field_stats(sales, "date")) == [(5, 0, 5, 5, 5, "Number")]
    assert browse.field_stats(sales, "region").first().kind == "Category"
    assert rows(browse.top_values(journey, "region", 2)) == [("North", 3), ("South", 2)]
    assert rows(browse.with_others(browse.top_values(journey, "region", 2), browse.page_info(journey)))[-1] == ("Others", 2)
    assert rows(browse.with_others(browse.top_values(journey, "region", 5), browse.page_info(journey)))[-1] == ("West", 2)


def test_ranges(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    got = rows(browse.numeric_ranges(df, "v", 4, 8))
    assert sum(r[3] for r in got) == 100 and len(got) == 4
    assert browse.numeric_ranges(df.where("v < 5"), "v").count() == 0


def test_facets(journey):
    fs = [Filter("region", "eq", ("North",)), Filter("category", "eq", ("A",))]
    assert dict(rows(browse.facet_distinct(journey, fs, ["region", "category"]))) == {"region": 2, "category": 2}
    assert rows(browse.facet_values(journey, fs, "region")) == [("North", 2), ("South", 1)]


# profiles


def test_profile(sales, spark):
    got = {r.column: r for r in profile.profile(sales).collect()}
    assert got["date"].inferred_type == "Date" and got["region"].inferred_type == "Category"
    assert got["sales"].inferred_type == "Category"  # four of five are numbers
    odd = spark.createDataFrame([("yes", None, "1,5", 1, [1]), ("no", " ", "2", 2, [2])], "b string, e string, n string, t int, l array<int>")
    got = {r.column: r for r in profile.profile(odd).collect()}
    assert (got["b"].inferred_type, got["e"].inferred_type, got["n"].inferred_type, got["t"].inferred_type) == ("Boolean", "String", "Number", "Number")
    assert got["e"].null_rate == 1.0 and got["n"].max == 15.0 and "l" not in got
    assert profile.profile(odd.limit(0)).count() == 4
    assert rows(profile.profile_top_values(sales, 1).where("column = 'region'")) == [("region", "North", 3)]


def test_recommendations(spark):
    cols = [("created_at", "Date", 0.0, 300), ("amount", "Number", 0.0, 900), ("score", "Number", 0.1, 50), ("kind", "Category", 0.0, 4), ("row_id", "Number", 0.0, 1000), ("width", "Number", 0.0, 10)]
    df = spark.createDataFrame([("t", c, k, 1000, n, d, 0.0, 1.0) for c, k, n, d in cols], "table string, column string, inferred_type string, row_count long, null_rate double, distinct_count long, min double, max double")
    roles = {r.column: r.role for r in recommend.roles(df).collect()}
    assert roles == {"created_at": "Time", "amount": "Measure", "score": "Measure", "kind": "Category", "row_id": "Id", "width": "Measure"}
    assert {r.column: r.role for r in recommend.roles(df, compat=True).collect()}["width"] == "Id"
    got = recommend.recommend(df).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 9))
    assert (got[0].chart, got[0].x, got[0].y, got[0].score) == ("line", "created_at", "amount", round(0.52 + 0.18 + 0.22 * 0.9 + 0.14 + 0.05, 3) if 0.52 + 0.18 + 0.22 * 0.9 + 0.14 + 0.05 < 1 else 1.0)
    assert recommend.choose(recommend.recommend(df), chart="bar").count() == 2


# signals


def test_trend_and_volatility(spark):
    up = signals.signals(series(spark, [10, 12, 14, 16, 18, 20, 22, 24]), ["series"]).first()
    assert up.trend == "Up" and up.volatility in ("Low", "Medium") and up.confidence > 0.3
    assert signals.trend(series(spark, [100, 92, 85, 79, 74, 70, 67, 63, 60]), ["series"]).first().trend == "Down"
    assert signals.volatility(series(spark, [10, 80, 12, 95, 8, 120, 14, 110, 9]), ["series"]).first().volatility == "High"
    few = signals.signals(series(spark, [1, 2, 3]), ["series"]).first()
    assert (few.trend, few.volatility, few.outliers, few.seasonality, few.confidence) == ("Flat", "Medium", "None", "None", 0.2)


def test_outliers(spark):
    df = series(spark, [10, 11, 9, 12, 10, 11, 950, 10, 9])
    got = signals.outliers(df, ["series"]).first()
    assert (got.outliers, got.outlier_count) == ("Few", 1)
    assert [r.y for r in signals.outlier_rows(df, ["series"]).collect()] == [950.0]
    assert signals.outliers(series(spark, [5] * 20), ["series"]).first().outliers == "None"


def test_seasonality(spark):
    pattern = [120, 95, 105, 130, 115, 80, 70]
    df = series(spark, [pattern[k % 7] + k % 3 for k in range(84)])
    assert signals.seasonality(df, ["series"]).first().seasonality == "Strong"
    assert signals.seasonality(series(spark, pattern), ["series"]).first().seasonality == "None"


# evidence and forecasts


def test_change_points_against_a_loop(spark):
    import random

    random.seed(3)
    values = [random.random() + (5 if k > 25 else 0) for k in range(60)]
    w, n = max(3, min(20, 60 // 8)), 60
    shifts = sorted(((abs(sum(values[i : i + w]) / w - sum(values[i - w : i]) / w), -i) for i in range(w, n - w)), reverse=True)[:3]
    got = evidence.change_points(series(spark, values), ["series"]).orderBy("rank").collect()
    assert [r.x for r in got] == [day(-i) for _, i in shifts]
    assert [r.shift for r in got] == pytest.approx([s for s, _ in shifts])
    assert evidence.change_points(series(spark, values[:11]), ["series"]).count() == 0


def test_linear_series(spark):
    df = series(spark, [100 + 0.5 * i for i in range(90)])
    for method in forecast.METHODS:
        assert forecast.forecast(df, method, 10, "day", ["series"]).count() == 10
    got = forecast.forecast(df, "linear", 7, "day", ["series"]).orderBy("step").collect()
    assert got[0].forecast == pytest.approx(145.0) and got[0].residual_std == pytest.approx(0, abs=1e-9) and got[0].x == day(90)
    assert forecast.forecast(df, "naive", 500, "day", ["series"]).count() == 90
    assert forecast.forecast(series(spark, [1]), "linear", 7, "day", ["series"]).count() == 0


def test_moving_average_against_a_loop(spark):
    values = [3.0, 8, 1, 9, 4, 7, 2, 6]
    history = list(values)
    for _ in range(7):
        history.append(sum(history[-5:]) / 5)
    got = forecast.forecast(series(spark, values), "moving_average", 7, "day", ["series"]).orderBy("step").collect()
    assert [r.forecast for r in got] == pytest.approx(history[8:])


def test_quality_segments_facts(spark, sales, journey):
    q = evidence.quality(sales, "date", "sales").first()
    assert (q.rows, q.columns, q.unparsable_dates, q.negative_values) == (5, 3, 0, 0)
    seg = evidence.segment_breakdown(journey.select(F.col("region").alias("series"), F.col("sales").alias("y"))).orderBy("rank").collect()
    assert [s.segment for s in seg] == ["North", "West", "South"] and sum(s.share_percent for s in seg) == pytest.approx(100)
    assert {s.segment for s in evidence.segment_breakdown(journey.select(F.col("region").alias("series"), F.col("sales").alias("y")), sensitive=True).collect()} == {"segment"}
    facts = evidence.facts(evidence.distribution(journey.select(F.col("sales").alias("y"))), "DIST", ["mean", "stddev"], "metric")
    assert [r.evidence_id for r in facts.collect()] == ["DIST_MEAN_METRIC", "DIST_STDDEV_METRIC"]
    cites = spark.createDataFrame([("DIST_MEAN_METRIC",), ("DIST_MEAN_METRIC",), ("NOPE",)], "evidence_id string")
    assert rows(evidence.unknown_citations(cites, facts)) == [("NOPE",)]
    assert rows(evidence.citation_usage(cites, facts)) == [("DIST_MEAN_METRIC", 2)]


def test_redaction_and_intents(spark):
    df = spark.createDataFrame([(1, "a@b", (2, "x"))], "sales int, customer_email string, who struct<age:int,ssn:string>")
    assert redact.redact(df).schema.simpleString() == "struct<sales:int,who:struct<age:int>>"
    names = spark.createDataFrame([("sales",), ("customer_email",), (None,)], "name string")
    assert redact.redact_rows(names, "name").count() == 2
    texts = ["Show the TREND", "any anomaly?", "break it down", "hello", None]
    got = questions.classify_intent(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert [r.intent for r in got.collect()] == ["Trend", "Outliers", "Breakdown", "Compare", "Compare"]


# ---- text literals, hashes, plans


def brute_text_filter(values, op, literals):
    numbers = [Fraction(x.replace(",", "")) for x in literals]
    tests = {
        "eq": lambda v: v == numbers[0], "not_eq": lambda v: v != numbers[0], "gt": lambda v: v > numbers[0], "gte": lambda v: v >= numbers[0], "lt": lambda v: v < numbers[0], "lte": lambda v: v <= numbers[0],
        "in": lambda v: v in numbers, "between": lambda v: any(a <= v <= b for a, b in zip(numbers[::2], numbers[1::2])),
    }
    return [k for k, v in enumerate(values) if v is not None and tests[op](Fraction(v))]


@pytest.mark.parametrize("kind", ["tinyint", "int", "bigint", "decimal(10,2)", "decimal(4,0)"])
def test_text_literals_compare_exactly(spark, kind):
    if kind == "bigint":
        values = [None, 0, -1, 5, 2**53, 2**53 + 1, 2**63 - 1, -(2**63)]
    else:
        values = [None, *([0, -1, 5, 6, 7, 127, -128] if "decimal" not in kind else [Decimal("0"), Decimal("-1.25") if "2" in kind else Decimal(-1), Decimal(5), Decimal("5.01") if "2" in kind else Decimal(6)])]
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, v {kind}")
    literals = ["5", "5.5", "5.010", "-1.25", "-0.001", "9,007,199,254,740,992", "9007199254740993", "1e3", "99999999999999999999999", "-99999999999999999999999", "9223372036854775807", "-9223372036854775808", "-10000000000", "128"]
    for op in ("eq", "not_eq", "gt", "gte", "lt", "lte"):
        for x in literals:
            got = [r.k for r in filters.apply(rows, [Filter("v", op, (x,))]).select("k").collect()] if op in ("eq", "lt", "gte") or x in literals[:6] else None
            assert got is None or sorted(got) == brute_text_filter(values, op, [x]), (op, x)
    for op, x in (("in", ("5", "5.5", "-1")), ("between", ("4.5", "6.5", "-1.5", "-0.5"))):
        assert sorted(r.k for r in filters.apply(rows, [Filter("v", op, x)]).collect()) == brute_text_filter(values, op, x)


def test_text_literals_reach_the_scan(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    conditions = {
        "GreaterThan(l_orderkey,3000)": Filter("l_orderkey", "gt", ("3,000",)), "(l_linenumber": Filter("l_linenumber", "in", ("1", "3")),
        "LessThanOrEqual(l_quantity,10.5)": Filter("l_quantity", "lte", ("10.5",)), "GreaterThanOrEqual(l_shipdate": Filter("l_shipdate", "gte", ("1997-06-01",)),
    }
    for part, condition in conditions.items():
        plan = filters.apply(items, [condition])._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters") :].split("]")[0].replace("IsNotNull(", "")
        assert part in pushed, (part, pushed)


def test_row_hashes_tell_columns_apart(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("\\N", "c"), (None, "c"), ("", "c"), ("1:a", "c"), ("-", "c")], "a string, b string")
    assert rows.select(coerce.row_hash(F.col("a"), F.col("b"))).distinct().count() == 7


def test_profile_scans_a_table_twice(spark):
    plan = profile.profile(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Python" not in plan
