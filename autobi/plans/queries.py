"""Queries over the given tables, each with equivalent SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autobi.functions import coerce
from autobi.operators import browse, charts, evidence, filters, forecast, percentiles, profile, questions, recommend, redact, signals, whatif
from autobi.plans.spec import Filter, QuerySpec, Step
from autobi.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 4):
    """Register a query on tables, its doubles rounded."""

    def add(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(make(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")), digits)

        run.__doc__ = make.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select([F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else df[f.name] for f in df.schema.fields])


# ---- time series -------------------------------------------------------------------------------------------


def line_sql(table: str, x: str, y: str, bin: str, agg: str, series: str | None = None, where: str = "TRUE") -> str:
    extra = f"coalesce(nullif(trim({series}), ''), 'Unknown') AS series, " if series else ""
    value = f"count({y})" if agg == "count" else f"round({agg}({y}), 4)"
    return f"SELECT {extra}date_trunc('{bin}', {x})::TIMESTAMP AS x, {value} AS value FROM {table} WHERE {where} AND {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL"


F_ORDERS = (Filter("o_orderstatus", "eq", ("F",)),)

query("line_orders_month_sum", line_sql("orders", "o_orderdate", "o_totalprice", "month", "sum", where="o_orderstatus = 'F'"))(lambda t: charts.time_series(t("orders"), "o_orderdate", "o_totalprice", "month", "sum", filters=F_ORDERS))
query("line_orders_week_avg", line_sql("orders", "o_orderdate", "o_totalprice", "week", "avg").replace(", 4)", ", 7)"), 7)(lambda t: charts.time_series(t("orders"), "o_orderdate", "o_totalprice", "week", "avg"))
query("line_orders_quarter_count", line_sql("orders", "o_orderdate", "o_totalprice", "quarter", "count"))(lambda t: charts.time_series(t("orders"), "o_orderdate", "o_totalprice", "quarter", "count"))
query("line_orders_year_min", line_sql("orders", "o_orderdate", "o_totalprice", "year", "min"))(lambda t: charts.time_series(t("orders"), "o_orderdate", "o_totalprice", "year", "min"))
query("line_orders_year_max", line_sql("orders", "o_orderdate", "o_totalprice", "year", "max"))(lambda t: charts.time_series(t("orders"), "o_orderdate", "o_totalprice", "year", "max"))
query("line_events_day_sum", line_sql("events", "ts", "value", "day", "sum"))(lambda t: charts.time_series(t("events"), "ts", "value", "day", "sum"))
query("line_events_by_type", line_sql("events", "ts", "value", "day", "avg", "event_type"))(lambda t: charts.time_series(t("events"), "ts", "value", "day", "avg", "event_type"))
query("line_lineitem_month_by_flag", line_sql("lineitem", "l_shipdate", "l_extendedprice", "month", "sum", "l_returnflag"), 2)(lambda t: charts.time_series(t("lineitem"), "l_shipdate", "l_extendedprice", "month", "sum", "l_returnflag"))
ORACLES["line_lineitem_month_by_flag"] = ORACLES["line_lineitem_month_by_flag"].replace(", 4)", ", 2)")

query(
    "multi_metric_month",
    " UNION ALL ".join(f"SELECT '{m}' AS series, date_trunc('month', l_shipdate)::TIMESTAMP AS x, round(avg({m}), 4) AS value FROM lineitem WHERE {m} IS NOT NULL GROUP BY ALL" for m in ("l_quantity", "l_extendedprice", "l_discount")),
)(lambda t: charts.time_series(t("lineitem"), "l_shipdate", ["l_quantity", "l_extendedprice", "l_discount"], "month", "avg"))


def daily(t, agg: str = "sum") -> DataFrame:
    """Order totals by priority and day: (series, x, y)."""
    return charts.time_series(t("orders"), "o_orderdate", "o_totalprice", "day", agg, "o_orderpriority").withColumnRenamed("value", "y")


DAILY = "daily AS (SELECT o_orderpriority AS series, date_trunc('day', o_orderdate)::TIMESTAMP AS x, sum(o_totalprice) AS y FROM orders GROUP BY ALL)"
NUMBERED = f"{DAILY}, pts AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM daily)"


def all_daily(t) -> DataFrame:
    """Totals of orders in progress by day, days without any null: (x, y), one series."""
    points = charts.time_series(t("orders"), "o_orderdate", "o_totalprice", "day", "sum", filters=(Filter("o_orderstatus", "eq", ("P",)),))
    return charts.fill_gaps(points, "day", value="value").withColumnRenamed("value", "y")


DAILY_ALL = """held AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS x, sum(o_totalprice) AS y FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), cal AS (SELECT unnest(generate_series(min(x), max(x), INTERVAL 1 DAY)) AS x FROM held),
    daily AS (SELECT c.x::TIMESTAMP AS x, s.y FROM cal c LEFT JOIN held s ON s.x = c.x)"""


def gaps_sql(value: str) -> str:
    return f"""WITH {DAILY}, cal AS (SELECT series, unnest(generate_series(min(x), max(x), INTERVAL 1 DAY)) AS x FROM daily GROUP BY series),
    j AS (SELECT c.series, c.x, d.y FROM cal c LEFT JOIN daily d ON d.series = c.series AND d.x = c.x)
    SELECT series, x::TIMESTAMP AS x, round({value}, 2) AS y FROM j"""


query("gapfill_nulls", gaps_sql("y"), 2)(lambda t: charts.fill_gaps(daily(t), "day", "nulls", ["series"], value="y"))
query("gapfill_ffill", gaps_sql("last_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"), 2)(lambda t: charts.fill_gaps(daily(t), "day", "ffill", ["series"], value="y"))
query("gapfill_zeros", gaps_sql("coalesce(y, 0)"), 2)(lambda t: charts.fill_gaps(daily(t), "day", "zeros", ["series"], value="y"))
query("stride_downsample", f"WITH {NUMBERED} SELECT series, x, round(y, 2) AS y FROM pts WHERE i % greatest(1, ceil(n / 100.0)::BIGINT) = 0", 2)(lambda t: charts.stride(daily(t), 100, ["series"]))
query(
    "even_downsample",
    f"""WITH {NUMBERED}, want AS (SELECT DISTINCT series, round_even(k * (n - 1) / 99.0::DOUBLE, 0)::BIGINT AS i FROM (SELECT DISTINCT series, n FROM pts), range(100) r(k))
    SELECT p.series, x, round(y, 2) AS y FROM pts p LEFT JOIN want w ON w.series = p.series AND w.i = p.i WHERE n <= 100 OR w.i IS NOT NULL""",
    2,
)(lambda t: charts.even_sample(daily(t), 100, ["series"]))

query("point_changes", f"WITH {DAILY} SELECT series, x, round(y, 2) AS y, round(y - lag(y) OVER (PARTITION BY series ORDER BY x), 2) AS diff FROM daily", 2)(lambda t: charts.diff(daily(t), by=["series"]))
query(
    "trailing_means",
    f"WITH {NUMBERED} SELECT series, x, round(y, 5) AS y, round(CASE WHEN i >= 7 THEN avg(y) OVER (PARTITION BY series ORDER BY x ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END, 5) AS trailing_mean FROM pts",
    5,
)(lambda t: charts.trailing_mean(daily(t), 7, by=["series"]))
query(
    "line_capped",
    """WITH d AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS x, sum(o_totalprice) AS v FROM orders GROUP BY 1), c AS (SELECT unnest(generate_series(min(x), max(x), INTERVAL 1 DAY)) AS x FROM d),
    n AS (SELECT c.x, v, row_number() OVER (ORDER BY c.x) - 1 AS i, count(*) OVER () AS n FROM c LEFT JOIN d ON d.x = c.x) SELECT x::TIMESTAMP AS x, round(v, 2) AS value FROM n WHERE i % greatest(1, ceil(n / 2000.0)::BIGINT) = 0""",
    2,
)(lambda t: charts.chart(t("orders"), QuerySpec("line", "o_orderdate", "o_totalprice", "day", "sum")))
query("chart_overridden", "SELECT o_orderpriority AS series, date_trunc('year', o_orderdate)::TIMESTAMP AS x, max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")(
    lambda t: charts.chart(t("orders"), QuerySpec("line", "o_orderdate", "o_totalprice", "day", "sum").replace(bin="year", agg="max", series="o_orderpriority", filters=F_ORDERS), gaps="none")
)
def row_ids(t) -> DataFrame:
    """The order of each order's lines by the numbers of rows in their files, dense, so that lines in different splits are as far apart as they lie."""
    rows = tables.with_row_number(t("lineitem")).select("l_orderkey", "l_partkey", "l_linenumber", "row_id")
    low = rows.groupBy("l_orderkey").agg(F.count("*").alias("rows"), F.count_distinct("row_id").alias("numbers"), F.min_by("l_partkey", "row_id").alias("first_part"), F.max_by("l_partkey", "row_id").alias("last_part"), F.min("row_id").alias("low"), F.sum("l_linenumber").alias("lines"), F.sum(F.col("l_linenumber") * F.col("row_id")).alias("products"))
    return low.select("l_orderkey", "rows", "numbers", "first_part", "last_part", (F.col("products") - F.col("low") * F.col("lines")).alias("places"))


query(
    "row_ids",
    """SELECT l_orderkey, count(*) AS rows, count(DISTINCT i) AS numbers, arg_min(l_partkey, i) AS first_part, arg_max(l_partkey, i) AS last_part, sum(l_linenumber * (i - low))::BIGINT AS places
    FROM (SELECT *, min(i) OVER (PARTITION BY l_orderkey) AS low FROM (SELECT *, row_number() OVER () AS i FROM lineitem)) GROUP BY 1""",
)(row_ids)
query(
    "sample_spread",
    f"""WITH {NUMBERED}, want AS (SELECT DISTINCT series, round_even(k * (n - 1) / 39.0::DOUBLE, 0)::BIGINT AS i FROM (SELECT DISTINCT series, n FROM pts), range(40) r(k))
    SELECT p.series, x, round(y, 2) AS y FROM pts p LEFT JOIN want w ON w.series = p.series AND w.i = p.i WHERE n <= 40 OR w.i IS NOT NULL""",
    2,
)(lambda t: evidence.aggregated_sample(daily(t), ["series"], 40).unionByName(evidence.aggregated_sample(daily(t), ["series"], 40, sensitive=True)))
query("top_series", "SELECT o_orderpriority AS series, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total DESC, series LIMIT 3", 2)(lambda t: charts.top_series(daily(t), 3, value="y"))

# ---- parsing and formatting --------------------------------------------------------------------------------


def dates_as_text(t) -> DataFrame:
    """Order dates written in four ways, parsed again."""
    forms = ["yyyyMMdd", "d/M/yyyy", "yyyy-M-d", "yyyy/MM/dd"]
    text = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in forms]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = t("orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", coerce.ts(rows, "text").alias("d"))


def numbers_as_text(t) -> DataFrame:
    """Prices written with thousands marks, parsed again; every tenth is no number."""
    text = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.col("o_totalprice").cast("string"), F.lit("d"))).otherwise(F.format_number("o_totalprice", 2))
    rows = t("orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", coerce.num(rows, "text").alias("n"), coerce.is_number_word(F.col("text")).alias("is_number"))


query("parse_dates", "SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS d FROM orders")(dates_as_text)
query("parse_numbers", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN round(o_totalprice, 2) END AS n, o_orderkey % 10 <> 0 AS is_number FROM orders")(numbers_as_text)
query(
    "scalar_functions",
    """SELECT event_id, epoch_us(ts) // 1000 AS ms, (date_trunc('quarter', ts) + INTERVAL 6 MONTH)::TIMESTAMP AS later, least(greatest(value, 10), 60)::DOUBLE AS clamped, regexp_replace(upper(event_type), '[^A-Z0-9]', '_', 'g') AS ident,
    round(CASE WHEN abs(value) >= 1e-7 THEN (50 - value) / abs(value) * 100 END, 4) AS pct, lower(event_type) IN ('yes', 'no', 't') AS truth FROM events""",
)(
    lambda t: t("events").select(
        "event_id", coerce.epoch_ms(F.col("ts")).alias("ms"), coerce.next_bin(coerce.time_bin(F.col("ts"), "quarter"), "quarter", F.lit(2)).alias("later"), coerce.clamp(F.col("value"), 10, 60).alias("clamped"),
        coerce.evidence_id(F.col("event_type")).alias("ident"), coerce.pct_change(F.col("value"), F.lit(50.0)).alias("pct"), coerce.is_bool_word(F.col("event_type")).alias("truth"),
    )
)



def more_scalars(t) -> DataFrame:
    """Numbers and dates written as text, and numbers that stand for times, read and written."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    low = F.floor(price / 1000) * 1000
    label = F.when(k % 2 == 0, F.format_string("[%d, %d)", low, low + 1000)).otherwise(F.format_string("%d - %d", low + 1000, low))
    word = F.element_at(F.array(*[F.date_format("o_orderdate", x) for x in ("dd-MM-yyyy", "yyyy/MM/dd", "yyyyMMdd")], F.lit("12 May")), (k % 4 + 1).cast("int"))
    rows = t("orders").select("o_orderkey", "o_orderpriority", price, F.format_number(price, 2).alias("text"), label.alias("label"), word.alias("word"), F.when(k % 3 == 0, k + 1_600_000_000).when(k % 3 == 1, (k + 1_600_000_000) * 1000).otherwise(k).alias("number"))
    limits = coerce.parse_range(F.col("label"))
    return rows.select(
        "o_orderkey", coerce.num(rows, "text", strict=True).alias("strict"), coerce.ts_from_number(F.col("number")).alias("stamp"), coerce.looks_like_date(F.col("o_orderpriority")).alias("dashed"), coerce.looks_like_date(F.col("word")).alias("date_like"),
        coerce.is_date_word(F.col("word")).alias("date_word"), coerce.fmt(F.col("o_totalprice")).alias("two"), coerce.fmt(F.col("o_totalprice") / 4, 4, trim=True).alias("trimmed"), coerce.fmt(F.col("o_totalprice") / 700_001, 1, percent=True).alias("percent"),
        limits["lo"].alias("lo"), limits["hi"].alias("hi"),
    )


query(
    "scalar_functions_more",
    """SELECT o_orderkey, round(o_totalprice, 2) AS strict, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE make_timestamp((o_orderkey + 1600000000) * 1000000) END AS stamp, contains(o_orderpriority, '-') AS dashed, o_orderkey % 4 <> 3 AS date_like,
    o_orderkey % 4 <> 3 AS date_word, printf('%.2f', o_totalprice) AS two, rtrim(rtrim(printf('%.4f', o_totalprice / 4), '0'), '.') AS trimmed, printf('%.1f', o_totalprice / 700001 * 100) || '%' AS percent,
    floor(o_totalprice / 1000) * 1000::DOUBLE AS lo, floor(o_totalprice / 1000) * 1000::DOUBLE + 1000 AS hi FROM orders""",
)(more_scalars)


def from_csv(t) -> DataFrame:
    """Orders written as a CSV file, ingested with inferred types, and summed up."""
    spark = t("orders").sparkSession
    file, table = tables.scratch(spark), tables.scratch(spark)
    t("orders").write.option("header", True).csv(file)
    rows = tables.ingest_csv(spark, file, table).select("rows")
    kinds = spark.read.parquet(table).agg(
        F.count("o_totalprice").alias("prices"), F.round(F.sum("o_totalprice") / F.count("*"), 4).alias("mean_price"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count_distinct("o_orderpriority").alias("priorities"), F.max("o_orderkey").cast("long").alias("top")
    )
    return rows.join(F.broadcast(kinds))  # one row each


query("csv_ingest", "SELECT count(*) AS rows, count(o_totalprice) AS prices, round(sum(o_totalprice) / count(*), 4) AS mean_price, min(o_orderdate) AS first, max(o_orderdate) AS last, count(DISTINCT o_orderpriority) AS priorities, max(o_orderkey) AS top FROM orders")(from_csv)


def bad_csv(t) -> DataFrame:
    """Events as lines of text, every tenth too short: skipped by a scan, padded by a tolerant one."""
    line = F.when(F.col("event_id") % 10 == 0, F.concat_ws(",", "event_id", "user_id")).otherwise(F.concat_ws(",", "event_id", "user_id", "event_type", "value"))
    file = tables.scratch(t("events").sparkSession)
    t("events").select(line.alias("value")).write.option("lineSep", "\n").text(file)
    schema = "event_id string, user_id string, event_type string, value string"
    scans = [tables.scan_csv(t("events").sparkSession, file, schema, tolerant=x, header=False).agg(F.lit(x).alias("tolerant"), F.count("*").alias("rows"), F.count("event_type").alias("types")) for x in (False, True)]
    return scans[0].unionByName(scans[1])


# ---- bars, scatter, histograms -----------------------------------------------------------------------------

query("bar_top_parts", "SELECT l_partkey::VARCHAR AS category, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1 ORDER BY value DESC, category LIMIT 20", 2)(lambda t: charts.bar(t("lineitem"), "l_partkey", "l_extendedprice"))
query("bar_segment_sum", "SELECT c_mktsegment AS category, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY 1 ORDER BY value DESC, category LIMIT 20", 2)(lambda t: charts.bar(t("customer"), "c_mktsegment", "c_acctbal"))
query(
    "bar_grouped_top5",
    """WITH p AS (SELECT o_custkey::VARCHAR AS category, coalesce(nullif(trim(o_orderpriority), ''), 'Unknown') AS series, sum(o_totalprice) AS value FROM orders GROUP BY ALL
      ORDER BY value DESC, category, series LIMIT 100),
    s AS (SELECT series FROM p GROUP BY 1 ORDER BY sum(value) DESC, series LIMIT 5)
    SELECT c.category, s.series, round(coalesce(p.value, 0), 2) AS value FROM (SELECT DISTINCT category FROM p) c CROSS JOIN s LEFT JOIN p ON p.category = c.category AND p.series = s.series""",
    2,
)(lambda t: charts.bar(t("orders"), "o_custkey", "o_totalprice", series="o_orderpriority"))
query("scatter_sample", "SELECT x, y FROM (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part ORDER BY sha256('42:' || p_partkey) LIMIT 500)")(lambda t: charts.scatter(t("part"), "p_size", "p_retailprice", 500, key="p_partkey"))


def fixed(x: str, digits: int) -> str:
    """A double as text with so many digits, halves of its shortest decimal form rounded up."""
    return f"round(({x})::DOUBLE::VARCHAR::DECIMAL(36, 16), {digits})::DECIMAL(36, {digits})::VARCHAR"


def histogram_sql(table: str, column: str, bins: int) -> str:
    return f"""WITH s AS (SELECT min({column})::DOUBLE AS low, max({column})::DOUBLE AS high FROM {table}),
    f AS (SELECT *, CASE WHEN high - low < 1e-4 THEN 1 ELSE {bins} END AS bins FROM s), w AS (SELECT *, (high - low) / bins AS width FROM f),
    c AS (SELECT CASE WHEN bins = 1 THEN 0 ELSE least(floor(({column} - low) / width), bins - 1) END::INTEGER AS bin, count(*) AS n FROM {table}, w WHERE {column} IS NOT NULL GROUP BY 1)
    SELECT b::INTEGER AS bin, round(low + b * width, 4) AS lo, round(CASE WHEN b = bins - 1 THEN high ELSE low + (b + 1) * width END, 4) AS hi, coalesce(n, 0)::BIGINT AS count,
    '[' || {fixed('low + b * width', 2)} || ', ' || {fixed('CASE WHEN b = bins - 1 THEN high ELSE low + (b + 1) * width END', 2)} || ')' AS label
    FROM w, range({bins}) r(b) LEFT JOIN c ON c.bin = b WHERE b < bins"""


query("histogram_price", histogram_sql("orders", "o_totalprice", 20))(lambda t: charts.histogram(t("orders"), "o_totalprice"))
query("histogram_constant", histogram_sql("(SELECT l_linenumber FROM lineitem WHERE l_linenumber = 1)", "l_linenumber", 20))(lambda t: charts.histogram(t("lineitem"), "l_linenumber", filters=(Filter("l_linenumber", "eq", (1,)),)))

# ---- filters -----------------------------------------------------------------------------------------------


def kept(name: str, table: str, key: str, where: str, *conditions: Filter) -> None:
    query(name, f"SELECT {key} FROM {table} WHERE {where}")(lambda t: filters.apply(t(table), conditions).select(key.split(", ")))


kept("filter_between_multi", "orders", "o_orderkey", "o_totalprice BETWEEN 1000 AND 50000 OR o_totalprice BETWEEN 200000 AND 250000", Filter("o_totalprice", "between", (1000, 50000, 200000, 250000)))
kept("filter_contains", "part", "p_partkey", "lower(p_name) LIKE '%a%' AND lower(p_type) LIKE '%e%'", Filter("p_name", "contains", ("A",)), Filter("p_type", "contains", ("e",)))
kept("filter_in", "orders", "o_orderkey", "o_orderstatus IN ('F', 'P')", Filter("o_orderstatus", "in", ("F", "P")))
kept("filter_or_chain", "orders", "o_orderkey", "(o_orderstatus = 'P' OR o_totalprice > 300000) AND o_custkey < 700", Filter("o_orderstatus", "eq", ("P",)), Filter("o_totalprice", "gt", (300000,), "or"), Filter("o_custkey", "lt", (700,)))
kept("filter_date_gte", "orders", "o_orderkey", "o_orderdate >= TIMESTAMP '1997-06-01'", Filter("o_orderdate", "gte", ("1997-06-01",)))
kept("filter_not_eq", "events", "event_id", "event_type <> 'click' AND value <= 50", Filter("event_type", "not_eq", ("click",)), Filter("value", "lte", (50,)))
# Literals as text, as requests carry them: compared in the column's own type.
kept("filter_text_literal", "lineitem", "l_orderkey, l_linenumber", "l_orderkey > 3000 AND l_linenumber IN (1, 3) AND l_quantity >= 10.5 AND l_shipdate < TIMESTAMP '1997-06-01'", Filter("l_orderkey", "gt", ("3,000",)), Filter("l_linenumber", "in", ("1", "3", "2.5")), Filter("l_quantity", "gte", ("10.5",)), Filter("l_shipdate", "lt", ("1997-06-01",)))
kept("filter_text_between", "orders", "o_orderkey", "o_orderkey BETWEEN 101 AND 500 OR o_orderkey BETWEEN 1000 AND 1100", Filter("o_orderkey", "between", ("100.5", "500.9", "1000", "1.1e3")))
kept("filter_text_beyond", "orders", "o_orderkey", "o_custkey < 300", Filter("o_orderkey", "lt", ("99999999999999999999",)), Filter("o_custkey", "lt", ("299.5",)), Filter("o_orderkey", "not_eq", ("0.5",)))
query("drop_values", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")(lambda t: filters.drop_values(t("orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey"))
query("search_any_column", "SELECT c_custkey FROM customer WHERE c_custkey::VARCHAR LIKE '%11%' OR lower(c_name) LIKE '%11%' OR c_nationkey::VARCHAR LIKE '%11%' OR c_acctbal::VARCHAR LIKE '%11%' OR lower(c_mktsegment) LIKE '%11%'")(lambda t: filters.search(t("customer"), "11").select("c_custkey"))
query("search_dates", "SELECT o_orderkey FROM orders WHERE o_orderkey::VARCHAR LIKE '%7-1%' OR o_custkey::VARCHAR LIKE '%7-1%' OR lower(o_orderstatus) LIKE '%7-1%' OR o_totalprice::VARCHAR LIKE '%7-1%' OR o_orderdate::VARCHAR LIKE '%7-1%' OR lower(o_orderpriority) LIKE '%7-1%'")(lambda t: filters.search(t("orders"), "7-1").select("o_orderkey"))
query("group_by_guard", "SELECT count(*) AS rows, count(DISTINCT o_orderpriority) AS distinct, count(DISTINCT o_orderpriority) <= least(50, greatest(20, floor(count(*) * 0.05))) AS allowed FROM orders")(lambda t: filters.guard_group_by(t("orders"), "o_orderpriority"))
query("row_hashes", "SELECT c_custkey, sha256(concat(coalesce(length(c_name) || ':' || c_name, '-'), coalesce(length(c_mktsegment) || ':' || c_mktsegment, '-'))) AS h FROM customer")(lambda t: t("customer").select("c_custkey", coerce.row_hash(F.col("c_name"), F.col("c_mktsegment")).alias("h")))

# ---- percentiles -------------------------------------------------------------------------------------------

LEVELS_SQL = ", ".join(f"round(quantile_cont({{y}}, {q}), 4) AS {n}" for n, q in percentiles.LEVELS.items())
query("percentiles_overall", f"SELECT {LEVELS_SQL.format(y='o_totalprice')} FROM orders")(lambda t: percentiles.percentile_refs(t("orders"), QuerySpec("histogram", "o_totalprice")))
query("percentiles_by_priority", f"SELECT o_orderpriority, {LEVELS_SQL.format(y='o_totalprice')} FROM orders GROUP BY 1")(lambda t: percentiles.percentiles(t("orders"), "o_totalprice", ["o_orderpriority"]))
query("percentile_by_month", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, round(quantile_cont(o_totalprice, 0.9), 4) AS percentile FROM orders GROUP BY 1")(lambda t: percentiles.percentile_by(t("orders"), QuerySpec("line", "o_orderdate", "o_totalprice", "month"), 0.9))
query("percentile_by_category", "SELECT l_returnflag AS bucket, l_linestatus AS series, round(quantile_cont(l_extendedprice, 0.95), 4) AS percentile FROM lineitem GROUP BY ALL")(lambda t: percentiles.percentile_by(t("lineitem"), QuerySpec("bar", "l_returnflag", "l_extendedprice", series="l_linestatus"), 0.95))
query("percentile_view_line", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS x, round(sum(o_totalprice), 4) AS value, round(quantile_cont(o_totalprice, 0.1), 4) AS percentile FROM orders GROUP BY 1")(lambda t: percentiles.percentile_view(t("orders"), QuerySpec("line", "o_orderdate", "o_totalprice", "month"), 0.1))
query("percentile_view_overall", "SELECT c_mktsegment AS category, round(sum(c_acctbal), 2) AS value, (SELECT round(quantile_cont(c_acctbal, 0.9), 2) FROM customer) AS percentile FROM customer GROUP BY 1", 2)(lambda t: percentiles.percentile_view(t("customer"), QuerySpec("bar", "c_mktsegment", "c_acctbal"), 0.9, "overall"))
query("percentile_view_bar", "SELECT o_orderpriority AS category, round(sum(o_totalprice), 2) AS value, round(quantile_cont(o_totalprice, 0.9), 2) AS percentile FROM orders GROUP BY 1", 2)(lambda t: percentiles.percentile_view(t("orders"), QuerySpec("bar", "o_orderpriority", "o_totalprice"), 0.9))
query("percentile_view_single", "SELECT c_custkey::VARCHAR AS category, round(c_acctbal, 2) AS value, (SELECT round(quantile_cont(c_acctbal, 0.95), 2) FROM customer) AS percentile FROM customer ORDER BY c_acctbal DESC, category LIMIT 20", 2)(lambda t: percentiles.percentile_view(t("customer"), QuerySpec("bar", "c_custkey", "c_acctbal"), 0.95))
query("has_multi", "SELECT max(n) > 1 AS multi FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")(lambda t: percentiles.has_multi(t("orders"), "o_custkey"))

# ---- what-if -----------------------------------------------------------------------------------------------


SHOWN = "SELECT dimension, round(baseline, 2) AS baseline, round(simulated, 2) AS simulated, round(delta, 2) AS delta, round(delta_percent, 2) AS delta_percent FROM d"


def whatif_sql(source: str, dim: str, metric: str, agg: str, simulated: str, keep: str = "TRUE", final: str = SHOWN) -> str:
    """Both sides in one aggregation over the rows, the simulated one by a filter."""
    return f"""WITH rows_ AS (SELECT *, {metric}::DOUBLE AS m, {dim} || '' AS dimension FROM {source}),
    sides AS (SELECT dimension, coalesce({agg}(m), 0)::DOUBLE AS baseline, coalesce({agg}({simulated}) FILTER ({keep}), 0)::DOUBLE AS simulated FROM rows_ GROUP BY dimension),
    d AS (SELECT *, simulated - baseline AS delta, 100 * (simulated - baseline) / CASE WHEN abs(baseline) >= 1e-7 THEN abs(baseline) END AS delta_percent FROM sides)
    {final}"""


def removed(t) -> DataFrame:
    steps = [Step("multiply", 1.1), Step("remove", column="o_orderstatus", values=("P",)), Step("remove", values=("5-LOW",))]
    return whatif.what_if(t("orders"), "o_totalprice", "o_orderpriority", "sum", steps)


REMOVED = ("orders", "o_orderpriority", "o_totalprice", "sum", "m * 1.1::DOUBLE", "o_orderstatus <> 'P' AND dimension <> '5-LOW'")
SHIP = ("lineitem", "l_returnflag || l_linestatus || '-' || l_linenumber", "l_extendedprice", "avg", "least(greatest(m + 500::DOUBLE, 2000::DOUBLE), 60000::DOUBLE)")


def clamped(t) -> DataFrame:
    rows = t("lineitem").withColumn("dim", F.concat("l_returnflag", "l_linestatus", F.lit("-"), F.col("l_linenumber").cast("string")))
    return whatif.what_if(rows, "l_extendedprice", "dim", "avg", [Step("add", 500), Step("clamp", low=2000, high=60000)])


query("whatif_multiply", whatif_sql("orders", "o_orderstatus", "o_totalprice", "sum", "m * 1.25::DOUBLE"), 2)(lambda t: whatif.what_if(t("orders"), "o_totalprice", "o_orderstatus", "sum", [Step("multiply", 1.25)]))
query("whatif_add_clamp", whatif_sql(*SHIP), 2)(clamped)
query("whatif_remove_category", whatif_sql(*REMOVED), 2)(removed)
query("whatif_filterout_filtered", whatif_sql("(SELECT * FROM orders WHERE o_totalprice > 100000)", "o_orderpriority", "o_totalprice", "count", "m", "o_orderstatus NOT IN ('F')"), 2)(
    lambda t: whatif.what_if(t("orders"), "o_totalprice", "o_orderpriority", "count", [Step("remove", column="o_orderstatus", values=("F",))], (Filter("o_totalprice", "gt", (100000,)),))
)
query("whatif_summary", whatif_sql(*REMOVED, final="SELECT round(avg(delta_percent), 4) AS mean_percent, round(max(delta_percent), 4) AS max_percent, round(min(delta_percent), 4) AS min_percent, count(*) FILTER (abs(delta) > 1e-7) AS changed FROM d"))(lambda t: whatif.delta_summary(removed(t)))
query(
    "whatif_conclusion",
    whatif_sql(
        *SHIP,
        final=f""", e AS (SELECT *, row_number() OVER (ORDER BY dimension) - 1 AS i, row_number() OVER (ORDER BY abs(delta) DESC, dimension) AS rank FROM d)
        SELECT round(avg(delta), 2) AS mean_delta, round(sum(delta), 2) AS sum_delta, round(max(delta), 2) AS max_delta, round(stddev_pop(simulated) - stddev_pop(baseline), 2) AS stddev_change,
        round(regr_slope(simulated, i) - regr_slope(baseline, i), 2) AS slope_change, string_agg(dimension || ': ' || {fixed('delta', 2)}, '; ' ORDER BY rank) FILTER (rank <= 3) AS drivers FROM e""",
    ),
    2,
)(lambda t: whatif.what_if_summary(clamped(t)))
query("whatif_cap_p95", "SELECT quantile_disc(o_totalprice, 0.95) AS cap FROM orders")(lambda t: whatif.cap_at_p95(t("orders"), "o_totalprice"))
query("whatif_presets", " UNION ALL ".join(f"SELECT '{n}' AS preset, * FROM ({whatif_sql('orders', 'o_orderpriority', 'o_totalprice', 'sum', v)})" for n, v in (("plus_10", "m * 1.1::DOUBLE"), ("minus_10", "m * 0.9::DOUBLE"), ("cap_p95", "least(m, (SELECT quantile_disc(o_totalprice, 0.95) FROM orders))"))), 2)(
    lambda t: functools.reduce(DataFrame.unionByName, [whatif.what_if(t("orders"), "o_totalprice", "o_orderpriority", "sum", whatif.preset(n, t("orders"), "o_totalprice")).select(F.lit(n).alias("preset"), "*") for n in ("plus_10", "minus_10", "cap_p95")])
)
query("top_deltas", whatif_sql(*SHIP, final=SHOWN + " ORDER BY abs(coalesce(d.delta_percent, d.delta)) DESC, dimension LIMIT 5"), 2)(lambda t: whatif.top_deltas(clamped(t), 5))
query(
    "compare_tables",
    """WITH a AS (SELECT c_mktsegment AS dimension, avg(c_acctbal) AS v FROM customer WHERE c_nationkey < 12 AND c_mktsegment <> 'BUILDING' GROUP BY 1), b AS (SELECT c_mktsegment AS dimension, avg(c_acctbal) AS v FROM customer WHERE c_nationkey >= 12 AND c_mktsegment <> 'MACHINERY' GROUP BY 1),
    c AS (SELECT coalesce(a.dimension, b.dimension) AS dimension, coalesce(a.v, 0) AS baseline, coalesce(b.v, 0) AS simulated FROM a FULL JOIN b ON a.dimension = b.dimension)
    SELECT dimension, round(baseline, 4) AS baseline, round(simulated, 4) AS simulated, round(simulated - baseline, 4) AS delta, round(CASE WHEN abs(baseline) < 1e-7 THEN NULL ELSE (simulated - baseline) / abs(baseline) * 100 END, 4) AS delta_percent FROM c""",
)(lambda t: whatif.compare(*[charts.bar(t("customer").where(w), "c_mktsegment", "c_acctbal", "avg").withColumnRenamed("category", "dimension") for w in ("c_nationkey < 12 and c_mktsegment <> 'BUILDING'", "c_nationkey >= 12 and c_mktsegment <> 'MACHINERY'")]))

# ---- row browser and facets --------------------------------------------------------------------------------

FACETS = (Filter("o_orderstatus", "eq", ("F",)), Filter("o_orderpriority", "in", ("1-URGENT", "2-HIGH")), Filter("o_totalprice", "gt", (50000,)))
query("browse_page", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY customer.c_custkey LIMIT 25 OFFSET 25")(lambda t: browse.browse(t("customer"), (Filter("c_mktsegment", "eq", ("BUILDING",)),), number=2, size=25, key="c_custkey"))
query("browse_sorted_search", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey::VARCHAR LIKE '%7%' OR lower(c_name) LIKE '%7%' OR c_nationkey::VARCHAR LIKE '%7%' OR c_acctbal::VARCHAR LIKE '%7%' OR lower(c_mktsegment) LIKE '%7%' ORDER BY c_mktsegment DESC, customer.c_custkey LIMIT 50")(
    lambda t: browse.browse(t("customer"), search="7", rules=[("c_mktsegment", "desc")], key="c_custkey")
)
query("page_info", "SELECT count(*) AS rows, ceil(count(*) / 50.0)::BIGINT AS pages, count(*) > 100000 AS truncated FROM orders")(lambda t: browse.page_info(t("orders")))


def stats_sql(table: str, column: str) -> str:
    """Counts by what the values read as, and the kind they lead to."""
    text, full = f"{column}::VARCHAR", f"coalesce(trim({column}::VARCHAR), '') <> ''"
    return f"""SELECT *, CASE WHEN rows > blanks AND numbers >= 0.9 * (rows - blanks) THEN 'Number' WHEN rows > blanks AND dates >= 0.9 * (rows - blanks) THEN 'Date' WHEN "distinct" <= 50 THEN 'Category' ELSE 'String' END AS kind FROM (
    SELECT count(*) AS rows, count(*) FILTER (NOT ({full})) AS blanks, count(DISTINCT {column}) FILTER ({full}) AS "distinct", count(*) FILTER ({full} AND try_cast({text} AS DOUBLE) IS NOT NULL) AS numbers,
    count(*) FILTER ({full} AND try_cast({text} AS TIMESTAMP) IS NOT NULL) AS dates FROM {table})"""


query("field_stats_num", stats_sql("lineitem", "l_quantity"))(lambda t: browse.field_stats(t("lineitem"), "l_quantity"))
query("field_stats_text", stats_sql("customer", "c_mktsegment"))(lambda t: browse.field_stats(t("customer"), "c_mktsegment"))
query("field_stats_date", stats_sql("events", "ts"))(lambda t: browse.field_stats(t("events"), "ts"))
query("top_values", "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, value LIMIT 12")(lambda t: browse.top_values(t("part"), "p_brand"))
query("top_values_others", "WITH v AS (SELECT p_type AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, value LIMIT 3) SELECT * FROM v UNION ALL SELECT 'Others', (SELECT count(*) FROM part) - (SELECT sum(count) FROM v)::BIGINT AS rest WHERE rest > 0")(lambda t: browse.with_others(browse.top_values(t("part"), "p_type", 3), browse.field_stats(t("part"), "p_type")))
RANGES = "w AS (SELECT *, (high - low) / 8 AS width FROM s), c AS (SELECT least(floor((v - low) / width), 7)::INTEGER AS bin, min(v) AS lo, max(v) AS hi, count(*) AS count FROM src, w GROUP BY 1 ORDER BY count DESC, bin LIMIT 8)"
query("numeric_ranges", f"WITH src AS (SELECT l_extendedprice AS v FROM lineitem), s AS (SELECT min(v) AS low, max(v) AS high FROM src), {RANGES} SELECT bin, round(lo, 4) AS lo, round(hi, 4) AS hi, count FROM c")(lambda t: browse.numeric_ranges(t("lineitem"), "l_extendedprice"))
query("date_ranges", f"WITH src AS (SELECT epoch_us(ts) / 1e6::DOUBLE AS v FROM events), s AS (SELECT min(v) AS low, max(v) AS high FROM src), {RANGES} SELECT bin, make_timestamp(round(lo * 1e6)::BIGINT) AS lo, make_timestamp(round(hi * 1e6)::BIGINT) AS hi, count FROM c")(lambda t: browse.date_ranges(t("events"), "ts"))
_S, _P, _T = "o_orderstatus = 'F'", "o_orderpriority IN ('1-URGENT', '2-HIGH')", "o_totalprice > 50000"
query(
    "facet_distinct",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct FROM orders WHERE {w}" for c, w in (("o_custkey", f"{_S} AND {_P} AND {_T}"), ("o_orderstatus", f"{_P} AND {_T}"), ("o_orderpriority", f"{_S} AND {_T}"))),
)(lambda t: browse.facet_distinct(t("orders"), FACETS, ["o_custkey", "o_orderstatus", "o_orderpriority"]))
query("facet_values", f"SELECT o_orderpriority AS value, count(*) AS count FROM orders WHERE {_S} AND {_T} GROUP BY 1 ORDER BY count DESC, value LIMIT 12")(lambda t: browse.facet_values(t("orders"), FACETS, "o_orderpriority"))
query("page_stats", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(count(*) FILTER (coalesce(trim({c}::VARCHAR), '') = '') / count(*), 4)::DOUBLE AS null_rate, count(DISTINCT {c}) AS distinct FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey")))(lambda t: browse.page_stats(t("nation")))
query("rows_behind_point", "SELECT * FROM orders WHERE o_orderpriority = '3-MEDIUM' ORDER BY o_orderkey LIMIT 200", 6)(lambda t: charts.rows_behind(t("orders"), "o_orderpriority", "3-MEDIUM", key="o_orderkey"))
query("rows_behind_contains", "SELECT * FROM orders WHERE lower(o_orderpriority) LIKE '%medium%' ORDER BY o_orderkey LIMIT 200", 6)(lambda t: charts.rows_behind(t("orders"), "o_orderpriority", "MEDIUM", key="o_orderkey"))
query("drilldown_histogram", histogram_sql("(SELECT * FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000)", "o_totalprice", 20))(lambda t: charts.chart(t("orders"), charts.drilldown(QuerySpec("histogram", "o_totalprice"), "[100000, 150000)")))
query("drilldown_bar", "SELECT o_orderstatus AS category, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'P' GROUP BY 1", 2)(lambda t: charts.chart(t("orders"), charts.drilldown(QuerySpec("bar", "o_orderstatus", "o_totalprice"), "P")))

# ---- profiles and recommendations --------------------------------------------------------------------------

#: Columns of single values of all tables.
PROFILED = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "nation": "n_nationkey n_name n_regionkey",
    "region": "r_regionkey r_name",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
WORDS_SQL = {
    "bools": f"lower(trim({{c}})) IN ({', '.join(repr(w) for w in coerce.BOOL_WORDS)})",
    "numbers": r"regexp_full_match(regexp_replace({c}, '[, ]', '', 'g'), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')",
    "dates": r"""(regexp_full_match(trim({c}), '[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}([ T][0-9:.]+)?|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}|[0-9]{{8}}')
      AND coalesce(try_cast(replace(trim({c}), '/', '-') AS TIMESTAMP), try_strptime(trim({c}), ['%Y%m%d', '%d/%m/%Y', '%m/%d/%Y', '%d-%m-%Y', '%m-%d-%Y'])) IS NOT NULL)""",
}


def profile_sql(table: str, name: str | None = None, columns: str | None = None) -> str:
    """Types, null rates and ends, computed from the table's values and their types."""
    parts = []
    for c in (columns or PROFILED[table]).split():
        text = f"{c}::VARCHAR"
        full = f"coalesce(trim({text}), '') <> ''"
        words = ", ".join(f"count(*) FILTER ({full} AND {test.format(c=text)}) AS {k}" for k, test in WORDS_SQL.items())
        parts.append(
            f"""SELECT {f"'{name}' AS \"table\", " if name else ''}'{c}' AS "column", inferred_type, row_count, round(1 - f / row_count, 4)::DOUBLE AS null_rate, d AS distinct_count,
            CASE WHEN inferred_type = 'Number' THEN low END AS min, CASE WHEN inferred_type = 'Number' THEN high END AS max FROM (
            SELECT *, CASE WHEN f = 0 THEN 'String' WHEN kind IN ('TIMESTAMP', 'DATE') THEN 'Date' WHEN kind = 'BOOLEAN' THEN 'Boolean' WHEN kind <> 'VARCHAR' THEN 'Number' WHEN bools >= 0.9 * f THEN 'Boolean'
              WHEN dates >= 0.9 * f THEN 'Date' WHEN numbers >= 0.9 * f THEN 'Number' WHEN d <= greatest(20, floor(row_count * 0.05)) THEN 'Category' ELSE 'String' END AS inferred_type FROM (
            SELECT any_value(typeof({c})) AS kind, count(*) AS row_count, count(*) FILTER ({full}) AS f, count(DISTINCT {c}) FILTER ({full}) AS d, {words},
              min(try_cast(regexp_replace({text}, '[, ]', '', 'g') AS DOUBLE)) AS low, max(try_cast(regexp_replace({text}, '[, ]', '', 'g') AS DOUBLE)) AS high FROM {table}))"""
        )
    return " UNION ALL ".join(parts)


def profiled(t) -> DataFrame:
    return profile.profile_tables({n: t(n) for n in PROFILED})


def texts(t) -> DataFrame:
    """Orders as they come from a file: all text, with gaps, thousands marks, several date forms and stray words."""
    k, date = F.col("o_orderkey"), F.col("o_orderdate")
    forms = F.element_at(F.array(F.date_format(date, "yyyy-MM-dd"), F.date_format(date, "dd/MM/yyyy"), F.date_format(date, "yyyyMMdd")), (k % 3 + 1).cast("int"))
    return t("orders").select(
        F.when(k % 7 != 0, forms).alias("day"), F.when(k % 11 == 0, F.lit("  ")).when(k % 13 == 0, F.lit("n/a")).otherwise(F.format_number("o_totalprice", 2)).alias("price"),
        F.when(k % 5 == 0, F.lit("?")).otherwise(k.cast("string")).alias("mixed"), F.element_at(F.array(F.lit("Yes"), F.lit(" no"), F.lit("1"), F.lit(None)), (k % 4 + 1).cast("int")).alias("flag"),
        F.when(k % 2 == 0, F.col("o_orderpriority")).alias("priority"), F.lit(None).cast("string").alias("empty"),
    )


def dated_texts(t) -> DataFrame:
    """Order keys, days and prices as text, some days being none."""
    k = F.col("o_orderkey")
    forms = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd")]), (k % 3 + 1).cast("int"))
    price = F.when(k % 11 == 0, F.lit("  ")).when(k % 13 == 0, F.lit("n/a")).otherwise(F.format_number("o_totalprice", 2))
    return t("orders").select("o_orderkey", F.when(k % 17 == 0, F.lit("no date")).when(k % 7 != 0, forms).alias("day"), price.alias("price"))


TEXTS = """(SELECT CASE WHEN o_orderkey % 7 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y%m%d') END END AS day,
CASE WHEN o_orderkey % 11 = 0 THEN '  ' WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE format('{:,.2f}', o_totalprice) END AS price, CASE WHEN o_orderkey % 5 = 0 THEN '?' ELSE o_orderkey::VARCHAR END AS mixed,
CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no' WHEN 2 THEN '1' END AS flag, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS priority, NULL::VARCHAR AS empty FROM orders)"""

query("profile_orders", profile_sql("orders"))(lambda t: profile.profile(t("orders")))
query("profile_texts", profile_sql(TEXTS, columns="day price mixed flag priority empty"))(lambda t: profile.profile(texts(t)))
DATE_SQL = "(try_strptime(trim({c}), '%Y-%m-%d') IS NOT NULL OR try_strptime(trim({c}), '%d/%m/%Y') IS NOT NULL OR (length(trim({c})) = 8 AND try_strptime(trim({c}), '%Y%m%d') IS NOT NULL))"
query("field_stats_texts", " UNION ALL ".join(
    f"""SELECT *, CASE WHEN rows > blanks AND numbers >= 0.9 * (rows - blanks) THEN 'Number' WHEN rows > blanks AND dates >= 0.9 * (rows - blanks) THEN 'Date' WHEN "distinct" <= 50 THEN 'Category' ELSE 'String' END AS kind FROM (
    SELECT '{c}' AS field, count(*) AS rows, count(*) FILTER (coalesce(trim({c}), '') = '') AS blanks, count(DISTINCT {c}) FILTER (trim({c}) <> '') AS distinct,
    count(*) FILTER (try_cast(replace(trim({c}), ',', '') AS DOUBLE) IS NOT NULL) AS numbers, count(*) FILTER ({DATE_SQL.format(c=c)}) AS dates FROM {TEXTS})""" for c in ("day", "price", "mixed", "flag", "priority", "empty"))
)(lambda t: functools.reduce(DataFrame.unionByName, [browse.field_stats(texts(t), c).select(F.lit(c).alias("field"), "rows", "blanks", "distinct", "numbers", "dates", "kind") for c in ("day", "price", "mixed", "flag", "priority", "empty")]))
query("profile_all_tables", " UNION ALL ".join(profile_sql(n, n) for n in PROFILED))(profiled)
query(
    "profile_top_values",
    " UNION ALL ".join(f"(SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS count FROM customer GROUP BY ALL ORDER BY count DESC, value LIMIT 3)" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
)(lambda t: profile.profile_top_values(t("customer")))
ROLES = """r AS (SELECT *, CASE WHEN inferred_type = 'Date' THEN 'Time' WHEN regexp_matches(lower("column"), '(^|_)(id|key)($|_)|key$') OR (inferred_type IN ('String', 'Category') AND distinct_count >= 0.98 * row_count) THEN 'Id'
WHEN inferred_type = 'Number' THEN 'Measure' ELSE 'Category' END AS role FROM p)"""


def roles_sql(*names: str) -> str:
    return f"p AS ({' UNION ALL '.join(profile_sql(n, n) for n in names)}), {ROLES}"


def recommend_sql(*names: str) -> str:
    base = lambda k: "CASE chart " + " ".join(f"WHEN '{c}' THEN {b[k]}::DOUBLE" for c, b in recommend.BASE.items()) + " END"
    return f"""WITH {roles_sql(*names)},
    me AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY lower("column") LIKE '%score%' DESC, lower("column") LIKE '%balance%' DESC, distinct_count DESC, "column") AS k FROM r WHERE role = 'Measure' QUALIFY k <= 3),
    ti AS (SELECT * FROM r WHERE role = 'Time' QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY lower("column") LIKE '%created%' DESC, "column") = 1),
    gr AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY distinct_count, "column") AS k FROM r WHERE role = 'Category' AND distinct_count <= 20 QUALIFY k <= 3),
    c AS (SELECT me."table", 'line' AS chart, ti."column" AS x, me."column" AS y, 'avg' AS agg, 'day' AS bin, me.k AS g FROM ti JOIN me ON me."table" = ti."table" AND me.k <= 2
      UNION ALL SELECT me."table", 'bar', gr."column", me."column", 'sum', NULL, gr.k * 10 + me.k + 100 FROM gr JOIN me ON me."table" = gr."table" AND me.k <= 2
      UNION ALL SELECT "table", 'histogram', "column", NULL, NULL, NULL, k + 200 FROM me WHERE k <= 2
      UNION ALL SELECT "table", 'scatter', x, y, NULL, NULL, o + 300 FROM (SELECT a."table", a."column" AS x, b."column" AS y, row_number() OVER (PARTITION BY a."table" ORDER BY a.k, b.k) AS o FROM me a JOIN me b ON a."table" = b."table" AND a.k < b.k) WHERE o <= 2),
    f AS (SELECT c.*, xr.inferred_type = 'Date' AS dated, xr.distinct_count <= greatest(20, floor(xr.row_count * 0.05)) AS low, coalesce(1 - yr.null_rate, 0) AS cover, least(1, coalesce(yr.distinct_count / greatest(1, yr.row_count), 0)) AS share
      FROM c JOIN r xr ON xr."table" = c."table" AND xr."column" = c.x LEFT JOIN r yr ON yr."table" = c."table" AND yr."column" = c.y),
    s AS (SELECT *, round_even(greatest(0, least(1, {base(0)} + 0.18 * cover + 0.22 * share + CASE WHEN dated THEN 0.14 WHEN low THEN 0.08 ELSE -0.04 END + CASE WHEN agg IN ('sum', 'avg') THEN 0.05 ELSE 0 END)), 3)::DOUBLE AS score,
      round_even(greatest(0, least(1, {base(1)} + 0.3 * share + 0.15 * cover + CASE WHEN dated THEN 0.08 WHEN low THEN 0.04 ELSE 0 END)), 3)::DOUBLE AS impact FROM f)
    SELECT "table", chart, x, y, agg, bin, score, impact, row_number() OVER (PARTITION BY "table" ORDER BY score DESC, impact DESC, g)::INTEGER AS rank FROM s QUALIFY rank <= 12"""


query(
    "column_roles_compat",
    f"""WITH p AS ({' UNION ALL '.join(profile_sql(n, n) for n in PROFILED)}) SELECT "table", "column", CASE WHEN inferred_type = 'Date' THEN 'Time' WHEN contains(lower("column"), 'id')
    OR (inferred_type IN ('String', 'Category') AND distinct_count >= 0.98 * row_count AND row_count > 0) THEN 'Id' WHEN inferred_type = 'Number' THEN 'Measure' ELSE 'Category' END AS role FROM p""",
)(lambda t: recommend.roles(profiled(t), compat=True).select("table", "column", "role"))
query("column_roles", f'WITH {roles_sql(*PROFILED)} SELECT "table", "column", inferred_type, role FROM r')(lambda t: recommend.roles(profiled(t)).select("table", "column", "inferred_type", "role"))
query("recommend_orders", recommend_sql("orders"))(lambda t: recommend.recommend(profile.profile(t("orders"), table="orders")).drop("criteria"))
query("recommend_chosen", f"SELECT * FROM ({recommend_sql('orders')}) WHERE chart = 'bar' AND score >= 0.5 AND contains(lower(concat_ws(' ', x, y)), 'price')")(
    lambda t: recommend.choose(recommend.recommend(profile.profile(t("orders"), table="orders")), "bar", 0.5, "Price", "impact").drop("criteria")
)
query(
    "recommend_criteria",
    f"""WITH r AS (SELECT * FROM ({recommend_sql('orders')})), p AS ({profile_sql('orders')}), b AS (SELECT r.chart, r.x, r.y, r.agg, px.inferred_type = 'Date' AS timed, px.distinct_count <= greatest(20, floor(px.row_count * 0.05)) AS few,
      coalesce(1 - py.null_rate, 0) >= 0.95 AS whole, coalesce(py.distinct_count / greatest(1, py.row_count), 0) >= 0.5 AS many FROM r JOIN p px ON px."column" = r.x LEFT JOIN p py ON py."column" = r.y)
    SELECT chart, x, y, array_to_string(list_filter([CASE WHEN whole THEN 'the measure is almost complete' END, CASE WHEN many THEN 'the measure takes many values' END, CASE WHEN timed THEN 'the axis is time' END,
      CASE WHEN few THEN 'the axis has few values' END, CASE WHEN agg IN ('sum', 'avg') THEN 'rows are summarised' END], lambda c: c IS NOT NULL)[1:5], '; ') AS criteria FROM b""",
)(lambda t: recommend.recommend(profile.profile(t("orders"), table="orders")).select("chart", "x", "y", F.array_join("criteria", "; ").alias("criteria")))
query("profile_sample", profile_sql("(SELECT * FROM orders LIMIT 700)", columns=PROFILED["orders"]))(lambda t: profile.profile(t("orders"), sample_rows=700))
query("recommend_all_tables", recommend_sql(*PROFILED))(lambda t: recommend.recommend(profiled(t)).drop("criteria"))

# ---- signals -----------------------------------------------------------------------------------------------

BY = ["series"]
TREND = f"""{NUMBERED}, tr0 AS (SELECT series, n, coalesce(regr_slope(y, i), 0) * (n - 1) / greatest(abs(avg(y)), 1e-9::DOUBLE) AS c FROM pts GROUP BY series, n),
tr AS (SELECT series, n, CASE WHEN n < 4 OR abs(c) < 0.06 THEN 'Flat' WHEN c > 0 THEN 'Up' ELSE 'Down' END AS trend, CASE WHEN n < 4 THEN 0 ELSE least(1, abs(c) / CASE WHEN abs(c) < 0.06 THEN 0.06::DOUBLE ELSE 0.35::DOUBLE END) END AS ts FROM tr0)"""
VOLATILITY = """vo0 AS (SELECT series, stddev_pop(y) / greatest(abs(avg(y)), 1e-9::DOUBLE) AS cv FROM daily GROUP BY 1),
vo AS (SELECT series, CASE WHEN cv < 0.15 THEN 'Low' WHEN cv < 0.45 THEN 'Medium' ELSE 'High' END AS volatility, CASE WHEN cv < 0.15 THEN 0.1::DOUBLE WHEN cv < 0.45 THEN 0.2::DOUBLE ELSE 0.35::DOUBLE END AS vs FROM vo0)"""
FENCES = """fe AS (SELECT series, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS s, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM daily GROUP BY 1),
ma AS (SELECT d.*, f.n, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM daily d JOIN fe f USING (series)), ou0 AS (SELECT series, n, count(*) FILTER (y < lo OR y > hi) AS c FROM ma GROUP BY ALL),
ou AS (SELECT series, c AS outlier_count, CASE WHEN c = 0 THEN 'None' WHEN c / n <= 0.02 OR c <= 3 THEN 'Few' ELSE 'Many' END AS outliers, least(1, c / n * 8)::DOUBLE AS os FROM ou0)"""
SEASON = """wm AS (SELECT series, dayofweek(x) AS b, avg(y) AS m FROM daily GROUP BY ALL), se0 AS (SELECT w.series, stddev_pop(m) / any_value(s) AS st FROM wm w JOIN (SELECT series, stddev_pop(y) AS s FROM daily GROUP BY 1) a USING (series) GROUP BY 1),
se AS (SELECT series, CASE WHEN st >= 0.45 THEN 'Strong' WHEN st >= 0.25 THEN 'Weak' ELSE 'None' END AS seasonality, least(1, CASE WHEN st < 0.25 THEN st / 2 ELSE st END) AS ss FROM se0)"""
query("signals_trend", f"WITH {TREND} SELECT series, trend, round(ts, 4) AS trend_strength FROM tr")(lambda t: signals.trend(daily(t), BY))
query("signals_volatility", f"WITH {DAILY}, {VOLATILITY} SELECT series, volatility, vs AS volatility_strength FROM vo")(lambda t: signals.volatility(daily(t), BY))
query("signals_outliers", f"WITH {DAILY}, {FENCES} SELECT series, outliers, outlier_count, round(os, 4) AS outlier_strength FROM ou")(lambda t: signals.outliers(daily(t), BY))
query("outlier_rows", f"WITH {DAILY}, {FENCES}, r AS (SELECT series, x, y, greatest(lo - y, y - hi) AS distance FROM ma WHERE y < lo OR y > hi), k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY distance DESC, x) AS rank FROM r) SELECT series, x, round(y, 2) AS y, round(distance, 2) AS distance, rank::INTEGER AS rank FROM k WHERE rank <= 5", 2)(lambda t: signals.outlier_rows(daily(t), BY))
query("signals_seasonality", f"WITH {DAILY}, {SEASON} SELECT series, seasonality, round(ss, 4) AS seasonality_strength FROM se")(lambda t: signals.seasonality(daily(t), BY))
query(
    "signals_confidence",
    f"""WITH {TREND}, {VOLATILITY}, {FENCES}, {SEASON} SELECT series, tr.n, trend, volatility, outliers, seasonality, outlier_count,
    round(greatest(0.1, least(0.95, 0.2 + CASE WHEN tr.n >= 500 THEN 0.4 WHEN tr.n >= 100 THEN 0.3 WHEN tr.n >= 30 THEN 0.2 WHEN tr.n >= 10 THEN 0.12 ELSE 0.05 END + 0.35 * (ts + vs + os + ss) / 4)), 4)::DOUBLE AS confidence
    FROM tr JOIN vo USING (series) JOIN ou USING (series) JOIN se USING (series)""",
)(lambda t: signals.signals(daily(t), BY))

# ---- evidence and forecasts --------------------------------------------------------------------------------

query(
    "quality_table",
    f"""WITH nulls AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, count(*) FILTER (coalesce(trim({c}::VARCHAR), '') = '') / count(*) AS r FROM orders" for c in PROFILED['orders'].split())}),
    d AS (SELECT greatest(count(DISTINCT o_orderkey), count(DISTINCT o_custkey), count(DISTINCT o_totalprice), count(DISTINCT o_orderdate)) AS d, count(*) AS n FROM orders)
    SELECT n AS rows, (SELECT count(*) FROM nulls) AS columns, (SELECT avg(r) FROM nulls) AS mean_null_rate, (SELECT max(r) FROM nulls) AS max_null_rate, (SELECT c FROM nulls ORDER BY r DESC, c LIMIT 1) AS max_null_column, round(greatest(0, 1 - d / n), 4)::DOUBLE AS duplicate_rate_est,
    (SELECT min(o_orderdate) FROM orders) AS first, (SELECT max(o_orderdate) FROM orders) AS last, (SELECT count(*) FILTER (trim(o_orderdate::VARCHAR) <> '' AND try_cast(o_orderdate::VARCHAR AS TIMESTAMP) IS NULL) FROM orders) AS unparsable_dates, (SELECT count(*) FROM orders WHERE o_totalprice < 0) AS negative_values,
    (SELECT abs((avg(o_totalprice) - median(o_totalprice)) / stddev_pop(o_totalprice)) >= 1.5 FROM orders) AS extreme_skew FROM d""",
)(lambda t: evidence.quality(t("orders"), "o_orderdate", "o_totalprice"))
query(
    "quality_texts",
    f"""WITH t AS (SELECT * REPLACE (CASE WHEN o_orderkey % 17 = 0 THEN 'no date' ELSE day END AS day) FROM {TEXTS.replace("SELECT CASE", "SELECT o_orderkey, CASE", 1)}),
    nulls AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, count(*) FILTER (coalesce(trim({c}::VARCHAR), '') = '') / count(*) AS r FROM t" for c in ("o_orderkey", "day", "price"))})
    SELECT count(*) AS rows, round((SELECT max(r) FROM nulls), 4)::DOUBLE AS max_null_rate, (SELECT c FROM nulls ORDER BY r DESC, c LIMIT 1) AS max_null_column,
    min(d) AS first, max(d) AS last, count(*) FILTER (coalesce(trim(day), '') <> '' AND d IS NULL) AS unparsable_dates
    FROM (SELECT *, coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%d/%m/%Y'), CASE WHEN length(day) = 8 THEN try_strptime(day, '%Y%m%d') END) AS d FROM t)""",
)(lambda t: evidence.quality(dated_texts(t), "day", "price").select("rows", "max_null_rate", "max_null_column", "first", "last", "unparsable_dates"))
query(
    "distribution_stats",
    """WITH q AS (SELECT event_type AS series, count(*) AS n, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS stddev, min(value) AS min, max(value) AS max, quantile_cont(value, 0.05) AS p05,
    quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1)
    SELECT series, n, round(mean, 4) AS mean, round(median, 4) AS median, round(stddev, 4) AS stddev, round(min, 4) AS min, round(max, 4) AS max, round(p05, 4) AS p05, round(p25, 4) AS p25, round(p75, 4) AS p75, round(p95, 4) AS p95,
    round(p75 - p25, 4) AS iqr, round(stddev / abs(mean), 4) AS cv, round((mean - median) / stddev, 4) AS skew FROM q""",
)(lambda t: evidence.distribution(t("events").select(F.col("event_type").alias("series"), F.col("value").alias("y")), BY))
query(
    "timeseries_stats",
    f"""WITH {NUMBERED}, s AS (SELECT series, n, regr_slope(y, i) AS slope, avg(y) AS m, stddev_pop(y) AS sd FROM pts GROUP BY series, n)
    SELECT series, n, round(slope, 2) AS slope, CASE WHEN slope > 0.01 * abs(m) THEN 'Rising' WHEN slope < -0.01 * abs(m) THEN 'Falling' ELSE 'Flat' END AS trend, round(sd / abs(m), 2) AS volatility_ratio, round(m - sd, 2) AS band_low, round(m + sd, 2) AS band_high FROM s""",
    2,
)(lambda t: evidence.series_stats(daily(t), BY))


def pattern_sql(bucket: str) -> str:
    return f"WITH {DAILY}, a AS (SELECT series, count(*) AS n, stddev_pop(y) AS s FROM daily GROUP BY 1), b AS (SELECT series, {bucket}(x) AS b, avg(y) AS m FROM daily GROUP BY ALL) SELECT series, n, round(stddev_pop(m) / s, 4) AS strength FROM b JOIN a USING (series) GROUP BY series, n, s"


query("pattern_strength", pattern_sql("dayofweek"))(lambda t: evidence.pattern_strength(daily(t), "weekday", BY))
query("pattern_strength_month", pattern_sql("month"))(lambda t: evidence.pattern_strength(daily(t), "month", BY))
query(
    "change_points",
    f"""WITH {NUMBERED}, z AS (SELECT *, greatest(3, least(20, n // 8)) AS w FROM pts), c AS (SELECT a.series, a.x, avg(b.y) FILTER (b.i < a.i) AS before, avg(b.y) FILTER (b.i >= a.i) AS after FROM z a JOIN z b ON b.series = a.series AND b.i >= a.i - a.w AND b.i < a.i + a.w
    WHERE a.n >= 12 AND a.i >= a.w AND a.i < a.n - a.w GROUP BY a.series, a.x, a.i), k AS (SELECT *, abs(after - before) AS shift, row_number() OVER (PARTITION BY series ORDER BY round(abs(after - before), 6) DESC, x) AS rank FROM c)
    SELECT series, x, round(before, 5) AS before, round(after, 5) AS after, round(shift, 5) AS shift, rank::INTEGER AS rank FROM k WHERE rank <= 3""",
    5,
)(lambda t: evidence.change_points(daily(t), BY))
query(
    "segment_breakdown",
    f"""WITH {DAILY}, s AS (SELECT series, sum(y) AS total, 1 / (1 + stddev_pop(y) / abs(avg(y))) AS stability FROM daily GROUP BY 1 ORDER BY abs(total) DESC, series LIMIT 10),
    p AS (SELECT *, abs(total) / sum(abs(total)) OVER () * 100 AS share FROM s), q AS (SELECT *, avg(share) OVER () AS sm, stddev_pop(share) OVER () AS sd, row_number() OVER (ORDER BY abs(total) DESC, series) AS rank FROM p)
    SELECT series AS segment, round(total, 2) AS total, round(share, 2) AS share_percent, round(stability, 2) AS stability, sd > 1e-9 AND abs(share - sm) > 2 * sd AS outlier, rank::INTEGER AS rank FROM q""",
    2,
)(lambda t: evidence.segment_breakdown(daily(t)))


def monthly(t) -> DataFrame:
    return charts.time_series(t("orders"), "o_orderdate", "o_totalprice", "month", "sum", "o_orderpriority").withColumnRenamed("value", "y")


MONTHLY = NUMBERED.replace("'day'", "'month'")
MODEL = "fig AS (SELECT series, n, max(x) AS last_x, max_by(y, x) AS last_y, regr_slope(y, i) AS a, regr_intercept(y, i) AS b FROM pts GROUP BY series, n)"


def forecast_sql(errors: str, value: str, more: str = "") -> str:
    return f"""WITH RECURSIVE {MONTHLY}, {MODEL}, er AS ({errors}), es AS (SELECT series, stddev_pop(e) AS sd, sqrt(avg(e * e)) AS rmse FROM er GROUP BY 1){more}
    SELECT f.series, k::INTEGER AS step, (last_x + to_months(k::INTEGER))::TIMESTAMP AS x, round({value}, 2) AS forecast, round({value} - 1.64::DOUBLE * sd, 2) AS lower, round({value} + 1.64::DOUBLE * sd, 2) AS upper, round(sd, 2) AS residual_std, round(rmse, 2) AS rmse
    FROM fig f JOIN es USING (series), range(1, 13) r(k)"""


query("forecast_naive", forecast_sql("SELECT series, y - lag(y) OVER (PARTITION BY series ORDER BY x) AS e FROM pts", "last_y"), 2)(lambda t: forecast.forecast(monthly(t), "naive", 12, "month", BY))
query("forecast_linear", forecast_sql("SELECT series, y - (b + a * i) AS e FROM pts JOIN fig USING (series)", "(b + a * (n - 1 + k))"), 2)(lambda t: forecast.forecast(monthly(t), "linear", 12, "month", BY))
query(
    "forecast_moving_average",
    forecast_sql(
        "SELECT series, y - avg(y) OVER (PARTITION BY series ORDER BY x ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS e, i FROM pts QUALIFY i >= 5",
        "v.forecast",
        """, st AS (SELECT series, 0 AS k, list(y ORDER BY i) FILTER (i >= n - 5) AS tail, NULL::DOUBLE AS forecast FROM pts GROUP BY series UNION ALL
        SELECT series, k + 1, list_append(tail[2:], list_avg(tail)), list_avg(tail) FROM st WHERE k < 12), v AS (SELECT series, k AS step, forecast FROM st WHERE k > 0)""",
    ).replace("range(1, 13) r(k)", "range(1, 13) r(k), v WHERE v.series = f.series AND v.step = k"),
    2,
)(lambda t: forecast.forecast(monthly(t), "moving_average", 12, "month", BY))


query("segments_hidden", f"SELECT 'segment' AS segment, total, share_percent, stability, outlier, rank FROM ({ORACLES['segment_breakdown']})", 2)(lambda t: evidence.segment_breakdown(daily(t), sensitive=True))


def every_fact(t) -> DataFrame:
    """Facts of series, segments, forecasts and a scenario."""
    return evidence.all_facts(
        evidence.facts(evidence.series_stats(daily(t), BY), "TS", ["slope", "volatility_ratio"], "y", BY),
        evidence.facts(evidence.segment_breakdown(daily(t)), "SEG", ["total", "share_percent"], None, ["segment"]),
        evidence.facts(forecast.forecast(monthly(t), "naive", 12, "month", BY), "FORECAST", ["forecast", "upper"], None, ["series", "step"]),
        evidence.facts(whatif.what_if_summary(clamped(t)), "SCN", ["mean_delta", "sum_delta", "max_delta"], "price"),
    )


def facts_sql(source: str, prefix: str, values: list[str], name: str | None = None, keys: tuple[str, ...] = ()) -> str:
    ident = "".join(f" || '_' || regexp_replace(upper({k}::VARCHAR), '[^A-Z0-9]', '_', 'g')" for k in keys)
    words = "".join(f" || ' ' || {k}::VARCHAR" for k in keys)
    named, of = (f"_{name.upper()}", f" of {name}") if name else ("", "")
    return " UNION ALL ".join(f"SELECT '{prefix}_{v.upper()}{named}'{ident} AS evidence_id, '{v}{of}'{words} AS claim, {v} AS value FROM ({ORACLES[source]})" for v in values)


query(
    "evidence_facts_all",
    " UNION ALL ".join([
        facts_sql("timeseries_stats", "TS", ["slope", "volatility_ratio"], "y", ("series",)), facts_sql("segment_breakdown", "SEG", ["total", "share_percent"], None, ("segment",)),
        facts_sql("forecast_naive", "FORECAST", ["forecast", "upper"], None, ("series", "step")), facts_sql("whatif_conclusion", "SCN", ["mean_delta", "sum_delta", "max_delta"], "price"),
    ]),
    2,
)(every_fact)


def known_facts(t) -> DataFrame:
    rows = t("events").select(F.col("event_type").alias("series"), F.col("value").alias("y"))
    return evidence.all_facts(
        evidence.facts(evidence.distribution(rows, BY), "DIST", ["mean", "stddev", "median"], "value", BY),
        evidence.facts(signals.moments(rows).select("n", "min", "max"), "DQ", ["n", "min", "max"], "value"),
    )


FACTS = """q AS (SELECT event_type AS series, avg(value) AS mean, stddev_pop(value) AS stddev, median(value) AS median FROM events GROUP BY 1), z AS (SELECT count(*)::DOUBLE AS n, min(value) AS min, max(value) AS max FROM events),
facts AS (SELECT 'DIST_' || upper(k) || '_VALUE_' || regexp_replace(upper(series), '[^A-Z0-9]', '_', 'g') AS evidence_id, k || ' of value ' || series AS claim, v AS value FROM (SELECT series, unnest(['mean', 'stddev', 'median']) AS k, unnest([mean, stddev, median]) AS v FROM q)
UNION ALL SELECT 'DQ_' || upper(k) || '_VALUE', k || ' of value', v FROM (SELECT unnest(['n', 'min', 'max']) AS k, unnest([n, min, max]) AS v FROM z))"""


def cites(t) -> DataFrame:
    kind = F.when(F.col("event_id") % 7 == 0, F.lit("made_up")).otherwise(F.concat(F.lit("dist_mean_value_"), F.col("event_type")))
    return t("events").select("event_id", coerce.evidence_id(kind).alias("evidence_id"))


CITES = "cites AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'MADE_UP' ELSE 'DIST_MEAN_VALUE_' || regexp_replace(upper(event_type), '[^A-Z0-9]', '_', 'g') END AS evidence_id FROM events)"
query("evidence_facts", f"WITH {FACTS} SELECT evidence_id, claim, round(value, 4) AS value FROM facts")(known_facts)
query("citation_check", f"WITH {FACTS}, {CITES} SELECT event_id, evidence_id FROM cites WHERE evidence_id NOT IN (SELECT evidence_id FROM facts)")(lambda t: evidence.unknown_citations(cites(t), known_facts(t)).select("event_id", "evidence_id"))
query("citation_usage", f"WITH {FACTS}, {CITES} SELECT evidence_id, count(*) AS used FROM cites WHERE evidence_id IN (SELECT evidence_id FROM facts) GROUP BY 1 ORDER BY used DESC, evidence_id LIMIT 10")(lambda t: evidence.citation_usage(cites(t), known_facts(t)))

# ---- retention, redaction, questions -----------------------------------------------------------------------

query("retention_expired", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY")(lambda t: tables.expired(t("events"), "ts", "2024-01-20", 10).select("event_id"))
query("redact_customer", "SELECT c_custkey, c_nationkey, round(c_acctbal, 4) AS c_acctbal FROM customer")(lambda t: redact.redact(t("customer"), ["name", "segment"]))
query("redact_profile_rows", "SELECT n_nationkey, n_name FROM nation WHERE NOT regexp_matches(lower(n_name), 'an|ia')")(lambda t: redact.redact_rows(t("nation").select("n_nationkey", "n_name"), "n_name", ["AN", "ia"]))
query(
    "question_intent",
    """WITH q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS s FROM conversations), i AS (SELECT *, CASE WHEN contains(s, 'tend') OR contains(s, 'trend') THEN 'Trend' WHEN contains(s, 'outlier') OR contains(s, 'anom') THEN 'Outliers'
    WHEN contains(s, 'break') OR contains(s, 'quebra') THEN 'Breakdown' ELSE 'Compare' END AS intent FROM q) SELECT conv_id, turn, intent, CASE WHEN intent = 'Trend' THEN 'line' ELSE 'bar' END AS chart FROM i""",
)(lambda t: questions.classify_intent(t("conversations")).select("conv_id", "turn", "intent", "chart"))


query("csv_bad_rows", "SELECT FALSE AS tolerant, count(*) FILTER (event_id % 10 <> 0) AS rows, count(*) FILTER (event_id % 10 <> 0) AS types FROM events UNION ALL SELECT TRUE, count(*), count(*) FILTER (event_id % 10 <> 0) FROM events")(bad_csv)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue of finished orders with empty months shown."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return charts.fill_gaps(charts.time_series(orders, "o_orderdate", "o_totalprice", "month", "sum", filters=F_ORDERS), "month")
