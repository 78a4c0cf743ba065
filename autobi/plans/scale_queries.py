"""Queries for what must hold at any size: dialects and ledgers of CSV files, row numbers, deep pages, selection, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autobi.operators import browse, charts, evidence, pages, percentiles, profile_store, recommend, search_index, signals
from autobi.plans.queries import DAILY_ALL, LEVELS_SQL, TEXTS, all_daily, profile_sql, query, recommend_sql, texts
from autobi.sources import dialect, ledger, tables

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def dialects(t) -> DataFrame:
    """Customers written in three dialects, detected and read back."""
    spark = t("customer").sparkSession
    customer, out = t("customer").select(CUSTOMER), None
    named = customer.withColumn("c_name", F.concat(F.col("c_name"), F.lit("; a, b\tc")))  # every delimiter within a field
    for sep, quote, header in ((";", '"', True), ("\t", "'", True), (",", '"', False)):
        path = tables.scratch(spark)
        named.coalesce(1).write.options(sep=sep, quote=quote, header=header, quoteAll=True).csv(path)
        found = dialect.detect(spark, path)
        rows = tables.scan_csv(spark, path, dialect=found).toDF(*CUSTOMER)
        one = rows.agg(F.lit(found.delimiter).alias("delimiter"), F.lit(found.quote).alias("quote"), F.lit(found.header).alias("header"), F.count("*").alias("rows"), F.sum(F.col("c_acctbal").cast("double")).alias("balance"), F.sum(F.length("c_name")).alias("letters"))
        out = one if out is None else out.unionByName(one)
    return out


query(
    "csv_dialects",
    """SELECT delimiter, quote, header, count(*) AS rows, round(sum(c_acctbal), 2) AS balance, sum(length(c_name) + 8)::BIGINT AS letters FROM customer, (VALUES (';', '"', TRUE), (chr(9), '''', TRUE), (',', '"', FALSE)) d(delimiter, quote, header) GROUP BY ALL""",
    2,
)(dialects)


def spoiled(t, share: int):
    """Orders as lines of CSV: one price in ``share`` is no number, one date in 3000 no date, one row in 1000 too short."""
    spark, key = t("orders").sparkSession, F.col("o_orderkey")
    price = F.when(key % share == 7, F.concat(F.lit("about "), F.col("o_totalprice").cast("string"))).otherwise(F.col("o_totalprice").cast("string"))
    day = F.when(key % 3000 == 11, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    whole = F.concat_ws(",", key, "o_orderpriority", price, day)
    line = F.when(key % 1000 == 5, F.concat_ws(",", key, "o_orderpriority")).otherwise(whole)
    path = tables.scratch(spark)
    t("orders").orderBy("o_orderkey").select(F.concat_ws("\n", *[F.when(key == least, F.lit("key,priority,price,day")) for least in [t("orders").agg(F.min("o_orderkey")).first()[0]]], line).alias("value")).coalesce(1).write.text(path)
    return ledger.ingest(spark, path, tables.scratch(spark))


SPOILED = "FROM orders WHERE "


def ledger_counts(t) -> DataFrame:
    found = spoiled(t, 500)
    return found.summary().join(F.broadcast(found.rows.agg(F.sum("price").alias("price"), F.max("day").alias("last"), F.max("row_id").alias("top")))).withColumn("lifted", F.lit(len(found.lifted)))  # one row each


BAD = "(o_orderkey % 1000 = 5 OR o_orderkey % 500 = 7 OR o_orderkey % 3000 = 11)"
query(
    "ledger_counts",
    f"""WITH n AS (SELECT *, {BAD} AS bad, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) SELECT count(*) AS rows_in, count(*) FILTER (NOT bad) AS rows, count(*) FILTER (bad) AS rejected, count(*) FILTER (bad) AS reasons,
    round(sum(o_totalprice) FILTER (NOT bad), 2) AS price, max(date_trunc('day', o_orderdate)) FILTER (NOT bad) AS last, max(i) FILTER (NOT bad) AS top, 0 AS lifted FROM n""",
    2,
)(ledger_counts)
query(
    "ledger_rejects",
    f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_id FROM orders) SELECT row_id, CASE WHEN o_orderkey % 1000 = 5 THEN NULL WHEN o_orderkey % 500 = 7 THEN 'price' ELSE 'day' END AS "column",
    CASE WHEN o_orderkey % 1000 = 5 THEN 'width' WHEN o_orderkey % 500 = 7 THEN 'not a number' ELSE 'not a date' END AS reason,
    CASE WHEN o_orderkey % 1000 = 5 THEN o_orderkey || ',' || o_orderpriority WHEN o_orderkey % 500 = 7 THEN NULL ELSE 'soon' END AS text FROM n WHERE {BAD}""",
)(lambda t: spoiled(t, 500).rejects.withColumn("text", F.when(F.col("reason") != "not a number", F.col("text"))))
query(
    "ledger_lifted",
    """SELECT count(*) AS rows, 'price' AS lifted, count(*) FILTER (o_orderkey % 20 = 7) AS texts FROM orders WHERE o_orderkey % 1000 <> 5 AND o_orderkey % 3000 <> 11""",
)(lambda t: (lambda found: found.rows.agg(F.count("*").alias("rows"), F.lit(",".join(found.lifted)).alias("lifted"), F.count_if(F.col("price").startswith("about ")).alias("texts")))(spoiled(t, 20)))

query("row_numbers", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS row_id FROM events")(lambda t: tables.with_row_number(t("events")).select("event_id", "row_id"))


def deep_page(t) -> DataFrame:
    spark, rules = t("lineitem").sparkSession, (("l_extendedprice", "desc"), ("l_linenumber", "asc"))
    rows = t("lineitem").select(F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", F.lpad(F.col("l_partkey").cast("string"), 12, "0")).alias("id"), "l_linenumber", "l_extendedprice")
    index = pages.build(rows, tables.scratch(spark), "id", rules, rows=4000)
    return pages.page(spark, index, 60, 50)


query(
    "deep_page",
    "SELECT id, l_linenumber, round(l_extendedprice, 4) AS l_extendedprice FROM (SELECT lpad(l_orderkey::VARCHAR, 12, '0') || '-' || l_linenumber || '-' || lpad(l_partkey::VARCHAR, 12, '0') AS id, l_linenumber, l_extendedprice FROM lineitem) ORDER BY lineitem_price DESC, l_linenumber, id LIMIT 50 OFFSET 2950".replace("lineitem_price", "l_extendedprice"),
)(deep_page)

query("percentiles_bounded", f"SELECT {LEVELS_SQL.format(y='l_extendedprice')} FROM lineitem")(lambda t: percentiles.percentiles(t("lineitem"), "l_extendedprice", bounded=True))
query("percentiles_bounded_by_flag", f"SELECT l_returnflag, {LEVELS_SQL.format(y='l_extendedprice')} FROM lineitem GROUP BY 1")(lambda t: percentiles.percentiles(t("lineitem"), "l_extendedprice", ["l_returnflag"], bounded=True))

query("ffill_all", f"WITH {DAILY_ALL} SELECT x, round(last_value(y IGNORE NULLS) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS y FROM daily", 2)(lambda t: charts.ffill(all_daily(t), "y"))
query("changes_all", f"WITH {DAILY_ALL} SELECT x, round(y, 2) AS y, round(y - lag(y) OVER (ORDER BY x), 2) AS diff FROM daily", 2)(lambda t: charts.diff(all_daily(t), "y"))
query(
    "trailing_means_all",
    f"WITH {DAILY_ALL} SELECT x, round(y, 5) AS y, round(CASE WHEN row_number() OVER (ORDER BY x) > 7 THEN avg(y) OVER (ORDER BY x ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END, 5) AS trailing_mean FROM daily",
    5,
)(lambda t: charts.trailing_mean(all_daily(t), 7))
query("slope_all", f"WITH {DAILY_ALL}, i AS (SELECT y, row_number() OVER (ORDER BY x) - 1 AS i FROM daily WHERE y IS NOT NULL) SELECT round(regr_slope(y, i), 4) AS slope, round(regr_intercept(y, i), 4) AS intercept FROM i")(lambda t: signals.slope(all_daily(t)))
query(
    "change_points_all",
    f"""WITH {DAILY_ALL}, p AS (SELECT x, y, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n, greatest(3, least(20, (count(*) OVER ()) // 8)) AS w FROM daily WHERE y IS NOT NULL),
    m AS (SELECT p.x, (SELECT avg(q.y) FROM p q WHERE q.i >= p.i - p.w AND q.i < p.i) AS before, (SELECT avg(q.y) FROM p q WHERE q.i >= p.i AND q.i < p.i + p.w) AS after FROM p WHERE i >= w AND i + w < n AND n >= 12)
    SELECT x, round(before, 5) AS before, round(after, 5) AS after, round(abs(after - before), 5) AS shift, row_number() OVER (ORDER BY round(abs(after - before), 6) DESC, x) AS rank FROM m ORDER BY rank LIMIT 3""",
    5,
)(lambda t: evidence.change_points(all_daily(t)))

query("heavy_values", "SELECT l_partkey::VARCHAR AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, value LIMIT 12")(lambda t: browse.heavy_values(t("lineitem"), "l_partkey", buckets=512))
query("heavy_words", "SELECT event_type AS value, count(*) AS count FROM events WHERE trim(event_type) <> '' GROUP BY 1 ORDER BY count DESC, value LIMIT 3")(lambda t: browse.heavy_values(t("events"), "event_type", 3))
SAME = "l_returnflag, l_linestatus, l_quantity, l_discount"
query(
    "duplicate_rows",
    f"WITH d AS (SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT {SAME} FROM lineitem)) AS distinct_rows FROM lineitem) SELECT rows, distinct_rows, rows - distinct_rows AS duplicate_rows, round((rows - distinct_rows) / rows, 4) AS duplicate_rate FROM d",
)(lambda t: evidence.duplicates(t("lineitem"), SAME.split(", ")))


def stored(rows: DataFrame, first) -> tuple:
    """Rows written to a folder in two goes, the profile store brought up to date after each."""
    spark = rows.sparkSession
    path, store = tables.scratch(spark), tables.scratch(spark)
    for part in (rows.where(first), rows.where(~first)):
        part.write.mode("append").parquet(path)
        profile_store.update(spark, path, store)
    return spark, path, store


query("profile_store", profile_sql("orders"))(lambda t: profile_store.profile(*stored(t("orders"), F.col("o_orderkey") % 3 == 0)))
query("profile_store_texts", profile_sql(TEXTS, columns="day price mixed flag priority empty"))(lambda t: profile_store.profile(*stored(texts(t), F.col("mixed").contains("7"))))
query("profile_store_recommend", recommend_sql("orders"))(lambda t: recommend.recommend(profile_store.profile(*stored(t("orders"), F.col("o_custkey") % 2 == 0), table="orders")).drop("criteria"))
query(
    "profile_store_top_values",
    " UNION ALL ".join(f"(SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS count FROM customer GROUP BY ALL ORDER BY count DESC, value LIMIT 3)" for c in CUSTOMER),
)(lambda t: profile_store.top_values(*stored(t("customer").select(CUSTOMER), F.col("c_custkey") % 2 == 0)))


def searched(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows written in ranges of the key, one file each, indexed and searched."""
    spark = rows.sparkSession
    path, store = tables.scratch(spark), tables.scratch(spark)
    rows.repartitionByRange(16, key).write.parquet(path)
    search_index.update(spark, path, store)
    return search_index.search(spark, path, store, text)


query(
    "search_indexed",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey::VARCHAR LIKE '%0012%' OR lower(c_name) LIKE '%0012%' OR c_nationkey::VARCHAR LIKE '%0012%' OR c_acctbal::VARCHAR LIKE '%0012%' OR lower(c_mktsegment) LIKE '%0012%'",
)(lambda t: searched(t("customer").select(CUSTOMER), "c_custkey", "0012").select("c_custkey", "c_name"))
query(
    "search_indexed_dates",
    "SELECT o_orderkey FROM orders WHERE o_orderkey::VARCHAR LIKE '%1996-02-2%' OR o_custkey::VARCHAR LIKE '%1996-02-2%' OR lower(o_orderstatus) LIKE '%1996-02-2%' OR o_totalprice::VARCHAR LIKE '%1996-02-2%' OR o_orderdate::VARCHAR LIKE '%1996-02-2%' OR lower(o_orderpriority) LIKE '%1996-02-2%'",
)(lambda t: searched(t("orders"), "o_orderdate", "1996-02-2").select("o_orderkey"))
