"""What must hold at any size: dialects, ledgers, row numbers, deep pages, selection, scans."""

import random

import pytest
from autobi.operators import browse, charts, evidence, pages, percentiles, profile, selection, signals
from autobi.operators import scan as scans
from autobi.plans.registry import QUERIES
from autobi.plans.spec import Filter
from autobi.sources import dialect, ledger, tables
from pyspark.sql import functions as F
from tests.helpers import day, rows, series

BODY = [("10001", "Ann, B.", "1.5", "2024-01-02"), ("10002", 'Bo "x"', "2,500", "2024-01-03"), ("10003", "C; D", "-3", "2024-02-03")]


def lines(sep, quote, header=("id", "name", "amount", "day")):
    cell = lambda v: quote + v.replace(quote, quote * 2) + quote if any(c in v for c in (sep, quote)) else v
    return [sep.join(map(cell, r)) for r in ([header] if header else []) + BODY * 5]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
@pytest.mark.parametrize("quote", ['"', "'"])
@pytest.mark.parametrize("header", [("id", "name", "amount", "day"), None])
def test_dialects(sep, quote, header):
    found = dialect.of_lines(lines(sep, quote, header))
    assert (found.delimiter, found.header, found.columns) == (sep, bool(header), header or ("c0", "c1", "c2", "c3"))
    assert dialect.cut(lines(sep, quote, header), found.delimiter, found.quote)[-1] == list(BODY[-1])


def test_dialects_of_odd_files():
    assert dialect.of_lines([]) == dialect.Dialect()
    assert dialect.of_lines(["name", "Ann", "Bo"]).columns == ("name",)
    assert dialect.of_lines(["a;b", "c;d", "e;f"]).header and not dialect.of_lines(["a;b", "c;d", "a;f"]).header
    assert dialect.of_lines(["x,,x,y", "1,2,3,4", "2,3,4,5"]).header is False
    assert dialect.names(["a", " ", "A", "a"], True) == ("a", "c1", "A_2", "a_3")
    assert dialect.of_lines(["1,5;2", "2,5;3", "3,5;4"]).delimiter == ";"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_semicolon_file_without_header_is_ingested(spark, tmp_path):
    path = write(tmp_path / "s.csv", "﻿1;\"a;b\";2024-01-01\n2;c;2024-01-02\n3;d;2024-01-03\n")
    found = dialect.detect(spark, path)
    assert (found.delimiter, found.header, len(found.columns)) == (";", False, 3)
    assert [r.c1 for r in tables.scan_csv(spark, path, dialect=found).collect()] == ["a;b", "c", "d"]
    out = str(tmp_path / "t")
    assert rows(tables.ingest_csv(spark, path, out)) == [(out, 3)]
    assert dict(spark.read.parquet(out).dtypes)["c2"] == "timestamp_ntz"


def test_ledger_accounts_for_every_row(spark, tmp_path):
    text = ["n,word,day"] + [f"{k},w{k},2024-01-{k % 28 + 1:02d}" for k in range(300)]
    text[5], text[9], text[11], text[20] = "x5,w,2024-01-01", "8,w", "10,w,someday", "bad,w,never"
    path = write(tmp_path / "l.csv", "\n".join(text) + "\n")
    found = ledger.ingest(spark, path, str(tmp_path / "t"), limit=0.05)
    assert rows(found.summary()) == [(300, 296, 4, 5)] and found.lifted == ()
    assert sorted(rows(found.rejects), key=str) == sorted([(5, "n", "x5", "not a number"), (9, None, "8,w", "width"), (11, "day", "someday", "not a date"), (20, "n", "bad", "not a number"), (20, "day", "never", "not a date")], key=str)
    kept = found.rows.orderBy("row_id").collect()
    assert [r.row_id for r in kept] == [k for k in range(1, 301) if k not in (5, 9, 11, 20)] and kept[0].n == 0.0
    assert dict(found.rows.dtypes) == {"row_id": "bigint", "n": "double", "word": "string", "day": "timestamp_ntz"}
    lifted = ledger.ingest(spark, path, str(tmp_path / "u"), limit=0.001)
    assert lifted.lifted == ("n", "day") and rows(lifted.summary()) == [(300, 299, 1, 1)]


def test_ledger_of_a_file_without_rows(spark, tmp_path):
    found = ledger.ingest(spark, write(tmp_path / "e.csv", "a,b\n"), str(tmp_path / "t"))
    assert rows(found.summary()) == [(0, 0, 0, 0)]


def test_row_numbers_do_not_depend_on_splits(spark, tmp_path):
    for name, start in (("b", 1000), ("a", 0)):
        spark.range(start, start + 1000, numPartitions=1).select("id", F.lit("x" * 50).alias("pad")).write.parquet(str(tmp_path / f"{name}.parquet"), mode="overwrite")
        spark.range(start, start + 1000, numPartitions=1).select("id", F.lit("x" * 50).alias("pad")).write.csv(str(tmp_path / "csv" / name), header=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("134217728b", "3000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = tables.with_row_number(spark.read.csv(str(tmp_path / "csv" / "*"), header=True)).collect()
            assert sorted((r.row_id, int(r.id)) for r in found) == [(k + 1, k) for k in range(2000)]
            found = tables.with_row_number(spark.read.parquet(str(tmp_path / "*.parquet"))).collect()
            assert sorted((r.row_id, r.id) for r in found) == [(k + 1, k) for k in range(2000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_row_ids_of_lines_in_several_files_are_places(spark, tmp_path):
    """Lines of an order lie in files of different sizes, of which the larger ones are read first."""
    rng, held, path = random.Random(4), {}, tmp_path / "lineitem.parquet"
    for k, n in enumerate((30, 400, 90)):
        part = [(rng.randrange(40), 1000 * k + j, rng.randrange(1, 8)) for j in range(n)]
        spark.createDataFrame(part, "l_orderkey long, l_partkey long, l_linenumber int").coalesce(1).write.mode("append").parquet(str(path))
        held[next(f.name for f in path.glob("*.parquet") if f.name not in held)] = part
    want = {}
    for i, (order, part, line) in enumerate(r for name in sorted(held) for r in held[name]):
        want.setdefault(order, []).append((i, part, line))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
        found = rows(QUERIES["row_ids"](spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(found) == {(o, len(x), len(x), x[0][1], x[-1][1], sum((i - x[0][0]) * n for i, _, n in x)) for o, x in want.items()}


def plan(df):
    return df._jdf.queryExecution().toString()


def test_deep_pages_read_their_range_only(spark, tmp_path):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 100).alias("v"), F.when(F.col("id") % 9 > 0, F.col("id") % 13).alias("w"))
    rules = [("w", "desc"), ("v", "asc")]
    index = pages.build(df.repartition(3), str(tmp_path / "p"), "id", rules, rows=400)
    want = rows(browse.sort_rows(df, rules, "id"))
    for number in (1, 2, 8, 57, 99, 100):
        assert rows(pages.page(spark, index, number, 50)) == want[50 * (number - 1) : 50 * number]
    assert rows(pages.page(spark, index, 101, 50)) == []
    assert rows(pages.info(spark, index, 50)) == [(5000, 100)]
    assert "4950" not in plan(pages.page(spark, index, 100, 50)) and "__range" in plan(pages.page(spark, index, 100, 50))
    empty = pages.build(df.limit(0), str(tmp_path / "q"), "id")
    assert rows(pages.info(spark, empty)) == [(0, 0)]


def test_ranges_of_pages_share_files(spark, tmp_path):
    """Many small ranges take no partition and no folder each; a page opens the files of its ranges."""
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("id"), F.lit("x").alias("pad"))
    index = pages.build(df, str(tmp_path / "p"), "id", rows=10)
    assert len(spark.read.parquet(f"{index.path}/rows").inputFiles()) == 4  # spark.sql.shuffle.partitions
    ranges = spark.read.parquet(f"{index.path}/ranges").orderBy("__start").collect()
    assert 500 <= len(ranges) <= 504 and max(r["__count"] for r in ranges) == 10 and sum(r["__count"] for r in ranges) == 5000
    for number in (1, 50, 251, 500):
        found = pages.page(spark, index, number, 10)
        assert [r.id for r in found.collect()] == list(range(10 * number - 10, 10 * number)) and len(found.inputFiles()) <= 2
    small = pages.build(df, str(tmp_path / "q"), "id", rows=10, file_rows=100)
    assert len(spark.read.parquet(f"{small.path}/rows").inputFiles()) == 50
    assert [r.id for r in pages.page(spark, small, 3, 1000).collect()] == list(range(2000, 3000))


@pytest.mark.parametrize("accuracy", [4, 50, 2000])
def test_selection_is_exact(spark, accuracy):
    rng = random.Random(accuracy)
    data = [(rng.choice(["a", "b", None]) if k % 3 else "hot", rng.choice([rng.gauss(0, 1), float(rng.randrange(4)), None, float(k)])) for k in range(3000)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, y double")
    levels = {"p0": 0.0, "p5": 0.05, "median": 0.5, "p90": 0.9, "p100": 1.0}
    for by in ([], ["g"]):
        got = {tuple(r[: len(by)]): tuple(r)[len(by) :] for r in selection.selected(df, "y", levels, by, accuracy).collect()}
        want = {tuple(r[: len(by)]): tuple(r)[len(by) :] for r in percentiles.percentiles(df, "y", by, levels).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert selection.selected(df.limit(0), "y", levels, ["g"]).count() == 0
    assert "percentile(" not in plan(selection.selected(df, "y", levels)).replace("approx_percentile(", "")


def scattered(spark, n):
    rng = random.Random(n)
    values = [None if rng.random() < 0.3 else float(rng.randrange(1000)) for _ in range(n)]
    return values, spark.createDataFrame([(day(k), v) for k, v in enumerate(values)], "x timestamp_ntz, y double").repartition(5)


@pytest.mark.parametrize("n", [0, 1, 7, 300])
def test_scans_equal_one_pass(spark, n):
    values, df = scattered(spark, n)
    ordered = lambda out, c: [r[c] for r in out.orderBy("x").collect()]
    known, before, sums, place = [], None, [], 0.0
    for v in values:
        before = v if v is not None else before
        known.append(before)
        place = place + v if v is not None else place
        sums.append(place if any(u is not None for u in values[: len(sums) + 1]) else None)
    assert ordered(charts.ffill(df, "y"), "y") == known
    assert ordered(charts.with_index(df), "i") == list(range(n))
    assert ordered(scans.running_sum(df, "y", "x", "s"), "s") == sums
    assert ordered(charts.diff(df, "y"), "diff") == [None if k == 0 or values[k - 1] is None or v is None else v - values[k - 1] for k, v in enumerate(values)]
    means = [[u for u in values[k - 4 : k] if u is not None] if k >= 4 else [] for k in range(n)]
    assert ordered(charts.trailing_mean(df, 4, "y"), "trailing_mean") == pytest.approx([sum(m) / len(m) if m else None for m in means])


def test_one_series_gives_what_many_do(spark):
    rng = random.Random(3)
    df = series(spark, [10 + rng.random() + (30 if 60 < k < 90 else 0) for k in range(200)])
    for make in (signals.signals, signals.slope, signals.outlier_rows, evidence.change_points, evidence.series_stats, lambda d, by: charts.stride(d, 17, by), lambda d, by: charts.even_sample(d, 17, by)):
        one, many = (sorted(rows(make(df, by).drop("series")), key=str) for by in ([], ["series"]))
        assert len(one) == len(many) and all(a == pytest.approx(b) if not isinstance(b, str) else a == b for p, q in zip(one, many) for a, b in zip(p, q) if isinstance(b, (int, float, str)))


def test_no_window_over_all_rows_without_series(spark):
    _, df = scattered(spark, 40)
    for made in (charts.ffill(df, "y"), charts.trailing_mean(df, 3, "y"), signals.signals(df), signals.trend(df), charts.with_index(df), charts.diff(df, "y")):
        windows = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
        assert all("__range" in x for x in windows)


@pytest.mark.parametrize("buckets", [3, 40, 1 << 16])
def test_heavy_values_are_the_top_values(spark, buckets):
    rng = random.Random(buckets)
    values = [rng.choice("abcdefgh") if rng.random() < 0.5 else f"rare{rng.randrange(900)}" for _ in range(4000)] + [None, " "]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for n in (1, 4, 12):
        assert rows(browse.heavy_values(df, "v", n, buckets)) == rows(browse.top_values(df, "v", n))
    unique = spark.range(500).withColumn("id", F.col("id").cast("string"))
    assert rows(browse.heavy_values(unique, "id", 5, buckets)) == rows(browse.top_values(unique, "id", 5))
    assert rows(browse.heavy_values(df.limit(0), "v", 5, buckets)) == []


def test_duplicates_are_exact(spark):
    data = [(1, "a", None), (1, "a", None), (1, None, "a"), (None, "a", "b"), (None, "a", "b"), (None, "a", "b"), (2, "", "x")]
    df = spark.createDataFrame(data, "n int, v string, w string")
    assert rows(evidence.duplicates(df)) == [(7, 4, 3, pytest.approx(3 / 7))]
    assert rows(evidence.duplicates(df, ["w"])) == [(7, 4, 3, pytest.approx(3 / 7))]
    assert rows(evidence.duplicates(df.limit(0))) == [(0, 0, 0, 0.0)]


def test_facets_are_counted_without_copies_of_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (None, " ")], "n int, v string")
    found = browse.facet_distinct(df, [Filter("n", "eq", ("1",)), Filter("v", "eq", ("b",))])
    assert sorted(rows(found)) == [("n", 2), ("v", 2)] and "Expand" not in plan(found)
    assert sorted(rows(browse.facet_distinct(df.limit(0), []))) == [("n", 0), ("v", 0)]
