"""Stored profiles and search filters of files: equal to a fresh scan, and each file read once."""

import os

import pytest
from autobi.functions import coerce
from autobi.operators import filters, profile, profile_store, recommend, search_index
from autobi.sources import tables
from pyspark.sql import functions as F
from tests.helpers import day, rows


def data(spark, keys):
    items = [(k, f"name {k % 7}" if k % 5 else " ", float(k % 11) - 5, -0.0 if k % 2 else 0.0, day(k % 40), k % 3 == 0 if k % 4 else None, f"{k % 13:,}", None) for k in keys]
    return spark.createDataFrame(items, "k long, name string, x double, zero double, d timestamp_ntz, b boolean, t string, nothing string")


def same(a, b):
    assert sorted(rows(a), key=str) == sorted(rows(b), key=str)


def test_merged_profile_equals_that_of_the_whole(spark, tmp_path):
    path, store = str(tmp_path / "a folder"), str(tmp_path / "store")
    data(spark, range(0, 300)).repartition(3).write.parquet(path)
    assert profile_store.update(spark, path, store) == 3
    data(spark, range(200, 900)).repartition(2).write.mode("append").parquet(path)
    assert profile_store.update(spark, path, store) == 2 and profile_store.update(spark, path, store) == 0
    whole = spark.read.parquet(path)
    same(profile_store.profile(spark, path, store), profile.profile(whole))
    same(profile_store.top_values(spark, path, store, 2).where("column <> 'zero'"), profile.profile_top_values(whole.drop("zero"), 2))
    estimate = {r.column: r.distinct_count for r in profile_store.profile(spark, path, store, exact=False).collect()}
    assert abs(estimate["k"] - 900) <= 45 and estimate["name"] == 7 and estimate["nothing"] == 0
    got, want = (recommend.recommend(p).drop("criteria") for p in (profile_store.profile(spark, path, store, table="t"), profile.profile(whole, table="t")))
    same(got, want)


def test_profile_store_follows_the_files(spark, tmp_path):
    path, store = str(tmp_path / "f"), str(tmp_path / "store")
    data(spark, range(50)).coalesce(1).write.parquet(path)
    data(spark, range(50, 90)).coalesce(1).write.mode("append").parquet(path)
    profile_store.update(spark, path, store)
    first = min((f for f in os.listdir(path) if f.endswith(".parquet")), key=lambda f: os.stat(f"{path}/{f}").st_mtime_ns)
    os.unlink(f"{path}/{first}")  # a file that is gone no longer counts
    same(profile_store.profile(spark, path, store), profile.profile(data(spark, range(50, 90))))
    data(spark, range(90, 95)).select("k", "x", F.lit("new").alias("extra")).coalesce(1).write.mode("append").parquet(path)
    profile_store.update(spark, path, store)
    got = {r.column: (r.row_count, r.null_rate, r.distinct_count) for r in profile_store.profile(spark, path, store).collect()}
    assert got["k"] == (45, 0.0, 45) and got["extra"] == (45, 1 - 5 / 45, 1) and got["nothing"] == (45, 1.0, 0)
    data(spark, range(3)).select(F.col("k").cast("string").alias("k")).coalesce(1).write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError):
        profile_store.update(spark, path, store)


def test_profile_store_of_empty_files(spark, tmp_path):
    path, store = str(tmp_path / "e"), str(tmp_path / "store")
    data(spark, range(3)).where("k > 9").coalesce(1).write.parquet(path)
    assert profile_store.update(spark, path, store) == 1 and profile_store.update(spark, path, store) == 0
    assert {(r.row_count, r.null_rate, r.distinct_count) for r in profile_store.profile(spark, path, store).collect()} == {(0, 0.0, 0)}


def test_values_longer_than_what_is_kept_are_told_apart(spark, tmp_path):
    path, store = str(tmp_path / "l"), str(tmp_path / "store")
    spark.createDataFrame([("a" * 300 + str(k % 4),) for k in range(9)], "t string").write.parquet(path)
    profile_store.update(spark, path, store)
    assert profile_store.profile(spark, path, store).first().distinct_count == 4
    assert [(r.value, r["count"]) for r in profile_store.top_values(spark, path, store, 1).collect()] == [("a" * 200, 3)]


def folder(spark, tmp_path):
    path, store = str(tmp_path / "rows of text"), str(tmp_path / "store")
    words = ["Alpha", "beta_max", "Gamma 50%", "ΔΕΛΤΑ", "back\\slash", "Zürich", "😀 face", "x"]
    items = [(k, f"{words[k // 50]} {k}" if k % 50 else None, k / 8, day(k)) for k in range(400)]
    spark.createDataFrame(items, "k long, word string, x double, d timestamp_ntz").repartitionByRange(8, "k").write.parquet(path)
    return path, store


def test_indexed_search_equals_the_full_scan_and_skips_files(spark, tmp_path):
    path, store = folder(spark, tmp_path)
    assert search_index.update(spark, path, store, slices=2) == 8 and search_index.update(spark, path, store, slices=2) == 0
    whole = spark.read.parquet(path)
    opened = {}
    for text in ["alpha", "ALPHA 1", "beta_max", "gamma 50%", "δελτα", "zürich", "back\\slash", "😀 fa", "2024-03-0", "12.5", "125", "a%4", "al", "", "%", "nowhere", "g_m", "alpha%24", "_________________________________________"]:
        same(search_index.search(spark, path, store, text, slices=2), filters.search(whole, text))
        opened[text] = search_index.candidates(spark, path, store, text, slices=2).count()
    assert (opened["alpha"], opened["zürich"], opened["nowhere"], opened["al"]) == (1, 1, 0, 8)
    assert len(search_index.search(spark, path, store, "alpha", slices=2).inputFiles()) == 1
    assert search_index.search(spark, path, store, "nowhere", slices=2).columns == whole.columns


def test_files_without_a_filter_are_searched(spark, tmp_path):
    path, store = folder(spark, tmp_path)
    assert search_index.search(spark, path, store, "alpha").count() == 49  # no store yet
    search_index.update(spark, path, store)
    spark.createDataFrame([(1000, "alpha again", 0.0, day(1))], "k long, word string, x double, d timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
    assert search_index.search(spark, path, store, "alpha").count() == 50
    assert search_index.candidates(spark, path, store, "alpha").count() == 2
    assert search_index.update(spark, path, store) == 1 and search_index.search(spark, path, store, "alpha").count() == 50


def test_listing_opens_no_file(spark, tmp_path):
    path, _ = folder(spark, tmp_path)
    listed = tables.listing(spark, path)
    assert listed.count() == 8 and "ReadSchema: struct<>" in listed._jdf.queryExecution().executedPlan().toString()


def test_filters_are_built_of_different_trigrams_only(spark, tmp_path):
    """Trigrams are told apart before bitmaps are made, which past 128 groups would sort each of them; long texts are cut in pieces."""
    path, store = str(tmp_path / "p"), str(tmp_path / "store")
    long = "".join(chr(97 + k * k % 26) + str(k) + "é" for k in range(700))
    spark.range(3000).select("id", F.concat(F.lit("common text "), F.col("id") % 5).alias("t")).unionByName(spark.createDataFrame([(-1, long)], "id long, t string")).repartitionByRange(5, "id").write.parquet(path)
    made = search_index._filters(tables.read_files(spark, path, [r.file for r in tables.listing(spark, path).collect()]), 32)
    steps = [x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate" in x or "Exchange" in x]
    assert "HashAggregate(keys=[id" in steps[-1] and "b0" in steps[-1] and sum("bitmap" in x for x in steps[:2]) == 2 == sum("bitmap" in x for x in steps)
    search_index.update(spark, path, store)
    whole = spark.read.parquet(path)
    for at in (0, 508, 509, 510, 511, 512, 513, 1022, 1500, len(long) - 5):
        same(search_index.search(spark, path, store, long[at : at + 5]), filters.search(whole, long[at : at + 5]))
    assert search_index.candidates(spark, path, store, long[510:516]).count() == 1


def test_profiles_hash_values_without_sorting_or_writing_numbers_as_text(spark, tmp_path):
    """Values of a file are counted by hash, not sorted by the file's name; a figure's test runs once a row, before the aggregation."""
    df = data(spark, range(50))
    df.write.parquet(str(tmp_path / "f"))
    read = tables.read_files(spark, str(tmp_path / "f"), [r.file for r in tables.listing(spark, str(tmp_path / "f")).collect()])
    counted = profile_store._counted(read, [F.struct(F.lit(0).alias("place"), F.xxhash64("name").alias("h"), F.hash("name").alias("g"), F.left("name", F.lit(9)).alias("head"))])
    steps = counted._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in steps and "HashAggregate" in steps
    made = profile.profile(df)._jdf.queryExecution().optimizedPlan().toString()
    sums = [x for x in made.splitlines() if "Aggregate" in x]
    assert sums and not any("RLIKE" in x or "gettimestamp" in x for x in sums)
    assert not any(f"cast({c}#{k} as string)" in made for c in ("k", "x", "d", "b") for k in range(9999))


def test_words_are_told_as_by_the_patterns_alone(spark):
    words = ["1", "1,2 3", " 12 ", "1\n", "+.5e-3", "- 5", "e5", "1e", "NaN", "12d", "", " ", "2024-01-02", " 2024/1/2", "2024-1-2T10:00:00", "1/2/2024", "13/13/2024", "1-2-2024", "20240102", "20241301", "20240132", "20240230", "00000101", "99999999", "2024", "13:45", "Sim", " não ", "FALSE", "falsey word", "x" * 50, None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    w = F.col("w")
    plain = df.select(F.regexp_replace(w, "[, ]", "").rlike(coerce.NUMBER).alias("n"), F.lower(F.trim(w)).isin(coerce.BOOL_WORDS).alias("b"), coerce.text_ts(F.trim(w), coerce.DATE_WORD_PATTERNS).isNotNull().alias("d"), coerce.text_num(F.regexp_replace(w, " ", "")).alias("v"), F.try_to_timestamp(w, F.lit("yyyyMMdd")).cast("string").alias("t"))
    gated = df.select(coerce.is_number_word(w).alias("n"), coerce.is_bool_word(w).alias("b"), coerce.is_date_word(w).alias("d"), F.when(coerce.may_be_number(w), coerce.text_num(F.replace(w, F.lit(" "), F.lit("")))).alias("v"), F.when(w.rlike(coerce._form("yyyyMMdd")), F.try_to_timestamp(w, F.lit("yyyyMMdd")).cast("string")).alias("t"))
    assert rows(gated.select("n", "b", F.coalesce("d", F.lit(False)), "v")) == rows(plain.select("n", "b", "d", "v"))
    eight = [k for k, v in enumerate(words) if v and len(v) == 8 and v.isdigit()]
    got, want = rows(gated.select("t")), rows(plain.select("t"))
    assert [got[k] for k in eight] == [want[k] for k in eight] and not rows(df.where(coerce.is_date_word(F.lit("20241301"))).limit(1))
