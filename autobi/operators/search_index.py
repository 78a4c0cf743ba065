"""Repeated searches: a Bloom filter of the trigrams of each file, so that a search opens only files that may hold the text.

The filters lie in a store, below ``filters`` one row of 32 768 bits for each file and slice of its filter. A file is
known by its path and the time it was written; files the store does not hold are searched as they are.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from autobi.operators import filters
from autobi.operators.profile import simple_columns
from autobi.sources import tables

FILTERS = "file string, changed timestamp, slice long, bits binary"
FILES = "file string, changed timestamp"
SLICE, HASHES = 32_768, 2
#: Characters of a text that are cut into trigrams at once, so that a long text is not walked through for each of them.
PIECE = 512


def trigrams(text: Column) -> Column:
    """All runs of three characters of a text; none if it is null or shorter."""
    chars = F.split(text, "")
    runs = F.transform(F.sequence(F.lit(1), F.size(chars) - 2), lambda k: F.concat(F.get(chars, k - 1), F.get(chars, k), F.get(chars, k + 1)))
    return F.when(F.char_length(text) >= 3, runs).otherwise(F.array().cast("array<string>"))


def _bit(gram: Column, k: int, slices: int) -> Column:
    return F.pmod(F.xxhash64(gram, F.lit(k)), F.lit(slices * SLICE))


def _bits(gram: Column, slices: int) -> Column:
    return F.array(*[_bit(gram, k, slices) for k in range(HASHES)])


def _filters(df: DataFrame, slices: int) -> DataFrame:
    """``(id, slice, bits)``: the filters of a scan's files, ``id`` a number made of each file's name and time.

    Two files of one number, should there be any, share a filter that misses nothing.
    """
    file, texts = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_modification_time")).alias("id"), [F.lower(df[f.name].cast("string")) for f in simple_columns(df)]
    rows = df.select(file, F.explode(F.array(*texts)).alias("text")).where(F.char_length("text") >= 3)
    cut = rows.select("id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.char_length("text") - 3) / PIECE).cast("int"))).alias("p"))
    pieces = cut.select("id", F.substring("text", F.col("p") * PIECE + 1, F.lit(PIECE + 2)).alias("piece"))
    runs = pieces.select("id", "piece", F.explode(F.sequence(F.lit(1), F.char_length("piece") - 2)).alias("k")).select("id", F.substring("piece", F.col("k"), F.lit(3)).alias("gram"))
    each = runs.select("id", *[_bit(F.col("gram"), k, slices).alias(f"b{k}") for k in range(HASHES)]).distinct()
    bits = each.select("id", F.explode(F.array(*[f"b{k}" for k in range(HASHES)])).alias("bit")).withColumn("slice", F.floor(F.col("bit") / SLICE).cast("long"))
    return bits.repartition("id", "slice").groupBy("id", "slice").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") % SLICE + 1)).alias("bits"))


def update(spark: SparkSession, path: str, store: str, slices: int = 32) -> int:
    """Build the filters of the folder's Parquet files that the store does not hold yet; returns how many files that were.

    A filter has ``slices`` times 32 768 bits, the same for all updates of a store. Trigrams are of the lower-cased text
    of every column of single values. The trigrams of a task are told apart by the bits they set, two numbers each, before
    anything is sent on, so that a task holds no more than its files have different ones.
    """
    known = tables.kept(spark, f"{store}/files/*", FILES)
    new = tables.listing(spark, path).join(known, ["file", "changed"], "left_anti").select("file", "changed")
    files = new.collect()  # names of files to read, which their scan lists as well
    if not files:
        return 0
    df, batch = tables.read_files(spark, path, [r.file for r in files]), uuid.uuid4().hex
    placed = _filters(df, slices)
    named = new.select("file", "changed", F.xxhash64("file", "changed").alias("id"))
    placed.join(F.broadcast(named) if len(files) <= tables.FILES else named, "id").select("file", "changed", "slice", "bits").write.parquet(f"{store}/filters/{batch}")
    # last, so that a file counts as held only if its filter is; one rewritten meanwhile is not
    listed = F.broadcast(new.select("file", "changed")) if len(files) <= tables.FILES else new
    tables.listing(spark, path).join(listed, ["file", "changed"], "left_semi").write.parquet(f"{store}/files/{batch}")
    return len(files)


def _needs(spark: SparkSession, text: str, slices: int) -> dict[int, list[int]]:
    """The places, by slice, that a file's filter must have set to hold the text; ``%`` and ``_`` are wild."""
    runs = [run for run in re.split("[%_]", text.lower()) if len(run) >= 3]
    found = defaultdict(list)
    if runs:
        grams = F.array_distinct(F.flatten(F.array(*[trigrams(F.lit(run)) for run in runs])))
        bits = F.array_distinct(F.flatten(F.transform(grams, lambda g: _bits(g, slices))))
        for bit in spark.range(1).select(bits.alias("bits")).first().bits:  # as many as the text has characters
            found[bit // SLICE].append(bit % SLICE)
    return found


def candidates(spark: SparkSession, path: str, store: str, text: str, slices: int = 32) -> DataFrame:
    """``(file, changed)``: the folder's files that may hold the text, or of which the store holds no filter."""
    listed, needs = tables.listing(spark, path), _needs(spark, text, slices)
    if not needs:
        return listed

    def is_set(place: int) -> Column:
        byte = F.conv(F.hex(F.substring("bits", place // 8 + 1, 1)), 16, 10).cast("int")
        return F.shiftright(byte, place % 8).bitwiseAND(1) == 1

    test = F.lit(False)
    for number, places in needs.items():
        all_set = F.lit(True)
        for place in places:
            all_set = all_set & is_set(place)
        test = test | ((F.col("slice") == number) & all_set)
    held = tables.kept(spark, f"{store}/filters/*", FILTERS).where(F.col("slice").isin(list(needs)) & test)
    passed = held.groupBy("file", "changed").agg(F.count_distinct("slice").alias("n")).where(F.col("n") == len(needs))
    known = tables.kept(spark, f"{store}/files/*", FILES)
    return listed.join(known, ["file", "changed"], "left_anti").unionByName(listed.join(passed, ["file", "changed"], "left_semi")).distinct()


def search(spark: SparkSession, path: str, store: str, text: str, slices: int = 32) -> DataFrame:
    """The folder's rows in which the text of any column holds the text, as ``filters.search`` finds them, from the candidate files only."""
    files = [r.file for r in candidates(spark, path, store, text, slices).collect()]  # no more than the scan lists
    whole = spark.read.parquet(path)
    return filters.search(tables.read_files(spark, path, files), text).select(whole.columns) if files else whole.limit(0)
