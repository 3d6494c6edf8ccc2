"""Shards of near equal bytes from sampled splitters. DataFrame functions alone."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.llm import common

#: Rows in a range on average, ranges per shard at least, sampled keys per range.
RANGE_ROWS = 200_000
RANGES_PER_SHARD = 8
KEYS_PER_RANGE = 32
#: Ranges at most, which bounds what the driver and broadcasts hold.
MAX_RANGES = 1 << 15
#: Copies of a text stay together up to this share of a shard's bytes.
TOGETHER = 0.02


def splitters(rows: DataFrame, ranges: int, total: int, key: str = "key", size: str = "size", draw: Column | None = None) -> list[int]:
    """At most ``ranges - 1`` rising keys that cut the bytes into near equal parts.

    Each row is drawn with a probability in proportion to its size (a row that
    outweighs its share of the sample is always in it, with its own weight), about
    ``KEYS_PER_RANGE`` rows for each range. Quantiles of the weights are the cuts.
    """
    share = max(1.0, total / (ranges * KEYS_PER_RANGE))
    weight = F.greatest(F.col(size).cast("double"), F.lit(share))
    sample = rows.where(draw < F.col(size) / share).select(key, weight.alias("w"))
    seen = sample.groupBy(key).agg(F.sum("w").alias("w"))
    before = F.sum("w").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")  # over the bounded sample
    whole = F.sum("w").over(Window.partitionBy())
    cut = seen.select(key, F.floor(before / whole * ranges).alias("part")).groupBy("part").agg(F.min(key).alias("at")).where("part > 0")
    return sorted({r.at for r in cut.collect()})


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below a key: a binary search inside a fold."""
    if not cuts:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    fits = lambda at, s: (at + s <= F.lit(len(cuts))) & (F.get(table, at + s - F.lit(1)) <= key)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(fits(at, s), at + s).otherwise(at))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards of near equal bytes.

    The size of a row is the UTF-8 bytes of its text (null: none) plus 8. Rows are
    ordered by a hash of the text, so equal texts lie together. Sampled splitters
    cut that order into many ranges; a range with over twice its share of rows or
    bytes is subdivided, by key; a key with many rows or bytes is cut into pieces,
    which follow each other. Shards are then cut at the exact quantiles of the
    bytes. Copies of one text stay in one shard, however many they are, unless together
    they outweigh both twice the largest row and ``TOGETHER`` of a shard; they lie
    where their middle does, so either end of a shard is off its quantile by half
    the larger of these two at most.

    Returns ``id_col``, ``size``, ``text_crc32`` long (unsigned, of the UTF-8; null
    text: 0), ``law`` ("bytes"), ``shard`` int, ``slot`` long (gapless from 0 in a
    shard) and ``grown_shard`` int (null: another law's). Null and repeated ids
    keep their rows; rows that are equal in all of these share their slots in any
    order. An empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key"))
    slim = common.stage(slim.withColumn("row", F.monotonically_increasing_id()), "rows")
    n, total, largest = slim.agg(F.count(F.lit(1)), F.sum("size"), F.max("size")).first()
    total, largest = total or 0, largest or 0
    ranges = min(MAX_RANGES, max(RANGES_PER_SHARD * shards, math.ceil(n / RANGE_ROWS)))
    draw = F.pmod(F.xxhash64("row", "key", F.lit(11)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    cuts = splitters(slim, ranges, total, draw=draw)
    placed = slim.withColumn("range", range_of(F.col("key"), cuts))

    # subdivide overfull ranges: keys by hash, and keys that alone are overfull into pieces of their own
    rows_most, bytes_most = max(1, 2 * n / ranges), max(1, 2 * total / ranges)
    share = lambda: F.ceil(F.greatest(F.col("n") / rows_most, F.col("b") / bytes_most)).cast("int")
    full = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    full = full.select("range", share().alias("subs")).where("subs > 1")
    inside = placed.join(F.broadcast(full), "range")
    heavy = inside.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).where((F.col("n") > rows_most / 2) | (F.col("b") > bytes_most / 2))
    heavy = heavy.select("key", (2 * share()).alias("pieces"))  # keys with half a range's share or more: no more than 4 per range on average
    divided = placed.join(F.broadcast(full), "range", "left").join(F.broadcast(heavy), "key", "left")
    alone = F.col("pieces").isNotNull()
    divided = divided.select(
        "range", F.when(alone, F.lit(-1)).otherwise(F.pmod(F.xxhash64("key", F.lit(5)), F.coalesce("subs", F.lit(1)))).cast("int").alias("sub"),
        F.when(alone, F.col("key")).otherwise(0).alias("whose"), F.when(alone, F.pmod(F.xxhash64("row"), "pieces")).otherwise(0).cast("int").alias("piece"),
        "id", "size", "crc", "key", "row",
    )

    # where each part begins, in rows and bytes: a row per part, and what a key in pieces takes as a whole
    lane = ["range", "sub", "whose", "piece"]
    parts = divided.groupBy(*lane).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    up_to = Window.orderBy(*lane).rowsBetween(Window.unboundedPreceding, 0)
    of_key = Window.partitionBy("range", "sub", "whose")
    parts = parts.select(*lane, (F.sum("n").over(up_to) - F.col("n")).alias("rows_before"), (F.sum("b").over(up_to) - F.col("b")).alias("bytes_before"), F.sum("b").over(of_key).alias("key_bytes"))
    parts = parts.withColumn("key_before", F.min("bytes_before").over(of_key))
    inner = Window.partitionBy(*lane).orderBy("key", "id", "size", "crc", "row")
    ordered = divided.select("*", F.row_number().over(inner).alias("nth"), F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    copies = Window.partitionBy(*lane, "key")
    ordered = ordered.select("*", F.sum("size").over(copies).alias("group_bytes"), F.max("upto").over(copies).alias("group_end"))
    at = ordered.join(F.broadcast(parts), lane)
    # a group of copies lies where its middle does, unless it is too heavy to stay together
    split = F.col("sub") == -1
    group_bytes = F.when(split, F.col("key_bytes")).otherwise(F.col("group_bytes"))
    group_start = F.when(split, F.col("key_before")).otherwise(F.col("bytes_before") + F.col("group_end") - F.col("group_bytes"))
    whole = group_bytes <= max(2 * largest, TOGETHER * total / shards)
    middle = F.when(whole, group_start + group_bytes / 2).otherwise(F.col("bytes_before") + F.col("upto") - F.col("size") / 2)
    place = F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int")
    at = at.select("id", "size", "crc", place.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("row"))
    at = common.stage(at, "placed")
    first = at.groupBy("shard").agg(F.min("row").alias("first"))
    out = at.join(F.broadcast(first), "shard")  # one row per shard
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
