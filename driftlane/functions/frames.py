"""Layout of frames: spreading few splits, and numbering rows without one task."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_SHUFFLES = re.compile(r"Join|Aggregate|Window|Sort|Repartition|Rebalance|Limit|InArrow|InPandas")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out if a scan has fewer splits than cores; costly functions of rows
    then use all cores. A large input passes unshuffled, as does what comes from
    joins or aggregates."""
    if _SHUFFLES.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def kept(df: DataFrame) -> DataFrame:
    """Writes what is used more than once into the shared folder of
    ``spark.checkpoint.dir`` and reads it from there, also after lost executors. Where
    that isn't set, a session on one machine takes a local folder; on a cluster it
    is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="driftlane-"))
    return df.checkpoint()


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) that a row's keys and the seed determine: 52 bits of the
    MD5 of both as text, which any SQL engine can repeat. Null keys count as
    absent."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def number(df: DataFrame, key: Column, buckets: int, first: Column | None = None, name: str = "n") -> DataFrame:
    """Adds numbers 0 .. N-1, rows of larger ``first`` before others. Rows are dealt
    into buckets by a hash of the key and numbered there; what lies before a bucket
    comes from the table of counts. Equal keys may change places with each other."""
    held = df.withColumn("__k", key).withColumn("__f", first if first is not None else F.lit(0)).withColumn("__b", F.pmod(F.xxhash64("__k"), F.lit(buckets)))
    order = Window.orderBy(F.col("__f").desc(), "__b").rowsBetween(Window.unboundedPreceding, -1)
    before = held.groupBy("__f", "__b").agg(F.count(F.lit(1)).alias("c")).select("__f", "__b", F.coalesce(F.sum("c").over(order), F.lit(0)).alias("__o"))  # a row per bucket
    joined = held.join(F.broadcast(before), ["__f", "__b"])
    return joined.withColumn(name, F.col("__o") + F.row_number().over(Window.partitionBy("__f", "__b").orderBy("__k")) - 1).drop("__k", "__f", "__b", "__o")


def in_order(df: DataFrame, order: str, name: str = "n") -> DataFrame:
    """Adds numbers 0 .. N-1 by ``order``; equal values in any order. Rows are staged
    in ranges of it, a range is sorted in a task and goes on from the counts of those
    before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = kept(df.repartitionByRange(parts, order).withColumn("__p", F.spark_partition_id()))
    upto = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = held.groupBy("__p").agg(F.count(F.lit(1)).alias("c")).select("__p", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("__o"))  # a row per range
    numbered = held.join(F.broadcast(before), "__p").withColumn(name, F.col("__o") + F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1)
    return kept(numbered.drop("__p", "__o"))  # ties keep their numbers
