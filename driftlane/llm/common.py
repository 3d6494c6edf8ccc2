"""Shared pieces of the training-data operators: tables, staging in the shared
folder, spreading of few large splits, and byte-size bounded slices of batches."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_SHUFFLES = re.compile(r"Join|Aggregate|Window|Sort|Repartition|Rebalance|Limit|InArrow|InPandas")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir`` (or a checkpoint folder that the session
    already has). Where neither is set, a session on one machine, as in tests, gets
    a local one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="driftlane-"))
        have = sc.getCheckpointDir()
    return have


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage and survives the loss of executors: a lost task reads
    the written files, and their order is the same each time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path is not None:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores if a scan has fewer splits than cores.

    A large input has more splits than cores and passes unchanged, unshuffled.
    What comes from joins or aggregates passes too: only running it would tell its
    number of partitions.
    """
    if _SHUFFLES.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of one key that a task takes in a join; a key with more is dealt to several.
HOT_ROWS = 1 << 16


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, salt: Column, per: int = HOT_ROWS) -> DataFrame:
    """Join ``rows`` with ``keyed``, which has one row per key and counts the rows of
    its key in a column ``n`` (the result doesn't have it).

    Any key may hold a large share of the rows: one with more than ``per`` of them is
    dealt by ``salt`` (a whole number that its rows don't share) to several tasks, and
    its row in ``keyed`` goes to each of these. The list of such keys has at most one
    for each ``per`` rows and is broadcast. Rows with a null key or without a partner
    are left out.
    """
    hot = F.broadcast(keyed.where(F.col("n") > per).select(key, F.ceil(F.col("n") / per).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_salt", F.pmod(salt, salts).cast("int")).drop("_salts")
    right = keyed.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts", "n")
    return left.join(right, [key, "_salt"]).drop("_salt")


def field(df: DataFrame, name: str, out: str | None = None) -> T.StructField:
    """The schema field of a column, nullable, under another name if given."""
    return T.StructField(out or name, df.schema[name].dataType, True)


def slices(batch: pa.RecordBatch, text: int | None = None, rows: int = 512, limit: int = 4 << 20):
    """Cut a record batch into runs of at most ``rows`` rows and about ``limit``
    bytes of column ``text``; a longer value stands alone. No row is left out."""
    n = batch.num_rows
    if text is None:
        for a in range(0, n, rows):
            yield batch.slice(a, rows)
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    a = held = 0
    for i, s in enumerate(sizes):
        if i > a and (held + s > limit or i - a >= rows):
            yield batch.slice(a, i - a)
            a, held = i, 0
        held += s
    if a < n:
        yield batch.slice(a, n - a)
