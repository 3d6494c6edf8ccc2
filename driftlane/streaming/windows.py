"""Drift per event-time window: counts in the stream, a test per finished window."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.operators import univariate


def window_counts(stream: DataFrame, ts: str, features: Iterable[str], window: str, watermark: str, slide: str | None = None) -> DataFrame:
    """``start, end, feature, category, n`` of each window, once it is past the
    watermark; later rows are dropped, as a watermark means. ``ts`` may be without
    time zone; it is read as a timestamp of the session's."""
    features = list(features)
    held = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", watermark)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("category")) for f in features]))
    long = held.select("__ts", rows.alias("r")).where("r.category is not null")
    counts = long.groupBy(F.window("__ts", window, slide), F.col("r.feature").alias("feature"), F.col("r.category").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("window.start", "window.end", "feature", "category", "n")


def window_report(counts: DataFrame, ref: DataFrame, features: Iterable[str]) -> DataFrame:
    """``start, end, feature, distance, dof, p_val`` of the chi-squared test of each
    window against the reference. ``counts`` is a batch of finished windows."""
    base = univariate.long_form(ref.withColumn("is_ref", F.lit(1)), features, "is_ref", "string").groupBy("feature", F.col("value").alias("category")).agg(F.count(F.lit(1)).alias("m"))
    frames = counts.select("start", "end", "feature").distinct()
    known = frames.join(base, "feature").select("start", "end", "feature", "category", F.col("m").alias("ref"), F.lit(0).cast("long").alias("test"))
    seen = counts.select("start", "end", "feature", "category", F.lit(0).cast("long").alias("ref"), F.col("n").alias("test"))
    mark = "\x1f"
    table = known.unionByName(seen).groupBy("start", "end", "feature", "category").agg(F.sum("ref").alias("ref"), F.sum("test").alias("test"))
    named = table.select(F.concat_ws(mark, F.col("start").cast("string"), F.col("end").cast("string"), "feature").alias("feature"), "category", "ref", "test")
    parts = F.split("feature", mark)
    out = univariate.chi2_from_counts(named)
    return out.select(F.get(parts, F.lit(0)).cast("timestamp").alias("start"), F.get(parts, F.lit(1)).cast("timestamp").alias("end"), F.get(parts, F.lit(2)).alias("feature"), "distance", "dof", "p_val")


def watch(stream: DataFrame, ref: DataFrame, ts: str, features: Iterable[str], window: str, watermark: str, out: str, checkpoint: str, once: bool = False):
    """Starts a query that appends the report of each finished window to a Parquet
    folder. Windows are reported once: a batch that is run again after a failure
    overwrites its own folder."""
    features = list(features)

    def report(batch: DataFrame, number: int) -> None:
        window_report(batch, ref, features).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = window_counts(stream, ts, features, window, watermark).writeStream.outputMode("append").foreachBatch(report).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
