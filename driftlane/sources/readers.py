"""Readers of the datasets' file formats, all over Spark's own file access."""

from __future__ import annotations

import io
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Attack types of the KDD-Cup-99 data by category, and the columns
# that are kept by default.
KDD_CATEGORIES = {
    "dos": "back land neptune pod smurf teardrop".split(),
    "r2l": "ftp_write guess_passwd imap multihop phf spy warezclient warezmaster".split(),
    "u2r": "buffer_overflow loadmodule perl rootkit".split(),
    "probe": "ipsweep nmap portsweep satan".split(),
    "normal": ["normal"],
}
KDD_COLUMNS = (
    "duration protocol_type service flag src_bytes dst_bytes land wrong_fragment urgent hot num_failed_logins logged_in num_compromised root_shell su_attempted "
    "num_root num_file_creations num_shells num_access_files num_outbound_cmds is_host_login is_guest_login count srv_count serror_rate srv_serror_rate rerror_rate "
    "srv_rerror_rate same_srv_rate diff_srv_rate srv_diff_host_rate dst_host_count dst_host_srv_count dst_host_same_srv_rate dst_host_diff_srv_rate "
    "dst_host_same_src_port_rate dst_host_srv_diff_host_rate dst_host_serror_rate dst_host_srv_serror_rate dst_host_rerror_rate dst_host_srv_rerror_rate"
).split()
KDD_KEPT = (
    "srv_count serror_rate srv_serror_rate rerror_rate srv_rerror_rate same_srv_rate diff_srv_rate srv_diff_host_rate dst_host_count dst_host_srv_count "
    "dst_host_same_srv_rate dst_host_diff_srv_rate dst_host_same_src_port_rate dst_host_srv_diff_host_rate dst_host_serror_rate dst_host_srv_serror_rate "
    "dst_host_rerror_rate dst_host_srv_rerror_rate"
).split()


def attack_category(label: str | Column) -> Column:
    """Category of an attack type; a final full stop is ignored, an unknown type has none."""
    c = F.rtrim(F.regexp_replace(F.col(label) if isinstance(label, str) else label, r"\.$", ""))
    table = F.create_map(*[F.lit(x) for cat, types in KDD_CATEGORIES.items() for t in types for x in (t, cat)])
    return F.try_element_at(table, c)


def read_kdd(spark: SparkSession, path: str, target: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """CSV without header: kept columns as numbers, ``category`` and ``target`` (1
    for the attack categories asked for). Rows of other attack categories go."""
    target, keep = target or ["dos", "r2l", "u2r", "probe"], keep or KDD_KEPT
    schema = ", ".join(f"{c} {'string' if c in ('protocol_type', 'service', 'flag') else 'double'}" for c in KDD_COLUMNS) + ", label string"
    df = spark.read.schema(schema).csv(path).withColumn("category", attack_category("label"))
    return df.where(F.col("category").isin([*target, "normal"])).select(*keep, "category", F.col("category").isin(target).cast("int").alias("target"))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Numeric rows of an ARFF file: ``features`` array, ``label`` string (the last
    attribute). Comments, the header and blank lines go; ? is null."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where((F.col("v") != "") & ~F.col("v").rlike(r"^[%@]"))
    cells = F.transform(F.split("v", r"\s*,\s*"), lambda x: F.regexp_replace(x, "^['\"]|['\"]$", ""))
    return lines.select(cells.alias("c")).select(F.transform(F.slice("c", F.lit(1), F.size("c") - 1), lambda x: x.try_cast("double")).alias("features"), F.element_at("c", -1).alias("label"))


def read_npy(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """``path, row, shape, values``: a row per first-axis entry of .npy files, or of
    one array of .npz files. Pickled content is refused."""

    def run(batches):
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a[member] if member else a
                yield pd.DataFrame({"path": p, "row": np.arange(len(a)), "shape": [list(a.shape[1:])] * len(a), "values": list(a.reshape(len(a), -1).astype(float))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, shape array<int>, values array<double>")


def severity_slice(df: DataFrame, severity: int, per_level: int = 10_000) -> DataFrame:
    """Rows of one of the levels 1 to 5 that follow each other in a file."""
    return df.where((F.col("row") >= (severity - 1) * per_level) & (F.col("row") < severity * per_level))


def read_labelled_series(spark: SparkSession, csv: str, labels: str, name: str) -> DataFrame:
    """``ts, value, is_outlier``: a CSV of timestamp and value, and a JSON map from
    series name to a list of timestamps."""
    values = spark.read.option("header", True).csv(csv).select(F.to_timestamp("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    marks = spark.read.text(labels, wholetext=True).select(F.explode(F.try_element_at(F.from_json("value", "map<string,array<string>>"), F.lit(name))).alias("t")).select(F.to_timestamp("t").alias("ts")).distinct()
    return values.join(marks.withColumn("m", F.lit(1)), "ts", "left").select("ts", "value", F.coalesce("m", F.lit(0)).alias("is_outlier"))


def list_bucket(spark: SparkSession, xml: str, folder: str = "", suffix: str = "") -> DataFrame:
    """``key``: names in a bucket listing by prefix and suffix."""
    keys = spark.read.text(xml, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit("<Key>([^<]*)</Key>"), 1)).alias("key"))
    return keys.where(F.col("key").startswith(folder) & F.col("key").endswith(suffix))


def join_url(base: str, parts: list[str] | str) -> str:
    """A base and path parts with one slash between them."""
    return "/".join([base.rstrip("/"), *[re.sub("^/+|/+$", "", p) for p in ([parts] if isinstance(parts, str) else parts)]])


def read_sequences(spark: SparkSession, path: str, splits: dict[str, tuple[str, ...]]) -> DataFrame:
    """``split, row, tokens, is_outlier``: arrays of an .npz by split; names that end
    in _ood are outliers."""
    parts = []
    for split, names in splits.items():
        for n in names:
            d = read_npy(spark, path, n)
            parts.append(d.select(F.lit(split).alias("split"), "row", F.transform("values", lambda x: x.cast("int")).alias("tokens"), F.lit(int(n.endswith("_ood"))).alias("is_outlier")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stream_parquet(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files, ``files`` in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
