"""Detectors as declarations: JSON beside Parquet, nothing executable.

A spec names a detector, its parameters, its columns and the reference table. It
is written to a new folder and moved into place, so a reader never sees a part.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from driftlane import __version__


@dataclass
class Spec:
    detector: str
    params: dict = field(default_factory=dict)
    columns: list[str] = field(default_factory=list)
    version: str = __version__

    def check(self, known: dict[str, set[str]]) -> Spec:
        """Raises ValueError for a detector or parameter that isn't known."""
        if self.detector not in known:
            raise ValueError(f"no detector {self.detector!r}")
        strange = set(self.params) - known[self.detector]
        if strange:
            raise ValueError(f"{self.detector} has no parameters {sorted(strange)}")
        return self


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save(spec: Spec, ref: DataFrame | None, path: str, **tables: DataFrame) -> None:
    """Writes spec, reference and further tables; an existing folder is an error."""
    from pyspark.sql import SparkSession as S

    spark = ref.sparkSession if ref is not None else S.active()
    target, fs = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    part = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    try:
        spark.createDataFrame([(json.dumps(asdict(spec)),)], "value string").coalesce(1).write.text(f"{part}/spec")
        for name, df in {"ref": ref, **tables}.items():
            if df is not None:
                df.write.parquet(f"{part}/{name}")
        if not fs.rename(_fs(spark, part)[0], target):
            raise OSError(f"can't move the spec to {path}")
    except Exception:
        fs.delete(_fs(spark, part)[0], True)
        raise


def load(spark: SparkSession, path: str, known: dict[str, set[str]]) -> tuple[Spec, DataFrame | None]:
    """The checked spec and its reference, if it has one. A version other than this
    program's is kept in the spec for the caller to judge."""
    raw = json.loads(spark.read.text(f"{path}/spec").first().value)
    spec = Spec(**{k: raw[k] for k in ("detector", "params", "columns", "version")}).check(known)
    p, fs = _fs(spark, f"{path}/ref")
    return spec, spark.read.parquet(f"{path}/ref") if fs.exists(p) else None


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A further table that was saved with a spec."""
    return spark.read.parquet(f"{path}/{name}")
