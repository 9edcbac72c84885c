"""Intermediate tables on the folder that driver and executors share, and broadcasts behind a check of their size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of strings, and rows, up to which a side of a join is broadcast.
SMALL_BYTES, SMALL_ROWS = 32 << 20, 500_000

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. In local mode alone, where driver and executors are one process, a temporary folder stands in
    for it; on a cluster a missing setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="wikiloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read again: no long lineage, nothing lost with an executor. Removed by dropped(), or at the end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*dfs: DataFrame) -> None:
    """Remove what staged() wrote for these; nothing may read them any more."""
    for df in dfs:
        path = getattr(df, "_staged_path", None)
        if path:
            _remove(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint where it is small by count; as it is, to be shuffled, where it is not."""
    text = [F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in df.columns]
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(sum(text, F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if rows <= SMALL_ROWS and size <= SMALL_BYTES else df
