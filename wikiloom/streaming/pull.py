"""Incremental ingestion: changed pages arrive as files and are merged by key, batch after batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_changes(batch: DataFrame, key: str, at: str) -> DataFrame:
    """The last change of each key within a batch: a grouped maximum with map-side sums, no window over a hot key."""
    rest = [c for c in batch.columns if c not in (key, at)]
    return batch.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("r")).select(key, "r.*")


def merge(state: DataFrame, changes: DataFrame, key: str, at: str) -> DataFrame:
    """state with newer changes applied; an older change than what state holds is dropped."""
    return latest_changes(state.unionByName(changes), key, at)


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, at: str) -> DataFrame:
    """All files of `source` not read before, merged into the table at `target`, which is returned.

    The stream's checkpoint remembers the files; each batch writes a new version of the table under a number of its own
    and then names it in `target`/current, so a batch that runs again after a failure replaces its own version only.
    """
    head = f"{target}/current"

    def versions() -> list[int]:
        path = spark._jvm.org.apache.hadoop.fs.Path(head)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(r["v"]) for r in spark.read.schema("v long").json(head).collect()) if fs.exists(path) else []

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = [v for v in versions() if v < number]
        new = latest_changes(batch, key, at)
        if before:
            new = merge(session.read.parquet(f"{target}/v{before[-1]}"), new, key, at)
        new.write.mode("overwrite").parquet(f"{target}/v{number}")
        if number not in versions():
            session.createDataFrame([(number,)], "v long").coalesce(1).write.mode("append").json(head)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = versions()
    return spark.read.parquet(f"{target}/v{found[-1]}") if found else spark.createDataFrame([], schema)
