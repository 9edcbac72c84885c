"""What several operators share: tables, staging on shared storage, joins that survive a hot key."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1 / HOT_KEYS of the rows, so at most HOT_KEYS keys are ever broadcast.
HOT_KEYS = 1000
#: Rows of a join up to which hot keys aren't told apart: all of them are little work for one task, and a plan with two joins
#: and two broadcasts takes more of the driver's memory than a plain join.
PLAIN_ROWS = 300_000


#: Rows of an Arrow batch in the registered queries, unless the session sets another number: batches live beside the heap.
BATCH_ROWS = 1000
#: Characters of a plan's description that the driver keeps and logs, for each of the last thousand executions.
PLAN_CHARS = 20_000
#: Bytes of texts that a Python worker takes at a time, however long the rows of an Arrow batch are.
SLICE_BYTES = 8 << 20


def bounded(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE_BYTES of their text column, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def production(spark: SparkSession) -> SparkSession:
    """The session of a registered query or stage, with smaller Arrow batches and descriptions of plans than Spark's defaults
    where it has those.

    Operators leave the session's settings alone; registered queries own theirs.
    """
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.maxPlanStringLength", "2147483632b", PLAN_CHARS)):
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return production(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode alone, where driver and executors are
    one process, a temporary folder stands in for it; on a cluster a missing setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="wikiloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_staged: list[tuple[SparkSession, str]] = []


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to shared storage and read it back: cuts lineage and survives lost executors.

    Column pruning applies to each later read. The folders go when the driver ends, or earlier by unstage().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    path = getattr(df, "_staged_path", None)
    if path:
        drop_path(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return


def attach(rows: DataFrame, by_key: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of rows with by_key (one row per key, with its row count) that doesn't pile a hot key onto one task.

    Keys with more than total / HOT_KEYS rows, HOT_KEYS at most, are broadcast; all other keys are small and shuffled.
    Up to PLAIN_ROWS rows are joined as they are.
    """
    if total <= PLAIN_ROWS:
        return rows.join(by_key, key)
    limit = max(total // HOT_KEYS, 2000)
    hot, cold = by_key.filter(F.col(count) > limit), by_key.filter(F.col(count) <= limit)
    keys = hot.select(F.col(key).alias("__hot"))
    return (
        rows.join(F.broadcast(hot), key)
        .unionByName(rows.join(F.broadcast(keys), F.col(key) == F.col("__hot"), "left_anti").join(cold, key))
    )


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that df has as columns in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text):
    """A-Z in lower case, all else as it is. lower() has a fast path for pure ASCII but folds other letters too."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def crc_fold(id_col, modulo: int):
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulo


def scaled_partitions(spark: SparkSession, factor: float = 1.0) -> int:
    return max(8, int(int(spark.conf.get("spark.sql.shuffle.partitions")) * factor))
