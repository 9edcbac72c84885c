"""Tables that change together: each commit is a manifest of Parquet folders, so readers see all of it or nothing.

A table is dealt into buckets by its key. A change rewrites the buckets that hold its keys and leaves the others where they
are; then one manifest, created under the next version's number, makes the new folders of all tables current at once. A task
or driver that dies before that leaves folders that no manifest names, and the version before. Two writers can't both create
the same number: the later one is refused and starts again from what is then current.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikiloom.staging import small

#: Buckets of a table, unless its first commit says otherwise: the manifest has a row for each.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed since this one read."""


@dataclass
class Change:
    """Rows of `rows` replace all rows with their keys; rows whose keys are in `gone` (a column named as the key) go."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None


class Tables:
    """Tables below `root`, by name; keys: the column by which each is changed."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        jvm = spark.sparkContext._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """All versions, oldest first."""
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit())

    def manifest(self, version: int) -> dict[str, dict[int, str]]:
        """For each table the folder of each bucket that has rows; at most `buckets` entries a table."""
        out: dict[str, dict[int, str]] = {}
        for r in self.spark.read.schema("name string, bucket int, path string").json(f"{self.root}/versions/{version:010d}").collect():
            out.setdefault(r["name"], {})
            if r["path"]:
                out[r["name"]][r["bucket"]] = r["path"]
        return out

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table as of a version, the newest if none is given."""
        version = version or self.versions()[-1]
        return self._read(self.manifest(version)[name].values(), self._schema(name))

    def _schema(self, name: str):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.root}/schemas/{name}").first()[0]))

    def _read(self, paths, schema) -> DataFrame:
        paths = [f"{self.root}/{p}" for p in paths]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _put(self, path: str, text: str) -> None:
        """A file with this text, whole or not at all; Conflict if it's there."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        part, final = self._path(f"{path}.{uuid.uuid4().hex}"), self._path(path)
        out = self._fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._fs.getUri(), self._conf)
        try:
            context.rename(part, final, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(part, False)
            if "already exist" in str(e) or "AlreadyExists" in str(e):
                raise Conflict(path) from e
            raise

    def commit(self, changes: dict[str, Change], base: int | None = None) -> int:
        """The changes of all named tables as one new version, whose number is returned; base: the version they were made from."""
        known = self.versions()
        base = (known[-1] if known else 0) if base is None else base
        now = {n: dict(b) for n, b in (self.manifest(base) if base else {}).items()}
        for name, change in changes.items():
            now[name] = self._changed(name, change, now.get(name))
        rows = [json.dumps({"name": n, "bucket": b, "path": p}) for n, have in now.items() for b, p in (have or {None: None}).items()]
        self._put(f"{self.root}/versions/{base + 1:010d}", "\n".join(rows) + "\n")
        return base + 1

    def _changed(self, name: str, change: Change, have: dict[int, str] | None) -> dict[int, str]:
        """New folders for the buckets that the change touches."""
        key = self.keys[name]
        bucket = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(self.buckets)).cast("int")
        keys = [d.select(key) for d in (change.rows, change.gone) if d is not None]
        keys = (keys[0].unionByName(keys[1]) if len(keys) == 2 else keys[0]).distinct()
        if have is None:
            new, touched = change.rows, None
            self._put(f"{self.root}/schemas/{name}", change.rows.schema.json())
        else:
            touched = {r[0] for r in keys.select(bucket.alias("b")).distinct().collect()}  # at most `buckets`
            schema = self._schema(name)
            old = self._read([p for b, p in have.items() if b in touched], schema)
            k = F.col("__key_of_change")
            new = old.join(small(keys.select(F.col(key).alias("__key_of_change"))), old[key].eqNullSafe(k), "left_anti")
            if change.rows is not None:
                new = new.unionByName(change.rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]))
        folder = f"data/{name}-{uuid.uuid4().hex}"
        new.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{folder}")
        made = {}
        for f in self._fs.listStatus(self._path(f"{self.root}/{folder}")):
            left, eq, number = f.getPath().getName().partition("=")
            if eq:
                made[int(number)] = f"{folder}/{left}={number}"
        return {b: p for b, p in (have or {}).items() if touched is not None and b not in touched} | made

    def vacuum(self, keep: int = 2) -> int:
        """Remove manifests before the last `keep`, and folders that no remaining one names; how many folders went. Not while
        a writer is at work."""
        known = self.versions()
        live = {p.split("/")[1] for v in known[-keep:] for have in self.manifest(v).values() for p in have.values()}
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/versions/{v:010d}"), False)
        gone = 0
        for f in self._fs.listStatus(self._path(f"{self.root}/data")):
            if f.getPath().getName() not in live:
                self._fs.delete(f.getPath(), True)
                gone += 1
        return gone
