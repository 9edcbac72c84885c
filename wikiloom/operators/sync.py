"""Change detection between local files, what was last synced, and the remote side; plans, upserts and path choice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.functions.text import title_key

TOLERANCE_SECONDS = 30


def diff(local: DataFrame, ledger: DataFrame) -> DataFrame:
    """key, change (new, modified, deleted), title, path: one shuffle on the normalised title; rows that agree are dropped."""
    a = local.select(title_key(F.col("title")).alias("key"), F.col("title").alias("local_title"), F.col("path").alias("local_path"), F.col("hash").alias("local_hash"))
    b = ledger.select(title_key(F.col("title")).alias("key"), F.col("title").alias("known_title"), F.col("path").alias("known_path"), F.col("hash").alias("known_hash"))
    change = F.when(F.col("known_hash").isNull(), "new").when(F.col("local_hash").isNull(), "deleted").when(F.col("local_hash") != F.col("known_hash"), "modified")
    both = a.join(b, "key", "full").withColumn("change", change).filter("change is not null")
    return both.select("key", "change", F.coalesce("local_title", "known_title").alias("title"), F.coalesce("local_path", "known_path").alias("path"))


def chosen(changes: DataFrame, titles: list[str] | None = None, paths: list[str] | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """Changes that any selection names; all where nothing is selected."""
    tests = [F.col("title").isin(titles)] if titles else []
    tests += [F.col("path").isin(paths)] if paths else []
    tests += [F.startswith("path", F.lit(p)) for p in prefixes or []]
    out = F.lit(not tests)
    for t in tests:
        out = out | t
    return changes.filter(out)


def conflicts(changes: DataFrame, ledger: DataFrame, remote: DataFrame, tolerance: int = TOLERANCE_SECONDS) -> DataFrame:
    """changes with conflict: a new page exists remotely, or the remote page changed since it was synced."""
    known = ledger.select(title_key(F.col("title")).alias("key"), F.col("changed_at").alias("known_at"))
    there = remote.select(title_key(F.col("title")).alias("key"), F.col("changed_at").alias("remote_at"))
    told = changes.join(known, "key", "left").join(there, "key", "left")
    moved = F.abs(F.col("remote_at") - F.col("known_at")) > tolerance
    conflict = F.when(F.col("remote_at").isNull(), False).when(F.col("change") == "new", True).otherwise(F.coalesce(moved, F.lit(False)))
    return told.withColumn("conflict", conflict).select(*changes.columns, "conflict")


def plan_counts(told: DataFrame) -> DataFrame:
    return told.groupBy("change").agg(F.count("*").alias("pages"), F.count_if("conflict").alias("conflicts"))


def pull(remote: DataFrame, ledger: DataFrame, local: DataFrame, overwrite: bool = False) -> DataFrame:
    """key, action (created, updated, unchanged, skipped), changed_at for every remote page.

    A page whose local file differs from what was synced is skipped unless `overwrite`; skipped pages don't move the
    checkpoint, so they come again.
    """
    there = remote.select(title_key(F.col("title")).alias("key"), F.col("hash").alias("remote_hash"), "changed_at")
    known = ledger.select(title_key(F.col("title")).alias("key"), F.col("hash").alias("known_hash"))
    mine = local.select(title_key(F.col("title")).alias("key"), F.col("hash").alias("local_hash"))
    told = there.join(known, "key", "left").join(mine, "key", "left")
    edited = F.col("local_hash").isNotNull() & ~F.col("local_hash").eqNullSafe(F.col("known_hash"))
    action = F.when(F.col("local_hash") == F.col("remote_hash"), "unchanged").when(edited & F.lit(not overwrite), "skipped").when(F.col("local_hash").isNull(), "created").otherwise("updated")
    return told.select("key", action.alias("action"), "changed_at", "remote_hash")


def checkpoint_of(actions: DataFrame) -> DataFrame:
    """One row: how many pages each action has, and the time up to which all was applied."""
    n = [F.count_if(F.col("action") == a).alias(a) for a in ("created", "updated", "unchanged", "skipped")]
    return actions.agg(*n, F.max(F.when(F.col("action") != "skipped", F.col("changed_at"))).alias("checkpoint"))


def upsert(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have; the last of new by all its columns where a key comes twice."""
    rest = [c for c in new.columns if c != key]
    last = new.groupBy(key).agg(F.max(F.struct(*rest)).alias("r")).select(key, "r.*")
    return old.join(new.select(key), key, "left_anti").unionByName(last)


def chosen_paths(pages: DataFrame, existing: DataFrame) -> DataFrame:
    """title, path: of pages (ord, title, path); of paths that differ in case only, an existing one (else the first) keeps its
    name and the others get the title in hexadecimal behind theirs."""
    told = pages.join(existing.select("path").distinct().withColumn("exists", F.lit(True)), "path", "left")
    at = F.row_number().over(Window.partitionBy(F.lower("path")).orderBy(F.coalesce("exists", F.lit(False)).desc(), "ord"))
    hexed = F.concat(F.regexp_replace("path", r"\.[^.]*\z", ""), F.lit("~"), F.lower(F.hex("title")), F.regexp_extract("path", r"(\.[^.]*)\z", 1))
    return told.withColumn("at", at).select("title", F.when(F.col("at") == 1, F.col("path")).otherwise(hexed).alias("path"))


def content_diffs(pairs: DataFrame) -> DataFrame:
    """title, status (same, changed, missing_baseline), diff: unified diffs of (title, before, after), each within its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import difflib

        for batch in batches:
            status, text = [], []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                status.append("missing_baseline" if a is None else "same" if a == b else "changed")
                lines = difflib.unified_diff(a.splitlines(), (b or "").splitlines(), "synced", "local", lineterm="") if status[-1] == "changed" else []
                text.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(status, pa.string()), pa.array(text, pa.string())], ["title", "status", "diff"])

    return pairs.select("title", "before", "after").mapInArrow(run, "title string, status string, diff string")
