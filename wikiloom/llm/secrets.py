"""Secret scans (operator 7): candidates in whole texts, told apart by how many repositories and owners hold each value."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.common import attach, bounded, fresh, stage

# The kinds and patterns of the contract. Kinds sort in this order where they start at one place.
KINDS = ["assign", "access", "hex", "token"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Any other stretch that may be a credential; it needs letters, digits and this many bits of entropy a character.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ENTROPY = 3.2
#: A value is a copied example when as many owners hold it, in however many repositories.
COPIED_OWNERS = 4

_NAMES = ("pass", "secret", "token", "api")


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) in the order of start and kind; positions are code points, ends exclusive."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    # tokens don't overlap each other, so one walk along both lists finds those that meet no base span
    base, k, reach = sorted(out), 0, 0
    for m in TOKEN.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach, k = max(reach, base[k][1]), k + 1
        s = m[0]
        if reach <= m.start() and any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= ENTROPY:
            out.append((m.start(), m.end(), 3, s))
    return sorted(out)


def scan(docs: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column) -> DataFrame:
    """id, mark (hash of the text), repo, owner, n_assign, n_access, n_hex, base_sha256, found: array of (start, end,
    kind, value: 128-bit hash in hex, never the secret itself). One row per document, map-only."""
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found, counts, digests = [], np.zeros((3, batch.num_rows), np.int64), []
            for i, text in enumerate(batch.column(1).to_pylist()):
                got = candidates(text) if text else []
                for k in range(3):
                    counts[k, i] = sum(x[2] == k for x in got)
                base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, _ in got if k < 3)
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                found.append([{"start": a, "end": b, "kind": k, "value": hashlib.blake2b(v.encode(), digest_size=16).hexdigest()} for a, b, k, v in got])
            arrays = [batch.column(0), batch.column(2), batch.column(3), batch.column(4), *(pa.array(c) for c in counts), pa.array(digests), pa.array(found, pa.list_(item))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "mark", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    bare = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("mark"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"))
    return bare.mapInArrow(run, f"id {kind}, mark long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:long,end:long,kind:int,value:string>>")


def ownership(found: DataFrame, texts_once: bool = False) -> DataFrame:
    """value, n_rows, n_repos, n_owners, named (seen by a pattern of the contract), live.

    texts_once: all rows of a text count for its least owner, as where each document is an owner of its own.

    Distinct repositories and owners are counted in two steps, so a value that a third of the corpus holds is summed
    before it is shuffled, and again before it meets in one row. A missing repository or owner counts as one.
    """
    each = found.filter("size(found) > 0").select("mark", "repo", "owner", F.explode("found").alias("x")).select("mark", "repo", "owner", "x.value", (F.col("x.kind") < 3).alias("named"))
    if texts_once:
        each = each.groupBy("value", "mark").agg(F.min("owner").alias("owner"), F.min("repo").alias("repo"), F.count("*").alias("rows"), F.max("named").alias("named"))
    else:
        each = each.withColumn("rows", F.lit(1))
    held = each.groupBy("value", "owner", "repo").agg(F.sum("rows").alias("rows"), F.max("named").alias("named"))
    by_owner = held.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("rows").alias("rows"), F.max("named").alias("named"))
    # a repository belongs to one owner; where several claim it, it counts for each
    total = by_owner.groupBy("value").agg(F.sum("rows").alias("n_rows"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.max("named").alias("named"))
    return total.withColumn("live", F.col("n_owners") < COPIED_OWNERS)


def judged(found: DataFrame, values: DataFrame) -> DataFrame:
    """id, mark, spans: array of (start, end, kind, live), for each row with candidates.

    Bare tokens are spans where their value is owner-specific or is named as a secret elsewhere; base candidates always.
    """
    total = values.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    each = found.filter("size(found) > 0").dropDuplicates(["id", "mark"]).select("id", "mark", F.explode("found").alias("x")).select("id", "mark", "x.start", "x.end", "x.kind", "x.value")
    told = attach(each, values.select("value", "n_rows", "named", "live"), "value", "n_rows", total).filter("kind < 3 or named or live")
    return told.groupBy("id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("spans"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans ("kind:start:end", comma-joined), n_live, n_copied.

    repo and owner default to the text's hash, so that exact copies count once, and to `source` (the id where there is no
    such column; there, too, exact copies count once). Null text counts as empty
    and has no spans; null ids are kept; repeated rows give one row each; an empty table gives none; other columns are
    ignored. Spans of live values look like credentials of one owner, those of copied values like examples.
    """
    repo = F.xxhash64(text_col) if repo is None else repo
    once = owner is None and "source" not in docs.columns
    owner = (F.col("source") if "source" in docs.columns else F.col(id_col)) if owner is None else owner
    found = stage(scan(docs, id_col, text_col, repo, owner), "secrets")
    spans = judged(found, stage(ownership(found, once), "values"))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s["end"])), ",")
    told = spans.select(F.col("id").alias("i"), F.col("mark").alias("m"), text.alias("spans"), F.size(F.filter("spans", lambda s: s.live)).alias("n_live"), F.size("spans").alias("n"))
    out = found.join(told, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    live = F.coalesce("n_live", F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), live.alias("n_live"), (F.coalesce("n", F.lit(0)) - live).alias("n_copied")
    )


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with each owner-specific value (its whole span) replaced by mask; copied examples and all else stay.

    Null and empty texts and rows with null ids stay as they are but for their own secrets; repeated rows are masked alike;
    spans that overlap are masked as one; an empty table gives none.
    """
    once = "source" not in docs.columns
    repo, owner = F.xxhash64(text_col), F.col(id_col) if once else F.col("source")
    found = stage(scan(docs, id_col, text_col, repo, owner).filter("size(found) > 0"), "secrets")
    spans = judged(found, stage(ownership(found, once), "values"))
    own, mark, live, fp = fresh(docs, "__id", "__mark", "__live", "__fp")
    side = spans.select(F.col("id").alias(own), F.col("mark").alias(mark), F.transform(F.filter("spans", lambda s: s.live), lambda s: F.struct(s.start, s["end"])).alias(live)).filter(F.size(live) > 0)
    rows = docs.withColumn(fp, F.xxhash64(text_col)).join(side, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(fp) == F.col(mark)), "left").select(*docs.columns, live)
    text_at, schema = docs.columns.index(text_col), docs.schema

    def masked(text: str, places: list[dict]) -> str:
        """What stands before each span that starts past all spans before it, then the mask; then the rest."""
        out, at = [], 0
        for s in places:
            if s["start"] >= at:
                out += [text[at : s["start"]], mask]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text_at):
            texts = batch.column(text_at)
            places = batch.column(batch.num_columns - 1)
            if places.null_count < len(places):
                texts = pa.array([masked(t, x) if x else t for t, x in zip(texts.to_pylist(), places.to_pylist(), strict=True)], texts.type)
            yield pa.RecordBatch.from_arrays([texts if k == text_at else batch.column(k) for k in range(batch.num_columns - 1)], schema.names)

    return rows.mapInArrow(run, schema)
