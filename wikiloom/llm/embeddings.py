"""Embedding near-dedup (operator 6): randomised-rotation binary codes with correction factors choose what is recomputed."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.common import attach, scaled_partitions, stage
from wikiloom.llm.components import Forest, block_pairs, components, each_group

#: Chance with which a pair just at the threshold shares a band; bits of a band, 10 at least, else rows / ROWS_A_BAND.
RECALL, ROWS_A_BAND = 0.998, 64
#: Standard errors of the estimate that are granted before a pair is dropped without a closer look.
EPSILON = 5.0
#: Vectors that one side of a block holds about.
BLOCK_ROWS = 2048
#: Pairs that a task estimates at a time.
CHUNK_PAIRS = 100_000
_PLANES = 8  # bits of a coordinate of the quantised side


def banding(rows: int, cosine: float) -> tuple[int, int]:
    """Bits and number of bands: buckets stay small as rows grow, pairs at the threshold share a band with RECALL."""
    bits = max(10, math.ceil(math.log2(max(rows, 2) / ROWS_A_BAND)))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agree))


@cache
def rotation(dim: int, size: int, seed: int = 7) -> np.ndarray:
    """size x dim: blocks of random orthogonal rotations, one above another."""
    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(-(-size // dim)):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts)[:size]


@cache
def _projections(dim: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rotations as whole numbers, and their sums: products with quantised coordinates are exact in any order."""
    r = np.rint(rotation(dim, size) * (1 << 15))
    return r, r.sum(axis=1)


def _words(dim: int) -> int:
    return -(-dim // 64)


def _packed(x: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(x), _words(x.shape[1]) * 64), bool)
    wide[:, : x.shape[1]] = x
    return np.packbits(wide, axis=1)


def encoded(unit: np.ndarray) -> list[bytes]:
    """What is stored of each unit vector, rotated into one orthogonal frame: its signs (the binary code), its coordinates
    as bit planes of 8-bit numbers, and factor, low, step and error as floats.

    factor is <c, o>, c being the code as a unit vector; a coordinate is low + step * number; error bounds the distance of
    the vector so written from the vector itself.
    """
    n, dim = unit.shape
    turned = unit @ rotation(dim, dim, 11).T
    low = turned.min(axis=1).astype(np.float32)
    step = np.maximum((turned.max(axis=1) - low) / (2**_PLANES - 1), 1e-12).astype(np.float32)
    wide = low.astype(np.float64)[:, None], step.astype(np.float64)[:, None]
    level = np.rint((turned - wide[0]) / wide[1]).clip(0, 2**_PLANES - 1).astype(np.int64)
    error = np.linalg.norm(turned - wide[0] - wide[1] * level, axis=1) * (1 + 1e-6) + 1e-9
    factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
    parts = [_packed(turned > 0), *(_packed((level >> k) & 1 == 1) for k in range(_PLANES)), np.stack([factor, low, step, error], axis=1).astype("<f4").view(np.uint8)]
    return [row.tobytes() for row in np.concatenate(parts, axis=1)]


class Codes:
    """Stored codes read again: bounds of inner products by bit counts, and closer ones by whole numbers.

    <o, q> is estimated as <c, q> / <c, o>, which is unbiased over rotations; its standard error is known from <c, o> alone.
    """

    def __init__(self, stored: list[bytes], dim: int):
        raw = np.frombuffer(b"".join(stored), np.uint8).reshape(len(stored), -1)
        size = 8 * _words(dim)
        self.dim = dim
        self.bits = raw[:, :size].copy().view(np.uint64)
        self.planes = [raw[:, size * (k + 1) : size * (k + 2)].copy().view(np.uint64) for k in range(_PLANES)]
        self.factor, self.low, self.step, self.error = raw[:, size * (_PLANES + 1) :].copy().view("<f4").astype(np.float64).T
        self.ones = np.bitwise_count(self.bits).sum(axis=1).astype(np.float64)
        self.total = sum(np.bitwise_count(p).sum(axis=1) * float(1 << k) for k, p in enumerate(self.planes))

    def levels(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return sum(np.unpackbits(p[rows].view(np.uint8), axis=1)[:, : self.dim] * float(1 << k) for k, p in enumerate(self.planes))

    def upper(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper confidence bounds of the inner products of pairs (i, j), from i's code and j's quantised coordinates."""
        both = np.zeros(len(i))
        for k, plane in enumerate(self.planes):
            for word in range(plane.shape[1]):
                both += np.bitwise_count(plane[j, word] & self.bits[i, word]) * float(1 << k)
        # <c, q> over axes with c > 0 less that over the rest
        plus = both * self.step[j] + self.ones[i] * self.low[j]
        whole = self.total[j] * self.step[j] + self.dim * self.low[j]
        f = self.factor[i]
        spread = np.sqrt(np.maximum(1 - f * f, 0) / max(self.dim - 1, 1)) / f
        return (2 * plus - whole) / math.sqrt(self.dim) / f + EPSILON * spread + self.error[j]

    def closer(self, i: np.ndarray, j: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sure bounds, from both vectors' quantised coordinates; the same in whatever task they are worked out."""
        a, b, c, d = self.low[i], self.low[j], self.step[i], self.step[j]
        near = self.dim * a * b + a * d * self.total[j] + b * c * self.total[i] + c * d * np.einsum("ij,ij->i", levels[i], levels[j])
        e, f = self.error[i], self.error[j]
        room = (1 + e) * f + (1 + f) * e + e * f + 1e-9
        return near - room, near + room

    def keys(self, rows: np.ndarray, bits: int, bands: int) -> np.ndarray:
        """The bucket of each band: signs of rotations of the quantised vector."""
        turns, sums = _projections(self.dim, bits * bands)
        signs = self.low[rows, None] * sums + self.step[rows, None] * (self.levels(rows) @ turns.T) > 0
        return signs.reshape(len(signs), bands, bits) @ (1 << np.arange(bits)).astype(np.int64)


def _pairs(own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a bucket's block, or of two blocks, some rows of the first side at a time."""
    if (own == own[0]).all():
        left, right = np.arange(len(own)), np.arange(len(own))
    else:
        left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
    step = max(1, CHUNK_PAIRS // len(right))
    for a in range(0, len(left), step):
        i, j = np.repeat(left[a : a + step], len(right)), np.tile(right, len(left[a : a + step]))
        if (own == own[0]).all():
            keep = j > i
            i, j = i[keep], j[keep]
        if len(i):
            yield i, j


_LINKS = "u long, v long, n long, dim int, bucket long, block_a int, block_b int, own int, band int"


def _linker(cosine: float, bits: int, bands: int, exact: bool):
    def link(group: pa.Table) -> pa.RecordBatch | None:
        """Of one bucket (or two of its blocks): links whose first common band this is, counted, and a spanning forest.

        Rows out: (u, v, n): v null: n more linked vectors of u; else a link. Codes alone decide nearly all pairs; n is
        -1 for vectors of pairs that they leave open. With `exact`, the group are these vectors, their coordinates are
        there, and the open pairs alone are worked out in double precision.
        """
        ids, own, size = (group.column(c).to_numpy() for c in ("id", "own", "copies"))
        if len(ids) < 2:
            return None
        here, dim = group.column("band")[0].as_py(), group.column("dim")[0].as_py()
        codes, forest, links = Codes(group.column("code").to_pylist(), dim), Forest(len(ids)), []
        levels = codes.levels()
        unit = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(len(ids), -1) if exact else None
        more, open_ = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        keys = np.zeros((len(ids), bands), np.int64)
        keyed = np.zeros(len(ids), bool)
        for i, j in _pairs(own):
            may = codes.upper(i, j) >= cosine
            i, j = i[may], j[may]
            least, most = codes.closer(i, j, levels)
            may = (most >= cosine) & (least < cosine) if exact else most >= cosine
            i, j, least = i[may], j[may], least[may]
            if here and len(i):  # what met in an earlier band is counted there
                new = np.unique(np.concatenate([i, j]))
                new = new[~keyed[new]]
                keys[new], keyed[new] = codes.keys(new, bits, bands), True
                first = ~(keys[i, :here] == keys[j, :here]).any(axis=1)
                i, j, least = i[first], j[first], least[first]
            if exact:
                true = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
            else:
                true = least >= cosine
                open_[i[~true]] = open_[j[~true]] = True
            i, j = i[true], j[true]
            np.add.at(more, i, size[j])
            np.add.at(more, j, size[i])
            while len(i):
                roots = forest.roots()
                apart = roots[i] != roots[j]
                i, j = i[apart], j[apart]
                # one link for each two trees at a time
                _, first = np.unique(np.stack([roots[i], roots[j]]), axis=1, return_index=True) if len(i) else (None, [])
                links += [(ids[i[k]], ids[j[k]]) for k in first if forest.join(int(i[k]), int(j[k]))]
        at, left = np.flatnonzero(more), np.flatnonzero(open_)
        if not len(at) and not len(left):
            return None
        u = np.concatenate([ids[at], ids[left], [a for a, _ in links]]).astype(np.int64)
        v = pa.array([None] * (len(at) + len(left)) + [int(b) for _, b in links], pa.int64())
        n = np.concatenate([more[at], np.full(len(left), -1), np.zeros(len(links), np.int64)]).astype(np.int64)
        where = [np.full(len(u), group.column(c)[0].as_py(), np.int64 if c == "bucket" else np.int32) for c in ("dim", "bucket", "block_a", "block_b")]
        sides = np.zeros(len(u), np.int32)
        sides[len(at) : len(at) + len(left)] = own[left]
        return pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(n), *map(pa.array, where), pa.array(sides), pa.array(np.full(len(u), here, np.int32))], ["u", "v", "n", "dim", "bucket", "block_a", "block_b", "own", "band"])

    return link


def units(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dim, unit (its coordinates as little-endian doubles; null for vectors that link with nothing), key (128-bit hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dims = [], []
            for v in batch.column(1).to_pylist():
                x = np.array(v, np.float64) if v and all(c is not None for c in v) else np.zeros(0)
                most = np.abs(x).max(initial=0)
                good = len(x) and np.isfinite(x).all() and most > 0
                if good:
                    x = x / most
                    x = x / np.sqrt((x * x).sum())
                dims.append(len(x) if good else 0)
                out.append(x.astype("<f8").tobytes() if good else None)
            keys = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(out, pa.binary()), pa.array(keys, pa.binary())], ["id", "dim", "unit", "key"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, dim int, unit binary, key binary")


def _coded(rows: DataFrame) -> DataFrame:
    """(class, rep, dim, unit, copies, key) with code, which encoded() makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, units_ = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            codes: list[bytes] = [b""] * len(units_)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for i, code in zip(at, encoded(np.frombuffer(b"".join(units_[i] for i in at), np.float64).reshape(len(at), -1)), strict=True):
                    codes[i] = code
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], [*batch.schema.names, "code"])

    return rows.mapInArrow(run, "class long, rep long, dim int, unit binary, copies long, key binary, code binary")


def _spread(coded: DataFrame, bits: int, bands: int) -> DataFrame:
    """dim, bucket, band, id, copies, code: each class once for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, stored = batch.column(0).to_numpy(), batch.column(3).to_pylist()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                keys = Codes([stored[i] for i in at], int(dim)).keys(np.arange(len(at)), bits, bands)
                part = batch.take(pa.array(at))
                for k in range(bands):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys[:, k] * bands + k), pa.array(np.full(len(at), k, np.int32)), *part.columns[1:]], ["dim", "bucket", "band", "id", "copies", "code"])

    return coded.select("dim", F.col("class").alias("id"), "copies", "code").mapInArrow(run, "dim int, bucket long, band int, id long, copies long, code binary")


def embedding_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per vector: the id, n_links (other vectors with a cosine of `cosine` or more), component_id (least id that
    links reach), kept (id = component_id).

    1. Equal vectors form a class, of which one goes on with its number of copies. Its codes are made once and stored.
    2. Signs of random rotations are cut into bands; codes that share a band's bucket meet, a large bucket in blocks.
    3. In a bucket, binary codes give an unbiased estimate and an upper bound of each inner product; for what the bound
       keeps, quantised coordinates give bounds that are sure. Only vectors of pairs between the two bounds are sent after
       their codes, bucket by bucket, and recomputed in double precision. A pair counts in the first band that it shares.
    4. Tasks return counts and a spanning forest, never pairs; components are taken of the forests.

    Null, zero or empty vectors and those with null or non-finite components link with nothing, nor do vectors of
    different lengths. A null id has a null component and is kept. Ids are whole numbers; rows that share one are vectors
    of their own for the counts and one node of the components. An empty table gives none; other columns are ignored.
    """
    spark = rows.sparkSession
    found = stage(units(rows, id_col, vector_col), "units")
    full = found.filter("unit is not null and id is not null")
    total = full.count()
    classes = full.groupBy("key", "dim").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("unit").alias("unit"))
    # one class may hold ids that other classes hold too: its own number then tells it apart
    numbered = classes.select(F.monotonically_increasing_id().alias("class"), "rep", "dim", "unit", "copies", "key")
    alone = stage(_coded(stage(numbered, "classes")), "codes")
    member = stage(attach(full.select("id", "key"), alone.select("key", "rep", "copies"), "key", "copies", total).select("id", "rep").distinct(), "members")
    bits, bands = banding(alone.count(), cosine)
    task = ["dim", "bucket", "block_a", "block_b"]

    each = _spread(alone, bits, bands)
    sizes = stage(_spread(alone.withColumn("copies", F.lit(0).cast("long")), bits, bands).groupBy("dim", "bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    keyed = each.withColumn("key", F.struct("dim", "bucket"))
    dealt = block_pairs(attach(keyed, sizes.select(F.struct("dim", "bucket").alias("key"), "n"), "key", "n", bands * total), F.ceil(F.col("n") / BLOCK_ROWS), F.col("id"))
    work = dealt.select(*task, "own", "band", "id", "copies", "code")
    linked = stage(each_group(work, task, scaled_partitions(spark, 2), _linker(cosine, bits, bands, False), _LINKS), "links")
    open_ = linked.filter("n = -1").drop("v", "n").withColumnRenamed("u", "id")
    again = open_.join(alone.select(F.col("class").alias("id"), "copies", "code", "unit"), "id").select(*task, "own", "band", "id", "copies", "code", "unit")
    closer = stage(each_group(again, task, scaled_partitions(spark, 2), _linker(cosine, bits, bands, True), _LINKS), "links")
    linked = linked.filter("n >= 0").unionByName(closer).select("u", "v", "n")

    more = linked.filter("v is null").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("more"))
    counted = alone.select("class", "key", "copies").join(more, "class", "left")
    by_key = counted.select("key", (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    reps = alone.select("class", "rep")
    edges = linked.filter("v is not null").select("u", "v").join(reps.select(F.col("class").alias("u"), F.col("rep").alias("a")), "u").join(reps.select(F.col("class").alias("v"), F.col("rep").alias("b")), "v")
    final = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(member.filter("id <> rep").join(member.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select("id"), "id", "left_semi").select(F.col("id").alias("u"), F.col("rep").alias("v"))))
    rep = member.groupBy("id").agg(F.min("rep").alias("rep"))
    home = stage(rep.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component_id")), "homes")
    out = attach(full.select("id", "key"), by_key, "key", "copies", total).select("id", "n_links")
    out = out.unionByName(found.filter("unit is null or id is null").select("id", F.lit(0).cast("long").alias("n_links")))
    out = out.join(home, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long"), "component_id", (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))
