"""Cross-tokenizer alignment (operator 12): two tokenizers' tokens linked where they end together, counted in id-striped matrices.

Three passes. Texts are encoded by both sides in blocks of documents; a block's links are cut into stripes of B ids
(id modulo STRIPES) and written down, and each task's pair counts beside them. Counts meet by stripe in a dense matrix (B ids
of the stripe by all A ids), whose row maxima are the best counts. Then the counts of a stripe, dealt to as many places as
its share of all links asks for, meet that stripe's links, and each block gets sums for its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.bpe import Encoder, Pool
from wikiloom.llm.common import bounded, stage
from wikiloom.llm.textgrid import Grid, prefix, slabs, span_hashes
from wikiloom.llm.tokens import _byte_of, library

#: B ids are dealt into so many stripes; one stripe's matrix has vocabulary B / STRIPES rows and a column for each A id.
STRIPES = 128
#: Distinct pairs that a task counts before it writes them down, and entries of a matrix in one row.
HELD_PAIRS, CHUNK = 2_000_000, 1_000_000
SPACE = "▁"


@cache
def pieces(path: str):
    """The sentencepiece model, and whether words encode apart: a space is a piece, and none holds one behind another character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return model, SPACE in names and not any(SPACE in x.lstrip(SPACE) for x in names)


def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries end to end, where each starts, and their sizes."""
    size = np.array([len(x) for x in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size


def _laid(table: tuple, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of ids end to end, and where each ends."""
    data, at, size = table
    size = size[ids]
    stop = np.cumsum(size)
    return data[np.repeat(at[ids] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)], stop


def byte_entries(path: str) -> list[bytes]:
    """By id, the bytes of a byte-level vocabulary's tokens; of special tokens, none."""
    byte_of, names = _byte_of(), {i: s for s, i in library(path, True).get_vocab(with_added_tokens=False).items()}
    return [bytes(byte_of.get(c, 63) for c in names.get(i, "")) for i in range(max(names) + 1)]


def piece_entries(path: str) -> list[bytes]:
    """By id, the bytes of a sentencepiece model's pieces; of unknown and control pieces, none."""
    model, _ = pieces(path)
    out = []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        out.append(b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(SPACE, " ").encode())
    return out


class Sides:
    """Both sides' tokens of a slab of texts, each with a space before it, and what links them."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Encoder(a_path, plain=True)
        self.model, self.apart = pieces(b_path)
        lone = [self.model.piece_to_id(SPACE)]  # the model adds the first space, but to nothing
        self.b = Pool(lambda texts: [x if t != " " else lone for t, x in zip(texts, self.model.encode([t[1:] for t in texts], num_threads=1), strict=True)])
        self.bytes_a, self.bytes_b = _table(byte_entries(a_path)), _table(piece_entries(b_path))
        most = max(len(self.bytes_a[1]), len(self.bytes_b[1]))
        self.names = _table([b"%d%c" % (i, c) for c in (44, 124, 59) for i in range(most)])  # followed by , or | or ;
        self.most = most

    def _ids_b(self, texts: list[str]) -> list[np.ndarray]:
        if not self.apart:
            return [np.array(x, np.int64) for x in self.model.encode([t[1:] for t in texts], num_threads=1)]
        grid = Grid(texts)
        space = grid.cp == 32
        start = np.zeros(len(space), bool)
        start[1:] = space[1:] & ~space[:-1]
        start[np.concatenate([[0], grid.ends[:-1] + 1])] = True
        start = np.flatnonzero(start)
        doc = np.searchsorted(grid.ends, start)
        end = np.minimum(np.append(start[1:], len(space)), grid.ends[doc])
        ids, size = self.b.look(span_hashes(prefix(grid.cp), start, end), lambda i: grid.joined[start[i] : end[i]])
        bounds = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(doc, np.arange(len(texts) + 1))]
        return [ids[x:y].astype(np.int64) for x, y in zip(bounds, bounds[1:], strict=False)]

    def links(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """For each text n_a, n_b and its groups as a string; for each link its text's number, A id and B id."""
        spaced = [f" {t}" if t else "" for t in texts]
        full = [i for i, t in enumerate(spaced) if t]
        n_a, n_b, groups = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [""] * len(texts)
        doc, link_a, link_b = [], [], []
        for lo, hi in slabs([spaced[i] for i in full]):
            some = full[lo:hi]
            part = [spaced[i] for i in some]
            for i, t, a, b in zip(some, part, self.a.encode(part), self._ids_b(part), strict=True):
                raw = np.frombuffer(t.encode(), np.uint8)
                (laid_a, end_a), (laid_b, end_b) = _laid(self.bytes_a, a), _laid(self.bytes_b, b)
                if not (np.array_equal(laid_a, raw) and np.array_equal(laid_b, raw)):
                    continue
                n_a[i], n_b[i] = len(a), len(b)
                both = np.intersect1d(end_a, end_b, assume_unique=True)
                last_a, last_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)
                groups[i] = self._groups(a, b, last_a, last_b)
                doc.append(np.full(len(both), i, np.int64))
                link_a.append(a[last_a])
                link_b.append(b[last_b])
        none = [np.zeros(0, np.int64)]
        return n_a, n_b, groups, np.concatenate(doc or none), np.concatenate(link_a or none).astype(np.int64), np.concatenate(link_b or none)

    def _groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """a1,a2|b1;a3|b2: each group's A ids, then its B ids."""
        line = np.empty(len(a) + len(b), np.int64)
        of_a, of_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        name_a, name_b = a.astype(np.int64), b.copy()
        name_a[last_a] += self.most
        name_b[last_b] += 2 * self.most
        line[np.arange(len(a)) + np.concatenate([[0], last_b + 1])[of_a]] = name_a
        line[np.arange(len(b)) + (last_a + 1)[of_b]] = name_b
        return _laid(self.names, line)[0][:-1].tobytes().decode()


def _packed(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", stripes: int = STRIPES, digest: bool = False) -> DataFrame:
    """One row per document: the id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    Side A is a byte-level BPE file of the tokenizers library, side B a sentencepiece model; both take a space and the whole
    text, special strings being plain text. Tokens that end at the same byte are linked and end a group; `groups` states all
    ids group by group (`digest`: its sha256 instead, so that no long strings are written down; '' stays ''). A pair's count
    is its number of links in the whole table; n_best are the links whose count is their B id's highest, ties included,
    count_sum is the sum of counts. Null and empty texts, and those that a side's tokens don't give back byte by byte, have zeros and ''.
    A null id is kept, repeated rows count each, an empty table gives no rows; further columns of docs are ignored.

    Shuffled are packed rows: each task's distinct pairs once, each block's (document, pair) once, each block's sums. A stripe
    with a large share of the links is dealt to as many places; a matrix has (B ids / stripes) x A ids cells, however large
    the table.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    width = len(byte_entries(a_path))
    rows_of_stripe = -(-len(piece_entries(b_path)) // stripes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        sides, number = Sides(a_path, b_path), TaskContext.get().partitionId() << 32
        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows(size: int, ids: pa.Array, **have) -> pa.RecordBatch:
            kinds = {"block": pa.int64(), "place": pa.int32(), "id": ids.type, "n_a": pa.int64(), "n_b": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "stripe": pa.int32()}
            kinds |= {"pair": pa.binary(), "doc": pa.binary(), "n": pa.binary(), "total_pair": pa.binary(), "total_n": pa.binary(), "total": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.nulls(size, t) if have.get(k) is None else have[k] if isinstance(have[k], pa.Array) else pa.array(have[k], t) for k, t in kinds.items()], list(kinds))

        def cut(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
            """Ranges of sorted keys (the stripe is what stands above the cells) by stripe, CHUNK at most."""
            edges = np.searchsorted(keys, np.arange(stripes + 1) * (rows_of_stripe * width))
            for s in range(stripes):
                for x in range(edges[s], edges[s + 1], CHUNK):
                    yield s, x, min(x + CHUNK, edges[s + 1])

        def totals(ids: pa.Array) -> Iterator[pa.RecordBatch]:
            for s, x, y in cut(held):
                yield rows(1, ids, stripe=[s], total_pair=[_packed(held[x:y] - s * rows_of_stripe * width, "<u4")], total_n=[_packed(counts[x:y], "<i8")], total=[int(counts[x:y].sum())])

        empty = None
        for batch in bounded(batches):
            ids = batch.column(0)
            empty = ids[:0]
            if not batch.num_rows:
                continue
            n_a, n_b, groups, doc, a, b = sides.links([t or "" for t in batch.column(1).to_pylist()])
            if digest:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            yield rows(batch.num_rows, ids, block=[number] * batch.num_rows, place=range(batch.num_rows), id=ids, n_a=n_a, n_b=n_b, n_links=np.bincount(doc, minlength=batch.num_rows), groups=groups)
            cell = (b % stripes) * (rows_of_stripe * width) + (b // stripes) * width + a
            keys, n = np.unique(cell * batch.num_rows + doc, return_counts=True)
            cell, doc = keys // batch.num_rows, keys % batch.num_rows
            for s, x, y in cut(cell):
                yield rows(1, ids, block=[number], stripe=[s], pair=[_packed(cell[x:y] - s * rows_of_stripe * width, "<u4")], doc=[_packed(doc[x:y], "<u2" if batch.num_rows <= 1 << 16 else "<u4")], n=[_packed(n[x:y], "<u4")])
            held, counts = _merged(np.concatenate([held, cell]), np.concatenate([counts, n]))
            if len(held) > HELD_PAIRS:
                yield from totals(ids)
                held, counts = held[:0], counts[:0]
            number += 1
        if empty is not None:
            yield from totals(empty)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None

        def best() -> Iterator[pa.RecordBatch]:
            if now is not None:
                at = np.flatnonzero(block)
                top = (block == block.max(axis=1, keepdims=True)).ravel()[at]
                flat = block.ravel()[at]
                for x in range(0, len(at), CHUNK):
                    y = x + CHUNK
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([v], pa.binary()) for v in (_packed(at[x:y], "<u4"), _packed(flat[x:y], "<i8"), _packed(top[x:y], "u1")))], ["stripe", "pair", "n", "best"])

        for batch in batches:
            for s, pair, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if s != now:
                    yield from best()
                    now, block = s, np.zeros((rows_of_stripe, width), np.int64)
                np.add.at(block.reshape(-1), np.frombuffer(pair, "<u4"), np.frombuffer(n, "<i8"))
        yield from best()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a place in order: its stripe's counts first (block is null), then its links."""
        now, count, top = None, None, None
        for batch in batches:
            out = []
            for s, block, pair, doc, n, best in zip(*(batch.column(c).to_pylist() for c in ("stripe", "block", "pair", "doc", "n", "best")), strict=True):
                if s != now:
                    now, count, top = s, np.zeros(rows_of_stripe * width, np.int64), np.zeros(rows_of_stripe * width, bool)
                pair = np.frombuffer(pair, "<u4")
                if block is None:
                    count[pair], top[pair] = np.frombuffer(n, "<i8"), np.frombuffer(best, "u1").astype(bool)
                    continue
                times, doc = np.frombuffer(n, "<u4").astype(np.int64), np.frombuffer(doc, "<u2" if len(doc) == 2 * len(pair) else "<u4").astype(np.int64)
                has, back = np.unique(doc, return_inverse=True)
                total, good = np.zeros(len(has), np.int64), np.zeros(len(has), np.int64)
                np.add.at(total, back, times * count[pair])
                np.add.at(good, back, times * top[pair])
                out.append((block, _packed(has, "<u4"), _packed(good, "<u4"), _packed(total, "<i8")))
            if out:
                block, *packed = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], ["block", "docs", "good", "total"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's sums first (place is null), then its documents."""
        now, good, total = None, np.zeros(1, np.int64), np.zeros(1, np.int64)
        for batch in batches:
            keep, best, summed = [], [], []
            for i, (block, place, *packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "place", "docs", "good", "total")), strict=True)):
                if block != now:
                    now, good, total = block, np.zeros(1, np.int64), np.zeros(1, np.int64)
                if place is None:
                    at = np.frombuffer(packed[0], "<u4")
                    if at[-1] >= len(good):
                        more = np.zeros(int(at[-1]) + 1 - len(good), np.int64)
                        good, total = np.concatenate([good, more]), np.concatenate([total, more])
                    good[at] += np.frombuffer(packed[1], "<u4")
                    total[at] += np.frombuffer(packed[2], "<i8")
                else:
                    keep.append(i)
                    best.append(int(good[place]) if place < len(good) else 0)
                    summed.append(int(total[place]) if place < len(good) else 0)
            have = batch.take(pa.array(keep, pa.int64()))
            links = have.column("n_links")
            yield pa.RecordBatch.from_arrays([have.column("id"), have.column("n_a"), have.column("n_b"), links, links, pa.array(best, pa.int64()), pa.array(summed, pa.int64()), have.column("groups")], ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    bare = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    written = stage(
        bare.mapInArrow(encode, f"block long, place int, id {kind}, n_a long, n_b long, n_links long, groups string, stripe int, pair binary, doc binary, n binary, total_pair binary, total_n binary, total long"), "alignment"
    )
    # at most `stripes` rows
    sizes = {r["stripe"]: r["total"] for r in written.filter("total is not null").groupBy("stripe").agg(F.sum("total").alias("total")).collect()}
    places, all_links = int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, sum(sizes.values()))
    spread = F.array(*(F.lit(-(-sizes.get(s, 0) * places // all_links) or 1) for s in range(stripes)))
    counts = stage(
        written.filter("total is not null").select("stripe", "total_pair", "total_n").repartition(min(places, stripes), "stripe").sortWithinPartitions("stripe").mapInArrow(matrices, "stripe int, pair binary, n binary, best binary"), "pair-counts"
    )
    none = F.lit(None)
    dealt = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.element_at(spread, F.col("stripe") + 1) - 1)).alias("salt"), none.cast("long").alias("block"), "pair", none.cast("binary").alias("doc"), "n", "best")
    found = written.filter("pair is not null").select("stripe", F.pmod(F.xxhash64("block"), F.element_at(spread, F.col("stripe") + 1)).cast("int").alias("salt"), "block", "pair", "doc", "n", none.cast("binary").alias("best"))
    scored = dealt.unionByName(found).repartition(places, "stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("block").asc_nulls_first()).mapInArrow(score, "block long, docs binary, good binary, total binary")
    own = ["id", "n_a", "n_b", "n_links", "groups"]
    asked = written.filter("place is not null").select("block", "place", *own, *(none.cast("binary").alias(c) for c in ("docs", "good", "total")))
    back = scored.select("block", none.cast("int").alias("place"), *(none.cast(asked.schema[c].dataType).alias(c) for c in own), "docs", "good", "total")
    out = back.unionByName(asked).repartition(places, "block").sortWithinPartitions("block", F.col("place").asc_nulls_first())
    return out.mapInArrow(sums, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string").withColumnRenamed("id", id_col)
