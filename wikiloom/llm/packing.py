"""Best-fit packing (operator 10): pattern packing by non-negative least squares over the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.llm.bpe import Encoder
from wikiloom.llm.common import bounded, stage

#: Pieces of one length that are numbered by one task.
RANK_ROWS = 50_000


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, size: int, separator: int) -> DataFrame:
    """Each document's ids and the separator, cut into pieces of `size` tokens; the first piece takes the remainder."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in bounded(batches):
            doc, piece, start, length, crc = [], [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, ids in enumerate(encoder.encode(texts)):
                ids = np.append(ids, np.uint32(separator)).astype("<u4")
                at, k = 0, 0
                while at < len(ids):
                    stop = at + (len(ids) % size or size) if k == 0 else at + size
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(ids[at:stop]))
                    at, k = stop, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares, min |a x - b| with x >= 0, by accelerated projected gradients."""
    v = np.ones(a.shape[1])
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(a.T @ (a @ v)))
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (last - 1) / t * (new - x)
        x = new
    return x


def patterns(bins: int, most: int) -> list[tuple[int, ...]]:
    """Multisets of 2 to `most` bin numbers from 1 to bins that fill `bins` exactly."""
    out, open_ = [], [((), bins, bins)]
    while open_:
        have, left, top = open_.pop()
        if left == 0:
            out.append(have)
        elif len(have) < most:
            low = -(-left // (most - len(have)))  # else too little room remains for as few parts
            open_ += [((*have, k), left - k, k) for k in range(max(1, low), min(top, left) + 1)]
    return [p for p in out if len(p) > 1]


def plan(counts: np.ndarray, size: int, bins: int = 256, most: int = 3, slack: int = 2) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): every piece of the histogram counts[length] in exactly one place.

    Lengths are grouped into `bins` classes, rounded up. Repeat counts of the patterns that fill all classes are fitted
    to the class histogram by NNLS and rounded down. Of each class the longest pieces go first; the last place of a
    pattern takes the longest piece that fits exactly what the others leave, so that rounding lengths costs no room; a
    pattern that would still leave `slack` tokens open is not repeated further. What the patterns leave is packed by best fit, longest first, into the room left in them and then into new sequences.
    """
    left = {n: int(c) for n, c in enumerate(counts) if n and c}
    out: list[list] = []
    if left.get(size):
        out.append([[size], left.pop(size)])
    width = -(-size // bins)
    bins = -(-size // width)
    shape = patterns(bins, most)
    matrix = np.zeros((bins + 1, len(shape)))
    for j, p in enumerate(shape):
        np.add.at(matrix[:, j], list(p), 1)
    seen = np.zeros(bins + 1)
    for n, c in left.items():
        seen[-(-n // width)] += c
    fit = np.floor(nnls(matrix, seen)).astype(np.int64) if shape else np.zeros(0, np.int64)
    alive = sorted(left)

    def longest(limit: int, have: list[int]) -> int | None:
        """The longest length up to limit of which pieces are left besides those in `have`."""
        i = bisect_right(alive, limit) - 1
        while i >= 0:
            n = alive[i]
            if left[n] > have.count(n):
                return n
            if not left[n]:
                alive.pop(i)
            i -= 1
        return None

    for j in np.argsort(-fit, kind="stable"):
        repeats = int(fit[j])
        while repeats:
            take: list[int] = []
            for k in shape[j]:
                n = longest(k * width if len(take) + 1 < len(shape[j]) else size - sum(take), take)
                if n is None:
                    break
                take.append(n)
            if len(take) < len(shape[j]) or size - sum(take) >= slack:
                break
            times = min(repeats, *(left[n] // take.count(n) for n in take))
            for n in take:
                left[n] -= times
            out.append([take, times])
            repeats -= times
    # best fit: rooms by space left, each room a pattern with its repeats
    room: dict[int, list[list]] = {}
    spaces: list[int] = []

    def open_room(p: list) -> None:
        space = size - sum(p[0])
        if space:
            if space not in room:
                insort(spaces, space)
            room.setdefault(space, []).append(p)

    for p in out:
        open_room(p)
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        c = left[n]
        while c:
            i = bisect_left(spaces, n)
            if i == len(spaces):
                # as many of this length as fit share a new sequence
                fits = min(size // n, c)
                new = [[n] * fits, c // fits]
                c -= fits * new[1]
                out.append(new)
                open_room(new)
                continue
            space = spaces[i]
            p = room[space].pop()
            if not room[space]:
                del room[space]
                spaces.pop(i)
            fits = min(space // n, c)
            times = min(p[1], c // fits)
            if times < p[1]:
                rest = [list(p[0]), p[1] - times]
                out.append(rest)
                open_room(rest)
                p[1] = times
            p[0] += [n] * fits
            c -= fits * times
            open_room(p)
    return [(tuple(p), times) for p, times in out]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, separator: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents of up to `size` tokens, the separator included, stay whole. Pieces are numbered within their length, in
    blocks of at most about RANK_ROWS, so no task holds all pieces of a common length; the plan for the histogram
    (size + 1 counts) is made on the driver, has a few rows for each length and is looked up by (length, number).
    Null or empty text is the separator alone. A null id is kept; repeated rows are packed once each; an empty table
    gives no rows; further columns of docs are ignored.
    """
    spark = docs.sparkSession
    cut = stage(pieces(docs, path, id_col, text_col, size, separator), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for n, c in cut.groupBy("length").count().collect():  # at most `size` rows
        counts[n] = c
    blocks = np.maximum(1, -(-counts // RANK_ROWS))
    per = F.array(*(F.lit(int(b)) for b in blocks))
    spread = F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.element_at(per, F.col("length").cast("int") + 1)).cast("int")
    rows = cut.withColumn("block", spread)
    sizes = rows.groupBy("length", "block").count()
    before = sizes.withColumn("first", F.sum("count").over(Window.partitionBy("length").orderBy("block")) - F.col("count")).drop("count")

    slots, sequence, used = [], 0, np.zeros(size + 1, np.int64)
    for lengths, times in plan(counts, size):
        at = 0
        for n in lengths:
            slots.append((int(n), int(used[n]), int(used[n] + times), sequence, at))
            used[n] += times
            at += n
        sequence += times
    schema = "length long, slot_from long, slot_to long, slot_sequence long, offset long"
    places = spark.createDataFrame(slots, schema).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("slot_from", "slot_to", "slot_sequence", "offset"))).alias("slots"))

    number = F.row_number().over(Window.partitionBy("length", "block").orderBy("id", "piece", "start", "ids_crc32")).cast("long") - 1
    ranked = rows.withColumn("number", number).join(before, ["length", "block"]).withColumn("number", F.col("number") + F.col("first"))
    found = ranked.join(F.broadcast(places), "length").withColumn("slot", F.filter("slots", lambda s: (F.col("number") >= s.slot_from) & (F.col("number") < s.slot_to))[0])
    return found.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("slot.slot_sequence") + F.col("number") - F.col("slot.slot_from")).alias("sequence_id"), F.col("slot.offset").alias("offset")
    )
