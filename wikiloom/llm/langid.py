"""Language identification (operator 1): nearest of several clustered centroids per language, by cosine of TF-IDF n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.llm.common import bounded
from wikiloom.llm.textgrid import BOUNDARY, LETTER, Grid, mix, slabs

#: Hashed n-gram dimensions; n-gram orders; centroids per language.
DIMS, ORDERS, CENTROIDS = 4096, (1, 2, 3), 4
#: Labelled rows that the classifier is fitted on, for each language and (with few languages, of which each has a row) in all.
PER_LANGUAGE, IN_ALL = 1000, 4000
#: A text is rejected when its cosine is under this share of what nearly all labelled texts with about as many different
#: n-grams reach.
REJECT_SHARE, REJECT_QUANTILE = 0.7, 0.005


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed character n-grams within words (each word between blanks) and letters of each text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    letters = np.zeros(len(texts), np.int64)
    for a, b in slabs(texts):
        grid = Grid(texts[a:b], fold=True)
        cls = grid.cls & 7
        letter = cls == LETTER
        doc = np.repeat(np.arange(b - a), np.diff(np.concatenate([[0], grid.ends + 1])))
        letters[a:b] = np.bincount(doc[letter], minlength=b - a)
        unit = np.where(letter, grid.cp, 32).astype(np.uint64)
        blank = ~letter
        edge = cls == BOUNDARY
        for n in ORDERS:
            m = len(unit) - n + 1
            if m <= 0:
                continue
            h, bad = np.full(m, n, np.uint64), np.zeros(m, bool)
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + unit[k : m + k]
                bad |= edge[k : m + k] if n > 1 else blank[k : m + k]
                if 0 < k < n - 1:
                    bad |= blank[k : m + k]  # a blank only at either end
            if n > 1:
                bad |= blank[:m] & blank[n - 1 :]
            at = ~bad
            slot = (mix(h[at]) >> np.uint64(20)).astype(np.int64) % DIMS
            where = doc[:m][at] * DIMS + slot
            out[a:b] += np.bincount(where, minlength=(b - a) * DIMS).reshape(b - a, DIMS).astype(np.float32)
    return out, letters


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # all languages' centroids, one a row
    owner: np.ndarray  # of each centroid, the place of its language
    floor: np.ndarray  # least cosine, by the logarithm of the number of different n-grams

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts)
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return x

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the language (-1: no letter), score and whether it is rejected, for each text."""
        place, score, out = np.full(len(texts), -1), np.zeros(len(texts)), np.ones(len(texts), bool)
        for a in range(0, len(texts), 256):
            counts, letters = vectors(texts[a : a + 256])
            if not len(self.langs):
                continue
            cosine = self.weigh(counts) @ self.centroids.T
            best = np.full((len(counts), len(self.langs)), -1.0)
            for c, k in enumerate(self.owner):
                best[:, k] = np.maximum(best[:, k], cosine[:, c])
            top = best.argmax(axis=1)
            near = best[np.arange(len(best)), top]
            share = np.exp(20 * (best - near[:, None]))
            real = letters > 0
            place[a : a + 256] = np.where(real, top, -1)
            score[a : a + 256] = np.where(real, np.clip(1 / share.sum(axis=1), 0, 1), 0)
            out[a : a + 256] = ~real | (near < self.floor[buckets(counts, len(self.floor))])
        return place, score, out


def buckets(counts: np.ndarray, n: int) -> np.ndarray:
    """By the logarithm of how many different n-grams a text has: a long text that repeats itself is like a short one."""
    return np.minimum(np.log2(np.maximum(np.count_nonzero(counts, axis=1), 1)).astype(int), n - 1)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out first rows; unit centroids."""
    first = [0]
    while len(first) < min(k, len(x)):
        first.append(int((x @ x[first].T).max(axis=1).argmin()))
    c = x[first]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _sampled(docs: DataFrame, key: Column) -> DataFrame:
    """lang, text of PER_LANGUAGE labelled rows per language (fewer where languages are many), those with the least hashes
    of key. Every language has rows; a share that is surely enough is taken before rows are ranked."""
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"))
    each = max(1, min(PER_LANGUAGE, IN_ALL // max(1, sizes.count())))
    place = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30))
    few = docs.join(F.broadcast(sizes), "lang").withColumn("place", place).filter(F.col("place") / float(1 << 30) < (2 * each + 40) / F.col("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "k"))
    return few.withColumn("first", first).filter(F.col("first") <= each).select("lang", "text")


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model:
    """Fit on a bounded sample of labelled rows: n-gram counts are made in tasks and come as (slot, count) pairs; the
    centroids are found among at most IN_ALL rows, or one a language."""
    named = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("k")).filter("text is not null and lang is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 128):
                counts, letters = vectors(texts[a : a + 128])
                slots, times = zip(*((np.flatnonzero(c).astype(np.uint16).tobytes(), c[c > 0].astype(np.uint32).tobytes()) for c in counts), strict=True) if len(counts) else ((), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 128), pa.array(slots, pa.binary()), pa.array(times, pa.binary()), pa.array(letters)], ["lang", "slots", "times", "letters"])

    found = _sampled(named, F.col("k")).mapInArrow(run, "lang string, slots binary, times binary, letters long").filter("letters > 0").toArrow()
    names, letters = found.column("lang").to_pylist(), found.column("letters").to_numpy()
    slots, times = ([np.frombuffer(b, kind) for b in found.column(c).to_pylist()] for c, kind in (("slots", np.uint16), ("times", np.uint32)))
    del found
    langs = sorted(set(names))
    own = np.searchsorted(langs, names) if langs else np.zeros(0, int)
    order = np.lexsort(([t.sum() for t in times], letters, own)) if langs else np.zeros(0, int)  # the same fit in whatever order rows come
    x = np.zeros((len(names), DIMS), np.float32)
    for row, i in zip(x, order.tolist(), strict=True):
        row[slots[i]] = times[i]
    own = own[order]
    idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 1
    model = Model(langs, idf, np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(20))
    at = buckets(x, 20)
    for a in range(0, len(x), 256):  # in place: the driver holds the sample once
        x[a : a + 256] = model.weigh(x[a : a + 256])
    parts = [cluster(x[own == k], CENTROIDS) for k in range(len(langs))]
    if parts:
        model.centroids, model.owner = np.concatenate(parts).astype(np.float32), np.repeat(np.arange(len(langs)), [len(p) for p in parts])
        near = np.concatenate([(x[own == k] @ p.T).max(axis=1) for k, p in enumerate(parts)])
        for j in range(20):
            close = near[np.abs(at - j) <= 1]
            # too few such texts: what holds for shorter ones
            model.floor[j] = REJECT_SHARE * np.quantile(close, REJECT_QUANTILE) if len(close) >= 100 else model.floor[j - 1] if j else 0
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id, lang_pred, score, rejected for each row, and its columns `keep`.

    lang_pred is a learned language; `und` where the text is null or has no letter, or nothing could be learned. Rejected
    are `und` and texts too far from all centroids for their number of different n-grams; of equally near languages the
    first by name is taken. Null ids are kept and repeated rows give one row
    each; an empty table gives none. Whole texts count. Map-only; the model has a fixed size for each language.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = np.array([*model.langs, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            place, score, out = model.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[place], pa.string()), pa.array(score), pa.array(out)], ["id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the classifier doesn't reject: null and empty texts and texts without a letter go,
    repeated rows stay or go together, null ids count like others; an empty table, or nothing learned, gives no rows."""
    text_at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text_at):
            yield batch.filter(pa.array(~model.predict([t or "" for t in batch.column(text_at).to_pylist()])[2]))

    return docs.mapInArrow(run, schema)
