"""Toxicity (operator 3): nearest labelled examples by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.common import bounded
from wikiloom.llm.textgrid import Grid, mix, prefix, slabs, span_hashes

#: Labelled rows that the classifier is fitted on, of either label.
EXAMPLES = {1: 5000, 0: 12000}
#: In how many examples a term of the index must be (so the sample bounds their number). It must surely (standard errors of the
#: smoothed log odds) be LIFT times as likely in label 1: rare terms count where they are pure, however many rows there
#: are, common words that are a little more frequent don't.
SEEN, SURE, LIFT = 3, 1.64, 1.35
#: Neighbours that vote; examples in a block of the index; weight of the prior beside the votes.
NEAREST, BLOCK, PRIOR = 50, 64, 0.2
#: A word is a term, and so are its beginnings of these lengths.
PREFIXES = (4, 5, 6, 7)


def terms(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each text its sorted distinct term hashes, how often each occurs, and its number of words."""
    for a, b in slabs(texts):
        grid = Grid(texts[a:b], fold=True)
        start, end = grid.letters()
        doc = np.searchsorted(grid.ends, start)
        sums = prefix(grid.cp)
        hashes, docs = [span_hashes(sums, start, end)], [doc]
        for k in PREFIXES:
            long = end - start >= k
            hashes.append(mix(span_hashes(sums, start[long], start[long] + k) ^ np.uint64(k)))
            docs.append(doc[long])
        h, d = np.concatenate(hashes).view(np.int64), np.concatenate(docs)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, int)
        times = np.diff(np.append(new, len(h)))
        h, d = h[new], d[new]
        bound = np.searchsorted(d, np.arange(b - a + 1))
        n_words = np.bincount(doc, minlength=b - a)
        for i in range(b - a):
            yield h[bound[i] : bound[i + 1]], times[bound[i] : bound[i + 1]], int(n_words[i])


def _ranges(first: np.ndarray, end: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of first[i]..end[i] - 1, one range after another, and each range's value beside its members."""
    n = end - first
    stop = np.cumsum(n)
    return np.repeat(first - stop + n, n) + np.arange(stop[-1] if len(stop) else 0), np.repeat(value, n)


@dataclass
class Index:
    """Examples' TF-IDF vectors by term, in blocks of BLOCK examples with each term's greatest weight in each block."""

    term: np.ndarray  # sorted hashes
    idf: np.ndarray
    first: np.ndarray  # of each term, its first posting; one more at the end
    example: np.ndarray  # of each posting
    weight: np.ndarray
    block_first: np.ndarray  # of each term, its first (block, greatest weight)
    block: np.ndarray
    block_max: np.ndarray
    cell_first: np.ndarray  # of each (term, block), its first posting; one more at the end
    label: np.ndarray  # of each example
    mass: np.ndarray  # labelled rows that an example stands for
    doc: np.ndarray  # ids of the examples, the evidence
    prior: float  # share of label 1 among rows without any indexed term
    knots: np.ndarray  # votes and what share of the labelled rows with such votes has label 1
    share: np.ndarray

    def vector(self, h: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of the indexed terms among h; unit length."""
        if not len(self.term) or not len(h):
            return np.zeros(0, int), np.zeros(0)
        at = np.minimum(np.searchsorted(self.term, h), len(self.term) - 1)
        here = self.term[at] == h
        at, w = at[here], np.log1p(times[here]) * self.idf[at[here]]
        return at, w / max(np.linalg.norm(w), 1e-12)

    def nearest(self, at: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The NEAREST examples by cosine, exactly: blocks are opened by falling upper bound until none can add to them."""
        cells, pull = _ranges(self.block_first[at], self.block_first[at + 1], w)
        block = self.block[cells]
        bound = np.bincount(block, pull * self.block_max[cells], minlength=1)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        ids, cosines, k, some = np.zeros(0, int), np.zeros(0), 0, 4
        while k < len(order) and (len(ids) < NEAREST or bound[order[k]] + 1e-12 >= cosines[-1]):
            opened = np.zeros(len(bound), bool)
            opened[order[k : k + some]] = True
            k, some = k + some, 2 * some  # a few at first, then more at a time
            here = opened[block]
            posts, pulls = _ranges(self.cell_first[cells[here]], self.cell_first[cells[here] + 1], pull[here])
            got = np.bincount(self.example[posts], pulls * self.weight[posts])
            new = np.flatnonzero(got > 0)
            new = new[new != skip]
            ids, cosines = np.concatenate([ids, new]), np.concatenate([cosines, got[new]])
            best = np.lexsort((ids, -cosines))[:NEAREST]
            ids, cosines = ids[best], cosines[best]
        return ids, cosines

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        pull = cosines**2 * self.mass[ids]
        return float((pull @ self.label[ids] + PRIOR * self.prior) / (pull.sum() + PRIOR))

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, self.knots, self.share)) if len(self.knots) else vote


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and non-decreasing means of y by x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order:
        pools.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """doc, label, mass, text of a bounded sample of labelled documents, chosen by a hash of the id."""
    named = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc")).agg(F.max(label_col).cast("int").alias("label"))
    named = named.withColumn("place", F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(1 << 30)) / float(1 << 30))
    n = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, EXAMPLES[k] / n[k]) if n.get(k) else 1.0 for k in EXAMPLES}
    few = named.filter(F.col("place") < F.when(F.col("label") == 1, share[1]).otherwise(share[0])).withColumn("mass", F.when(F.col("label") == 1, 1 / share[1]).otherwise(1 / share[0]))
    few = few.select("doc", "label", "mass")  # about as many as EXAMPLES says, by chance of the hash
    texts = docs.filter(F.col(text_col).isNotNull()).join(F.broadcast(few), F.col(id_col) == F.col("doc"), "left_semi").groupBy(F.col(id_col).alias("doc")).agg(F.min(text_col).alias("text"))
    # copies of one text are one example, or the words of a copied text would look sure
    same = texts.join(F.broadcast(few), "doc").groupBy("text").agg(F.min("doc").alias("doc"), F.max("label").alias("label"), F.sum("mass").alias("mass"))
    return same.select("doc", "label", "mass", "text").repartition(24, "doc")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index:
    """Terms are chosen by the log odds of label 1 over the sample; all its rows with a chosen term are indexed, of either label.

    Documents whose id or label is null, and other labels than 0 and 1, teach nothing; an id with several rows is one
    example (the least text, the greatest label), and so are equal texts. Without examples all scores are 0.
    """
    chosen = _examples(docs, labels, id_col, text_col, label_col).persist()
    mass = {(r["label"]): (r["n"], r["m"]) for r in chosen.groupBy("label").agg(F.count("*").alias("n"), F.sum("mass").alias("m")).collect()}
    n_of = {k: mass.get(k, (0, 0.0)) for k in (0, 1)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {0: [], 1: []}
        for batch in bounded(batches, 0):
            for label, (h, _, _) in zip(batch.column(1).to_pylist(), terms(batch.column(0).to_pylist()), strict=True):
                rows[label].append(h)
        for label, parts in rows.items():
            if parts:
                h, c = np.unique(np.concatenate(parts), return_counts=True)
                for a in range(0, len(h), 1 << 17):
                    part = c[a : a + (1 << 17)]
                    zero = np.zeros(len(part), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h[a : a + (1 << 17)]), pa.array(part if label else zero), pa.array(zero if label else part)], ["term", "ones", "zeros"])

    seen = chosen.select("text", "label").mapInArrow(count, "term long, ones long, zeros long").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    ones, zeros = float(n_of[1][0]), float(n_of[0][0])
    a, b = F.col("ones") + 0.5, F.col("zeros") + 0.5
    odds = F.log(a / (ones + 1) / (b / (zeros + 1)))
    sure = odds - SURE * F.sqrt(1 / a + 1 / b)
    picked = seen.filter(F.col("ones") + F.col("zeros") >= SEEN).withColumn("sure", sure).filter(F.col("sure") >= math.log(LIFT)).toPandas()
    term = np.sort(picked["term"].to_numpy(np.int64))
    by = picked.set_index("term").reindex(term)
    df = by["ones"].to_numpy(float) * (n_of[1][1] / max(ones, 1)) + by["zeros"].to_numpy(float) * (n_of[0][1] / max(zeros, 1))
    idf = np.log1p((n_of[0][1] + n_of[1][1]) / np.maximum(df, 1))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            doc, at, times = [], [], []
            for i, (h, c, _) in enumerate(terms(batch.column(1).to_pylist())):
                place = np.minimum(np.searchsorted(term, h), max(len(term) - 1, 0))
                here = term[place] == h if len(term) else np.zeros(len(h), bool)
                doc.append(i)
                at.append(place[here].tolist())
                times.append(c[here].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["doc", "label", "mass", "at", "times"])

    kind = chosen.schema["doc"].dataType.simpleString()
    rows = chosen.select("doc", "text", "label", "mass").mapInArrow(known, f"doc {kind}, label int, mass double, at array<int>, times array<int>").toPandas()
    chosen.unpersist()
    vectors = []
    for at, times in zip(rows["at"], rows["times"], strict=True):
        w = np.log1p(np.asarray(times, float)) * idf[np.asarray(at, int)]
        vectors.append((np.asarray(at, int), w / max(np.linalg.norm(w), 1e-12)))
    label, weight_of = rows["label"].to_numpy(float), rows["mass"].to_numpy(float)
    bare = np.array([len(v[0]) == 0 for v in vectors], bool)
    prior = float((label[bare] @ weight_of[bare] + 0.01) / (weight_of[bare].sum() + 1)) if len(rows) else 0.0
    # examples with a heaviest term in common stand together, so that few blocks hold what a query needs
    held = sorted(np.flatnonzero(~bare), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), str(rows["doc"][i])))
    e = np.repeat(np.arange(len(held)), [len(vectors[i][0]) for i in held]) if held else np.zeros(0, int)
    t = np.concatenate([vectors[i][0] for i in held]) if held else np.zeros(0, int)
    w = np.concatenate([vectors[i][1] for i in held]) if held else np.zeros(0)
    order = np.lexsort((e, t))
    e, t, w = e[order], t[order], w[order]
    blk = e // BLOCK
    new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (blk[1:] != blk[:-1])])) if len(t) else np.zeros(0, int)
    most = np.maximum.reduceat(w, new) if len(new) else np.zeros(0)
    steps = np.arange(len(term) + 1)
    index = Index(
        term, idf, np.searchsorted(t, steps), e, w, np.searchsorted(t[new], steps), blk[new], most, np.append(new, len(t)), label[held], weight_of[held], rows["doc"].to_numpy()[held], prior, np.zeros(0), np.zeros(0)
    )
    # each example is judged by the others, in tasks; its votes tell what a vote is worth
    if held:
        judged = [vectors[i] for i in held]

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                who = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([index.vote(*index.nearest(*judged[k], skip=k)) for k in who], pa.float64())], ["k", "vote"])

        told = docs.sparkSession.range(len(held), numPartitions=24).mapInArrow(judge, "k long, vote double").toPandas().sort_values("k")
        index.knots, index.share = isotonic(np.append(told["vote"].to_numpy(), prior), np.append(index.label, prior), np.append(index.mass, 1.0))
    return index


def toxicity(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """id, score (0 to 1), predicted (1 if score >= 0.5), evidence (ids of the nearest examples) for each row.

    A text's score is the calibrated vote of its nearest examples, weighted by cosine; where no indexed term occurs (or
    the text is null or empty) it is the share of label 1 among labelled rows without one, and there is no evidence.
    Of equally near examples those that come first in the index vote. Null ids are kept; repeated rows give one row each; an empty table gives none. Whole texts count. Map-only.
    """
    kind, example = docs.schema[id_col].dataType.simpleString(), "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[float, list[str]]] = {}
        for batch in bounded(batches):
            score, why = np.zeros(batch.num_rows), []
            for i, (h, times, _) in enumerate(terms([t or "" for t in batch.column(1).to_pylist()])):
                at, w = index.vector(h, times)
                key = at.tobytes() + w.tobytes()
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    ids, cosines = index.nearest(at, w)
                    known[key] = (index.calibrated(index.vote(ids, cosines)) if len(ids) else index.prior, [str(x) for x in index.doc[ids[:evidence]]])
                score[i], found = known[key]
                why.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(why, pa.list_(pa.string()))], ["id", "score", "predicted", "evidence"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, score double, predicted int, evidence array<{example}>")
    return out.withColumnRenamed("id", id_col)
