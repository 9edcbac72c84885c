"""MinHash near-dedup (operator 9): universal hash minima, banding, signature verification, exact confirmation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.common import attach, bounded, fresh, scaled_partitions, stage
from wikiloom.llm.components import Forest, block_pairs, components, each_group
from wikiloom.llm.textgrid import byte_words, mix, slabs

#: 32 bands of 6 minima: of pairs with a similarity of 0.8, one in 17,000 shares no band.
BANDS, ROWS = 32, 6
#: Pairs go to the exact check when this share of their minima agrees: 0.8 less 4.5 standard errors.
AGREE = 0.67
#: Ids of duplicates up to which they are broadcast (16 bytes each); beyond it, by a shuffle.
BROADCAST_IDS = 1_000_000
#: Shingles, and signatures, that one side of a block holds about.
BLOCK_SHINGLES, BLOCK_ROWS = 1_000_000, 2_000

_seed = np.random.default_rng(20240607)
_A = _seed.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _seed.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64)
_FOLD = _seed.integers(1 << 63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _seed.integers(1 << 63, size=BANDS, dtype=np.uint64)


def shingle_sets(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `words` words; fewer words are one shingle; none, no set."""
    for a, b in slabs(texts):
        h, first, last = byte_words(texts[a:b])
        long = np.zeros(0, np.uint64)
        if len(h) >= words:
            n = len(h) - words + 1
            long = h[:n].copy()
            for k in range(1, words):
                long = long * np.uint64(0x9FB21C651E98DF25) + h[k : n + k]
            long = mix(long)
        for i, j in zip(first.tolist(), last.tolist(), strict=True):
            if j - i >= words:
                yield np.unique(long[i : j - words + 1])
            elif j > i:
                whole = np.array([j - i], np.uint64)
                for x in h[i:j]:
                    whole = mix(whole * np.uint64(0xC2B2AE3D27D4EB4F) ^ x)
                yield whole
            else:
                yield h[:0]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the universal hashes a * x + b over a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (_A[:, None] * shingles[None, at : at + 512] + _B[:, None]).min(axis=1), out=least)
    return least


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """id, n_shingles, key (128-bit hash of the set, null if empty), bands (a bucket for each band), sig (a byte a minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            place = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            sizes, keys, bands, sigs = [], [], np.zeros((len(place), BANDS), np.uint64), []
            for i, s in enumerate(shingle_sets(list(place), words)):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                least = minima(s)
                bands[i] = (least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1) + _SALT
                sigs.append(mix(least).astype(np.uint8).tobytes())
            flat = pa.array(mix(bands).view(np.int64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
            take = pa.array([place[t] for t in texts], pa.int64())
            cols = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists, pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(c.take(take) for c in cols)], ["id", "n_shingles", "key", "bands", "sig"])

    return docs.mapInArrow(run, "id long, n_shingles long, key binary, bands array<long>, sig binary")


def _alike(pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v, sig_u, sig_v) those of which enough minima agree."""
    least = int(AGREE * BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in (2, 3))
            keep = pa.array((a == b).sum(axis=1) >= least)
            yield batch.select([0, 1]).filter(keep)

    return pairs.select("u", "v", "sig_u", "sig_v").mapInArrow(run, "u long, v long")


def _bridges(group: pa.Table) -> pa.RecordBatch | None:
    """One link for each two components of a bucket that hold members whose signatures agree."""
    own, ids, comp = (group.column(c).to_numpy() for c in ("own", "id", "component"))
    if len(set(comp.tolist())) < 2:
        return None
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    names, local = np.unique(comp, return_inverse=True)
    forest, out, least = Forest(len(names)), [], int(AGREE * BANDS * ROWS)
    same = own[0] == own[-1] and (own == own[0]).all()
    for i in range(len(ids)):
        other = np.arange(i + 1, len(ids)) if same else np.flatnonzero(own > own[i])
        other = other[forest.roots()[local[other]] != forest.root(int(local[i]))]
        if len(other):
            for j in other[(sig[other] == sig[i]).sum(axis=1) >= least]:
                if forest.join(int(local[i]), int(local[j])):
                    out.append((ids[i], ids[j]))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"]) if out else None


def _confirmer(percent: int):
    def confirm(group: pa.Table) -> pa.RecordBatch | None:
        """A spanning forest of the pairs whose full sets are similar enough; members joined already aren't compared: those
        that share a `joined`, or are led to each other here. Where `own` differs, only members with different ones meet."""
        own, ids = group.column("own").to_numpy(), group.column("id").to_numpy()
        if len(ids) < 2:
            return None
        column = group.column("shingles")
        sets = [np.frombuffer(column[i].as_buffer(), np.uint64) for i in range(len(ids))]
        size = np.array([len(s) for s in sets])
        values, dense = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        forest, out, flag = Forest(len(ids)), [], np.zeros(len(values), bool)
        _, first, label = np.unique(group.column("joined").to_numpy(), return_index=True, return_inverse=True)
        forest.up = first[label]
        same = (own == own[0]).all()
        for i in range(len(ids)):
            other = np.arange(i + 1, len(ids)) if same else np.flatnonzero(own > own[i])
            other = other[forest.roots()[other] != forest.root(i)]
            other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
            if not len(other):
                continue
            mine = dense[ends[i] - size[i] : ends[i]]
            flag[mine] = True
            if size[other].sum() * 2 > len(dense):
                both = np.add.reduceat(flag[dense], ends - size)[other]
            else:
                both = np.array([np.count_nonzero(flag[dense[ends[j] - size[j] : ends[j]]]) for j in other])
            flag[mine] = False
            for j in other[100 * both >= percent * (size[i] + size[other] - both)]:
                if forest.join(i, int(j)):
                    out.append((ids[i], ids[j]))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"]) if out else None

    return confirm


def _with_sets(rows: DataFrame, words: int) -> DataFrame:
    """rows with `shingles`, the sorted set of its text, in the place of `text`, which is the first column."""
    kinds = dict(rows.dtypes)
    rest = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 0):
            sets = [s.tobytes() for s in shingle_sets([t or "" for t in batch.column(0).to_pylist()], words)]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *batch.columns[1:]], ["shingles", *rest])

    return rows.select("text", *rest).mapInArrow(run, ", ".join(["shingles binary", *(f"`{c}` {kinds[c]}" for c in rest)]))


def _confirmed(texts: DataFrame, seats: DataFrame, words: int, percent: int) -> DataFrame:
    """u, v: a spanning forest of the true links within each group of seats (group, node, size, blocks).

    A group of one block is one task. Of a larger one, each block's members are compared with each other and with the
    group's least member; mostly that joins all. Only what still stands apart from the group's greatest part is dealt to
    meet all blocks of the group, so a group of copies is read about twice, however large it is. Sets are made anew from
    texts each time, as they take more room than these.
    """
    spark = texts.sparkSession
    task = ["group", "block_a", "block_b"]

    def linked(of: DataFrame, deals: Column) -> DataFrame:
        """Links among the members of `of` (group, node); deals: for each the (block_a, block_b, own, joined) it goes to."""
        side = F.broadcast(of) if of.count() <= BROADCAST_IDS else of  # a few numbers a row
        dealt = _with_sets(texts.join(side, F.col("id") == F.col("node")).select("text", "id", *of.columns), words)
        each = dealt.select("group", "id", "shingles", F.explode(deals).alias("d")).select("group", "d.block_a", "d.block_b", "d.own", "id", "d.joined", "shingles")
        return each_group(each, task, scaled_partitions(spark, 2), _confirmer(percent), "u long, v long")

    def deal(a: Column, b: Column, own: Column, joined: Column) -> Column:
        return F.struct(a.cast("int").alias("block_a"), b.cast("int").alias("block_b"), own.cast("int").alias("own"), joined.cast("long").alias("joined"))

    zero = F.lit(0)
    links = linked(seats.filter("blocks <= 1").select("group", "node"), F.array(deal(zero, zero, zero, F.col("node"))))
    large = seats.filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    if not large.head(1):
        return links
    links = stage(links, "links")
    every = F.sequence(zero, F.col("blocks").cast("int") - 1)
    met = F.transform(F.when(F.col("node") == F.col("group"), every).otherwise(F.array("block")), lambda b: deal(b, zero, zero, F.col("node")))
    near = stage(linked(large.select("group", "node", "blocks", "block"), met), "links")
    parts = components(near)
    labelled = large.join(parts, "node", "left").withColumn("joined", F.coalesce("component", "node")).drop("component")
    labelled = stage(labelled, "parts")
    sizes = labelled.groupBy("group", "joined").agg(F.count("*").alias("n"))
    main = stage(sizes.groupBy("group").agg(F.max_by("joined", F.struct("n", -F.col("joined"))).alias("main"), F.count("*").alias("k")).filter("k > 1").drop("k"), "main")
    links = links.unionByName(near)
    if not main.head(1):
        return links
    # there are fewer such groups than blocks, as each has two blocks at least
    members = labelled.join(main, "group").withColumn("apart", F.col("joined") != F.col("main"))
    width = members.groupBy("group").agg(F.ceil(F.sum(F.when(F.col("apart"), F.col("size")).otherwise(0)) / BLOCK_SHINGLES).cast("int").alias("width"))
    members = stage(members.join(width, "group").select("group", "node", "blocks", "block", "joined", "apart", "width"), "members")
    left = F.transform(every, lambda b: deal(F.pmod(F.xxhash64("node", F.lit(1)), "width"), b, zero, F.col("joined")))
    right = F.transform(F.sequence(zero, F.col("width") - 1), lambda a: deal(a, F.col("block"), F.lit(1), F.col("joined")))
    far = linked(members, F.concat(F.when(F.col("apart"), left).otherwise(F.slice(left, 1, 0)), right))
    return links.unionByName(far)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: the id, n_shingles, component_id (least id that links reach), kept (id = component_id).

    Documents link when 100 * intersection >= percent * union over their sets of `words`-word shingles, words being what
    white space parts, A-Z in lower case. Candidates share a band of minima; signatures choose the pairs for which the
    full sets are compared, and only confirmed pairs link.

    1. Documents with equal sets form a class, of which one member goes on.
    2. In each bucket all members are compared with its least and greatest member by signature; what agrees is joined.
    3. In buckets that still hold several components, members of different components are compared, in blocks.
    4. Within the components so found, full sets are compared, in large ones with the least member and within blocks
       first; components are taken of confirmed links.

    Ids are integers. A document with a null id, or without words (null or empty text), links with nothing; a null id
    has a null component and is kept. Rows that share an id are one document. An empty table gives none; further columns
    are ignored.
    """
    spark = docs.sparkSession
    bare = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = stage(signatures(bare, words), "minhash")
    full = found.filter("id is not null and key is not null")
    total = full.count()
    classes = full.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = stage(classes, "classes")
    member = stage(attach(full.select("id", "key"), classes, "key", "n", total).select("id", "rep").distinct(), "members")

    one = full.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    twice = stage(full.groupBy("id", "key").count().filter("count > 1").select("id", "key"), "twice")
    if twice.head(1):  # repeated rows, seldom
        one = one.join(twice, ["id", "key"], "left_anti").unionByName(one.join(twice, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]))
    one = stage(one, "ones")
    spread = one.select("id", F.explode("bands").alias("bucket"))
    bucket = stage(spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).filter("n > 1"), "buckets")
    shared = stage(attach(spread, bucket, "bucket", "n", BANDS * total), "shared")

    ends = F.explode(F.array(F.struct(F.col("low").alias("u"), F.col("id").alias("v")), F.struct(F.col("id").alias("u"), F.col("high").alias("v"))))
    star = shared.select(ends.alias("p")).select("p.u", "p.v").filter("u < v").distinct()
    sig = one.select("id", "sig")
    sides = star.join(sig.select(F.col("id").alias("u"), F.col("sig").alias("sig_u")), "u").join(sig.select(F.col("id").alias("v"), F.col("sig").alias("sig_v")), "v")
    joined = components(_alike(sides))

    # members of one bucket in different components, not all compared yet
    wide = shared.filter("n > 3").select("bucket", "id", "n").join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = wide.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max("n").alias("m")).filter("least <> most").select("bucket", "m")
    left = attach(wide, open_, "bucket", "m", BANDS * total).join(sig, "id")
    dealt = block_pairs(left, F.ceil(F.col("n") / BLOCK_ROWS), F.col("id"))
    bridges = stage(each_group(dealt.select("bucket", "block_a", "block_b", "own", "id", "component", "sig"), ["bucket", "block_a", "block_b"], scaled_partitions(spark), _bridges, "u long, v long"), "bridges")
    if bridges.head(1):
        joined = components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(bridges))

    sized = joined.join(one.groupBy("id").agg(F.sum("n_shingles").alias("size")), F.col("node") == F.col("id")).drop("id")
    weight = sized.groupBy("component").agg(F.sum("size").alias("size"), F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("size") / BLOCK_SHINGLES))
    seats = stage(attach(sized.select("component", "node", F.col("size").alias("own_size")), weight, "component", "n", total).select(F.col("component").alias("group"), "node", F.col("own_size").alias("size"), "blocks"), "seats")
    links = _confirmed(bare, seats, words, percent)
    # ids whose rows have several texts join the classes of all of them
    joins = member.filter("id <> rep").join(member.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1"), "id", "left_semi")
    final = components(links.unionByName(joins.select(F.col("id").alias("u"), F.col("rep").alias("v"))))

    rep = member.groupBy("id").agg(F.min("rep").alias("rep"))
    home = stage(rep.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component_id")), "homes")
    out = found.select("id", "n_shingles").join(home, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near_duplicates(), the one with the least id; all columns.

    Documents with a null id or without words stay. Of rows that share an id one stays.
    """
    own, whole = fresh(docs, "__id", "__row")
    told = stage(near_duplicates(docs, id_col, text_col, words, percent).select(F.col(id_col).alias(own), "kept"), "told")
    gone = told.filter("not kept").select(own).distinct()
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    out = docs.join(side, F.col(id_col) == F.col(own), "left_anti")
    twice = told.filter(F.col("kept") & F.col(own).isNotNull()).groupBy(own).agg(F.count("*").alias("n")).filter("n > 1").select(own)
    if twice.head(1):
        again = out.join(twice, F.col(id_col) == F.col(own), "left_semi")
        # the least row of each id, without holding all rows of an id at once
        row = F.struct(text_col, *[c for c in docs.columns if c not in (id_col, text_col)])
        one = again.groupBy(id_col).agg(F.min(row).alias(whole)).select(id_col, f"{whole}.*").select(*docs.columns)
        out = out.join(twice, F.col(id_col) == F.col(own), "left_anti").unionByName(one)
    return out
