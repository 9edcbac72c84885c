"""Benchmark decontamination (operator 8): a broadcast hash set of test n-grams against all token windows of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.common import ascii_lower, fresh, stage

#: What parts words: ASCII that is neither digit nor lower-case letter, once A-Z are lower-cased.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Bytes of the table of test windows, item ids included, up to which it is broadcast; beyond it, windows are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Hits up to which the spans to remove are broadcast (about 40 bytes each); beyond it, by a shuffle.
BROADCAST_HITS = 1_000_000
_HEAD = 0


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"{PARTS}+", -1), "")


def _window(w: Column, at: Column, size) -> Column:
    return F.slice(w, at, size)


def test_windows(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """hash, len, gram (the window's text), items (sorted ids that hold it; null ids aren't listed) for each distinct window of
    the test items."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n)))
    at = w.select("item", "len", "w", F.explode(F.expr("sequence(1, size(w) - len + 1)")).alias("at"))
    gram = at.select("item", "len", _window(F.col("w"), F.col("at"), F.col("len")).alias("g"))
    grouped = gram.groupBy("len", "g").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return grouped.select(F.xxhash64("g").alias("hash"), "len", F.array_join("g", " ").alias("gram"), "items")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10) -> DataFrame:
    """One row per document: id, mark (hash of the text), n_words, spans (array of start and len in words, from 1), items.

    A window is n consecutive words of a test item; an item of fewer words, but not none, is one window. A span is a
    place where a window's words occur, found by hash and verified word by word. Null or empty texts have no words;
    items without words have no windows, those with a null id have windows and aren't listed; an empty benchmark gives no spans. Repeated rows give one row
    each; null ids are kept. Where the windows are broadcast, documents are read once, and only one row per document and one per hit are shuffled.
    """
    spark = docs.sparkSession
    tests = stage(test_windows(benchmark, item_col, item_text_col, n), "test-windows")
    lengths = sorted((r[0] for r in tests.select("len").distinct().collect()), reverse=True)  # n at most
    weight = F.octet_length("gram") + 16 * F.size("items") + F.octet_length(F.array_join("items", "")) + 64
    few = tests.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0] <= BROADCAST_BYTES
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), words(F.col(text_col)).alias("w"))
    hashed = [f"if(size(w) >= {k}, transform(sequence(1, size(w) - {k} + 1), i -> xxhash64(slice(w, i, {k}))), cast(array() as array<bigint>))" for k in lengths]
    dealt = base.select("id", "mark", "w", F.size("w").cast("long").alias("n_words"), F.expr(f"concat(array({_HEAD}L), {', '.join(hashed)})" if hashed else f"array({_HEAD}L)").alias("hashes"))
    # outer, though hashes is never empty: for the inner form Spark derives a filter that repeats all that was computed above
    seen = dealt.select("id", "mark", "w", "n_words", F.posexplode_outer("hashes").alias("place", "hash"))
    # the windows of each length stand one after the other behind the head
    size, start, before = F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in lengths:
        here = F.col("place") - before
        size, start = F.when(here > 0, k).otherwise(size), F.when(here > 0, here).otherwise(start)
        before = before + F.greatest(F.col("n_words") - k + 1, F.lit(0))
    if not few:
        return _shuffled_hits(base, seen.withColumn("size", size).withColumn("start", start.cast("int")), tests)
    # the words stay where they are and are compared only where a hash is found; each document's head is one row more
    head = spark.range(1).select(F.lit(_HEAD).cast("long").alias("hash"), F.lit(0).alias("len"), F.lit(None).cast("string").alias("gram"), F.lit(None).cast("array<string>").alias("items"))
    found = seen.join(F.broadcast(tests.unionByName(head)), "hash").withColumn("size", size).withColumn("start", start.cast("int"))
    true = found.filter(F.expr("(place = 0 and len = 0) or (place > 0 and len > 0 and size = len and array_join(slice(w, greatest(start, 1), size), ' ') = gram)"))
    span = F.when(F.col("len") > 0, F.struct("start", "len"))
    by_doc = true.groupBy("id", "mark", "n_words").agg(
        F.sum((F.col("len") == 0).cast("int")).alias("times"), F.sort_array(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    return by_doc.select("id", "mark", "n_words", "spans", "items", F.explode(F.expr("sequence(1, int(times))")).alias("copy")).drop("copy")


def _shuffled_hits(base: DataFrame, seen: DataFrame, tests: DataFrame) -> DataFrame:
    """benchmark_hits() where the windows are too many to broadcast: hashes and places meet them by a shuffle that carries no
    words and no row for a document without windows; what is found goes back to its document, once, and is verified there."""
    met = seen.filter("place > 0").select("id", "mark", "start", "size", "hash").join(tests, "hash").filter("size = len")
    near = met.groupBy(F.col("id").alias("i"), F.col("mark").alias("m")).agg(F.collect_set(F.struct("start", "len", "gram", "items")).alias("near"))
    rows = base.join(near, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    true = F.filter(F.coalesce("near", F.array().cast(near.schema["near"].dataType)), lambda x: F.array_join(F.slice("w", x.start, x.len), " ") == x.gram)
    told = rows.select("id", "mark", F.size("w").cast("long").alias("n_words"), true.alias("true"))
    spans = F.array_sort(F.array_distinct(F.transform("true", lambda x: F.struct(x.start.alias("start"), x.len.alias("len")))))
    return told.select("id", "mark", "n_words", spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.transform("true", lambda x: x["items"])))).alias("items"))


def hit_words(spans: Column) -> Column:
    """The distinct places of words inside spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s.start, s.start + s.len - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10) -> DataFrame:
    """benchmark_hits() in numbers: id, n_words, n_hit, n_items, items_sha256 (of the sorted item ids), contaminated."""
    found = benchmark_hits(docs, benchmark, id_col, text_col, item_col, item_text_col, n)
    counted = found.withColumn("n_hit", F.size(hit_words(F.col("spans"))).cast("long"))
    return counted.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, drop_share: float = 0.5) -> DataFrame:
    """docs without their benchmark passages: hit words and what stands before them go; a document of which drop_share
    or more of the words are hit goes altogether. All other rows and columns are as they were.

    Null and empty texts stay; null ids are cut like others, repeated rows alike; an empty benchmark leaves all as it was.
    """
    found = benchmark_hits(docs, benchmark, id_col, text_col, item_col, item_text_col, n).filter("size(spans) > 0").dropDuplicates(["id", "mark"])
    own, mark, hit, words_in, fp, parts, cut = fresh(docs, "__id", "__mark", "__hit", "__words", "__fp", "__pieces", "__cut")
    found = stage(found.select(F.col("id").alias(own), F.col("mark").alias(mark), hit_words(F.col("spans")).alias(hit), F.col("n_words").alias(words_in)), "hits")
    total = found.agg(F.coalesce(F.sum(F.size(hit) + 8), F.lit(0))).first()[0]
    side = F.broadcast(found) if total <= BROADCAST_HITS else found
    rows = docs.withColumn(fp, F.xxhash64(text_col)).join(side, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(fp) == F.col(mark)), "left")
    rows = rows.filter(F.col(hit).isNull() | (F.size(hit) < drop_share * F.col(words_in)))
    pieces = F.regexp_extract_all(text_col, F.lit("([\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)"), F.lit(1))
    tail = F.regexp_extract(text_col, "([\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*)\\z", 1)
    rows = rows.withColumn(parts, F.when(F.col(hit).isNotNull(), pieces))
    # one hashed difference and one walk, however many words are hit
    left = F.array_except(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), F.col(hit))
    kept = F.transform(left, lambda i: F.get(parts, i - 1))
    rows = rows.withColumn(cut, F.when(F.col(hit).isNotNull(), F.concat(F.array_join(kept, ""), tail)))
    return rows.withColumn(text_col, F.coalesce(cut, text_col)).select(*docs.columns)
