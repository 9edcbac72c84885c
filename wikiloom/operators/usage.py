"""Usage of templates and modules, examples, parameter merges and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.operators.links import first_per_group


def usage_summary(invocations: DataFrame, name: str = "template", most_keys: int = 12, most_pages: int = 3) -> DataFrame:
    """One row per template: uses, pages, keys ("key:count" of the most used), example_pages; invocations (name, page, keys).

    Distinct (page, name, keys) rows count, as the index keeps them.
    """
    rows = invocations.select(name, "page", "keys").distinct()
    total = rows.groupBy(name).agg(F.count("*").alias("uses"), F.count_distinct("page").alias("pages"))
    keys = rows.select(name, F.explode(F.split("keys", ",")).alias("key")).filter("key <> ''").groupBy(name, "key").agg(F.count("*").alias("n"))
    best = first_per_group(keys, [name], [F.desc("n"), F.asc("key")], most_keys).groupBy(name).agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "key", "n").alias("k")))).alias("k"))
    pages = first_per_group(rows.select(name, "page").distinct(), [name], [F.asc("page")], most_pages).groupBy(name).agg(F.array_join(F.array_sort(F.collect_list("page")), "; ").alias("example_pages"))
    return total.join(best, name, "left").join(pages, name, "left").select(name, "uses", "pages", F.coalesce(F.array_join("k.k", ","), F.lit("")).alias("keys"), "example_pages")


def ranked_usage(summary: DataFrame, name: str, most: int) -> DataFrame:
    return summary.orderBy(F.desc("uses"), F.desc("pages"), F.asc(name)).limit(most)


def examples(rows: DataFrame, name: str = "template", most: int = 3) -> DataFrame:
    """The shortest examples of each template: by tokens, page, place."""
    got = first_per_group(rows.select(name, "page", "place", "text", "tokens").withColumnRenamed("place", "at"), [name], [F.asc("tokens"), F.asc("page"), F.asc("at"), F.asc("text")], most)
    return got.select(name, F.col("place").cast("long").alias("rank"), "page", F.col("at").alias("place"), "text", "tokens")


def value_examples(rows: DataFrame, name: str = "template", most: int = 3) -> DataFrame:
    """name, key, rank, value: the first distinct values of each parameter in the order of page and place."""
    each = rows.select(name, "page", "place", F.explode(F.split("text", r"\|")).alias("part")).select(name, "page", "place", F.trim(F.substring_index("part", "=", 1)).alias("key"), F.trim(F.regexp_replace("part", r"\A[^=]*=", "")).alias("value"))
    first = each.filter("key <> '' and value <> ''").groupBy(name, "key", "value").agg(F.min(F.struct("page", "place")).alias("seen"))
    got = first_per_group(first, [name, "key"], [F.asc("seen"), F.asc("value")], most)
    return got.select(name, "key", F.col("place").cast("long").alias("rank"), "value")


def merged_parameters(declared: DataFrame, documented: DataFrame, observed: DataFrame) -> DataFrame:
    """template, key, sources, uses: full outer merge of three (template, key[, uses]) lists."""
    parts = [(documented, "documented"), (declared, "declared"), (observed, "observed")]
    every = None
    for k, (df, label) in enumerate(parts):
        uses = F.col("uses") if "uses" in df.columns else F.lit(0)
        one = df.select("template", "key", F.lit(k).alias("ord"), F.lit(label).alias("source"), uses.cast("long").alias("uses"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("template", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ord", "source"))), lambda s: s.source), "+").alias("sources"), F.sum("uses").alias("uses"))


def catalog(pages: DataFrame, usage: DataFrame) -> DataFrame:
    """title, local, uses, status of every template that exists or is used."""
    local = pages.filter("namespace = 'Template'").select(F.concat(F.lit("Template:"), F.col("title")).alias("title")).withColumn("local", F.lit(True))
    used = usage.select(F.col("template").alias("title"), "uses")
    both = local.join(used, "title", "full")
    status = F.when(F.col("local").isNull(), "missing").when(F.col("uses").isNull(), "unused").otherwise("active")
    return both.select("title", F.coalesce("local", F.lit(False)).alias("local"), F.coalesce("uses", F.lit(0).cast("long")).alias("uses"), status.alias("status"))


def manifest_merge(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """key, name, version: overlay's version where it has one and its name where that is longer; rows of either side."""
    a = base.select(F.lower("name").alias("key"), F.col("name").alias("a"), F.col("version").alias("av"))
    b = overlay.select(F.lower("name").alias("key"), F.col("name").alias("b"), F.col("version").alias("bv"))
    name = F.when(F.col("a").isNull() | (F.char_length("b") > F.char_length("a")), F.col("b")).otherwise(F.col("a"))
    return a.join(b, "key", "full").select("key", name.alias("name"), F.coalesce("bv", "av").alias("version"))


def share_of_pages(invocations: DataFrame, name: str = "template") -> DataFrame:
    """template, page, share: of all a page's invocations, in thousandths; ranks within the page."""
    w = Window.partitionBy("page")
    n = invocations.groupBy("page", name).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.floor(1000 * F.col("n") / F.sum("n").over(w)).cast("long"))
