"""Citation audits: filters, counts, duplicates and usage by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.functions.text import domain, identifier, normal_spaces
from wikiloom.operators.links import first_per_group


def citations(rows: DataFrame) -> DataFrame:
    """rows (page, place, url, doi, isbn, template, kind, wikitext) with domain, ids (sorted `key:value`) and authority."""
    ids = F.array_sort(F.array_compact(F.array(*[F.when(F.col(k).isNotNull() & (F.col(k) != ""), F.concat(F.lit(f"{k}:"), identifier(F.lit(k), F.col(k)))) for k in ("doi", "isbn")])))
    told = rows.withColumn("domain", domain(F.col("url"))).withColumn("ids", ids)
    return told.withColumn("authority", F.coalesce("domain", "template", "kind"))


def filtered(rows: DataFrame, domain: str | None = None, template: str | None = None, authority: str | None = None, id_key: str | None = None, id_value: str | None = None) -> DataFrame:
    if domain is not None:
        rows = rows.filter(F.col("domain") == domain.lower())
    if template is not None:
        rows = rows.filter(F.lower(F.regexp_replace("template", "(?i)^template:", "")) == template.lower().removeprefix("template:"))
    if authority is not None:
        rows = rows.filter(F.lower("authority") == authority.lower())
    if id_key is not None:
        rows = rows.filter(F.exists("ids", lambda x: x.startswith(f"{id_key}:")))
    if id_value is not None:
        rows = rows.filter(F.exists("ids", lambda x: x.endswith(f":{id_value}")))
    return rows


def totals(rows: DataFrame) -> DataFrame:
    """One row: citations, pages and distinct domains, templates, kinds, authorities and identifiers."""
    one = rows.agg(F.count("*").alias("citations"), *[F.count_distinct(a).alias(b) for a, b in (("page", "pages"), ("domain", "domains"), ("template", "templates"), ("kind", "kinds"), ("authority", "authorities"))])
    return one.crossJoin(rows.select(F.explode("ids").alias("i")).agg(F.count_distinct("i").alias("identifiers")))


def top_lists(rows: DataFrame, most: int = 12) -> DataFrame:
    """list, rank, key, n: the most frequent domains, templates, kinds, authorities and identifier kinds."""
    parts = [F.struct(F.lit(name).alias("list"), F.col(c).alias("key")) for name, c in (("domain", "domain"), ("template", "template"), ("kind", "kind"), ("authority", "authority"))]
    keys = F.concat(F.array(*parts), F.transform(F.array_distinct(F.transform("ids", lambda x: F.substring_index(x, ":", 1))), lambda k: F.struct(F.lit("identifier").alias("list"), k.alias("key"))))
    counted = rows.select(F.explode(keys).alias("x")).select("x.*").filter("key is not null").groupBy("list", "key").agg(F.count("*").alias("n"))
    return first_per_group(counted, ["list"], [F.desc("n"), F.asc("key")], most).select("list", F.col("place").cast("long").alias("rank"), "key", "n")


def duplicates(rows: DataFrame) -> DataFrame:
    """kind, key, n, pages, first_page: citations that share an address, an identifier or their text; two or more.

    One pass deals each citation to its keys; groups are counted with map-side sums, so a key that all pages share costs
    one row a task.
    """
    keys = F.concat(
        F.array(F.struct(F.lit("url").alias("kind"), F.regexp_replace(F.regexp_replace(F.lower("url"), r"\Ahttps?://(www\.)?", ""), r"/\z", "").alias("key")), F.struct(F.lit("wikitext").alias("kind"), normal_spaces(F.col("wikitext")).alias("key"))),
        F.transform("ids", lambda x: F.struct(F.lit("identifier").alias("kind"), x.alias("key"))),
    )
    each = rows.select("page", F.explode(keys).alias("x")).select("page", "x.*").filter("key is not null and key <> ''")
    return each.groupBy("kind", "key").agg(F.count("*").alias("n"), F.count_distinct("page").alias("pages"), F.min("page").alias("first_page")).filter("n >= 2")


def profile_usage(rows: DataFrame, most: int = 3) -> DataFrame:
    """kind, template: citations, pages, the most used domains and a best example (with identifiers first, then shortest)."""
    group = ["kind", "template"]
    base = rows.groupBy(*group).agg(
        F.count("*").alias("citations"), F.count_distinct("page").alias("pages"), F.min(F.struct((F.size("ids") == 0).cast("int").alias("bare"), F.char_length("wikitext").alias("length"), "page", "place")).alias("best")
    )
    hosts = first_per_group(rows.filter("domain is not null").groupBy(*group, "domain").agg(F.count("*").alias("n")), group, [F.desc("n"), F.asc("domain")], most)
    told = hosts.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "domain", "n"))), lambda x: F.concat_ws(":", x.domain, x.n)), ",").alias("domains"))
    return base.join(told, group, "left").select(*group, "citations", "pages", F.coalesce("domains", F.lit("")).alias("domains"), F.col("best.page").alias("example_page"), F.col("best.place").alias("example_place"))


def profile_lists(refs: DataFrame, most: int = 6) -> DataFrame:
    """profile, list, rank, key, n: for each citation profile what its citations (of references.references()) have most of.

    Lists: template, link, domain, authority, identifier_key, identifier and signal; a citation counts once for a key. All are
    dealt out of one pass and counted by one grouping; ranks are by number, then name.
    """
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    lists = {"template": F.col("templates"), "link": F.col("links"), "domain": one("domain"), "authority": one("authority"), "identifier_key": F.col("id_keys"), "identifier": F.col("ids"), "signal": F.col("signals")}
    named = lambda name, keys: F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(name).alias("list"), k.alias("key")))
    each = F.flatten(F.array(*(named(name, keys) for name, keys in lists.items())))
    n = refs.select("profile", F.explode(each).alias("x")).groupBy("profile", "x.list", "x.key").agg(F.count("*").alias("n"))
    return first_per_group(n, ["profile", "list"], [F.desc("n"), F.asc("key")], most).select("profile", "list", F.col("place").alias("rank"), "key", "n")
