"""Documentation pages taken apart: sections with their paths, symbols, and examples of code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.functions.text import docs_page_kind, flat_excerpt, normal_spaces, retrieval_key
from wikiloom.operators.markup import sections

# Tags that hold code, and the least characters of an example.
CODE, LEAST = "syntaxhighlight|source|pre|code", 4


def docs_sections(pages: DataFrame) -> DataFrame:
    """page, kind, place, level, heading, path (headings above it, joined by ` > `), text: sections of pages (title, text)."""
    cut = sections(pages)
    path = F.aggregate(
        F.col("before"), F.array().cast("array<struct<level:int,heading:string>>"),
        lambda s, x: F.array_append(F.filter(s, lambda y: y.level < x.level), F.struct(x.level.alias("level"), x.heading.alias("heading"))), lambda s: F.array_join(F.transform(s, lambda y: y.heading), " > "),
    )
    heads = cut.filter("heading is not null").groupBy("title").agg(F.array_sort(F.collect_list(F.struct("place", "level", "heading"))).alias("heads"))
    told = cut.join(heads, "title", "left").withColumn("before", F.filter(F.coalesce("heads", F.array().cast("array<struct<place:int,level:int,heading:string>>")), lambda h: h.place <= F.col("place")))
    return told.select(F.col("title").alias("page"), docs_page_kind(F.col("title")).alias("kind"), "place", "level", "heading", path.alias("path"), flat_excerpt(F.col("body")).alias("text"))


def docs_symbols(pages: DataFrame) -> DataFrame:
    """page, kind, name, key: symbols of pages (title, text), each (kind, key) once a page.

    Hooks and settings by title; settings, parser functions, magic words and tags by how they are written.
    """
    t, title = F.col("text"), F.col("title")
    of = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    named = F.array_compact(F.array(F.nullif(F.regexp_extract(title, r"\AManual:Hooks/(.*\S)", 1), F.lit(""))))
    settings = F.concat(F.array_compact(F.array(F.nullif(F.regexp_extract(title, r"\AManual:(\$wg\w+)", 1), F.lit("")))), F.regexp_extract_all(t, F.lit(r"(\$wg[A-Z]\w*)"), F.lit(1)))
    parser = F.regexp_extract_all(t, F.lit(r"\{\{\s*(#[a-z][a-z0-9_-]*)\s*:"), F.lit(1))
    magic = F.regexp_extract_all(t, F.lit(r"(__[A-Z]{3,}__)"), F.lit(1))
    tags = F.regexp_extract_all(t, F.lit(r"&lt;([a-z][a-z0-9]*)(?:\s[^&]*)?&gt;"), F.lit(1))
    every = F.concat(of("hook", named), of("config", settings), of("parser_function", parser), of("magic_word", magic), of("tag", tags))
    each = pages.select(title.alias("page"), F.explode(every).alias("s")).select("page", "s.kind", normal_spaces(F.col("s.name")).alias("name"))
    return each.groupBy("page", "kind", retrieval_key(F.col("name")).alias("key")).agg(F.min("name").alias("name")).select("page", "kind", "name", "key")


def docs_examples(pages: DataFrame) -> DataFrame:
    """page, place, language, text: code of pages (title, text) that is long enough; the language is what the tag says."""
    blocks = F.regexp_extract_all("text", F.lit(rf"(?is)(<(?:{CODE})\b[^>]*>.*?</(?:{CODE})>)"), F.lit(1))
    each = pages.select(F.col("title").alias("page"), F.posexplode(blocks).alias("place", "b"))
    body = F.trim(F.regexp_replace(F.regexp_replace("b", r"(?is)\A<[^>]*>|</\w+>\z", ""), r"\A\s+|\s+\z", ""))
    return each.select("page", "place", F.regexp_extract("b", r"""(?is)\A<[^>]*\blang\s*=\s*["']?([\w-]+)""", 1).alias("language"), body.alias("text")).filter(F.char_length("text") >= LEAST)


def symbol_lookup(asked: DataFrame, symbols: DataFrame, kind: str | None = None) -> DataFrame:
    """query, page, kind, name, tier: symbols whose key is what is asked (query, text): 0 exact, 1 without its first sign (`$`, `#`)."""
    rows = symbols if kind is None else symbols.filter(F.col("kind") == kind)
    keys = F.array_distinct(F.array(F.col("key"), F.regexp_replace("key", r"\A[$#]+", "")))
    each = rows.select("page", "kind", "name", F.posexplode(keys).alias("tier", "k"))
    return asked.select("query", retrieval_key(F.col("text")).alias("k")).join(each, "k").select("query", "page", "kind", "name", "tier")
