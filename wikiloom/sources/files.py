"""Where rows come from: trees of page files, CSV and JSON rows, documentation bundles; and rows written as pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wikiloom.functions.text import namespace_of, redirect_target, sync_hash, title_key, variant_base, variant_language

# How a title's characters are written in a file's name, and extensions by what a page is.
ESCAPES = [("___", "/"), ("--", ":"), ("_", " ")]
EXTENSIONS = {"Template": "wikitext", "Module": "lua"}


def path_title(path: Column) -> Column:
    """The title of a path `Folder/Name.ext`; folder Main has no prefix; names `~<hex>` hold titles that differ in case."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+\z", 1)
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]+)\z", 1), r"\.[^.]*\z", "")
    plain = name
    for a, b in ESCAPES:
        plain = F.replace(plain, F.lit(a), F.lit(b))
    exact = F.decode(F.unhex(F.regexp_extract(name, r"~((?:[0-9a-f]{2})+)\z", 1)), "UTF-8")
    whole = F.when(folder.isin("Main", "main", ""), plain).otherwise(F.concat(folder, F.lit(":"), plain))
    return F.when(exact != "", exact).otherwise(whole)


def title_path(title: Column) -> Column:
    """The inverse of path_title() for titles without its escapes."""
    ns = namespace_of(title)
    name = F.when(ns == "Main", title).otherwise(F.regexp_replace(title, r"\A[^:]*:", ""))
    for a, b in ESCAPES:
        name = F.replace(name, F.lit(b), F.lit(a))
    extension = F.lit("wiki")
    for k, v in EXTENSIONS.items():
        extension = F.when(ns == k, v).otherwise(extension)
    return F.concat(ns, F.lit("/"), name, F.lit("."), extension)


def page_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("wiki", "wikitext", "lua", "css", "js")) -> DataFrame:
    """path (below root), title, namespace, text, is_redirect, redirect_target, hash, bytes, base and language of variants.

    Files are read in parallel by Spark's own reader from any store that it reaches.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    text = F.decode("content", "UTF-8")
    path = F.regexp_extract("path", r"([^/]+/[^/]+)\z", 1)
    told = files.select(path.alias("path"), path_title(path).alias("title"), text.alias("text"), F.col("length").alias("bytes"))
    return told.select(
        "path", "title", namespace_of(F.col("title")).alias("namespace"), "text", redirect_target(F.col("text")).isNotNull().alias("is_redirect"), redirect_target(F.col("text")).alias("redirect_target"),
        sync_hash(F.col("text")).alias("hash"), "bytes", variant_base(F.col("title")).alias("base"), variant_language(F.col("title")).alias("language"),
    )


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a header; quoted fields may hold commas, doubled quotes and line ends; blank rows are dropped."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8").dropna(how="all")


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """The objects of an array as maps of strings: null is empty, other values are their JSON text."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("row")).select(F.transform_values("row", lambda _, v: F.coalesce(v, F.lit(""))).alias("row"))


def import_plan(rows: DataFrame, existing: DataFrame, mode: str = "upsert") -> DataFrame:
    """title, content, action: create, update, skip, or error where there is no title. mode: create, update or upsert."""
    if mode not in ("create", "update", "upsert"):
        raise ValueError(f"no such mode: {mode}")
    known = existing.select(title_key(F.col("title")).alias("key")).distinct().withColumn("there", F.lit(True))
    told = rows.withColumn("key", title_key(F.col("title"))).join(known, "key", "left")
    there = F.coalesce("there", F.lit(False))
    action = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "error").when(there & F.lit(mode == "create"), "skip").when(~there & F.lit(mode == "update"), "skip").when(there, "update").otherwise("create")
    return told.select("title", "content", action.alias("action"))


def row_page(row: Column, template: str) -> Column:
    """A map as a call of a template, keys in order; values that hold a pipe or closing braces stand in nowiki."""
    safe = lambda v: F.when(v.contains("|") | v.contains("}}"), F.concat(F.lit("<nowiki>"), v, F.lit("</nowiki>"))).otherwise(v)
    lines = F.transform(F.array_sort(F.map_entries(row)), lambda e: F.concat(F.lit("|"), e.key, F.lit("="), safe(e.value)))
    return F.concat(F.lit("{{" + template + "\n"), F.array_join(lines, "\n"), F.lit("\n}}"))


BUNDLE = """schema_version int, generated_at_unix long, source string, extensions array<struct<extension_name:string, source_wiki:string, version:string, pages:array<struct<page_title:string, local_path:string, content:string>>>>,
technical array<struct<doc_type:string, pages:array<struct<page_title:string, local_path:string, content:string>>>>"""


def docs_bundle(spark: SparkSession, path: str) -> DataFrame:
    """corpus, kind, page, text of a documentation bundle (schema version 1; others give no rows)."""
    b = spark.read.schema(BUNDLE).json(path, multiLine=True).filter("schema_version = 1")
    a = b.select(F.explode("extensions").alias("x")).select(F.concat(F.lit("extension:"), "x.extension_name").alias("corpus"), F.lit("extension").alias("kind"), F.explode("x.pages").alias("p"))
    t = b.select(F.explode("technical").alias("x")).select(F.concat(F.lit("technical:"), "x.doc_type").alias("corpus"), F.lit("technical").alias("kind"), F.explode("x.pages").alias("p"))
    return a.unionByName(t).select("corpus", "kind", F.col("p.page_title").alias("page"), F.col("p.content").alias("text"))


def replace_corpora(pages: DataFrame, target: str) -> None:
    """Write pages by corpus; corpora in `pages` replace their old versions, others stay."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus").parquet(target)
