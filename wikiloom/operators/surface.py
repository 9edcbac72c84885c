"""What articles use of the wiki, by kind: templates, modules, parser functions, extension tags and stylesheets, against what it has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.functions.text import ascii_lower, canonical_title, namespace_of, normal_spaces, template_title
from wikiloom.operators.artifacts import artifacts, masked

KINDS = ("template", "module", "function", "tag", "asset")


def uses(pages: DataFrame, id_col: str = "title", text_col: str = "text") -> DataFrame:
    """page, kind, name: each use of a text, from one pass over it: calls by what they begin with, tags as they open, stylesheets by
    their source (in the template namespace where it names none)."""
    rows = artifacts(pages, id_col, text_col, ("calls",)).select(F.col("title").alias("page"), F.transform("calls", lambda c: c["name"]).alias("names"))
    module = lambda n: F.concat(F.lit("Module:"), normal_spaces(F.regexp_replace(F.regexp_replace(n, r"(?i)\A#invoke:", ""), r"(?i)\A\s*module:", "")))
    of = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))

    def called(n):
        low = ascii_lower(n)
        return F.when(low.startswith("#invoke:"), of("module", module(n))).when(low.startswith("#"), of("function", F.regexp_extract(low, r"\A(#[^:\s]*)", 1))).otherwise(of("template", template_title(n)))

    calls = rows.select("page", F.explode(F.transform("names", called)).alias("x"))
    text = masked(F.col(text_col))
    src = F.regexp_extract_all(text, F.lit(r"""(?i)<templatestyles\b[^>]*?\bsrc\s*=\s*["']?([^"'>]+?)["']?\s*/?>"""), F.lit(1))
    asset = lambda s: canonical_title(F.when(namespace_of(s) == "Main", F.concat(F.lit("Template:"), s)).otherwise(s))
    tags = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)<([a-z][a-z0-9]*)\b"), F.lit(1)), lambda t: of("tag", ascii_lower(t)))
    other = pages.select(F.col(id_col).alias("page"), F.explode(F.concat(tags, F.transform(src, lambda s: of("asset", asset(s))))).alias("x"))
    return calls.unionByName(other).select("page", "x.kind", "x.name").filter("name is not null and name <> ''")


def surface(used: DataFrame, known: DataFrame, most: int = 12) -> DataFrame:
    """kind, rank, name, uses, pages, known: the most used names of each kind, and rank 0 (name null) for all of the kind together.

    Numbers of names and of kinds come from one grouping, so a page counts once for its kind however much it uses. known: kind,
    name, in either case of A-Z; what the wiki has and nobody uses stands behind what is used.
    """
    both = used.select("kind", "name", "page", F.lit(1).alias("n")).unionByName(known.select("kind", "name", F.lit(None).cast(used.schema["page"].dataType).alias("page"), F.lit(0).alias("n")).distinct())
    each = both.withColumn("key", ascii_lower(F.col("name"))).groupingSets([("kind", "key"), ("kind",)], "kind", "key").agg(
        F.grouping("key").alias("all"), F.coalesce(F.min(F.when(F.col("n") == 1, F.col("name"))), F.min("name")).alias("name"), F.sum("n").cast("long").alias("uses"), F.count_distinct("page").alias("pages"), (F.min("n") == 0).alias("known")
    )
    at = F.row_number().over(Window.partitionBy("kind", "all").orderBy(F.desc("uses"), F.desc("pages"), "name"))
    ranked = each.withColumn("rank", F.when(F.col("all") == 1, 0).otherwise(at)).filter(F.col("rank") <= most)
    return ranked.select("kind", "rank", F.when(F.col("rank") > 0, F.col("name")).alias("name"), "uses", "pages", F.when(F.col("rank") > 0, F.col("known")).alias("known"))
