"""Passages of one page: an index that is clustered by page, so that a page's reader opens the part that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikiloom.functions.text import lexical_terms
from wikiloom.operators.links import within_budget
from wikiloom.staging import small, staged

#: Bytes of a row group of the index.
GROUP_BYTES = 1 << 20


def write_index(passages: DataFrame, path: str, clustered: bool = False) -> None:
    """passages (page, place, text, tokens, and more) written in order of page and place, in small row groups with their bounds.

    clustered: they are dealt by ranges of pages already. Ranges are found in a pass of its own, so what makes passages from
    pages should follow that, not run twice.
    """
    ordered = (passages if clustered else passages.repartitionByRange(F.col("page"), F.col("place"))).sortWithinPartitions("page", "place")
    ordered.write.option("parquet.block.size", GROUP_BYTES).parquet(path)


def of_page(spark: SparkSession, path: str, page: str, text: str, limit: int, budget: int) -> DataFrame:
    """place, text, tokens, chosen: passages of a page that hold all words of a query, in their order, under limit and budget of
    tokens (the first that fits stays in any case). The page is a filter of the scan; a query without words finds nothing."""
    held = spark.read.parquet(path).filter(F.col("page") == page)
    return within(held, spark.range(1).select(F.lit(0).alias("query"), F.lit(page).alias("page"), F.lit(text).alias("asked")), limit, budget).drop("query", "page")


def within(index: DataFrame, asked: DataFrame, limit: int, budget: int) -> DataFrame:
    """query, page, place, text, tokens, chosen: the same for many queries (query, page, asked), each in its own page."""
    want = staged(asked.select("query", "page", F.explode_outer(F.array(lexical_terms(F.col("asked")))).alias("want")).filter("size(want) > 0"), "page-queries")
    met = index.select("page", "place", "text", "tokens").join(small(want), "page").filter(F.size(F.array_except("want", lexical_terms(F.col("text")))) == 0)
    kept = within_budget(met.withColumnRenamed("place", "at").select("query", "page", "at", "text", "tokens"), ["query", "page"], [F.asc("at")], "tokens", budget, limit)
    return kept.select("query", "page", F.col("at").alias("place"), "text", "tokens", F.col("place").cast("int").alias("chosen"))

