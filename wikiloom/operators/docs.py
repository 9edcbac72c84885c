"""Documentation corpora: search over tiers, contexts under a token budget, catalogue, refresh and removal."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.functions.text import ascii_lower, byte_token_estimate
from wikiloom.operators.search import ranked, tokens
from wikiloom.staging import small

# Base weight of a tier's hits, and what its fields weigh.
TIERS = {"page": (70, {"title": 8.0, "text": 2.0}), "section": (90, {"title": 7.0, "text": 1.0}), "symbol": (120, {"title": 7.0, "text": 2.0}), "example": (80, {"title": 5.0, "text": 2.0})}
# Bonus of the first hit, its fall by rank, its least.
FIRST, FALL, LEAST = 60, 4, 8


def tier_hits(queries: DataFrame, rows: DataFrame, tier: str, most: int = 20) -> DataFrame:
    """query, tier, page, place, weight: rows (page, place, title, text) of one tier by weighted BM25, then rescored."""
    base, fields = TIERS[tier]
    keyed = rows.withColumn("key", F.struct("page", "place"))
    asked = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    best = ranked(asked, keyed, "key", fields, most, 4).select("query", F.col("row.page").alias("page"), F.col("row.place").alias("place"), (F.col("rank") - 1).alias("rank"))
    told = best.join(rows.select("page", "place", "title"), ["page", "place"]).join(small(queries.select("query", F.col("text").alias("q"))), "query")
    t, q = ascii_lower(F.col("title")), ascii_lower(F.col("q"))
    bonus = F.when(t == q, 80).when(F.startswith(t, q), 40).when(F.contains(t, q), 20).otherwise(0)
    weight = F.lit(base) + F.greatest(F.lit(FIRST) - FALL * F.col("rank"), F.lit(LEAST)) + bonus
    return told.select("query", F.lit(tier).alias("tier"), "page", "place", "title", weight.cast("long").alias("weight"))


def search_docs(queries: DataFrame, tiers: dict[str, DataFrame], most: int = 10) -> DataFrame:
    """query, tier, page, place, title, weight, rank over all tiers."""
    every = None
    for name, rows in tiers.items():
        hits = tier_hits(queries, rows, name)
        every = hits if every is None else every.unionByName(hits)
    at = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("weight"), "title", "page", "tier", "place"))
    return every.withColumn("rank", at).filter(F.col("rank") <= most)


def docs_context(hits: DataFrame, texts: DataFrame, budget: int) -> DataFrame:
    """query, tier, page, place, tokens, cut: hits (of search_docs) taken in order of symbols, sections, examples, pages;
    what doesn't fit is cut (sections, examples) to the words that do, else skipped. A query's hits are few."""
    order = F.when(F.col("tier") == "symbol", 0).when(F.col("tier") == "section", 1).when(F.col("tier") == "example", 2).otherwise(3)
    rows = hits.join(texts.select("page", "place", "text"), ["page", "place"]).select("query", "tier", "page", "place", "rank", order.alias("ord"), byte_token_estimate(F.col("text")).alias("tokens"))

    def take(g: pd.DataFrame) -> pd.DataFrame:
        left, out = budget, []
        for r in g.sort_values(["ord", "rank"]).itertuples(index=False):
            if r.tokens <= left:
                out.append((r.query, r.tier, r.page, r.place, r.tokens, False))
            elif r.tier in ("section", "example") and left > 0:
                out.append((r.query, r.tier, r.page, r.place, left, True))
            else:
                continue
            left -= out[-1][4]
        return pd.DataFrame(out, columns=["query", "tier", "page", "place", "tokens", "cut"])

    kinds = dict(rows.dtypes)
    return rows.groupBy("query").applyInPandas(take, f"query {kinds['query']}, tier string, page {kinds['page']}, place {kinds['place']}, tokens long, cut boolean")


def catalogue(pages: DataFrame) -> DataFrame:
    """kind, corpora, pages, characters of pages (corpus, kind, page, text)."""
    return pages.groupBy("kind").agg(F.count_distinct("corpus").alias("corpora"), F.count("*").alias("pages"), F.sum(F.char_length("text")).alias("characters"))


def outdated(corpora: DataFrame, now: int) -> DataFrame:
    """Corpora (corpus, profile, kind, expires) past their time; extensions that a due profile refreshes are left out."""
    due = corpora.filter(F.col("expires") <= now)
    profiles = due.filter("kind = 'profile'").select("profile").distinct()
    return due.filter("kind = 'profile'").unionByName(due.filter("kind <> 'profile'").join(profiles, "profile", "left_anti").select(*due.columns))


def without(pages: DataFrame, key: str) -> DataFrame:
    """pages less what key names: the first of kind, corpus and page that names any."""
    tried = [F.col("kind") == key, F.col("corpus").isin(key, f"corpus:{key}"), F.col("page") == key]
    hit = pages.agg(*[F.max(t.cast("int")).alias(f"t{i}") for i, t in enumerate(tried)]).first()
    first = next((i for i in range(3) if hit[i]), None)
    return pages if first is None else pages.filter(~F.coalesce(tried[first], F.lit(False)))
