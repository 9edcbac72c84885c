"""Support for writing: evidence coverage, section skeletons, comparable pages, and scored contracts under a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.functions.text import ascii_lower, coverage_terms
from wikiloom.operators.links import first_per_group
from wikiloom.operators.search import containing

# What a term's first match in a field adds, and the most that use adds.
FIELDS = {"title": 150, "category": 90, "summary": 70, "keys": 48}
MOST_USE = 60


def coverage(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """query, terms, covered, missing (comma-joined): terms of the query that its evidence (query, text) holds."""
    held = evidence.select("query", F.explode(coverage_terms(F.col("text"))).alias("term")).distinct()
    need = queries.select("query", F.explode(coverage_terms(F.col("text"))).alias("term")).distinct()
    told = need.join(held.withColumn("have", F.lit(1)), ["query", "term"], "left")
    return told.groupBy("query").agg(F.count("*").alias("terms"), F.count("have").alias("covered"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("have").isNull(), F.col("term")))), ",").alias("missing"))


def section_skeleton(headings: DataFrame, most: int = 8, least_pages: int = 2) -> DataFrame:
    """topic, heading, pages, rank: headings (topic, page_rank, place, heading) that enough pages have (one, where a topic
    has one page), in the order in which the best page that has them brings them."""
    n = headings.groupBy("topic").agg(F.count_distinct("page_rank").alias("n"))
    found = headings.groupBy("topic", ascii_lower(F.col("heading")).alias("heading")).agg(F.count_distinct("page_rank").alias("pages"), F.min(F.struct("page_rank", "place")).alias("first"))
    kept = found.join(n, "topic").filter((F.col("pages") >= least_pages) | (F.col("n") == 1))
    return first_per_group(kept, ["topic"], [F.asc("first"), F.asc("heading")], most).select("topic", "heading", "pages", F.col("place").cast("long").alias("rank"))


def comparable_pages(lanes: DataFrame, most: int) -> DataFrame:
    """query, page, score, sources, rank: lanes (query, page, lane, weight) summed; sources joined by `+`."""
    summed = lanes.groupBy("query", "page").agg(F.sum("weight").alias("score"), F.array_join(F.array_sort(F.collect_set("lane")), "+").alias("sources"))
    at = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "page"))
    return summed.withColumn("rank", at).filter(F.col("rank") <= most)


def contract_scores(terms: DataFrame, contracts: DataFrame) -> DataFrame:
    """query, contract, score: each term (query, term) counts in the first field that holds it; and use."""
    low = {f: ascii_lower(F.col(f)) for f in FIELDS}
    hit = F.coalesce(*[F.when(F.contains(low[f], F.col("term")), w) for f, w in FIELDS.items()])
    every = low["title"]
    for f in list(FIELDS)[1:]:
        every = F.concat_ws(" ", every, low[f])
    near = containing(contracts, every, terms.select("query", "term"), F.col("term"))
    told = near.withColumn("hit", hit).filter("hit is not null").groupBy("query", "contract").agg(F.sum("hit").alias("score"), F.max("uses").alias("uses"))
    return told.select("query", "contract", (F.col("score") + F.least("uses", F.lit(MOST_USE))).cast("long").alias("score"))


def contract_plan(scored: DataFrame, contracts: DataFrame, limit: int, budget: int, candidates: int = 256) -> DataFrame:
    """query, contract, score, tokens, chosen, reason: by score until `limit`; what passes the budget is left out, not the end."""
    best = first_per_group(scored, ["query"], [F.desc("score"), F.asc("contract")], candidates).join(contracts.select("contract", "tokens"), "contract").select("query", "contract", "score", "tokens", "place")

    def take(g: pd.DataFrame) -> pd.DataFrame:
        used, n, out = 0, 0, []
        for r in g.sort_values("place").itertuples(index=False):
            fits = n < limit and used + r.tokens <= budget
            out.append((r.query, r.contract, r.score, r.tokens, fits, "" if fits else "limit" if n >= limit else "budget"))
            used, n = used + r.tokens * fits, n + fits
        return pd.DataFrame(out, columns=["query", "contract", "score", "tokens", "chosen", "reason"])

    kinds = dict(best.dtypes)
    return best.groupBy("query").applyInPandas(take, f"query {kinds['query']}, contract {kinds['contract']}, score long, tokens long, chosen boolean, reason string")


def touching_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges (source, target, relation) of which either end is among keys (key)."""
    a = edges.join(keys.select(F.col("key").alias("source")), "source", "left_semi").select(*edges.columns)
    b = edges.join(keys.select(F.col("key").alias("target")), "target", "left_semi").select(*edges.columns)
    return a.unionByName(b).distinct()
