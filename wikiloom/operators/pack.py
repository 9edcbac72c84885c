"""The knowledge pack: what an author should see of a topic, many lanes under one shared budget of tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.functions.text import token_estimate
from wikiloom.operators.links import first_per_group

#: Lanes in order of priority, and how many items each has at most.
LIMITS = {"related": 8, "passages": 12, "templates": 6, "links": 10, "categories": 5, "references": 6}
#: What a page that the topic links to adds, and one that links to it.
LINKED, LINKING = 160, 120


def related_pages(topics: DataFrame, links: DataFrame, pages: DataFrame, most: int = LIMITS["related"]) -> DataFrame:
    """query, page, score, rank: articles that a topic (query, title) links to or that link to it; each link counts once."""
    near = topics.join(links.select(F.col("source").alias("title"), F.col("target").alias("page")).distinct(), "title").select("query", "title", "page", F.lit(LINKED).alias("w"))
    far = topics.join(links.select(F.col("target").alias("title"), F.col("source").alias("page")).distinct(), "title").select("query", "title", "page", F.lit(LINKING).alias("w"))
    known = pages.filter("namespace = 'Main' and not is_redirect").select(F.col("title").alias("page"))
    summed = near.unionByName(far).filter("page <> title").groupBy("query", "page").agg(F.sum("w").cast("long").alias("score")).join(known, "page", "left_semi")
    return first_per_group(summed, ["query"], [F.desc("score"), F.asc("page")], most).select("query", "page", "score", F.col("place").alias("rank"))


def lanes(topics: DataFrame, related: DataFrame, pages: DataFrame, links: DataFrame, members: DataFrame, invocations: DataFrame, citations: DataFrame, passages: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """query, lane, rank, item, tokens: of a topic's related pages their summaries, passages (page, place, text, tokens; two a
    page), templates (by pages that call them), links and categories (by pages that have them; not what the topic links to
    already) and domains of citations (by how many)."""
    limits = LIMITS | (limits or {})
    mine = related.select("query", "page")
    own = topics.join(links.select(F.col("source").alias("title"), F.col("target").alias("item")).distinct(), "title").select("query", "item").unionByName(topics.select("query", F.col("title").alias("item")))

    def ranked(rows: DataFrame, lane: str, cost: Column) -> DataFrame:
        return first_per_group(rows, ["query"], [F.desc("n"), F.asc("item")], limits[lane]).select("query", F.lit(lane).alias("lane"), F.col("place").alias("rank"), "item", cost.cast("long").alias("tokens"))

    by_pages = lambda rows: rows.groupBy("query", "item").agg(F.count_distinct("page").alias("n"))
    about = related.join(pages.select(F.col("title").alias("page"), "name"), "page").select("query", F.lit("related").alias("lane"), "rank", F.col("page").alias("item"), (token_estimate(F.col("page")) + token_estimate(F.col("name"))).alias("tokens"))
    said = first_per_group(mine.join(passages, "page"), ["query", "page"], [F.asc("at"), F.asc("text"), F.asc("cost")], 2).withColumnRenamed("place", "turn")
    said = first_per_group(said, ["query"], [F.asc("turn"), F.asc("page"), F.asc("at"), F.asc("text"), F.asc("cost")], limits["passages"]).select("query", F.lit("passages").alias("lane"), F.col("place").alias("rank"), F.concat("page", F.lit(": "), "text").alias("item"), F.col("cost").cast("long").alias("tokens"))
    used = by_pages(mine.join(invocations.select("page", F.col("template").alias("item")), "page"))
    linked = by_pages(mine.join(links.select(F.col("source").alias("page"), F.col("target").alias("item")), "page")).join(own, ["query", "item"], "left_anti")
    filed = by_pages(mine.join(members.select(F.col("source").alias("page"), F.col("target").alias("item")), "page"))
    cited = mine.join(citations.select("page", F.col("domain").alias("item")), "page").groupBy("query", "item").agg(F.count("*").alias("n"))
    cost = token_estimate(F.col("item"))
    out = about.unionByName(said)
    for rows, lane in ((used, "templates"), (linked, "links"), (filed, "categories"), (cited, "references")):
        out = out.unionByName(ranked(rows, lane, cost))
    return out


def packed(rows: DataFrame, budget: int) -> DataFrame:
    """query, turn, lane, rank, item, tokens, kept, used: items taken one after the other while the budget lasts.

    The first item of each lane comes before all others, in order of priority, so that no lane starves; then the lanes follow
    whole. What doesn't fit is left out and the next tried; used is what is spent up to and with an item.
    """
    order = list(LIMITS)
    kinds = dict(rows.dtypes)

    def take(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(p=g["lane"].map(order.index), late=g["rank"] > 1).sort_values(["late", "p", "rank"])
        used, kept, spent = 0, [], []
        for t in g["tokens"].tolist():
            fits = used + t <= budget
            used += t * fits
            kept.append(fits)
            spent.append(used)
        return g.assign(turn=range(1, len(g) + 1), kept=kept, used=spent)[["query", "turn", "lane", "rank", "item", "tokens", "kept", "used"]]

    return rows.groupBy("query").applyInPandas(take, f"query {kinds['query']}, turn int, lane string, rank int, item string, tokens long, kept boolean, used long")


def totals(pack: DataFrame) -> DataFrame:
    """query, lane (`all` for their sum), items, kept, tokens (of what is kept), left_out (tokens): sums of a pack by one grouping."""
    n = pack.rollup("query", "lane").agg(F.grouping_id().alias("g"), F.count("*").alias("items"), F.count_if("kept").alias("kept"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("tokens"))), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(~F.col("kept"), F.col("tokens"))), F.lit(0)).alias("left_out"))
    return n.filter("g < 3").select("query", F.when(F.col("g") == 1, "all").otherwise(F.col("lane")).alias("lane"), "items", "kept", "tokens", "left_out")
