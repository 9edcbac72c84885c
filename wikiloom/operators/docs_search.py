"""Search over documentation in four tiers (pages, sections, symbols, examples), and what a draft asks of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.functions.text import ascii_lower, byte_token_estimate, normal_spaces, retrieval_key
from wikiloom.operators.docs_parse import docs_examples, docs_sections, docs_symbols
from wikiloom.operators.links import first_per_group
from wikiloom.operators.search import B, K1, containing, match_any, postings, tokens
from wikiloom.staging import small, staged

# For each tier its base weight, the bonus of its first hit (less FALL by rank, LEAST at the least), what its fields
# weigh in BM25, how many of its hits are rescored for each that is wanted, and bonuses: the key of the title is that of the query,
# the title is the query, and fields that hold it.
TIERS = {
    "page": (70, 64, {"title": 8.0, "alias": 6.0, "summary": 2.0, "text": 1.5}, 2, 120, 90, {"alias": 50, "summary": 35, "text": 25}),
    "section": (90, 58, {"page": 7.0, "title": 7.0, "summary": 2.0, "text": 1.0}, 2, 110, 0, {"title": 60, "summary": 35, "text": 20}),
    "symbol": (120, 72, {"page": 7.0, "kind": 6.0, "title": 8.0, "alias": 5.0, "text": 1.0}, 3, 140, 100, {"alias": 65, "summary": 40, "text": 25}),
    "example": (80, 54, {"page": 5.0, "title": 5.0, "kind": 2.0, "text": 2.0}, 2, 0, 0, {"summary": 40, "title": 40, "text": 25}),
}
FALL, LEAST = 4, 8
COLUMNS = ["page", "place", "kind", "title", "alias", "summary", "text"]
# Queries that a draft makes, and how many rows of a tier the bridge shows.
MOST_QUERIES = 4
SHOWN = {"page": 8, "section": 12, "symbol": 12, "example": 8}
EVERYWHERE = ["ref", "references", "nowiki", "pre", "includeonly", "noinclude", "onlyinclude"]


def tiers_of(pages: DataFrame) -> dict[str, DataFrame]:
    """The rows of all four tiers of documentation pages (title, text), with COLUMNS: what each is called, also called, and says."""
    none = F.lit("")
    cut = staged(docs_sections(pages), "docs-cut")
    lead = cut.filter("heading is null").select(F.col("page").alias("p"), F.col("text").alias("lead"))
    whole = cut.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x.text), " ").alias("text"), F.first("kind").alias("kind"))
    short = F.regexp_replace("page", r"\A[^:]*:", "")
    page = whole.join(lead, F.col("page") == F.col("p"), "left").select("page", F.lit(0).alias("place"), "kind", F.col("page").alias("title"), short.alias("alias"), F.coalesce("lead", none).alias("summary"), "text")
    section = cut.select("page", "place", "kind", F.coalesce("heading", "page").alias("title"), F.coalesce("path", none).alias("alias"), F.substring_index("text", ". ", 1).alias("summary"), "text")
    at = F.row_number().over(Window.partitionBy("page").orderBy("kind", "name")) - 1
    symbol = docs_symbols(pages).select("page", at.cast("int").alias("place"), "kind", F.col("name").alias("title"), F.regexp_replace("name", r"\A[$#]+", "").alias("alias"), none.alias("summary"), F.concat_ws(" ", "kind", "name", "page").alias("text"))
    example = docs_examples(pages).select("page", "place", F.col("language").alias("kind"), F.lit("").alias("title"), none.alias("alias"), F.col("language").alias("summary"), "text")
    return {n: staged(t.select(COLUMNS), f"docs-{n}") for n, t in (("page", page), ("section", section), ("symbol", symbol), ("example", example))}


def _of(tier: Column, values: dict) -> Column:
    """What `values` has for the tier that a row belongs to."""
    out = None
    for name, value in values.items():
        out = F.when(tier == name, value) if out is None else out.when(tier == name, value)
    return out


def _scored(asked: DataFrame, posts: DataFrame) -> DataFrame:
    """query, row, score: BM25 as in search.bm25(), with the numbers of each row's own tier; terms name their tier already."""
    totals = posts.groupBy("row").agg(F.first("length").alias("length")).groupBy(F.col("row.tier").alias("tier")).agg(F.count("*").alias("n_rows"), F.avg("length").alias("mean_length"))
    near = posts.join(small(asked.select("term").distinct()), "term", "left_semi").select("row", "term", "tf", "length")
    df = near.groupBy("term").agg(F.count("*").alias("df"))
    told = near.join(df, "term").withColumn("tier", F.col("row.tier")).join(F.broadcast(totals), "tier").join(small(asked.select("query", "term").distinct()), "term")
    idf = F.log((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return told.groupBy("query", "row").agg(F.round(F.sum(part), 4).alias("score"))


def hits(queries: DataFrame, tiers: dict[str, DataFrame], most: int) -> DataFrame:
    """query, tier, page, place, title, weight: in each tier the rows that hold a query (query, text) as a phrase or words that
    begin with each of its words, by weighted BM25; rows whose fields contain it for queries that find none so; rescored by
    place and fields.

    All tiers are searched in one pass: terms and queries carry the tier, so that numbers of rows stay apart.
    """
    rows = posts = None
    for name, t in tiers.items():
        one = t.withColumn("row", F.struct(F.lit(name).alias("tier"), "page", "place"))
        post = postings(one, "row", TIERS[name][2]).withColumn("term", F.concat(F.lit(f"{name}:"), "term"))
        rows, posts = (one, post) if rows is None else (rows.unionByName(one), posts.unionByName(post))
    posts = staged(posts, "postings-docs")
    tier = F.col("row.tier")
    each = queries.select("query", "text", F.explode(F.array(*map(F.lit, tiers))).alias("tier"))
    asked = each.select(F.struct("query", "tier").alias("query"), "tier", F.posexplode(tokens(F.col("text"))).alias("ord", "term")).withColumn("term", F.concat("tier", F.lit(":"), "term")).drop("tier")
    limits = {n: most * TIERS[n][3] for n in tiers}
    scored = match_any(asked, posts).join(_scored(asked, posts), ["query", "row"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "row.page", "row.place")
    ranked = scored.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < _of(tier, limits))
    ranked = staged(ranked.select("query.query", "row", "rank", F.greatest(_of(tier, {n: TIERS[n][1] for n in tiers}) - FALL * F.col("rank"), F.lit(LEAST)).alias("bonus")), "docs-ranked")
    found = ranked.select("query", F.col("row.tier").alias("tier")).distinct()
    lost = each.select("query", F.col("tier").alias("wanted"), ascii_lower(normal_spaces(F.col("text"))).alias("q")).join(found.withColumnRenamed("tier", "wanted"), ["query", "wanted"], "left_anti")
    every = F.concat_ws("\n", *(ascii_lower(F.col(c)) for c in ("title", "alias", "summary", "text")))
    like = containing(rows, every, lost, F.col("q")).filter(tier == F.col("wanted")).select("query", "wanted", "row")
    at = Window.partitionBy("query", "wanted").orderBy("row.page", "row.place")
    like = like.withColumn("rank", F.row_number().over(at) - 1).filter(F.col("rank") < _of(F.col("wanted"), limits)).select("query", "row", "rank", F.lit(0).alias("bonus"))
    told = ranked.unionByName(like).join(rows, "row").join(small(queries.select("query", F.col("text").alias("asked"))), "query")
    q = ascii_lower(normal_spaces(F.col("asked")))
    same_key, same_name = retrieval_key(F.col("title")) == retrieval_key(F.col("asked")), ascii_lower(F.col("title")) == q

    def weight(base: int, key: int, name: int, parts: dict) -> Column:
        out = F.lit(base) + F.when(same_key, key).otherwise(0) + F.when(same_name, name).otherwise(0)
        for field, bonus in parts.items():
            out = out + F.when(F.contains(ascii_lower(F.col(field)), q), bonus).otherwise(0)
        return out

    total = _of(tier, {n: weight(t[0], t[4], t[5], t[6]) for n, t in TIERS.items() if n in tiers})
    return told.select("query", tier.alias("tier"), "page", "place", "title", (total + F.col("bonus")).cast("long").alias("weight"))


def search(queries: DataFrame, tiers: dict[str, DataFrame], most: int = 10, scope: tuple[str, ...] = tuple(TIERS)) -> DataFrame:
    """query, rank, tier, page, place, title, weight: the best `most` hits of a query (query, text) over the tiers of `scope`.
    Queries without text find nothing."""
    every = hits(queries.filter(F.trim("text") != ""), {n: tiers[n] for n in scope}, most)
    at = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("weight"), "title", "page", "tier", "place"))
    return every.withColumn("rank", at).filter(F.col("rank") <= most).select("query", "rank", "tier", "page", "place", "title", "weight")


def draft_queries(drafts: DataFrame, templates: DataFrame, functions: list[str] | None = None, tags: list[str] | None = None, most: int = MOST_QUERIES) -> DataFrame:
    """topic, turn, text: what drafts (topic, text) ask of the documentation, the first `most` of each.

    Parser functions that a draft calls come first, then extension tags (of `tags`, but for those every article has), then
    templates that it calls (topic, template, ord) and, where there are any, `template parameters`. functions: those the
    wiki has, if that is known. Each query once, in either case.
    """
    called = F.transform(F.regexp_extract_all("text", F.lit(r"\{\{#([A-Za-z0-9_-]+):"), F.lit(1)), lambda x: ascii_lower(x))
    opened = F.transform(F.regexp_extract_all("text", F.lit(r"<([A-Za-z0-9_-]+)(?=[ \t\r\n>/])"), F.lit(1)), lambda x: ascii_lower(x))
    if functions:
        called = F.filter(called, lambda x: x.isin([f.lower().lstrip("#") for f in functions]))
    opened = F.filter(opened, lambda x: x.isin([t.lower() for t in tags or [] if t.lower() not in EVERYWHERE]))
    told = lambda part, found, what: F.transform(found, lambda x, i: F.struct(F.lit(part).alias("part"), i.cast("long").alias("ord"), F.concat(x, F.lit(what)).alias("text")))
    name = normal_spaces(F.translate(F.regexp_replace("template", r"\A[^:]*:", ""), "_", " "))
    both = F.array(F.struct(F.lit(2).alias("part"), F.col("ord").cast("long").alias("ord"), name.alias("text")), F.struct(F.lit(3).alias("part"), F.lit(0).cast("long").alias("ord"), F.lit("template parameters").alias("text")))
    # drafts and templates are read once each
    every = drafts.select("topic", F.inline(F.concat(told(0, called, " parser function"), told(1, opened, " extension tag")))).unionByName(templates.select("topic", F.inline(both))).filter("text <> ''")
    once = every.groupBy("topic", ascii_lower(F.col("text")).alias("k")).agg(F.min(F.struct("part", "ord", "text")).alias("x"))
    return first_per_group(once, ["topic"], [F.asc("x")], most).select("topic", F.col("place").alias("turn"), "x.text")


def bridge(asked: DataFrame, tiers: dict[str, DataFrame], each: int = 4) -> DataFrame:
    """topic, tier, rank, page, place, title, weight, turn, tokens: hits of all queries of a topic (topic, turn, text), each row once.

    The distinct texts are searched once, however many topics ask them. Of a row that several queries of a topic find, the
    first query's hit counts; then each tier is sorted again by weight and cut to SHOWN. What is asked is written, as each step
    of the search reads it again.
    """
    asked = staged(asked.select("topic", "turn", "text"), "docs-asked")
    texts = staged(asked.select("text").distinct(), "docs-texts")
    got = search(texts.select(F.col("text").alias("query"), "text"), tiers, each)
    found = asked.join(got.withColumnRenamed("query", "text"), "text").select("topic", "turn", "tier", "page", "place", "title", "weight")
    first = found.groupBy("topic", "tier", "page", "place").agg(F.min(F.struct("turn", "title", "weight")).alias("x")).select("topic", "tier", "page", "place", "x.*")
    at = F.row_number().over(Window.partitionBy("topic", "tier").orderBy(F.desc("weight"), "title", "page", "place"))
    shown = first.withColumn("rank", at).join(F.broadcast(_shown(asked)), "tier").filter(F.col("rank") <= F.col("most"))
    said = None
    for name, rows in tiers.items():
        one = rows.select(F.lit(name).alias("tier"), "page", "place", F.greatest(byte_token_estimate(F.col("text")), F.lit(1)).alias("tokens"))
        said = one if said is None else said.unionByName(one)
    return shown.join(said, ["tier", "page", "place"]).select("topic", "tier", "rank", "page", "place", "title", "weight", "turn", "tokens")


def _shown(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(list(SHOWN.items()), "tier string, most int")
